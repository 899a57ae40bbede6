"""Language identification by cross-parsing entropy.

For each language, a suffix automaton holds a bounded sample of its labelled text. A text is parsed against
each automaton: from where a phrase starts, the longest match that the automaton has is a phrase, and the
next one starts at the character where it fails. The phrases per character, times the logarithm of the
sample's length, estimate the cross entropy; the language with the least wins.

Texts are parsed in blocks of BLOCK letters, each starting a phrase, so that many blocks of many texts step
through the automaton together. Its transitions lie in one array, row over row, displaced so that no two
cells meet (a double array): its size goes with the sample, whatever the number of letters, and a step is two
gathers. A letter that the state at hand has no transition for ends the phrase and starts at the root.

Letters are compared in lower case; whatever is no letter counts as one space, runs of it as one. Every letter
of the samples has a code of its own, and every language that has labelled rows can be predicted.

Defined cases: null text, or text without a letter, is `und` with score 0; so is every text if no labelled
row has a letter; rows with null lang teach nothing; ties go to the language that sorts first; every input
row gives one output row, repeated ones and empty tables included; a very long text is parsed whole, and taught
from by pieces from anywhere in it; columns other than doc_id, text and lang, whatever their names, are not read.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import held_out, texts

#: Most pieces of labelled text in the sample of a language, characters of a piece, most pieces of all languages together.
PIECES, PIECE, ALL_PIECES = 64, 500, 1 << 14
BLOCK, BLOCKS, CHARS = 256, 4096, 1 << 21
PAD, SPACE, FIRST = 0, 1, 2


def sample(docs: DataFrame, pieces: int, piece: int) -> dict[str, list[str]]:
    """About `pieces` pieces of each language (at least one, and fewer if there are very many languages), from anywhere in the whole texts that are not held out; the same whenever it is run."""
    known = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null and text is not null").where(~held_out())
    known = known.withColumn("n", F.ceil(F.length("text") / piece).cast("long")).where("n > 0")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not sizes:
        return {}
    pieces = max(1, min(pieces, ALL_PIECES // len(sizes)))
    share = F.element_at(F.create_map(*(F.lit(v) for k, n in sizes.items() for v in (k, min(1.0, pieces / n)))), F.col("lang"))
    chance = lambda k: F.pmod(F.xxhash64("doc_id", k), F.lit(1 << 30))
    taken = known.select("lang", "doc_id", "text", F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda k: chance(k) < share * (1 << 30))).alias("k"))
    cut = taken.select("lang", "doc_id", "k", F.substring("text", (F.col("k") * piece + 1).cast("int"), F.lit(piece)).alias("part"))
    out: dict[str, list[str]] = {}
    for r in sorted(cut.collect(), key=lambda r: (r["lang"], r["doc_id"] or 0, r["k"], r["part"])):
        out.setdefault(r["lang"], []).append(r["part"])
    return {k: v for k, v in out.items() if any(c.isalpha() for p in v for c in p)}


@functools.cache
def letters() -> object:
    """Whether each code point is a letter."""
    import numpy as np

    return np.array([chr(i).isalpha() for i in range(0x110000)])


class Alphabet:
    """Codes of the letters of a sample, of spaces, and one (last) for other letters."""

    def __init__(self, known: str):
        import numpy as np

        self.size = FIRST + len(known) + 1
        self.codes = np.where(letters(), self.size - 1, SPACE).astype(np.int32)
        self.codes[[ord(c) for c in known]] = FIRST + np.arange(len(known))

    def __call__(self, text: str):
        """Codes of the characters of a text."""
        import numpy as np

        return self.codes[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]


def automaton(parts: list, width: int):
    """The suffix automaton of some code arrays: cells, and where each code leads from the root.

    A state is known by its base b; its transition by code c is cell b + c: b in the upper 32 bits, the base of the next
    state in the lower ones. Base 0 is a state without transitions, and where a code leads that the sample lacks.
    """
    import numpy as np

    edges, link, length = [{}], [-1], [0]
    for part in parts:
        last = 0
        for c in part.tolist():
            if c in edges[last] and length[edges[last][c]] == length[last] + 1:
                last = edges[last][c]
                continue
            new, p = len(edges), last
            edges.append({})
            link.append(0)
            length.append(length[last] + 1)
            while p >= 0 and c not in edges[p]:
                edges[p][c] = new
                p = link[p]
            if p >= 0:
                q = edges[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    twin = len(edges)
                    edges.append(dict(edges[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    while p >= 0 and edges[p].get(c) == q:
                        edges[p][c] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            last = new
    base = [0] * len(edges)
    used, bases, free, single = bytearray(2 * width + 2 * sum(map(len, edges))), {0}, width, False
    for state in sorted(range(1, len(edges)), key=lambda s: (-len(edges[s]), s)):
        codes = sorted(edges[state])
        if not codes:
            break
        if len(codes) == 1 and not single:
            free, single = width, True  # from here on every hole will do
        at, tries = free, 0
        while True:
            at = used.find(0, at)
            b = at - codes[0]
            if b + codes[-1] >= len(used) or at < 0:
                used.extend(bytes(len(used)))
                at = max(at, free)
            elif b not in bases and not any(used[b + c] for c in codes):
                break
            else:
                at, tries = at + 1, tries + 1
                if tries % 32 == 0:
                    free = at  # holes before this are left to states with fewer transitions
        if single:
            free = at
        for c in codes:
            used[b + c] = 1
        base[state] = b
        bases.add(b)
    cells = np.zeros(max(base) + width + 1, np.int64)
    for state, out in enumerate(edges):
        if state and out:
            for c, to in out.items():
                cells[base[state] + c] = base[state] << 32 | base[to]
    return cells, np.array([base[edges[0][c]] if c in edges[0] else 0 for c in range(width)], np.int64)


@functools.lru_cache(2)
def models(sampled: tuple):
    """Alphabet, and (automaton, log of the sample's length) per language; once per process."""
    import math

    alphabet = Alphabet("".join(sorted({c for _, parts in sampled for p in parts for c in p.lower() if c.isalpha()})))
    made = []
    for _, parts in sampled:
        coded = [squeezed(alphabet(p.lower())) for p in parts]
        made.append((automaton(coded, alphabet.size), math.log2(max(2, sum(map(len, coded))))))
    return alphabet, made


def squeezed(codes):
    """Codes with runs of spaces as one."""
    import numpy as np

    space = codes == SPACE
    return codes[~(space & np.concatenate(([False], space[:-1])))]


def phrases(table, blocks):
    """Phrases of each column of a (BLOCK, n) array of codes."""
    import numpy as np

    cells, root = table
    state = root[blocks[0]]
    count = np.ones(blocks.shape[1], np.int32)
    for row in blocks[1:]:
        cell = cells[state + row]
        ends = cell >> 32 != state
        ends |= state == 0
        count += ends & (row != PAD)
        state = np.where(ends, root[row], cell & 0xFFFFFFFF)
    return count


def entropies(rows: list[str], alphabet, made):
    """Letters and spaces of each text, whether it has a letter, and phrases x log / length for each language."""
    import numpy as np

    lowered = [t.lower() for t in rows]
    codes = alphabet("".join(lowered))
    doc = np.repeat(np.arange(len(rows)), [len(t) for t in lowered])
    space = codes == SPACE
    keep = ~(space & np.concatenate(([False], space[:-1] & (doc[1:] == doc[:-1])))) if len(codes) else space
    codes, doc = codes[keep], doc[keep]
    sizes = np.bincount(doc, minlength=len(rows))
    has = np.bincount(doc, codes >= FIRST, len(rows)) > 0
    per = -(-sizes // BLOCK)
    owner = np.repeat(np.arange(len(rows)), per)
    begins = np.cumsum(sizes) - sizes
    within = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    starts = begins[owner] + within * BLOCK
    ends = np.minimum(starts + BLOCK, (begins + sizes)[owner])
    total = np.zeros((len(made), len(rows)))
    padded = np.concatenate([codes, np.zeros(BLOCK, np.int32)])
    for at in range(0, len(starts), BLOCKS):
        here = starts[at : at + BLOCKS]
        place = np.arange(BLOCK)[:, None] + here[None, :]
        block = padded[place]
        block[place >= ends[at : at + BLOCKS][None, :]] = PAD
        for k, (table, _) in enumerate(made):
            total[k] += np.bincount(owner[at : at + BLOCKS], phrases(table, block), len(rows))
    logs = np.array([log for _, log in made])[:, None]
    return has, total * logs / np.maximum(sizes, 1)


def identify(docs: DataFrame, pieces: int = PIECES, piece: int = PIECE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; score is how far the runner-up is: its entropy over the sum of the two least."""
    sampled = tuple((k, tuple(v)) for k, v in sorted(sample(docs, pieces, piece).items()))
    names = [k for k, _ in sampled]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        alphabet, made = models(sampled) if sampled else (None, [])

        def judge(some):
            if not made:
                return ["und"] * len(some), [0.0] * len(some)
            has, h = entropies(some, alphabet, made)
            order = np.argsort(h, 0, kind="stable")
            least = np.take_along_axis(h, order[:2], 0)
            score = least[1] / np.maximum(least[0] + least[1], 1e-12) if len(made) > 1 else np.ones(len(some))
            return [names[k] if ok else "und" for k, ok in zip(order[0], has)], np.where(has, score, 0.0).tolist()

        for batch in batches:
            said, scores, some, held = [], [], [], 0
            for text in [*batch.column(2).to_pylist(), False]:
                if text is not False:
                    some.append(text or "")
                    held += len(some[-1])
                if some and (text is False or held >= CHARS):
                    a, b = judge(some)
                    said, scores, some, held = said + a, scores + b, [], 0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(said, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    named = texts(docs).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return named.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
