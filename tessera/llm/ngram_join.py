"""Jaccard self-join on word n-grams by vertical partitioning.

The global order of n-grams (rarer classes first, then by hash) is cut into fragments. Each document is
split into one segment per fragment, and fragments are worked on separately:

1. `shared`: each fragment finds the n-grams that two or more documents have. Only these can count for an
   overlap, so a document with fewer of them than similarity x size links with nothing and goes no further.
2. `candidates`: each fragment lists pairs of documents whose prefixes meet there. A prefix is as long as
   it must be for any two similar documents to share an n-gram of it (prefix filter), less the n-grams
   that no other document has. Two documents may meet at an n-gram only if what each has from there on, in
   the global order, is enough for the overlap that their two sizes ask for (positional filter): for the
   first n-gram that they share, no more can follow.
3. `overlaps`: each fragment counts the overlap of the candidate pairs in its own segments; the partial
   overlaps are summed per pair and compared with the threshold.

Links only matter here as far as they join components, so candidates come in rounds: each prefix n-gram
first pairs its documents with the one that has most left to share (in a group of near copies, the one
nearest to their common source), then with the best of another component, and lastly all documents that are
still in different components. Large groups of near copies are joined in the first rounds by a number of
pairs in proportion to the rows; the last round leaves no pair out. Texts with equal n-gram sets are one
component from the start, and within a task only the first of them is cut into segments.

Rows travel as blocks (arrays of numbers in one binary value) rather than one row per n-gram. An n-gram that
LOCAL documents of a block have goes to its fragment once, with its count, while the documents that have it stay
with the block: an n-gram that every document has is one number per block there. An n-gram is known by at
most 58 bits of its hash, 48 of them within its fragment.

Defined cases: without words or text, a document's set is empty and links with nothing; rows without doc_id
take no part and get a null component; rows that repeat a doc_id are one node (should their texts differ, each
fragment counts the one that fits best; representatives() keeps the text that sorts first); ties of what is left to
share go to the smaller doc_id; an empty table gives no rows; a very long text is one document of a block of its own
size; columns other than doc_id and text, whatever their names, are not read by join() and pass representatives();
every input row gives one output row of join().
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm.common import materialize, packed, raw, scratch, size_in_bytes, texts
from tessera.llm.components import merge

#: Bytes of input per fragment, most fragments (they grow from 8 TB on, to 100 MB at 100 TB), most n-grams in a block, documents of a block from which on an n-gram is counted there, most comparisons at a time.
FRAGMENT_BYTES, MOST_FRAGMENTS, BLOCK, LOCAL, CHUNK = 8 << 20, 1 << 20, 1 << 19, 16, 1 << 22
#: Bits of an n-gram that count in all (above them is its class), and those of them within its fragment at most.
ALL_BITS, OWN_BITS = 58, 48


def fragments_for(docs: DataFrame) -> int:
    """A power of two, so that fragments stay of one size as the input grows."""
    return min(MOST_FRAGMENTS, 1 << max(2, (size_in_bytes(docs) // FRAGMENT_BYTES).bit_length()))


def own_bits(fragments: int) -> int:
    return min(OWN_BITS, ALL_BITS - (fragments.bit_length() - 1))


def tasks_for(fragments: int) -> int:
    """Tasks that work on fragments, or blocks, so that one reads as much on large inputs as on small ones."""
    return max(8, fragments)


def grams(text: bytes | None, n: int):
    """Sorted distinct 64-bit hashes of the word n-grams of a text; a text of fewer words is one n-gram."""
    import numpy as np
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(h) < n:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=len(h))], np.uint64)
    mixed = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):  # a fixed odd multiplier for each place, then a full mix
        mixed ^= mixed >> np.uint64(29)
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i]
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    mixed.sort()
    return mixed[np.concatenate(([True], mixed[1:] != mixed[:-1]))]


def dump(places, codes, extra=None) -> bytes:
    """Non-decreasing 16-bit places and 48-bit codes (and a byte each) as bytes that compress well."""
    import numpy as np

    steps = np.diff(places.astype(np.int32), prepend=0).astype("<u2")
    parts = [np.int64(len(codes)).tobytes(), steps.tobytes(), codes.astype("<u4").tobytes(), (codes >> np.uint64(32)).astype("<u2").tobytes()]
    return b"".join(parts if extra is None else [*parts, extra.astype(np.uint8).tobytes()])


def load(payload: bytes, extra: bool = False):
    """What dump() was given."""
    import numpy as np

    n = int(np.frombuffer(payload, "<i8", 1)[0])
    places = np.cumsum(np.frombuffer(payload, "<u2", n, 8).astype(np.int64))
    codes = np.frombuffer(payload, "<u4", n, 8 + 2 * n).astype(np.uint64) | np.frombuffer(payload, "<u2", n, 8 + 6 * n).astype(np.uint64) << np.uint64(32)
    return (places, codes, np.frombuffer(payload, np.uint8, n, 8 + 8 * n)) if extra else (places, codes)


def frequent(codes):
    """The codes that are there LOCAL times or more, sorted, and for each code which of them it is (-1: none)."""
    import numpy as np

    bucket = (codes & np.uint64((1 << 20) - 1)).astype(np.int64)
    maybe = np.flatnonzero(np.bincount(bucket, minlength=1 << 20)[bucket] >= LOCAL)
    some, inverse, counts = np.unique(codes[maybe], return_inverse=True, return_counts=True)
    often = counts >= LOCAL
    which = np.full(len(codes), -1)
    which[maybe] = np.where(often, np.cumsum(often) - 1, -1)[inverse]
    return some[often], which


CUT = "fragment long, block long, many boolean, payload binary"


def cut(docs: DataFrame, n: int, fragments: int) -> DataFrame:
    """Segments (fragment >= 0) of blocks of documents, and one row per block (fragment < 0) with what is known of its documents.

    many: the segment holds n-grams of many documents of the block, with their counts in place of places.
    """
    bits = own_bits(fragments)
    drop = 64 - bits - (fragments.bit_length() - 1)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash
        from pyspark import TaskContext

        part_id = TaskContext.get().partitionId()
        block = part_id << 24
        seen: set[bytes] = set()
        ids, sizes, signs, places, arrays, held = [], [], [], [], [], 0

        def pieces(codes):
            """(fragment, from, to) of codes that are sorted by fragment."""
            part = (codes >> np.uint64(bits)).astype(np.int64)
            ends = np.flatnonzero(np.diff(part, append=-1)) + 1
            return zip(part[ends - 1].tolist(), [0, *ends[:-1]], ends)

        def flush():
            nonlocal block, held
            rows, mask, many = [], np.uint64((1 << bits) - 1), b""
            if arrays:
                codes = np.concatenate(arrays) >> np.uint64(drop)
                where = np.repeat(np.arange(len(arrays), dtype=np.int64), [len(a) for a in arrays])
                often, which = frequent(codes)
                order = np.argsort(which, kind="stable")[np.count_nonzero(which < 0) :]
                counts = np.bincount(which[order], minlength=len(often))
                many = b"".join((np.int64(len(often)).tobytes(), often.astype("<u8").tobytes(), counts.astype("<i8").tobytes(), where[order].astype("<u2").tobytes()))
                for fragment, a, b in pieces(often):
                    rows.append((fragment, block, True, dump(np.zeros(b - a), often[a:b] & mask) + counts[a:b].astype("<i8").tobytes()))
                codes, where = codes[which < 0], where[which < 0]
                order = np.argsort(codes >> np.uint64(bits), kind="stable")
                codes, where = codes[order], where[order]
                for fragment, a, b in pieces(codes):
                    rows.append((fragment, block, False, dump(where[a:b], codes[a:b] & mask)))
            known = (np.int64(len(ids)).tobytes(), np.array(ids, "<i8").tobytes(), np.array(sizes, "<i8").tobytes(), np.array(places, "<i4").tobytes(), b"".join(signs), many)
            rows.append((-1 - (part_id + block) % fragments, block, False, b"".join(known)))
            block += 1
            held = 0
            for x in (ids, sizes, signs, places, arrays):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.bool_(), pa.binary()))], ["fragment", "block", "many", "payload"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), raw(batch.column(1))):
                got = grams(text, n)
                sign = xxhash.xxh3_128_digest(got.tobytes())
                ids.append(doc_id)
                sizes.append(len(got))
                signs.append(sign)
                if len(got) and sign not in seen:
                    seen.add(sign)
                    places.append(len(arrays))
                    arrays.append(got)
                    held += len(got)
                else:
                    places.append(-1)
                if held >= BLOCK or len(ids) >= 60_000:
                    yield flush()
        if ids:
            yield flush()

    return docs.mapInArrow(run, CUT)


def shared(cuts: DataFrame, fragments: int) -> DataFrame:
    """Of each segment, the n-grams that two or more documents have, with the class of how many have them; rows of blocks pass."""

    def run(key, table):
        import numpy as np
        import pyarrow as pa

        fragment = key[0].as_py()
        if fragment < 0:
            return table
        blocks, many, payloads = (table.column(c).to_pylist() for c in ("block", "many", "payload"))
        loaded = [load(p) for p in payloads]
        codes = np.concatenate([c for _, c in loaded])
        weights = np.concatenate([np.frombuffer(p, "<i8", len(c), 8 + 8 * len(c)) if m else np.ones(len(c), np.int64) for (_, c), m, p in zip(loaded, many, payloads)])
        order = np.argsort(codes, kind="stable")
        ranked = codes[order]
        first = np.concatenate(([True], ranked[1:] != ranked[:-1]))
        per = np.empty(len(codes), np.int64)
        per[order] = np.add.reduceat(weights[order], np.flatnonzero(first))[np.cumsum(first) - 1]
        classes = np.where(per < 16, per, 12 + np.log2(np.maximum(per, 1)).astype(np.int64)).astype(np.uint8)
        out, at = [], 0
        for block, m, (places, own) in zip(blocks, many, loaded):
            kept = np.flatnonzero(per[at : at + len(own)] > 1)
            if len(kept):
                out.append((fragment, block, m, dump(places[kept], own[kept], classes[at : at + len(own)][kept])))
            at += len(own)
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.bool_(), pa.binary()))], names=["fragment", "block", "many", "payload"])

    return cuts.repartition(tasks_for(fragments), "fragment").groupBy("fragment").applyInArrow(run, CUT)


def gathered(parts: DataFrame, percent: int, fragments: int) -> DataFrame:
    """doc_id, n_shingles, sign of every document; codes (in global order, as 64-bit numbers) of those that may link."""
    bits = own_bits(fragments)

    def run(table):
        import numpy as np
        import pyarrow as pa

        table = table.sort_by("fragment")
        fragment, many, payload = (table.column(c).to_pylist() for c in ("fragment", "many", "payload"))
        head = payload[0]  # the only row below fragment 0
        n = int(np.frombuffer(head, "<i8", 1)[0])
        ids, sizes = np.frombuffer(head, "<i8", n, 8), np.frombuffer(head, "<i8", n, 8 + 8 * n)
        places, signs, rest = np.frombuffer(head, "<i4", n, 8 + 16 * n), head[8 + 20 * n : 8 + 36 * n], head[8 + 36 * n :]
        k = int(np.frombuffer(rest, "<i8", 1)[0]) if rest else 0
        if k:
            often, counts, holders = np.frombuffer(rest, "<u8", k, 8), np.frombuffer(rest, "<i8", k, 8 + 8 * k), np.frombuffer(rest, "<u2", -1, 8 + 16 * k)
            begins = np.cumsum(counts) - counts
        codes, where = [], []
        for f, m, p in zip(fragment[1:], many[1:], payload[1:]):
            spots, own, classes = load(p, True)
            full = np.uint64(f << bits) | own
            coded = classes.astype(np.uint64) << np.uint64(ALL_BITS) | full
            if m:
                spot = np.searchsorted(often, full)
                times = counts[spot]
                spots = holders[np.repeat(begins[spot] - np.cumsum(times) + times, times) + np.arange(times.sum())].astype(np.int64)
                coded = np.repeat(coded, times)
            codes.append(coded)
            where.append(spots)
        segments = [None] * n
        if codes:
            codes, where = np.concatenate(codes), np.concatenate(where)
            order = np.lexsort((codes, where))
            codes, where = codes[order], where[order]
            ends = np.searchsorted(where, np.arange(len(places) + 1))
            for i in np.flatnonzero(places >= 0):
                a, b = ends[places[i]], ends[places[i] + 1]
                if 100 * (b - a) >= percent * sizes[i]:
                    segments[i] = codes[a:b].astype("<u8").tobytes()
        return pa.table([pa.array(ids), pa.array(sizes), pa.array([signs[16 * i : 16 * i + 16] for i in range(n)], pa.binary()), pa.array(segments, pa.binary())], names=["doc_id", "n_shingles", "sign", "codes"])

    return parts.repartition(tasks_for(fragments), "block").groupBy("block").applyInArrow(run, "doc_id long, n_shingles long, sign binary, codes binary")


def prefixes(found: DataFrame, percent: int) -> DataFrame:
    """doc_id, sign, n_shingles, n_codes (how many n-grams others have too), prefix of each document that may link."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out, counts = [], []
            for size, codes in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                counts.append(len(codes) // 8)
                out.append(codes[: 8 * max(counts[-1] - -(-percent * size // 100) + 1, 0)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(counts, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "sign", "n_shingles", "n_codes", "prefix"])

    return found.select("doc_id", "sign", "n_shingles", "codes").mapInArrow(run, "doc_id long, sign binary, n_shingles long, n_codes long, prefix binary")


def dealt(rows: DataFrame, codes: str, more: list[str], fragments: int, bits: int, places: bool = False) -> DataFrame:
    """Documents' codes by fragment: per batch and fragment one row with ids, counts, codes and their places in the document's order; columns named in more go along (long, or lists of longs)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            values = [np.frombuffer(c, "<u8") for c in batch.column(len(more) + 1).to_pylist()]
            sizes = np.array([len(v) for v in values])
            flat = np.concatenate(values) if values else np.empty(0, np.uint64)
            where = np.repeat(np.arange(len(values)), sizes)
            part = ((flat & np.uint64((1 << ALL_BITS) - 1)) >> np.uint64(bits)).astype(np.int64) % fragments
            order = np.argsort(part, kind="stable")
            place = (np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes))[order]
            part, where, flat = part[order], where[order], flat[order]
            ends = np.flatnonzero(np.diff(part, append=-1)) + 1
            rows = []
            for a, b in zip([0, *ends[:-1]], ends):
                docs, counts = np.unique(where[a:b], return_counts=True)
                own = pa.table([batch.column(i).take(pa.array(docs)) for i in range(len(more) + 1)], names=["doc_id", *more])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, own.schema) as writer:
                    writer.write_table(own)
                rows.append((int(part[a]), sink.getvalue().to_pybytes(), counts.astype("<i8").tobytes(), flat[a:b].astype("<u8").tobytes(), place[a:b].astype("<i4").tobytes() if places else b""))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), *[pa.binary()] * 4))], ["fragment", "docs", "counts", "codes", "places"])

    made = rows.select("doc_id", *more, codes).mapInArrow(run, "fragment long, docs binary, counts binary, codes binary, places binary")
    return made.repartition(tasks_for(fragments), "fragment").groupBy("fragment")


def undealt(table):
    """The documents (an Arrow table), counts, codes and places of one fragment."""
    import numpy as np
    import pyarrow as pa

    docs = pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in table.column("docs").to_pylist()])
    joined = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
    return docs, joined("counts", "<i8"), joined("codes", "<u8"), joined("places", "<i4")


def candidates(labelled: DataFrame, percent: int, fragments: int, bits: int, turn: str) -> DataFrame:
    """Pairs (a, b) of documents of different labels that may link, by a common prefix n-gram; b of "best" and "other" is a document, a the one it is paired with, so that few have the same b.

    turn: "best" pairs an n-gram's documents with the one that has most left to share, "other" with the best of
    those that have another label than that one, "all" with each other.
    """

    def run(table):
        import numpy as np
        import pyarrow as pa

        docs, counts, codes, places = undealt(table)
        ids, sizes, kept, labels = (docs.column(c).to_numpy() for c in ("doc_id", "n_shingles", "n_codes", "label"))
        row = np.repeat(np.arange(len(ids)), counts)
        left = kept[row] - places
        order = np.lexsort((ids[row], -left / sizes[row], codes))
        codes, row, left = codes[order], row[order], left[order]
        starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
        lengths = np.diff(starts, append=len(codes))
        starts, lengths = starts[lengths > 1], lengths[lengths > 1]
        found, fresh = np.empty((0, 2), np.int64), []

        def add(x, y):
            """Keeps the pairs of places that may link, each pair of documents once."""
            nonlocal found
            both = sizes[row[x]] + sizes[row[y]]
            good = (labels[row[x]] != labels[row[y]]) & ((100 + percent) * np.minimum(left[x], left[y]) >= percent * both)
            fresh.append(np.stack([ids[row[y[good]]], ids[row[x[good]]]], 1))
            if sum(map(len, fresh)) > max(len(found), CHUNK):
                found = np.unique(np.concatenate([found, *fresh]), axis=0)
                fresh.clear()

        members = np.repeat(starts, lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        if turn == "best":
            add(members, np.repeat(starts, lengths))
        elif turn == "other" and len(starts):
            foreign = labels[row[members]] != labels[row[np.repeat(starts, lengths)]]
            lead = np.minimum.reduceat(np.where(foreign, members, len(row)), np.cumsum(lengths) - lengths)
            lead = np.repeat(lead, lengths)
            some = lead < len(row)
            add(members[some], lead[some])
        elif len(starts):
            # n-grams with several labels; their documents by size: y is at most as large as x, not too small, and small enough for what x has left
            mixed = np.add.reduceat(labels[row[members]] != labels[row[np.repeat(starts, lengths)]], np.cumsum(lengths) - lengths) > 0
            own = members[np.repeat(mixed, lengths)]
            gram = np.repeat(np.arange(mixed.sum()), lengths[mixed])
            order = np.lexsort((sizes[row[own]], gram))
            own, size = own[order], sizes[row[own[order]]]
            wide = int(sizes.max()) * 4 + 8
            key = gram * wide + size
            lo = np.searchsorted(key, gram * wide - (-percent * size // 100))
            hi = np.minimum(np.arange(len(own)), np.searchsorted(key, gram * wide + np.clip((100 + percent) * left[own] // percent - size, -1, wide - 1), "right"))
            per = np.maximum(hi - lo, 0)
            work, at = np.cumsum(per), 0
            while at < len(own):
                to = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + CHUNK, "right")))
                k = per[at:to]
                add(np.repeat(own[at:to], k), own[np.repeat(lo[at:to], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)])
                at = to
        found = np.unique(np.concatenate([found, *fresh]), axis=0)
        return pa.table([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    pairs = dealt(labelled, "prefix", ["n_shingles", "n_codes", "label"], fragments, bits, places=True).applyInArrow(run, "a long, b long")
    return pairs.distinct()


def overlaps(found: DataFrame, pairs: DataFrame, percent: int, fragments: int, bits: int) -> DataFrame:
    """The pairs (a, b) that link: partial overlaps of each fragment, summed per pair."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        docs, counts, codes, _ = undealt(table)
        ids, sizes = (docs.column(c).to_numpy() for c in ("doc_id", "n_shingles"))
        row = np.repeat(np.arange(len(ids)), counts)
        rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
        spread = int(rank.max()) + 1 if len(rank) else 1
        keys = np.sort(row * spread + rank)
        starts = np.cumsum(counts) - counts
        partners = docs.column("partners").combine_chunks()
        per = np.diff(partners.offsets.to_numpy())
        other = partners.flatten().to_numpy()
        mine = np.repeat(np.arange(len(ids)), per)
        by_id = np.argsort(ids, kind="stable")
        spot = np.minimum(np.searchsorted(ids[by_id], other), max(len(ids) - 1, 0))
        good = ids[by_id][spot] == other if len(ids) else np.zeros(0, bool)
        mine, theirs = mine[good], by_id[spot[good]] if len(ids) else mine
        shared_here = np.zeros(len(mine), np.int64)
        work = np.cumsum(counts[mine])
        at = 0
        while at < len(mine):
            to = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + CHUNK, "right")))
            k = counts[mine[at:to]]
            within = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            wanted = np.repeat(theirs[at:to], k) * spread + rank[np.repeat(starts[mine[at:to]], k) + within]
            spot = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            shared_here[at:to] = np.bincount(np.repeat(np.arange(to - at), k), keys[spot] == wanted, to - at)
            at = to
        some = np.flatnonzero(shared_here > 0)
        some = some[np.lexsort((-shared_here[some], ids[mine[some]], ids[theirs[some]]))]
        a, b = ids[theirs[some]], ids[mine[some]]
        some = some[np.concatenate((np.ones(len(a[:1]), bool), (a[1:] != a[:-1]) | (b[1:] != b[:-1])))]  # rows that repeat an id count once
        mine, theirs = mine[some], theirs[some]
        return pa.table([pa.array(ids[theirs]), pa.array(ids[mine]), pa.array(sizes[theirs]), pa.array(sizes[mine]), pa.array(shared_here[some])], names=["a", "b", "size_a", "size_b", "partial"])

    none = F.expr("cast(array() as array<bigint>)")
    ends = pairs.select(F.col("b").alias("doc_id"), F.col("a").alias("partner")).union(pairs.select("a", F.lit(None).cast("long")))
    lists = ends.groupBy("doc_id").agg(F.collect_list("partner").alias("partners"))
    rows = found.join(lists, "doc_id").select("doc_id", "n_shingles", F.coalesce("partners", none).alias("partners"), "codes")
    partial = dealt(rows, "codes", ["n_shingles", "partners"], fragments, bits).applyInArrow(run, "a long, b long, size_a long, size_b long, partial long")
    summed = partial.groupBy("a", "b").agg(F.sum("partial").alias("both"), F.max("size_a").alias("size_a"), F.max("size_b").alias("size_b"))
    return summed.where(100 * F.col("both") >= percent * (F.col("size_a") + F.col("size_b") - F.col("both"))).select("a", "b")


def join(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles and component_id of every document; two link when 100 * intersection >= percent * union."""
    docs = texts(docs)
    fragments = fragments_for(docs)
    bits = own_bits(fragments)
    with_id = docs.where("doc_id is not null")
    all_docs = materialize(gathered(shared(cut(with_id, n, fragments), fragments), percent, fragments), "ngram-docs")
    signed = all_docs.where("n_shingles > 0").select("doc_id", "sign").distinct()
    least = signed.groupBy("sign").agg(F.min("doc_id").alias("label"))
    firsts = signed.join(least, "sign").select("doc_id", "label")
    labels = materialize(firsts.groupBy("doc_id").agg(F.min("label").alias("label")), "labels")
    many = firsts.groupBy("doc_id").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("a", "b")
    if not many.isEmpty():  # an id that stands for several texts joins their components
        labels = merge(labels, many)
    found = all_docs.where("codes is not null").select("doc_id", "n_shingles", "sign", "codes")
    once = found.groupBy("sign").agg(F.min("doc_id").alias("doc_id"))  # of equal sets, one looks for partners
    prefix = materialize(prefixes(found, percent).join(once, ["doc_id", "sign"], "left_semi").drop("sign"), "prefixes")
    found = found.drop("sign")
    for turn in ("best", "other", "all"):
        pairs = materialize(candidates(prefix.join(labels, "doc_id"), percent, fragments, bits, turn), "pairs")
        if pairs.isEmpty():
            continue
        links = materialize(overlaps(found, pairs, percent, max(4, fragments // 4), bits), "similar")
        if not links.isEmpty():
            labels = merge(labels, links)
    whole = all_docs.select("doc_id", "n_shingles").join(labels, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"))
    return whole.unionByName(counted(docs.where("doc_id is null"), n))


def counted(docs: DataFrame, n: int) -> DataFrame:
    """n_shingles of rows that take no part in the join."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            sizes = [len(grams(x, n)) for x in raw(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.nulls(len(sizes), pa.int64())], ["doc_id", "n_shingles", "component_id"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, component_id long")


def representatives(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """One document of each component, the one with the smallest doc_id, with its columns; rows without doc_id stay."""
    with scratch(docs.sparkSession):  # the text is shuffled next; what the join wrote needn't be there then
        joined = materialize(join(docs, n, percent), "components", keep=True)
    first = joined.where("component_id = doc_id").select("doc_id").distinct()
    stay = docs.join(first.hint("merge"), "doc_id", "left_semi")  # one plan at every size
    names = [F.col(f"`{c}`") for c in docs.columns]
    if not joined.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        place = F.row_number().over(W.partitionBy("row.doc_id").orderBy("row.text", F.xxhash64("row")))
        stay = packed(stay).withColumn("place", place).where("place = 1").select("row.*")
    return stay.select(*names).unionByName(docs.where("doc_id is null"))
