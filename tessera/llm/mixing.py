"""Mixing to target weights with soft domain membership.

A softmax classifier, fitted on a bounded sample of labelled rows, gives each document a posterior over the
domains of the labels table. Document rates r >= 0 are then fitted so that the expected tokens of each
domain, sum of r x tokens x posterior, match the targets: projected gradient descent on the squared
residual, in the inner product that weighs documents by their tokens and residuals by the inverse Gram
matrix of the documents whose rate is above 0 (so a step of 1 is exact until another rate meets 0). A step
needs one vector and one small matrix from the whole corpus; each document's rate follows from the steps
so far and its own posterior.
So a pass is one aggregation over a narrow table, and only sums of a number per domain reach the driver.

A token is a word, [^\\x20\\x09-\\x0D]+.

Defined cases: null text counts as empty; labels without a known domain are left out; a domain without
labels has posterior 0, and without labels at all every posterior is equal; targets that no rates can
reach are approached in the least-squares sense; a domain that would need more than REPEATS copies of what
tells it from the others stays that far below its target; rows that share a doc_id, or have none, are drawn each
for itself by their text as well, and copies of a row are drawn alike; a very long text is counted whole; an empty table gives
no rows; further columns, whatever their names, pass mix() and are not read by rates(); every input row gives one
output row of rates().
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tessera.llm import textstats
from tessera.llm.common import materialize, packed, raw, text_of, texts

#: The domains of the labels table, in order.
DOMAINS = {"clean": "quality = 1 and coalesce(toxic, 0) = 0", "toxic": "toxic = 1", "low": "quality = 0 and coalesce(toxic, 0) = 0"}
#: Expected share of each domain's tokens in the mix.
TARGETS = {"clean": 0.985, "toxic": 0.005, "low": 0.01}
#: Most labelled rows of a domain that the classifier is fitted on, most words per domain that it looks for, most steps of the fit.
SAMPLE, WORDS, STEPS = 3000, 48, 30
#: Most times that the tokens of a domain may be repeated to reach its target.
REPEATS = 16
EDGE = b".,;:!?\"'()[]"


def words_of(text: bytes | None) -> set[bytes]:
    """Distinct words, ASCII letters in lower case, without punctuation at the ends."""
    return {w.strip(EDGE) for w in (text or b"").lower().split()}


def sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """doc_id, text, domain (number), weight of about `most` labelled documents of each domain, the same whenever it is run; at most 3 x most ids are broadcast.

    weight: how many labels of the domain a sampled one stands for, so that weighted counts keep the balance of the domains.
    """
    domain = F.coalesce(*(F.when(F.expr(rule), k) for k, rule in enumerate(DOMAINS.values())))
    marks = labels.select(F.col("doc_id").cast("long").alias("label_id"), domain.alias("domain")).where("label_id is not null and domain is not null")
    marks = marks.groupBy("label_id").agg(F.max("domain").alias("domain"))
    sizes = {r["domain"]: r["count"] for r in marks.groupBy("domain").count().collect()}
    share = F.coalesce(*(F.when(F.col("domain") == k, min(1.0, most / n)) for k, n in sizes.items()), F.lit(0.0))
    chosen = marks.where(F.pmod(F.xxhash64("label_id"), F.lit(1 << 20)) < share * (1 << 20))
    taken = {r["domain"]: r["count"] for r in chosen.groupBy("domain").count().collect()}
    weight = F.coalesce(*(F.when(F.col("domain") == k, sizes[k] / n) for k, n in taken.items()), F.lit(1.0))
    return materialize(texts(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "domain", weight.alias("weight")), "mixing-sample")


def telling_words(sampled: DataFrame, sizes: dict[int, int], most: int) -> list[bytes]:
    """Words whose presence tells a domain, at most `most` for each, by the G statistic against the other domains."""

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        found: Counter = Counter()
        for batch in batches:
            for text, domain in zip(raw(batch.column(1)), batch.column(2).to_pylist()):
                found.update((w, domain) for w in words_of(text))
        keys = [k for k, _ in found.items()]
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.binary()), pa.array([k[1] for k in keys], pa.int32()), pa.array(list(found.values()), pa.int64())], ["word", "domain", "n"])

    total = sum(sizes.values())
    counts = sampled.mapInArrow(run, "word binary, domain int, n long").groupBy("word").agg(*(F.sum(F.when(F.col("domain") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in sizes))
    everywhere = reduce(lambda a, b: a + b, (F.col(f"n{k}") for k in sizes))
    counts = materialize(counts.where(everywhere >= 5), "mixing-words")  # read once per domain
    chosen = set()
    for k, size in sizes.items():
        inside, outside, rest = F.col(f"n{k}"), everywhere - F.col(f"n{k}"), total - size
        rate = everywhere / F.lit(total)
        gain = inside * F.log((inside + 0.5) / (rate * size + 0.5)) + outside * F.log((outside + 0.5) / (rate * rest + 0.5))
        top = counts.where(everywhere >= 5).where(inside * rest > outside * size).orderBy(gain.desc(), "word").limit(most)
        chosen.update(bytes(r["word"]) for r in top.select("word").collect())
    return sorted(chosen)


def features(rows: list, words: dict[bytes, int]):
    """textstats.ratios of texts and the presence of each telling word; and the number of words."""
    import numpy as np

    counted = list(zip(*map(textstats.counts, rows))) or [[]] * len(textstats.NAMES)
    present = np.zeros((len(rows), len(words)))
    for i, row in enumerate(rows):
        for w in words_of(row) & words.keys():
            present[i, words[w]] = 1.0
    return np.concatenate([textstats.ratios(counted), present], 1), np.asarray(counted[0], np.int64)


def fit_softmax(x, y, classes: list[int], weight, rounds: int = 300, ridge: float = 1e-4):
    """Weights (features + 1, classes) of a softmax regression over rows that count by their weight; no ridge on the intercepts, so mean posteriors are the weighted shares."""
    import numpy as np

    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    target = (y[:, None] == np.array(classes)[None, :]).astype(float)
    w = np.zeros((x.shape[1], len(classes)))
    heavy = x * (weight / weight.sum())[:, None]
    step = 4.0 / max(np.linalg.eigvalsh(x.T @ heavy)[-1], 1e-9) / 2
    held = np.full((x.shape[1], 1), ridge)
    held[-1] = 0.0
    ahead, t = w.copy(), 1.0
    for _ in range(rounds):
        z = x @ ahead
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        new = ahead - step * (heavy.T @ (p - target) + held * ahead)
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        ahead, w = new + (before - 1) / t * (new - w), new
    return w


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, words: int = WORDS) -> dict:
    """The classifier: telling words, scaling and weights; its size is bounded by the parameters."""
    import numpy as np

    sampled = sample(docs, labels, most)
    sizes = {r["domain"]: r["count"] for r in sampled.groupBy("domain").count().orderBy("domain").collect()}
    if not sizes:
        return {"classes": [], "words": {}}
    known = {w: i for i, w in enumerate(telling_words(sampled, sizes, words))}

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x, _ = features(raw(batch.column(1)), known)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(list(x.astype("<f4")), pa.list_(pa.float32()))], ["doc_id", "domain", "weight", "x"])

    table = sampled.mapInArrow(run, "doc_id long, domain int, weight double, x array<float>").toArrow().sort_by("doc_id")
    x = np.array(table.column("x").to_pylist(), np.float64)
    y, weight = table.column("domain").to_numpy(), table.column("weight").to_numpy()
    mean, spread = x.mean(0), np.maximum(x.std(0), 1e-6)
    return {"classes": sorted(sizes), "words": known, "mean": mean, "spread": spread, "weights": fit_softmax((x - mean) / spread, y, sorted(sizes), weight)}


def posteriors(docs: DataFrame, model: dict) -> DataFrame:
    """row (the struct of a document's columns), m_tokens and m_<domain>, the posterior of each domain, of every whole text."""
    names = [f"m_{d}" for d in DOMAINS]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            x, tokens = features(raw(text_of(batch.column(0))), model["words"])
            p = np.full((len(x), len(names)), 0.0 if model["classes"] else 1 / len(names))
            if model["classes"]:
                z = np.clip((x - model["mean"]) / model["spread"], -20, 20) @ model["weights"][:-1] + model["weights"][-1]
                z = np.exp(z - z.max(1, keepdims=True))
                p[:, model["classes"]] = z / z.sum(1, keepdims=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens), *(pa.array(p[:, k]) for k in range(len(names)))], ["row", "m_tokens", *names])

    rows = packed(docs)
    return rows.mapInArrow(run, StructType([rows.schema["row"], StructField("m_tokens", LongType()), *(StructField(n, DoubleType()) for n in names)]))


def posterior_table(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, m_tokens and m_<domain> of every document, written once."""
    rows = posteriors(texts(docs), model)
    return materialize(rows.select("row.doc_id", *(c for c in rows.columns if c != "row")), "mixing")


def rate(steps: list[list[float]]) -> F.Column:
    """A document's rate after the steps: from 1, each step takes its posterior's share off and holds the rate at 0 or more."""
    if not steps:
        return F.lit(1.0)
    taken = F.array(*(F.array(*map(F.lit, s)) for s in steps))
    dot = lambda v: reduce(lambda a, b: a + b, (F.col(f"m_{d}") * v[k] for k, d in enumerate(DOMAINS)))
    return F.aggregate(taken, F.lit(1.0), lambda r, v: F.greatest(F.lit(0.0), r - dot(v)))


def apart(gram, k: int) -> float:
    """What domain k's expected tokens gain, those of the others held, per unit of its multiplier; 0 if no document tells it from the others."""
    import numpy as np

    rest = [j for j in range(len(gram)) if j != k]
    return max(0.0, float(gram[k, k] - gram[k, rest] @ np.linalg.pinv(gram[np.ix_(rest, rest)], rcond=1e-10, hermitian=True) @ gram[rest, k]))


def fit_rates(table: DataFrame, targets: dict[str, float], most: int = STEPS, exact: float = 1e-7, repeats: float = REPEATS) -> list[list[float]]:
    """The steps of the fit over a table of m_tokens and posteriors.

    The mix is as large as the tokens of its main domain (of those with tokens, the one with the highest target) allow
    without repeating them. Domains that have less than their target then ask are repeated, at most `repeats` times.
    """
    import numpy as np

    names = [f"m_{d}" for d in DOMAINS]
    k = len(names)

    def sums(steps):
        """Expected tokens of each domain, and the Gram matrix of the documents whose rate is above 0."""
        held = table.withColumn("m_rate", rate(steps))
        moving = F.when(F.col("m_rate") > 0, F.col("m_tokens")).otherwise(0)
        made = [F.sum(F.col("m_rate") * F.col("m_tokens") * F.col(a)) for a in names] + [F.sum(moving * F.col(a) * F.col(b)) for a in names for b in names]
        row = [v or 0.0 for v in held.agg(*(c.alias(f"c{i}") for i, c in enumerate(made))).collect()[0]]
        return np.array(row[:k]), np.array(row[k:]).reshape(k, k)

    have, gram = sums([])
    share = np.array([targets[d] for d in DOMAINS])
    share = share / share.sum()
    main = max((j for j in range(k) if share[j] > 0 and have[j] > 0), key=lambda j: share[j], default=None)
    wanted = share * (have[main] / share[main] if main is not None else 0.0)
    wanted = np.array([min(w, h + (repeats - 1) * apart(gram, j)) if w > h else w for j, (w, h) in enumerate(zip(wanted, have))])
    steps: list[list[float]] = []
    best = (np.abs(have - wanted).max(), 0)
    while len(steps) < most and best[0] > exact * max(wanted.sum(), 1.0):
        steps.append([float(v) for v in np.linalg.pinv(gram, rcond=1e-10, hermitian=True) @ (have - wanted)])
        have, gram = sums(steps)
        best = min(best, (np.abs(have - wanted).max(), len(steps)))
    return steps[: best[1]]


def rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """doc_id, n_tokens, the posterior p_<domain> of each domain, and rate (expected copies in the mix) of every document."""
    table = posterior_table(docs, fit(docs, labels))
    return table.select("doc_id", F.col("m_tokens").alias("n_tokens"), *(F.col(f"m_{d}").alias(f"p_{d}") for d in DOMAINS), rate(fit_rates(table, targets)).alias("rate"))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """The documents as often as their rates say, with the columns they came with.

    A rate's whole part is copies; its fraction is the chance of one more, decided by a hash of doc_id and text, so
    expected tokens of each domain match. Posteriors are computed again beside the columns, so no text is shuffled.
    """
    model = fit(docs, labels)
    steps = fit_rates(posterior_table(docs, model), targets)
    chance = F.pmod(F.xxhash64(F.lit("mix"), "row.doc_id", "row.text"), F.lit(1 << 30)) / F.lit(1 << 30)
    rows = posteriors(docs, model).withColumn("m_copies", F.floor(rate(steps) + chance).cast("int")).where("m_copies > 0")
    return rows.withColumn("m_copy", F.explode(F.sequence(F.lit(1), F.col("m_copies")))).select("row.*")
