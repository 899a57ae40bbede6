"""Quality rules with risk-controlled thresholds.

Rules compare ratios of a document with cutoffs. The cutoffs are learned from labelled holdouts: for each
rule and each length stratum, ever stricter cutoffs are tested in a fixed order, and one is certified only
while an exact binomial test shows that it rejects at most `risk / rules` of good documents. The error of
these tests is shared over rules and strata (Bonferroni); within a chain, fixed-sequence testing needs no
further correction. So with probability 1 - delta, all rules together reject at most `risk` of the good
documents of every stratum. Among certified cutoffs, the one that best separates the labels is used.

Defined cases: null text counts as empty and fails the base rule; labels that are null or without a
document count for nothing; labelled copies of a text count once, as good if any copy is (independent
trials are what the test assumes); without enough labels no cutoff is certified and only the base rule
rejects; ties with a cutoff pass; a very long text is counted whole; an empty table gives no rows; further columns,
whatever their names, pass keep() and are not read by judge(); every input row gives one output row, repeated ids
included.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessera.llm import textstats
from tessera.llm.common import materialize, packed, raw, text_of, texts

#: A rule's ratio in steps of 1 / STEPS, and the lower ends of the length strata in words.
STEPS = 256
STRATA = (0, 200, 1000)
RULES = {
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "capitals": "n_upper / greatest(word_chars, 1)",
    "bangs": "n_bangs / greatest(n_words, 1)",
    "doubled": "n_doubled / greatest(n_words, 1)",
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def counted(docs: DataFrame) -> DataFrame:
    """row (the struct of a document's columns), text_hash and textstats.NAMES of every whole text."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            rows = raw(text_of(batch.column(0)))
            columns = zip(*map(textstats.counts, rows)) if rows else [[]] * len(textstats.NAMES)
            hashes = [xxhash.xxh3_64_intdigest(x or b"") - (1 << 63) for x in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes, pa.int64()), *(pa.array(c, pa.int64()) for c in columns)], ["row", "text_hash", *textstats.NAMES])

    rows = packed(docs)
    return rows.mapInArrow(run, StructType([rows.schema["row"], *(StructField(n, LongType()) for n in ("text_hash", *textstats.NAMES))]))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and textstats.NAMES of every whole text."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            rows = raw(batch.column(1))
            columns = zip(*map(textstats.counts, rows)) if rows else [[]] * len(textstats.NAMES)
            hashes = [xxhash.xxh3_64_intdigest(x or b"") - (1 << 63) for x in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes, pa.int64()), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "text_hash", *textstats.NAMES])

    return texts(docs).mapInArrow(run, "doc_id long, text_hash long, " + ", ".join(f"{n} long" for n in textstats.NAMES))


def with_rules(measured: DataFrame) -> DataFrame:
    """Adds stratum, base_failed and, for each rule, the step of its ratio (0 to STEPS)."""
    stratum = reduce(lambda col, k: F.when(F.col("n_words") >= STRATA[k], k).otherwise(col), range(1, len(STRATA)), F.lit(0))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    steps = {f"step_{name}": F.least(F.ceil(F.expr(ratio) * STEPS), F.lit(STEPS)).cast("int") for name, ratio in RULES.items()}
    return measured.withColumns({"stratum": stratum, "base_failed": failed} | steps)


def log_binomial_cdf(k: int, n: int, p: float) -> float:
    """log P(Bin(n, p) <= k), exact up to rounding: terms from the largest on both ways, until they no longer count."""
    term = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    mode = min(k, int((n + 1) * p))
    top, total = term(mode), 1.0
    for way in (range(mode - 1, -1, -1), range(mode + 1, k + 1)):
        for i in way:
            part = math.exp(term(i) - top)
            total += part
            if part < 1e-18:
                break
    return top + math.log(total)


def certify(rejected: list[int], n: int, risk: float, delta: float) -> list[int]:
    """Indices of the cutoffs, loosest first, up to the first one not shown to reject at most risk of n good rows."""
    passed = []
    for i, k in enumerate(rejected):
        if n == 0 or k > risk * n or log_binomial_cdf(k, n, risk) > math.log(delta):
            break
        passed.append(i)
    return passed


def cutoffs(ruled: DataFrame, labels: DataFrame, risk: float, delta: float, weight: float) -> dict[tuple[str, int], int]:
    """The cutoff step of each (rule, stratum) for which one is certified; what is collected is at most strata x rules x (STEPS + 1) counts."""
    marks = labels.select(F.col("doc_id").cast("long").alias("label_id"), "quality").where("quality is not null and label_id is not null")
    marks = marks.groupBy("label_id").agg(F.max("quality").alias("quality"))
    seen = ruled.where("not base_failed").join(marks, F.col("doc_id") == F.col("label_id")).groupBy("text_hash").agg(F.max("quality").alias("quality"), F.first("stratum").alias("stratum"), *(F.first(f"step_{r}").alias(f"step_{r}") for r in RULES))
    pairs = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(f"step_{r}").alias("step")) for r in RULES)))
    table = seen.select("stratum", "quality", pairs.alias("x")).groupBy("stratum", "x.rule", "x.step").agg(F.sum(F.when(F.col("quality") > 0, 1).otherwise(0)).alias("good"), F.sum(F.when(F.col("quality") > 0, 0).otherwise(1)).alias("bad"))
    good, bad = {}, {}
    for row in table.collect():
        key = (row["rule"], row["stratum"])
        good.setdefault(key, [0] * (STEPS + 1))[row["step"]] += row["good"]
        bad.setdefault(key, [0] * (STEPS + 1))[row["step"]] += row["bad"]
    out = {}
    for key, per_step in good.items():
        above = lambda counts: [sum(counts[c + 1 :]) for c in range(STEPS - 1, -1, -1)]  # noqa: E731  loosest cutoff first
        g, b = above(per_step), above(bad[key])
        best = max(certify(g, sum(per_step), risk / len(RULES), delta / (len(RULES) * len(STRATA))), key=lambda i: b[i] - weight * g[i], default=None)
        if best is not None and b[best] > weight * g[best]:
            out[key] = STEPS - 1 - best
    return out


def broken_rules(chosen: dict[tuple[str, int], int]) -> F.Column:
    """Names of the rules whose cutoff a row exceeds."""
    fails = [F.when((F.col("stratum") == s) & (F.col(f"step_{r}") > c), r) for (r, s), c in sorted(chosen.items())]
    return F.filter(F.array(*fails), lambda x: x.isNotNull()) if fails else F.array().cast("array<string>")


def judge(docs: DataFrame, labels: DataFrame, risk: float = 0.05, delta: float = 0.1, weight: float = 20.0) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, stratum and failed_rules of every document.

    risk: most of a stratum's good documents that all rules together may reject; delta: chance that the
    guarantee fails; weight: good documents that count as much as one bad one when choosing among certified cutoffs.
    """
    ruled = materialize(with_rules(measure(docs)), "quality-rules")
    judged = ruled.withColumn("failed_rules", broken_rules(cutoffs(ruled, labels, risk, delta, weight)))
    return judged.select("doc_id", *BASE, "base_failed", (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"), "stratum", "failed_rules")


def keep(docs: DataFrame, labels: DataFrame, risk: float = 0.05, delta: float = 0.1, weight: float = 20.0) -> DataFrame:
    """The documents that the rules keep, with the columns they came with.

    The cutoffs are learned first; a second pass counts each text again beside its columns, so no text is shuffled.
    """
    chosen = cutoffs(materialize(with_rules(measure(docs)), "quality-rules"), labels, risk, delta, weight)
    rows = with_rules(counted(docs))
    return rows.where(~F.col("base_failed") & (F.size(broken_rules(chosen)) == 0)).select("row.*")
