"""Quality classifier: ridge regression on random Fourier features of document statistics, calibrated.

Random Fourier features (a fixed random projection and a cosine) approximate a Gaussian kernel over
standardised statistics of a text. Each partition sums its normal equations per fold; the sums of a few
partitions at a time are added up in rounds, so that only FINAL of them reach the driver. Ridge weights are
solved for all folds together, and for each fold left out; the scores of left-out rows, in BINS bins, are
calibrated by isotonic regression (pool adjacent violators), which gives the probability of label 1.

Defined cases: null text counts as empty; rows without label teach nothing; without any label every score
is 0.5, and with labels of one kind only it is that label; copies of a text count as often as they are
labelled; a repeated id, ties in score and clashing columns change nothing (only doc_id and text are read); a
row without doc_id is scored and not held out; a very long text is counted whole; an empty table gives no rows;
every input row gives one output row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textstats
from tessera.llm.common import FOLDS, held_out, materialize
from tessera.llm.quality_rules import measure

FEATURES, BANDWIDTH, RIDGE, SEED = 192, 4.0, 1e-4, 20240501
#: Bins of the calibration; how many sums are added up by one task; how many may reach the driver.
BINS, FAN, FINAL = 512, 16, 4


class Fourier:
    """The feature map for given means and spreads of the statistics."""

    def __init__(self, mean, spread):
        import numpy as np

        dice = np.random.default_rng(SEED)
        self.mean, self.spread = mean, spread
        self.turn = dice.standard_normal((len(mean), FEATURES)) / BANDWIDTH
        self.phase = dice.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, columns):
        import numpy as np

        x = np.clip((textstats.ratios(columns) - self.mean) / self.spread, -8, 8)
        z = np.cos(x @ self.turn + self.phase) * (2 / FEATURES) ** 0.5
        return np.concatenate([z, np.ones((len(z), 1))], 1)


def labelled(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows to learn from: textstats.NAMES, label (0 or 1) and fold (1 to FOLDS - 1)."""
    marks = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("quality").cast("int").alias("label")).where("label_id is not null and label is not null")
    marks = marks.groupBy("label_id").agg(F.min("label").alias("label"))
    rows = measured.where(~held_out()).join(marks, F.col("doc_id") == F.col("label_id"))
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)).cast("int")
    return rows.select(*textstats.NAMES, "label", fold.alias("fold"))


def moments(rows: DataFrame):
    """Mean and spread of the statistics of the rows to learn from; None without rows."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros((2, 15))
        n = 0
        for batch in batches:
            x = textstats.ratios(batch.columns)
            total += np.stack([x.sum(0), (x * x).sum(0)])
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([float(v)]) for v in (n, *total.ravel())], names=[f"c{i}" for i in range(31)])

    import numpy as np

    sums = rows.select(*textstats.NAMES).mapInArrow(run, ", ".join(f"c{i} double" for i in range(31))).agg(*(F.sum(f"c{i}").alias(f"c{i}") for i in range(31))).collect()[0]
    if not sums[0]:
        return None
    first, second = np.array(sums[1:16]) / sums[0], np.array(sums[16:]) / sums[0]
    return first, np.maximum(np.sqrt(np.maximum(second - first**2, 0)), 1e-6)


def normal_equations(rows: DataFrame, features: Fourier):
    """For each fold, the sums of z z' and z y over its rows: partition sums, added up FAN at a time."""
    import numpy as np

    width = FEATURES + 1

    def sums(batches):
        import pyarrow as pa

        total = np.zeros((FOLDS, width, width + 1))
        for batch in batches:
            z = features(batch.columns[:-2])
            y, fold = batch.column(len(textstats.NAMES)).to_numpy(), batch.column(len(textstats.NAMES) + 1).to_numpy()
            for k in np.unique(fold):
                own = fold == k
                total[k] += z[own].T @ np.concatenate([z[own], y[own, None]], 1)
        if total.any():
            from pyspark import TaskContext

            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["part", "total"])

    def add(table):
        import pyarrow as pa

        total = sum(np.frombuffer(x) for x in table.column("total").to_pylist())
        return pa.table([table.column("part").slice(0, 1), pa.array([total.tobytes()], pa.binary())], names=["part", "total"])

    held = materialize(rows.mapInArrow(sums, "part long, total binary"), "normal-equations")
    while held.count() > FINAL:
        held = materialize(held.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("part").applyInArrow(add, "part long, total binary"), "normal-equations")
    return sum((np.frombuffer(r["total"]) for r in held.collect()), np.zeros(FOLDS * width * (width + 1))).reshape(FOLDS, width, width + 1)


def solve(total):
    """Ridge weights of summed normal equations."""
    import numpy as np

    gram, right = total[:, :-1], total[:, -1]
    n = max(gram[-1, -1], 1.0)
    keep = np.eye(len(gram)) * RIDGE * n
    keep[-1, -1] = 1e-9 * n
    return np.linalg.solve(gram + keep, right)


def isotonic(positive, count):
    """The non-decreasing values nearest to positive / count, bin by bin (pool adjacent violators); bins without rows follow their neighbours."""
    import numpy as np

    blocks: list[list[float]] = []
    spots = [i for i in range(len(count)) if count[i]]
    for i in spots:
        blocks.append([positive[i], count[i], 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            p, c, n = blocks.pop()
            blocks[-1][0] += p
            blocks[-1][1] += c
            blocks[-1][2] += n
    values = np.repeat([p / c for p, c, _ in blocks], [n for *_, n in blocks])
    return np.interp(np.arange(len(count)), spots, values)


def bins_of(z, weights):
    """Raw scores in bins: the regression's value, from -0.5 to 1.5."""
    import numpy as np

    return np.clip((z @ weights + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int64)


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score (probability of label 1) and predicted (1 if score >= threshold) of every document."""
    import numpy as np

    measured = materialize(measure(docs), "quality-statistics")
    rows = labelled(measured, labels)
    rows = materialize(rows, "quality-labelled")
    known = moments(rows)
    if known is None:
        return measured.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.lit(0.5).alias("score"), F.lit(int(0.5 >= threshold)).alias("predicted"))
    features = Fourier(*known)
    totals = normal_equations(rows, features)
    whole = totals.sum(0)
    weights = solve(whole)
    without = [solve(whole - totals[k]) if 0 < totals[k][-1, -2] < whole[-1, -2] else weights for k in range(FOLDS)]

    def left_out(batches):
        import pyarrow as pa

        for batch in batches:
            z, y, fold = features(batch.columns[:-2]), batch.column(len(textstats.NAMES)).to_numpy(), batch.column(len(textstats.NAMES) + 1).to_numpy()
            spot = np.zeros(len(z), np.int64)
            for k in np.unique(fold):
                spot[fold == k] = bins_of(z[fold == k], without[k])
            yield pa.RecordBatch.from_arrays([pa.array(spot), pa.array(y.astype(np.int64))], ["bin", "label"])

    counted = rows.mapInArrow(left_out, "bin long, label long").groupBy("bin").agg(F.sum("label").alias("positive"), F.count("*").alias("n")).collect()
    positive, count = np.zeros(BINS), np.zeros(BINS)
    for r in counted:
        positive[r["bin"]], count[r["bin"]] = r["positive"], r["n"]
    calibrated = isotonic(positive, count)

    def final(batches):
        import pyarrow as pa

        for batch in batches:
            z = features(batch.columns[2:])
            values = calibrated[bins_of(z, weights)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values), pa.array((values >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return measured.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), *textstats.NAMES).mapInArrow(final, "doc_id long, held_out boolean, score double, predicted int")
