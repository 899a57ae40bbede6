"""Approximate nearest neighbours with learned partitions.

On a bounded sample of distinct vectors, a neighbour graph is built and cut into balanced parts
(size-constrained label propagation, from balanced centroids, so that few edges cross). A softmax classifier
learns, from a vector, how its graph neighbours are spread over the parts. Every row is indexed in its most
probable part. The number of parts grows with the square root of the rows; once there are more rows than
MOST_PARTS parts of LEAF rows hold, each part is cut in the same way by a second classifier, learned in the
cluster from a bounded sample of that part, so that a leaf stays of about LEAF rows however many there are.

A query goes to its several most probable leaves, and all rows there are reranked by exact cosine. How many
leaves that takes is measured: the k nearest rows of HELD queries that no classifier learned from are found
by brute force over all rows (one pass; a few rows per task and query are shuffled), and so many leaves are
probed that RECALL of them lie there.

Of equal vectors only as many as can be among a query's nearest (k + 1 with the smallest ids) go on: they
tie, and ties go to smaller ids, so nothing is lost. Leaves are worked on in cells of at most about CELL rows
by CELL queries. A query that finds fewer than k rows in its leaves is searched again in all of them.

Vectors are scaled by powers of two before anything is summed, so neither huge nor tiny components overflow
or vanish, and all other scores stay what they are to the last bit.

Defined cases: rows whose vector is null, zero, or has null or non-finite components, or whose length is not
the commonest one, take no part, as candidates or queries; rows without id neither; a repeated id counts once
per distinct vector as a candidate, and once as a query; with fewer candidates than k all are returned; with
fewer than 2 x LEAST rows there is one leaf; an empty table gives no rows; columns other than id and vector,
whatever their names (and texts of any length in them), are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm.common import materialize

#: Least rows of a part, most parts of a level, rows of a leaf from which on a part is cut again, most vectors that a classifier learns from.
LEAST, MOST_PARTS, LEAF, SAMPLE = 32, 256, 2048, 8192
#: Graph neighbours, queries that recall is measured with, recall aimed at, rows or queries in a cell, bytes of all classifiers of the second level.
GRAPH, HELD, RECALL, CELL, ROUTER_BYTES = 10, 256, 0.97, 8192, 64 << 20
#: How much closer than the last place a rough score must be to be left out safely.
SLACK = 1e-9


def usable(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """id and v (array of doubles) of the rows that take part."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v")).where("id is not null and v is not null and size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.coalesce(finite, F.lit(False))).where(F.exists("v", lambda x: x != 0))
    width = rows.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).limit(1).collect()
    return rows.where(F.size("v") == (width[0]["width"] if width else 0))


def nearest_in(x, k: int):
    """Places of the k nearest other rows of each row of unit vectors."""
    import numpy as np

    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 1024):
        near = x[at : at + 1024] @ x.T
        near[np.arange(len(near)), at + np.arange(len(near))] = -2
        top = np.argpartition(-near, k - 1, 1)[:, :k]
        out[at : at + 1024] = np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), 1, kind="stable"), 1)
    return out


def balanced(x, graph, parts: int, seed: int = 7):
    """A part for each row, none larger than 1.05 times the mean (and one), that few edges of the graph cross."""
    import numpy as np

    dice = np.random.default_rng(seed)
    centres = x[dice.choice(len(x), parts, replace=False)]
    for _ in range(12):
        own = np.argmax(x @ centres.T, 1)
        centres = np.stack([x[own == p].sum(0) if (own == p).any() else x[dice.integers(len(x))] for p in range(parts)])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    most = int(1.05 * len(x) / parts) + 1
    near = x @ centres.T
    part, size = np.full(len(x), -1), np.zeros(parts, np.int64)
    for i in np.argsort(-near.max(1), kind="stable"):
        for p in np.argsort(-near[i], kind="stable"):
            if size[p] < most:
                part[i] = p
                size[p] += 1
                break
    back: list[list[int]] = [list(row) for row in graph]
    for i, row in enumerate(graph):
        for j in row:
            back[j].append(i)
    for _ in range(8):
        moved = 0
        for i in dice.permutation(len(x)):
            votes = np.bincount(part[back[i]], minlength=parts)
            best = int(np.argmax(votes))
            if votes[best] > votes[part[i]] and size[best] < most:
                size[part[i]] -= 1
                size[best] += 1
                part[i] = best
                moved += 1
        if moved < len(x) // 500:
            break
    return part


def scaled(x):
    """Rows times a power of two each, so that the largest component is from 0.5 to 1."""
    import numpy as np

    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def unit(x):
    """Rows at length 1."""
    import numpy as np

    x = scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def classifier(x, parts: int):
    """Softmax weights (components + 1, parts) that tell, from a unit vector, over which parts of a balanced cut of the neighbour graph its neighbours are spread."""
    import numpy as np

    x = np.unique(x, axis=0)
    parts = max(1, min(parts, len(x) // 16))
    if parts == 1:
        return np.zeros((x.shape[1] + 1, 1), np.float32)
    graph = nearest_in(x, min(GRAPH, len(x) - 1))
    part = balanced(x, graph, parts)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph].ravel()), 0.5 / graph.shape[1])
    target[np.arange(len(x)), part] += 0.5
    z = np.concatenate([x, np.ones((len(x), 1))], 1)
    weights, ahead, before = np.zeros((z.shape[1], parts)), np.zeros((z.shape[1], parts)), 1.0
    step = 1.0 / max(np.linalg.eigvalsh(z.T @ z / len(z))[-1] / 2, 1e-9)
    for _ in range(400):
        p = softmax(z @ ahead)
        new = ahead - step * (z.T @ (p - target) / len(z) + 1e-6 * ahead)
        after = (1 + (1 + 4 * before * before) ** 0.5) / 2
        ahead, weights, before = new + (before - 1) / after * (new - weights), new, after
    return weights.astype(np.float32)


def softmax(s):
    import numpy as np

    p = np.exp(s - s.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


class Router:
    """From a unit vector to its most probable leaves: a classifier, and one for each part that is cut again.

    A leaf's number is part x MOST_PARTS + its place in the part. At most (1 + MOST_PARTS) classifiers, of
    ROUTER_BYTES together on the second level.
    """

    def __init__(self, first, second: dict | None = None):
        self.first, self.second, self.base = first, second or {}, MOST_PARTS
        self.leaves = sum(self.second[p].shape[1] if p in self.second else 1 for p in range(first.shape[1]))

    def ranked(self, x, most: int):
        """The `most` most probable leaves of each row, best first; fewer only if there are no more."""
        import numpy as np

        chance = softmax(x @ self.first[:-1] + self.first[-1])
        if not self.second:
            return np.argsort(-chance, 1, kind="stable")[:, :most] * self.base
        order = np.argsort(-chance, 1, kind="stable")
        names, values = [np.empty((len(x), 0), np.int64)], [np.empty((len(x), 0))]
        for turn in range(order.shape[1]):
            part = order[:, turn]
            if values[0].shape[1] >= most and (chance[np.arange(len(x)), part] <= values[0][:, most - 1]).all():
                break  # no leaf is likelier than its part
            name, value = np.full((len(x), self.base), -1), np.full((len(x), self.base), -1.0)
            for p in np.unique(part):
                own = part == p
                w = self.second.get(int(p))
                inside = softmax(x[own] @ w[:-1] + w[-1]) if w is not None else np.ones((own.sum(), 1))
                name[own, : inside.shape[1]] = p * self.base + np.arange(inside.shape[1])
                value[own, : inside.shape[1]] = inside * chance[own, p][:, None]
            names, values = [np.concatenate([*names, name], 1)], [np.concatenate([*values, value], 1)]
            best = np.argsort(-values[0], 1, kind="stable")[:, :most]
            names, values = [np.take_along_axis(names[0], best, 1)], [np.take_along_axis(values[0], best, 1)]
        return names[0]


def arrays(column):
    """An Arrow column of equally long lists of doubles as rows."""
    return column.flatten().to_numpy().reshape(len(column), -1)


def held() -> F.Column:
    """Whether a row is left out of what classifiers learn from."""
    return F.pmod(F.xxhash64(F.lit("held"), "id"), F.lit(16)) == 0


def sampled(rows: DataFrame, share: F.Column) -> DataFrame:
    """Rows to learn from: `share` of those that are not held, the same whenever it is run."""
    return rows.where(~held()).where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share * (1 << 30))


def learn(rows: DataFrame, n: int) -> Router:
    """The router, from at most about SAMPLE distinct vectors on the driver, and as many for each part that is cut again in the cluster."""
    import numpy as np

    first = max(1, min(MOST_PARTS, n // LEAST, round(n**0.5 / 3)))
    width = len(row[0]) if (row := rows.select("v").first()) else 1
    taken = sampled(rows, F.lit(min(1.0, SAMPLE / n * 16 / 15))).orderBy("id").limit(2 * SAMPLE).toArrow() if first > 1 else ()
    if len(taken) < 2 * LEAST:
        return Router(np.zeros((width + 1, 1), np.float32))
    router = Router(classifier(unit(arrays(taken.column("v").combine_chunks())), first))
    if n <= 2 * MOST_PARTS * LEAF:
        return router
    own = routed(rows, router, 1)
    counts = {r["part"]: r["count"] for r in own.groupBy("part").count().collect()}
    most = max(1, min(MOST_PARTS, ROUTER_BYTES // (4 * (width + 1) * len(counts))))
    leaves = {p: min(most, round(c / LEAF)) for p, c in counts.items()}

    def cut(table):
        import pyarrow as pa

        part = table.column("part")[0].as_py()
        made = classifier(unit(arrays(table.column("v").combine_chunks())), leaves[part])
        return pa.table([pa.array([part]), pa.array([made.tobytes()], pa.binary())], names=["part", "weights"])

    share = F.element_at(F.create_map(*(F.lit(v) for p, c in counts.items() for v in (p, min(1.0, SAMPLE / c * 16 / 15)))), F.col("part"))
    made = sampled(own, share).groupBy("part").applyInArrow(cut, "part long, weights binary").collect()
    return Router(router.first, {r["part"] // router.base: np.frombuffer(r["weights"], np.float32).reshape(width + 1, -1) for r in made})


def measured(rows: DataFrame, router: Router, k: int) -> int:
    """How many leaves the held queries need so that RECALL of their k nearest rows, by brute force, lie there."""
    import numpy as np

    if router.leaves == 1:
        return 1
    chosen = rows.where(held()).orderBy(F.xxhash64(F.lit("asked"), "id"), "id").limit(HELD).toArrow()
    if not len(chosen):
        return router.leaves
    ids, x = chosen.column("id").to_numpy(), unit(arrays(chosen.column("v").combine_chunks()))
    order = router.ranked(x, router.leaves)

    def nearest(batches):
        import pyarrow as pa

        best = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)]
        for batch in batches:
            own, leaf = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for at in range(0, len(own), CELL):
                near = x @ unit(arrays(batch.column(1).slice(at, CELL))).T
                near[ids[:, None] == own[None, at : at + CELL]] = -2
                top = np.argpartition(-near, min(k, near.shape[1]) - 1, 1)[:, :k]
                new = [np.repeat(np.arange(len(x)), top.shape[1]), own[at + top].ravel(), np.take_along_axis(near, top, 1).ravel(), leaf[at + top].ravel()]
                best = [np.concatenate(pair) for pair in zip(best, new)]
                keep = np.lexsort((best[1], -best[2], best[0]))
                best = [b[keep] for b in best]
                keep = np.arange(len(best[0])) - np.searchsorted(best[0], best[0]) < k
                best = [b[keep] for b in best]
        yield pa.RecordBatch.from_arrays([pa.array(b) for b in best], ["query", "id", "score", "leaf"])

    found = rows.mapInArrow(nearest, "query long, id long, score double, leaf long").where("score > -2")
    place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "id"))
    true = found.withColumn("place", place).where(F.col("place") <= k).select("query", "leaf").collect()
    needed = np.sort([int(np.argmax(order[r["query"]] == r["leaf"])) for r in true])
    return int(needed[min(len(needed) - 1, int(RECALL * len(needed)))]) + 1 if len(needed) else router.leaves


def routed(rows: DataFrame, router: Router, probes: int) -> DataFrame:
    """id, v and part, a row for each of the most probable `probes` leaves."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        step = max(1, (1 << 22) // (probes + MOST_PARTS))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                some = batch.slice(at, step)
                order = router.ranked(unit(arrays(some.column(1))), probes)
                row, turn = np.nonzero(order >= 0)
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(row)), some.column(1).take(pa.array(row)), pa.array(order[row, turn])], ["id", "v", "part"])

    return rows.select("id", "v").mapInArrow(run, "id long, v array<double>, part long")


def cosines(q, c):
    """Cosine of each pair of rows, each by the same sums whatever stands around it."""
    import numpy as np

    return (q * c).sum(1) / (np.sqrt((q * q).sum(1)) * np.sqrt((c * c).sum(1)))


def rerank(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score: the k nearest of each query in each cell of its leaves."""
    # at most MOST_PARTS x MOST_PARTS rows of three numbers
    counts = candidates.groupBy("part").agg(F.ceil(F.count("*") / CELL).alias("c_cells")).join(queries.groupBy("part").agg(F.ceil(F.count("*") / CELL).alias("q_cells")), "part")

    def spread(rows, kind):
        """A row for each cell: one of its own blocks, and every block of the other kind; leaves without the other kind go."""
        own, other, mine, copy = ("c_cells", "q_cells", "block", "turn") if kind == 0 else ("q_cells", "c_cells", "turn", "block")
        row = rows.join(F.broadcast(counts), "part").withColumn(mine, F.pmod(F.xxhash64("id"), F.col(own)))
        return row.withColumn(copy, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))).select("part", "block", "turn", F.lit(kind).alias("kind"), "id", "v")

    def search(table):
        import numpy as np
        import pyarrow as pa

        kind, ids = table.column("kind").to_numpy(), table.column("id").to_numpy()
        flat = scaled(arrays(table.column("v").combine_chunks()))
        c_ids, c, q_ids, q = ids[kind == 0], flat[kind == 0], ids[kind == 1], flat[kind == 1]
        found = []
        if len(c) and len(q):
            c_unit = unit(c)
            for at in range(0, len(q), 256):
                some = q[at : at + 256]
                near = unit(some) @ c_unit.T
                near[q_ids[at : at + 256, None] == c_ids[None, :]] = -np.inf
                top = min(k, len(c))
                least = -np.partition(-near, top - 1, 1)[:, top - 1]
                at_q, at_c = np.nonzero((near >= least[:, None] - SLACK) & (near > -np.inf))
                score = cosines(some[at_q], c[at_c])
                order = np.lexsort((c_ids[at_c], -score, at_q))
                at_q, at_c, score = at_q[order], at_c[order], score[order]
                first = np.searchsorted(at_q, at_q, "left")
                best = np.arange(len(at_q)) - first < k
                found.append((q_ids[at + at_q[best]], c_ids[at_c[best]], score[best]))
        columns = [np.concatenate(x) for x in zip(*found)] or [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table([pa.array(x) for x in columns], names=["query_id", "vec_id", "score"])

    both = spread(candidates, 0).unionByName(spread(queries, 1))
    return both.groupBy("part", "block", "turn").applyInArrow(search, "query_id long, vec_id long, score double")


def best(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of the k best of each query."""
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, k: int = 5, every: int = 50, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k nearest rows found for each row whose id is divisible by `every`."""
    rows = materialize(usable(vectors, key, column), "vectors")
    alike = W.partitionBy("v").orderBy("id")
    few = materialize(rows.distinct().withColumn("place", F.row_number().over(alike)).where(F.col("place") <= k + 1).drop("place"), "distinct-vectors")
    n = few.count()
    router = learn(few, n)
    candidates = materialize(routed(few, router, 1), "indexed-vectors")
    probes = measured(candidates, router, k)
    asked = rows.where(F.pmod("id", F.lit(every)) == 0).groupBy("id").agg(F.min("v").alias("v"))
    asked = materialize(asked, "asked-vectors")
    found = materialize(best(rerank(candidates, materialize(routed(asked, router, probes), "routed-queries"), k), k), "found")
    if probes >= router.leaves:
        return found
    full = found.groupBy("query_id").count().where(F.col("count") >= k).select(F.col("query_id").alias("id"))
    short = materialize(asked.join(full, "id", "left_anti"), "short-queries")
    if short.isEmpty():
        return found
    again = best(rerank(candidates, materialize(routed(short, router, router.leaves), "routed-queries"), k), k)
    return found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(again)
