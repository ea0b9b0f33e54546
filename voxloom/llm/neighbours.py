"""Nearest neighbours by an inverted multi-index.

Vectors are cut in two halves, each quantised with a codebook of ``K`` centroids fitted on at most ``sample``
vectors; a cell is a pair of centroids. A search goes through the pairs in order of summed distance to its two
halves, with a heap over the two sorted lists, and reranks the entries of each cell on the original vectors.
A cell is passed over only when its bound (the halves' products with the centroids plus norm times radius, for
each half) is under the score of the ``k``-th best so far, so the result is exact; recall measured against
brute force is 1 (tests, README).

Cells are packed into shards of bounded size, and a cell with more rows than a shard is dealt over several by
hash; queries are dealt into blocks. A task searches one block in one shard, and each query's best of all
shards are merged. Driver and broadcasts hold the codebooks, the sample and one row for each cell (``K`` is at
most 256).

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite
components take no part, nor do null ids; repeated rows count once; rows of the query's own id are no
candidates; with fewer candidates than ``k`` all are returned; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Workspace, worker


def k_means(x, k: int, rounds: int = 10):
    """Centroids of the rows of ``x``; the same for the same rows."""
    import numpy as np

    x = np.unique(x, axis=0)
    if len(x) <= k:
        return x
    c = x[np.random.default_rng(11).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = nearest(x, c)
        sums, n = np.zeros_like(c), np.bincount(own, minlength=k)
        np.add.at(sums, own, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x, c):
    return ((c**2).sum(1)[None, :] - 2 * x @ c.T).argmin(1)


class Shard:
    """The inverted lists of some cells, and searches in them."""

    def __init__(self, ids, x, cells, books):
        import numpy as np

        order = np.lexsort((ids, cells[:, 1], cells[:, 0]))
        self.ids, self.x, cells, self.books, self.half = ids[order], x[order], cells[order], books, books[0].shape[1]
        first = np.flatnonzero(np.r_[True, (cells[1:] != cells[:-1]).any(1)]) if len(ids) else np.zeros(0, int)
        last = np.r_[first[1:], len(ids)].astype(int)
        self.lists = {(int(cells[a, 0]), int(cells[a, 1])): (int(a), int(z)) for a, z in zip(first, last, strict=True)}
        self.radius = {}
        for (i, j), (a, z) in self.lists.items():
            near = [np.sqrt(((self.x[a:z, p] - b) ** 2).sum(1).max()) for p, b in ((slice(None, self.half), books[0][i]), (slice(self.half, None), books[1][j]))]
            self.radius[i, j] = (float(near[0]), float(near[1]))
        self.firsts, self.seconds = (np.array(sorted({c[v] for c in self.lists}), int) for v in (0, 1))

    def pairs(self, far):
        """Cells by the sum of their centroids' distances to the query's halves."""
        import heapq

        import numpy as np

        a, b = (rows[np.argsort(d[rows], kind="stable")] for rows, d in zip((self.firsts, self.seconds), far, strict=True))
        da, db, a, b = far[0][a].tolist(), far[1][b].tolist(), a.tolist(), b.tolist()
        heap = [(da[0] + db[0], 0, 0)] if a else []
        while heap:
            _, i, j = heapq.heappop(heap)
            if (a[i], b[j]) in self.lists:
                yield a[i], b[j]
            if j + 1 < len(b):
                heapq.heappush(heap, (da[i] + db[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (da[i + 1] + db[0], i + 1, 0))

    def search(self, own_id: int, q, k: int, batch: int = 1024):
        """Ids and scores of the ``k`` best, best first, ties to the smaller id."""
        import numpy as np

        halves = (q[: self.half], q[self.half :])
        products = [c @ h for c, h in zip(self.books, halves, strict=True)]
        norms = [float(np.sqrt(h @ h)) for h in halves]
        far = [(c**2).sum(1) - 2 * p + h @ h for c, p, h in zip(self.books, products, halves, strict=True)]
        pa, pb = products[0].tolist(), products[1].tolist()
        scores, rows, floor, waiting, n = np.zeros(0), np.zeros(0, int), -np.inf, [], 0

        def rank() -> None:
            nonlocal scores, rows, floor, waiting, n
            new = np.concatenate([np.arange(a, z) for a, z in waiting])
            s = np.concatenate([self.x[a:z] @ q for a, z in waiting])
            stay = (s >= floor) & (self.ids[new] != own_id)
            scores, rows = np.r_[scores, s[stay]], np.r_[rows, new[stay]]
            if len(scores) > k:
                floor = max(floor, float(np.partition(scores, -k)[-k]) - 1e-9 * norms_all)
                stay = scores >= floor
                scores, rows = scores[stay], rows[stay]
            waiting, n = [], 0

        norms_all = 1 + float(np.sqrt(q @ q)) * self.largest
        for i, j in self.pairs(far):
            r1, r2 = self.radius[i, j]
            if pa[i] + pb[j] + norms[0] * r1 + norms[1] * r2 + 1e-9 * norms_all >= floor:
                a, z = self.lists[i, j]
                waiting.append((a, z))
                n += z - a
                if n >= batch:
                    rank()
        if waiting:
            rank()
        exact = np.cumsum(self.x[rows] * q, axis=1)[:, -1] if len(rows) else scores  # one term after the other
        best = np.lexsort((self.ids[rows], -exact))[:k]
        return self.ids[rows][best], exact[best]

    @property
    def largest(self) -> float:
        """Norm of the longest vector."""
        import numpy as np

        if not hasattr(self, "_largest"):
            self._largest = float(np.sqrt((self.x**2).sum(1).max())) if len(self.x) else 0.0
        return self._largest


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """``vec_id, embedding`` (doubles) of the vectors that take part, and their length."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.filter("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.filter(fine & F.exists("embedding", lambda x: x != 0)).withColumn("d", F.size("embedding"))
    most = rows.groupBy("d").count().orderBy(F.desc("count"), "d").first()
    d = most["d"] if most else 0
    return rows.filter(F.col("d") == d).select("vec_id", "embedding").distinct(), d


def search_all(vectors: DataFrame, *, k: int = 20, every: int = 20, sample: int = 8192, codebook: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest inner products of each vector whose id ``every`` divides."""
    import numpy as np

    spark, work = vectors.sparkSession, Workspace(vectors.sparkSession, "neighbours")
    rows, d = usable(vectors.select("vec_id", "embedding"))
    rows = work.keep(rows, "vectors")
    n, n_queries = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    kinds = "query_id long, rank int, vec_id long, score double"
    if not n or not n_queries:
        return spark.createDataFrame([], kinds)
    most = rows.select(F.xxhash64("vec_id").alias("h")).orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    taken = rows.filter(F.xxhash64("vec_id") <= F.lit(most)).limit(2 * sample).toArrow()  # at most twice the sample
    x = np.array(taken["embedding"].combine_chunks().flatten()).reshape(-1, d)
    x = x[np.lexsort(x.T[::-1])]
    size = codebook or min(256, max(4, round((n / 256) ** 0.5)))
    books = [k_means(x[:, part], size) for part in (slice(None, d // 2), slice(d // 2, None))]

    def assign(batches):
        import pyarrow as pa

        for b in batches:
            x = np.array(b["embedding"].flatten()).reshape(-1, d)
            own = [nearest(part, c) if len(part) else np.zeros(0, int) for part, c in zip((x[:, : d // 2], x[:, d // 2 :]), books, strict=True)]
            yield pa.RecordBatch.from_arrays([b["vec_id"], pa.array([v.tobytes() for v in x], pa.binary()), *[pa.array(o.astype(np.int32)) for o in own]], ["vec_id", "v", "c1", "c2"])

    coded = work.keep(rows.mapInArrow(worker(assign), "vec_id long, v binary, c1 int, c2 int"), "coded")
    shard_rows, block_rows = min(131_072, max(2048, n // 16)), min(32_768, max(256, n_queries // 4))
    plan, shard, room = [], 0, shard_rows
    for c1, c2, count in sorted(tuple(r) for r in coded.groupBy("c1", "c2").count().collect()):  # one row for each cell
        pieces = -(-count // shard_rows)
        if pieces > 1 or count > room:
            shard, room = shard + 1, shard_rows
        plan.append((c1, c2, shard, pieces))
        shard, room = (shard + pieces, shard_rows) if pieces > 1 else (shard, room - count)
    shards, blocks = shard + 1, -(-n_queries // block_rows)
    cells = F.broadcast(spark.createDataFrame(plan, "c1 int, c2 int, first int, pieces int"))
    task = lambda c, m: F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(c)
    data = coded.join(cells, ["c1", "c2"]).select("vec_id", "v", "c1", "c2", (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("pieces"))).cast("int").alias("shard"), task("block", blocks))
    queries = coded.filter(F.col("vec_id") % every == 0).select(
        F.col("vec_id").alias("query"), F.col("v").alias("qv"), F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(blocks)).cast("int").alias("in_block"), task("in_shard", shards)
    )

    def run(key, data, queries):
        import pandas as pd

        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)], []
        vectors = lambda v: np.frombuffer(b"".join(v), np.float64).reshape(-1, d)
        if len(data) and len(queries):
            index = Shard(data["vec_id"].to_numpy(), vectors(data["v"]), data[["c1", "c2"]].to_numpy(), books)
            for own, q in zip(queries["query"].to_numpy(), vectors(queries["qv"]), strict=True):
                ids, scores = index.search(own, q, k)
                out[1].append((np.full(len(ids), own), ids, scores))
        columns = [np.concatenate([*x]) for x in zip(*out[1], strict=True)] if out[1] else out[0]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))

    found = data.groupBy("shard", "block").cogroup(queries.groupBy("in_shard", "in_block")).applyInPandas(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # k rows of each shard
    return found.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
