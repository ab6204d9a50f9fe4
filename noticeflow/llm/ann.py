"""Approximate nearest neighbours with an inverted multi-index.

The two halves of the vectors are quantised separately, so that K + K centroids
make K * K cells; K grows with the square root of the vectors, so cells keep
their size.  A query visits the cells in the order of its summed distances to
both halves' centroids, which a heap yields pair by pair, until the cells hold a
budget of entries; these entries are ranked again by their distance in double
precision.

The centroids come from k-means on a bounded sample (``SAMPLE`` vectors, the
first in hash order of their ids); every vector is indexed.  The budget is
learnt: the true neighbours of ``PROBES`` queries, found by brute force in one
pass, say how many entries must be visited for the share ``recall`` of them.  So
clustered vectors get a small budget, and vectors without structure a large one.

Entries and queries are compared in blocks of bounded size: the vectors of one
first centroid in chunks, against chunks of the queries that visit it, each block
keeping every query's best.  So a cell that holds a third of all vectors is many
blocks.

Defined cases: vectors that are null, empty, zero, hold null or non-finite
components, or differ in length from the most frequent length of the searched
vectors take no part; ties go to the smaller id; every row of ``queries`` is a
query of its own, and only its own row (one row of its id and vector) is no
candidate, other rows of its id are; an empty table gives no rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import scratch, staged, table

SAMPLE, KMEANS_STEPS, LEAST_CENTROIDS, MOST_CENTROIDS, CELL_ENTRIES = 16_384, 15, 16, 1024, 12
RECALL, PROBES, LEAST_ENTRIES = 0.96, 128, 512
ENTRY_CHUNK, QUERY_CHUNK = 20_000, 2_000


def _square_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1), 0)


def kmeans(x: np.ndarray, k: int, steps: int = KMEANS_STEPS, seed: int = 11) -> np.ndarray:
    """At most ``k`` centroids, started on distinct vectors."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    c = distinct[rng.permutation(len(distinct))[:k]].copy()
    for _ in range(steps):
        at = _square_distances(x, c).argmin(1)
        n = np.bincount(at, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def visit(d1: np.ndarray, d2: np.ndarray, counts: np.ndarray, enough: float) -> list[tuple[int, int]]:
    """Pairs of centroids by summed distance until their cells hold ``enough`` entries; empty cells are left out."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    heap, seen, got, out = [(d1[o1[0]] + d2[o2[0]], 0, 0)], {(0, 0)}, 0, []
    while heap and got < enough:
        _, i, j = heapq.heappop(heap)
        a, b = int(o1[i]), int(o2[j])
        if counts[a, b]:
            got += int(counts[a, b])
            out.append((a, b))
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(o1) and y < len(o2) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (d1[o1[x]] + d2[o2[y]], x, y))
    return out


def _matrix(col) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy().astype(float).reshape(len(col), -1)


def usable(vectors: DataFrame, id_col: str, vector_col: str, length: int | None = None) -> tuple[DataFrame, int]:
    """vec_id, v (doubles) of the vectors that take part, and their length: by default the most frequent one."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(finite & F.exists("v", lambda x: x != 0))
    if length is None:
        usual = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
        length = usual["d"] if usual else 0
    return rows.filter(F.size("v") == length), length


def _distances(x: np.ndarray, halves: list[np.ndarray]) -> list[np.ndarray]:
    """Square distances of both halves to their centroids."""
    half = x.shape[1] // 2
    return [_square_distances(x[:, part], c) for part, c in zip((slice(0, half), slice(half, None)), halves, strict=True)]


def _true_cells(entries: DataFrame, probes: np.ndarray, k: int) -> list:
    """(probe, c1, c2) of each probe's ``k`` nearest entries, by brute force; a batch and then a partition keep their best."""

    def nearest(batches):
        for batch in batches:
            x = _matrix(batch.column("v"))
            d = _square_distances(probes, x)
            best = np.argsort(d, axis=1, kind="stable")[:, :k]
            probe, at = np.repeat(np.arange(len(probes)), best.shape[1]), best.ravel()
            cols = [pa.array(probe.astype(np.int32)), pa.array(d[probe, at]), *(batch.column(c).take(pa.array(at)) for c in ("c1", "c2"))]
            yield pa.RecordBatch.from_arrays(cols, ["probe", "d", "c1", "c2"])

    found = entries.select("v", "c1", "c2").mapInArrow(nearest, "probe int, d double, c1 int, c2 int")
    order = Window.partitionBy("probe").orderBy("d", "c1", "c2")
    return found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k).select("probe", "c1", "c2").collect()


def entry_budget(probes: np.ndarray, cells: list, halves: list[np.ndarray], counts: np.ndarray, recall: float) -> float:
    """Entries to visit so that the share ``recall`` of the probes' true neighbours is met; cells: (probe, c1, c2)."""
    d1, d2 = _distances(probes, halves)
    need = []
    for i, a, b in cells:
        sums = d1[i][:, None] + d2[i]
        need.append(counts[sums <= sums[a, b]].sum())
    return float(np.quantile(need, recall)) if need else float(counts.sum())


def listed(sorted_cells: np.ndarray, cells: list[int]) -> np.ndarray:
    """The places of some distinct cells' entries in a list that is sorted by cell; nothing else is looked at."""
    first, last = np.searchsorted(sorted_cells, cells, "left"), np.searchsorted(sorted_cells, cells, "right")
    return np.concatenate([np.arange(a, b) for a, b in zip(first, last, strict=True)] or [np.arange(0)])


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL, centroids: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` nearest vectors found, by Euclidean distance."""
    with scratch(vectors.sparkSession):
        return _search(vectors, queries, k, id_col, vector_col, recall, centroids)


def _search(vectors: DataFrame, queries: DataFrame, k: int, id_col: str, vector_col: str, recall: float, centroids: int | None) -> DataFrame:
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    rows, length = usable(vectors, id_col, vector_col)
    sample = np.array([r.v for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()], float)
    if not len(sample):
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    size = len(sample) if len(sample) < SAMPLE else rows.count()
    centroids = centroids or min(MOST_CENTROIDS, max(LEAST_CENTROIDS, int((size / CELL_ENTRIES) ** 0.5)))
    half = length // 2
    halves = [kmeans(sample[:, part], centroids) for part in (slice(0, half), slice(half, None))]
    del sample

    def assign(batches):
        for batch in batches:
            cell = [pa.array(d.argmin(1).astype(np.int32)) for d in _distances(_matrix(batch.column("v")), halves)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cell], ["vec_id", "v", "c1", "c2"])

    entries = staged(rows.mapInArrow(assign, f"vec_id {kind}, v array<double>, c1 int, c2 int"), "multi-index", keep=True)
    counts = np.zeros((len(halves[0]), len(halves[1])), np.int64)
    held = entries.groupBy("c1", "c2").count().toArrow()  # K * K rows at most
    counts[held.column("c1").to_numpy(), held.column("c2").to_numpy()] = held.column("count").to_numpy()
    asked = usable(queries, id_col, vector_col, length)[0].select(F.monotonically_increasing_id().alias("query"), "vec_id", "v")
    asked = staged(asked, "queries")
    probes = np.array([r.v for r in asked.orderBy(F.xxhash64("vec_id"), "query").limit(PROBES).collect()], float)
    if not len(probes):
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    enough = max(LEAST_ENTRIES, entry_budget(probes, _true_cells(entries, probes, k + 1), halves, counts, recall))

    def probe(batches):
        for batch in batches:
            d = _distances(_matrix(batch.column("v")), halves)
            take, c1, c2 = [], [], []
            for i in range(len(batch)):
                lists: dict[int, list[int]] = {}
                for a, b in visit(d[0][i], d[1][i], counts, enough):
                    lists.setdefault(a, []).append(b)
                take += [i] * len(lists)
                c1 += list(lists)
                c2 += list(lists.values())
            part = batch.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(c1, pa.int32()), pa.array(c2, pa.list_(pa.int32()))], ["query", "vec_id", "v", "c1", "cells"])

    right = asked.repartition("query").mapInArrow(probe, f"query bigint, vec_id {kind}, v array<double>, c1 int, cells array<int>")
    right = staged(right, "query-cells", keep=True)
    visits = dict(tuple(r) for r in right.groupBy("c1").count().collect())
    per = lambda n, size: max(1, -(-int(n) // size))
    lookup = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("c1") + 1)
    chunks, parts = lookup([per(n, ENTRY_CHUNK) for n in counts.sum(1)]), lookup([per(visits.get(c, 0), QUERY_CHUNK) for c in range(len(counts))])
    left = entries.withColumn("chunk", F.pmod(F.xxhash64("vec_id", "v"), chunks).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    right = right.withColumn("part", F.pmod(F.xxhash64("query"), parts).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1)))

    def rank(e: pa.Table, q: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        if len(e) and len(q):
            e = e.take(pa.array(np.argsort(e.column("c2").to_numpy(), kind="stable")))  # each cell's entries lie side by side
            x, y, ids, c2 = _matrix(e.column("v")), _matrix(q.column("v")), np.array(e.column("vec_id").to_pylist()), e.column("c2").to_numpy()
            for i, (query, own, cells) in enumerate(zip(q.column("query").to_pylist(), q.column("vec_id").to_pylist(), q.column("cells").to_pylist(), strict=True)):
                inside = listed(c2, cells)
                d = ((x[inside] - y[i]) ** 2).sum(1)
                if len(inside) > k + 1:
                    near = d <= np.partition(d, k)[k]
                    inside, d = inside[near], d[near]
                score = np.sqrt(d)
                best = np.lexsort((ids[inside], score))[: k + 1]
                chosen = inside[best]
                out[0] += [query] * len(best)
                out[1] += [own] * len(best)
                out[2] += ids[chosen].tolist()
                out[3] += score[best].tolist()
                out[4] += ((ids[chosen] == own) & (x[chosen] == y[i]).all(1)).tolist()
        id_type = e.schema.field("vec_id").type
        kinds = [pa.int64(), id_type, id_type, pa.float64(), pa.bool_()]
        return pa.table([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["query", "query_id", "vec_id", "score", "same"])

    keys = ["c1", "chunk", "part"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(rank, f"query bigint, query_id {kind}, vec_id {kind}, score double, same boolean")
    own = Window.partitionBy("query")
    found = found.withColumn("n", F.row_number().over(own.orderBy("score", "vec_id", F.desc("same")))).filter(F.col("n") <= k + 1)
    found = found.withColumn("itself", F.min(F.when(F.col("same"), F.col("n"))).over(own)).filter(F.col("itself").isNull() | (F.col("n") != F.col("itself")))
    found = found.withColumn("rank", F.col("n") - F.coalesce((F.col("n") > F.col("itself")).cast("int"), F.lit(0)))
    return found.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter(F.col("vec_id") % 100 == 0))
