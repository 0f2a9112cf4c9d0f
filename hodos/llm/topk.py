"""Operator 13: exact top-k by inner product through a pivot-distance index.

Every vector is keyed by its nearest pivot and its distance from it, in rings of equal width: a
(pivot, ring) is an annulus. The index lists vectors by annulus, large annuli over many tasks.
A query orders all annuli by how near they can come to it, which the triangle inequality bounds
by its own distance from their pivot, and expands them in rounds of ``GROWTH`` times more vectors
each. After a round its k-th best score is known; an annulus is skipped where the bound on its
distance, with its largest norm, shows that no vector in it can score as much:
``2 q.x = |q|^2 + |x|^2 - |q - x|^2``. The last round expands all annuli that are left, so the
result is exact at every size; a bound that skips little costs time only.

Tasks hold one group of at most ``QUERY_ROWS`` queries at a time, read from the shared folder, and
score runs of an annulus against those queries that still need it, in one matrix product. From a
task leave at most k rows a query, of those that reach its k-th best score so far.

Pivots are chosen from a sample of at most ``SAMPLE`` vectors, by hash; every vector is indexed.
The table of annuli (at most ``PIVOTS`` * ``RINGS`` rows) is all that is collected besides.

Defined results: null vectors and those with null, infinite or NaN entries take no part, neither
as queries nor as candidates. A shorter vector counts as continued by zeros. Repeated rows are
candidates each, and queries each if their id makes them so; a row is not a candidate of its own
only. Null ids are candidates, after all others of their score. Scores and squared norms have to
fit a long. Further columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Window, functions as F

from hodos.llm.common import table
from hodos.llm.whitening import integers, usable
from hodos.session import scratch, shuffle_tasks

K, DIVISOR = 20, 20
PIVOTS, RINGS, SAMPLE = 64, 16, 2_048
#: Vectors a query looks at in its first round, and how many times more in each further one.
FIRST, GROWTH = 1_024, 8
#: Queries a task holds at a time; vectors it scores them against; scores looked through at once.
QUERY_ROWS, CHUNK, CELLS = 1 << 16, 1 << 15, 1 << 22
LOWEST = -(1 << 62)


def _padded(column: pa.Array, size: int) -> np.ndarray:
    """The arrays of a column as rows of ``size`` longs, zeros behind the shorter ones."""
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), size), np.int64)
    out[np.arange(size)[None, :] < lengths[:, None]] = column.flatten().to_numpy()
    return out


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    x, pivots = x.astype(np.float64), pivots.astype(np.float64)
    squared = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(squared, 0))


def _chosen(sample: np.ndarray) -> np.ndarray:
    """Pivots from the sample: one after the other the vector furthest from those chosen."""
    picked = [0]
    nearest = _distances(sample, sample[:1])[:, 0]
    while len(picked) < PIVOTS and nearest.max() > 0:
        picked.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, _distances(sample, sample[picked[-1:]])[:, 0])
    return sample[picked]


class Annuli:
    """The bounds of all annuli: pivot, ring, vectors, least and largest distance, largest squared norm."""

    def __init__(self, pivots: np.ndarray, rows: list):
        self.pivots = pivots
        rows = sorted(rows)
        self.pivot, self.ring, self.count = (np.array([r[j] for r in rows], np.int64) for j in range(3))
        self.least, self.most, self.norm = (np.array([r[j] for r in rows], np.float64) for j in range(3, 6))
        self.place = {(int(p), int(g)): i for i, (p, g) in enumerate(zip(self.pivot, self.ring))}

    def nearest(self, own: np.ndarray, at) -> np.ndarray:
        """How near vectors of the annuli ``at`` can come to queries ``own`` far from the pivots."""
        far = own[:, self.pivot[at]]
        bound = np.maximum(np.maximum(far - self.most[at], self.least[at] - far), 0)
        return np.maximum(bound - 1e-6 * (far + self.most[at] + 1), 0)  # for rounding

    def radii(self, own: np.ndarray, coverage: list[int]) -> np.ndarray:
        """For each query how near annuli have to come for it to see the vectors of each round."""
        near = self.nearest(own, slice(None))
        order = np.argsort(near, axis=1)
        near, seen = np.take_along_axis(near, order, 1), np.cumsum(self.count[order], axis=1)
        last = near.shape[1] - 1
        return np.stack([near[np.arange(len(near)), np.minimum((seen < c).sum(1), last)] for c in coverage], axis=1)


def _group(folder: str, group: int, size: int, pivots: np.ndarray) -> dict:
    """The queries of a group, read from the shared folder; the last one read is kept."""
    if (folder, group) in _held:
        return _held[folder, group]
    _held.clear()
    files, base = fs.FileSystem.from_uri(f"{folder}/part={group}")
    found = [f.path for f in files.get_file_info(fs.FileSelector(base, allow_not_found=True)) if f.path.endswith(".parquet")]
    read = [pq.ParquetFile(files.open_input_file(f)).read() for f in sorted(found)]
    if not read:
        return {}
    t = pa.concat_tables(read).combine_chunks()
    v = _padded(t["v"].combine_chunks() if isinstance(t["v"], pa.ChunkedArray) else t["v"], size)
    out = {c: t[c].to_numpy() for c in ("row", "floor", "since", "until")}
    _held[folder, group] = out | {"v": v, "norm": (v * v).sum(1).astype(np.float64), "own": _distances(v, pivots)}
    return _held[folder, group]


_held: dict[tuple[str, int], dict] = {}


class Best:
    """The k best candidates of each query of a group, as far as they reach its floor."""

    def __init__(self, floor: np.ndarray, k: int):
        self.floor, self.k, self.hits, self.pending = floor.astype(np.int64).copy(), k, [], 0

    def add(self, query: np.ndarray, score: np.ndarray, vec: np.ndarray, null: np.ndarray, row: np.ndarray) -> None:
        self.hits.append((query, score, vec, null, row))
        self.pending += len(query)
        if self.pending > CELLS:
            self.settle()

    def settle(self) -> tuple[np.ndarray, ...]:
        """Only the best are kept; a query that has k raises its floor."""
        parts = [np.concatenate([h[j] for h in self.hits]) if self.hits else np.zeros(0, np.int64) for j in range(5)]
        query, score, vec, null, row = parts
        order = np.lexsort((row, vec, null, -score, query))
        sorted_query = query[order]
        first = np.searchsorted(sorted_query, sorted_query)
        rank = np.arange(len(order)) - first
        full = rank == self.k - 1
        self.floor[sorted_query[full]] = np.maximum(self.floor[sorted_query[full]], score[order[full]])
        kept = order[rank < self.k]
        best = tuple(p[kept] for p in parts)
        self.hits, self.pending = [best], 0
        return best


def _expanded(index: DataFrame, folder: str, groups: int, annuli: Annuli, size: int, kind, k: int) -> DataFrame:
    """(query, vec_id, row, score): from each chunk of the index at most k rows a query."""

    def chunks(batches):
        held, rows = [], 0
        for batch in batches:
            for a in range(0, batch.num_rows, CHUNK):
                part = batch.slice(a, CHUNK)
                if rows + part.num_rows > CHUNK and held:
                    yield pa.Table.from_batches(held).combine_chunks()
                    held, rows = [], 0
                held.append(part)
                rows += part.num_rows
        if held:
            yield pa.Table.from_batches(held).combine_chunks()

    def run(batches):
        for chunk in chunks(batches):
            x = _padded(chunk["v"].combine_chunks() if isinstance(chunk["v"], pa.ChunkedArray) else chunk["v"], size).astype(kind)
            pivot, ring, row = (chunk[c].to_numpy() for c in ("pivot", "ring", "row"))
            null = np.asarray(chunk["vec_id"].is_null()).astype(np.int64)
            vec = chunk["vec_id"].fill_null(0).to_numpy()
            edges = np.r_[0, np.flatnonzero((pivot[1:] != pivot[:-1]) | (ring[1:] != ring[:-1])) + 1, len(pivot)]
            for group in range(groups):
                asked = _group(folder, group, size, annuli.pivots)
                if not asked:
                    continue
                best = Best(asked["floor"], k)
                queries = asked["v"].astype(kind)
                for a, b in zip(edges[:-1], edges[1:]):
                    at = np.array([annuli.place[int(pivot[a]), int(ring[a])]])
                    near = annuli.nearest(asked["own"], at)[:, 0]
                    reach = (asked["norm"] + annuli.norm[at] - near * near) / 2
                    due = (near > asked["since"]) & (near <= asked["until"])
                    needed = np.flatnonzero(due & (reach * (1 + 1e-9) + 1 >= best.floor))
                    step = max(1, CELLS // max(1, b - a))
                    for j in range(0, len(needed), step):
                        some = needed[j : j + step]
                        scores = queries[some] @ x[a:b].T
                        q, c = np.nonzero(scores >= best.floor[some].astype(kind)[:, None])
                        found, place = some[q], a + c
                        other = asked["row"][found] != row[place]
                        found, place = found[other], place[other]
                        best.add(found, scores[q[other], c[other]].astype(np.int64), vec[place], null[place], row[place])
                query, score, ids, missing, rows = best.settle()
                yield pa.RecordBatch.from_arrays([pa.array(asked["row"][query]), pa.array(ids, mask=missing.astype(bool)), pa.array(rows), pa.array(score)], names=["query", "vec_id", "row", "score"])

    return index.select("pivot", "ring", "row", "vec_id", "v").mapInArrow(run, "query long, vec_id long, row long, score long")


def searched(vectors: DataFrame, is_query, k: int = K) -> DataFrame:
    """query_id, rank, vec_id and score of the k best candidates of every query.

    ``vectors`` has ``vec_id`` and ``v`` (array of longs); ``is_query`` is a condition on ``vec_id``.
    """
    spark = vectors.sparkSession
    folder = scratch(spark, "topk")
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), "v").write.parquet(f"{folder}/vectors")
    rows = spark.read.parquet(f"{folder}/vectors")
    size, n, asked = rows.agg(F.max(F.size("v")), F.count(F.lit(1)), F.count_if(is_query)).first()
    if not asked:
        return none
    size = max(size, 1)
    sample = [r.v for r in rows.orderBy(F.xxhash64("row")).limit(SAMPLE).collect()]
    sample = np.array([v + [0] * (size - len(v)) for v in sample], np.int64)
    pivots = _chosen(sample)
    width = max(1.0, 1.25 * float(_distances(sample, pivots).min(1).max()) / RINGS)

    def key(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, CHUNK):
                part = batch.slice(a, CHUNK)
                v = _padded(part["v"], size)
                far = _distances(v, pivots)
                pivot = far.argmin(1)
                distance = far[np.arange(len(far)), pivot]
                ring = np.minimum(distance / width, RINGS - 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part["row"], part["vec_id"], part["v"], pa.array(pivot.astype(np.int32)), pa.array(ring), pa.array(distance), pa.array((v * v).sum(1))], names=["row", "vec_id", "v", "pivot", "ring", "distance", "norm"])

    rows.mapInArrow(key, "row long, vec_id long, v array<long>, pivot int, ring int, distance double, norm long").write.parquet(f"{folder}/keyed")
    keyed = spark.read.parquet(f"{folder}/keyed")
    found = keyed.groupBy("pivot", "ring").agg(F.count(F.lit(1)), F.min("distance"), F.max("distance"), F.max("norm")).collect()
    annuli = Annuli(pivots, [tuple(r) for r in found])
    keyed.repartitionByRange(shuffle_tasks(spark), "pivot", "ring", "row").sortWithinPartitions("pivot", "ring").select("pivot", "ring", "row", "vec_id", "v").write.parquet(f"{folder}/index")
    index = spark.read.parquet(f"{folder}/index")
    # a product and all of its partial sums are at most the largest squared norm
    top = max(r[5] for r in found)
    kind = np.float32 if top < 1 << 24 else np.float64 if top < 1 << 53 else np.int64

    coverage = []
    while FIRST * GROWTH ** len(coverage) < n:
        coverage.append(FIRST * GROWTH ** len(coverage))

    def rounds(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                radii = annuli.radii(_distances(_padded(part["v"], size), pivots), coverage) if coverage else np.zeros((part.num_rows, 0))
                cuts = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * len(coverage))
                yield pa.RecordBatch.from_arrays([part["row"], part["vec_id"], part["v"], pa.ListArray.from_arrays(cuts, pa.array(radii.ravel()))], names=["row", "vec_id", "v", "radii"])

    groups = -(-asked // QUERY_ROWS)
    rows.filter(is_query).mapInArrow(rounds, "row long, vec_id long, v array<long>, radii array<double>").write.parquet(f"{folder}/queries")
    queries = spark.read.parquet(f"{folder}/queries")
    best = None
    by_score = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    for j in range(len(coverage) + 1):
        floors = queries
        if best is not None:
            floor = best.filter(F.col("rank") == k).select(F.col("query").alias("row"), F.col("score").alias("floor"))
            floors = queries.join(floor, "row", "left")
        floors = floors.select(
            "row", "v", (F.coalesce("floor", F.lit(LOWEST)) if best is not None else F.lit(LOWEST)).cast("long").alias("floor"),
            (F.element_at("radii", j) if j else F.lit(-1.0)).alias("since"), (F.element_at("radii", j + 1) if j < len(coverage) else F.lit(float("inf"))).alias("until"),
            F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int").alias("part"),
        )
        floors.repartition(F.col("part")).write.partitionBy("part").parquet(f"{folder}/round-{j}")
        new = _expanded(index, f"{folder}/round-{j}", groups, annuli, size, kind, k)
        both = new if best is None else new.unionByName(best.drop("rank"))
        both.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k).write.parquet(f"{folder}/best-{j}")
        best = spark.read.parquet(f"{folder}/best-{j}")
    ids = queries.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"))
    return best.join(ids, "query").select("query_id", "rank", "vec_id", "score")


def exact_topk(spark, sf_dir: str) -> DataFrame:
    """op13: the best candidates of every query of ``embeddings``."""
    given = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    vectors = given.filter(usable(F.col("embedding"))).select("vec_id", integers(F.col("embedding")).alias("v"))
    return searched(vectors, F.col("vec_id") % DIVISOR == 0)


SQL = r"""
WITH vectors AS (
  SELECT row_number() OVER () AS place, vec_id, list_transform(embedding, lambda c: CAST(floor(CAST(c AS DOUBLE) * 64) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
scored AS (
  SELECT q.place, q.vec_id AS query_id, x.vec_id, x.place AS other,
    CAST(coalesce(list_sum(list_transform(list_zip(q.v, x.v), lambda p: coalesce(p[1] * p[2], 0))), 0) AS BIGINT) AS score
  FROM vectors q JOIN vectors x ON q.vec_id % 20 = 0 AND q.place <> x.place),
ranked AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id NULLS LAST, other) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""
