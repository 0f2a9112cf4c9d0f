"""Operator 11: vectors whitened by refined eigenvectors of their distributed covariance.

Entries become integers. The fit list holds each different vector once; its size and sums per
dimension are exact. Every task multiplies its centred vectors (``n * x - S``, exact, then over
``n``) and gives one matrix; tasks that each own some rows of the matrix add them up. Only that
matrix, of dimension by dimension numbers, reaches the driver.

Eigenvectors are solved in single precision and then corrected by Ogita-Aishima iterations:
matrix products in extended precision give the residual of orthogonality and of the
decomposition, from which follows a correction of all vectors at once. Where eigenvalues lie
closer than the residual can tell apart (a cluster), the vectors are only made orthogonal, and a
small eigenproblem in the space they span, shifted by the mean eigenvalue of the cluster, turns
them into place; the next iteration then has a smaller residual to tell them apart by.

Defined results: rows whose vector is null or holds null, infinite or NaN entries are dropped.
The dimension is the most frequent length in the fit list (of equally frequent ones the
longest), rows of other lengths are dropped. Repeated rows and null ids are returned each;
components whose eigenvalue is not above ``LEAST`` of the largest are left out, so equal vectors
or an empty table give no rows. Entries must be small enough for ``n * x`` to fit a long.
Dimensions of some thousands are meant: workers hold one matrix each. Further columns are not
looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from hodos.llm.common import table
from hodos.session import scratch

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Eigenvalues up to this share of the largest are rounding, not spread.
LEAST = 1e-12
#: Vectors multiplied at once, and rows of the matrix that are added up together.
CHUNK, ROWS = 8_192, 64
#: Iterations at most; two or three suffice without clusters.
MOST = 30


def usable(vector: Column) -> Column:
    """Whether a vector is there and all of its entries are finite numbers."""
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))


def integers(vector: Column, shift: int = 0) -> Column:
    """Each entry c as ``floor(64 * c) + shift``."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(shift).cast("long"))


# --- eigenvectors on the driver, of one matrix -----------------------------------------


def _clusters(values: np.ndarray, apart: float) -> list[slice]:
    """Runs of falling ``values`` whose neighbours are no further than ``apart``, of two or more."""
    edges = np.r_[0, np.flatnonzero(values[:-1] - values[1:] > apart) + 1, len(values)]
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:]) if b - a > 1]


def refined(matrix: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(falling eigenvalues, unit eigenvectors as columns) of a symmetric matrix."""
    size = len(matrix)
    scale = np.abs(matrix).max(initial=0)
    if not scale:
        return np.zeros(size), np.eye(size)
    a = (matrix / scale).astype(np.longdouble)
    a = (a + a.T) / 2
    x = (np.linalg.eigh((matrix / scale).astype(np.float32))[1] if start is None else start).astype(np.longdouble)
    one, tiny = np.eye(size, dtype=np.longdouble), np.finfo(np.longdouble).eps
    length, before = np.sqrt((a * a).sum()), np.inf
    for _ in range(MOST):
        r = one - x.T @ x
        s = x.T @ (a @ x)
        s = (s + s.T) / 2
        values = np.diag(s) / (1 - np.diag(r))
        order = np.argsort(-values, kind="stable")
        x, values, r, s = x[:, order], values[order], r[np.ix_(order, order)], s[np.ix_(order, order)]
        off = s - np.diag(values)
        apart = 2 * (np.sqrt((off * off).sum()) + length * np.sqrt((r * r).sum()))
        gap = values[None, :] - values[:, None]
        close = np.abs(gap) <= apart
        e = np.where(close, r / 2, (s + values[None, :] * r) / np.where(close, 1, gap))
        x = x + x @ e
        turned = 0.0
        for at in _clusters(values, float(apart)):
            part = x[:, at]
            inner = part.T @ (a @ part) - values[at].mean() * (part.T @ part)
            inner = (inner + inner.T) / 2
            top = np.abs(inner).max()
            if top > 64 * size * tiny:  # below that the eigenvalues are equal as far as can be told
                turn = np.linalg.eigh((inner / top).astype(np.float64))[1][:, ::-1]
                x[:, at] = part @ turn.astype(np.longdouble)
                turned = max(turned, float(np.abs(inner - np.diag(np.diag(inner))).max()))
        left = max(float(np.abs(e).max()), turned)
        if left < 1e-17 or (before < 1e-6 and left > before / 2):  # done, or down to rounding
            break
        before = left
    for _ in range(2):
        x = x + x @ (one - x.T @ x) / 2
    values = np.einsum("ij,ij->j", x, a @ x) / np.einsum("ij,ij->j", x, x)
    order = np.argsort(-values, kind="stable")
    x = x[:, order] / np.sqrt(np.einsum("ij,ij->j", x, x))[order]
    signs = np.sign(x[np.abs(x).argmax(0), np.arange(size)])
    return (values[order] * scale).astype(np.float64), (x * signs).astype(np.float64)


# --- sums over all tasks ----------------------------------------------------------------


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)


def _summed(frame: DataFrame, size: int, width: int, product) -> np.ndarray:
    """Sum over all rows of ``product(vectors)``, matrices of ``width`` by ``width``."""

    def each(batches):
        total = np.zeros((width, width))
        for batch in batches:
            for a in range(0, batch.num_rows, CHUNK):
                total += product(_matrix(batch["x"].slice(a, CHUNK), size))
        blocks = range(0, width, ROWS)
        yield pa.RecordBatch.from_arrays([pa.array([b // ROWS for b in blocks], pa.int32()), pa.array([total[b : b + ROWS].tobytes() for b in blocks], pa.binary())], names=["block", "part"])

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, part in zip(batch["block"].to_pylist(), batch["part"]):
                part = np.frombuffer(part.as_buffer(), np.float64)
                held[block] = held[block] + part if block in held else part.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([p.tobytes() for p in held.values()], pa.binary())], names=["block", "part"])

    kinds = "block int, part binary"
    parts = frame.mapInArrow(each, kinds).repartition(F.col("block")).mapInArrow(add, kinds).collect()
    total = np.zeros((width, width))
    for block, part in parts:
        total[block * ROWS : (block + 1) * ROWS] += np.frombuffer(part, np.float64).reshape(-1, width)
    return total


def _sums(frame: DataFrame, size: int) -> np.ndarray:
    """Exact sums per dimension."""

    def each(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += _matrix(batch["x"], size).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["at", "total"])

    rows = frame.mapInArrow(each, "at int, total long").groupBy("at").agg(F.sum("total").alias("total")).collect()
    out = np.zeros(size, np.int64)
    for at, total in rows:
        out[at] = total
    return out


def fitted(vectors: DataFrame, components: int = COMPONENTS) -> dict | None:
    """What column ``x`` (arrays of longs) of ``vectors`` gives: ``n``, ``sums``, ``vectors`` and
    ``values`` of at most ``components`` components, ``explained`` and ``identity_error``; None
    without a single component."""
    spark = vectors.sparkSession
    folder = scratch(spark, "whitening")
    vectors.select("x").distinct().write.parquet(f"{folder}/fit")
    fit = spark.read.parquet(f"{folder}/fit")
    lengths = fit.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    if not lengths or not lengths[0][0]:
        return None
    size, n = lengths[0]
    fit = fit.filter(F.size("x") == size)
    sums = _sums(fit, size)

    def centred(x: np.ndarray) -> np.ndarray:
        return (n * x - sums).astype(np.float64) / n

    def outer(x: np.ndarray) -> np.ndarray:
        c = centred(x)
        return c.T @ c

    covariance = _summed(fit, size, size, outer) / n
    values, columns = refined(covariance)
    kept = min(components, int((values > LEAST * max(values[0], 0)).sum()) if values[0] > 0 else 0)
    if not kept:
        return None
    values, columns, trace = values[:kept], columns[:, :kept], np.trace(covariance)
    project = columns / np.sqrt(values)

    def spread(x: np.ndarray) -> np.ndarray:
        w = centred(x) @ project
        return w.T @ w

    error = np.abs(_summed(fit, size, kept, spread) / n - np.eye(kept)).max()
    return {"size": size, "n": n, "sums": sums, "values": values, "vectors": columns, "explained": values / trace, "identity_error": float(error)}


def transformed(rows: DataFrame, model: dict) -> DataFrame:
    """Columns of ``rows`` but ``x``, with ``deviation`` (exact, of up to 38 digits) and
    ``whitened``, one number a component; rows of another length than the model's are left out."""
    size, n, sums = model["size"], model["n"], model["sums"]
    project = model["vectors"] / np.sqrt(model["values"])
    others = [f for f in rows.schema.fields if f.name != "x"]
    kinds = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in others] + ["deviation decimal(38,0)", "whitened array<double>"])

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, CHUNK):
                part = batch.slice(a, CHUNK)
                d = n * _matrix(part["x"], size) - sums
                top = int(np.abs(d).max(initial=0))
                exact = d if top * top * size < 1 << 63 else d.astype(object)
                white = (d.astype(np.float64) / n) @ project
                cuts = pa.array(np.arange(len(d) + 1, dtype=np.int32) * white.shape[1])
                deviation = pa.array((exact * exact).sum(1).tolist(), pa.int64() if exact is d else pa.decimal128(38, 0)).cast(pa.decimal128(38, 0))
                arrays = [part[f.name] for f in others] + [deviation, pa.ListArray.from_arrays(cuts, pa.array(white.ravel()))]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in others] + ["deviation", "whitened"])

    return rows.filter(F.size("x") == size).mapInArrow(run, kinds)


def whitening(spark, sf_dir: str) -> DataFrame:
    """op11: one row for each usable vector of ``embeddings`` and component."""
    given = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    rows = given.filter(usable(F.col("embedding"))).select("vec_id", integers(F.col("embedding"), SHIFT).alias("x"))
    model = fitted(rows)
    if model is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    shares = F.array(*[F.lit(float(v)) for v in model["explained"]])
    each = transformed(rows, model).select("vec_id", F.col("deviation").cast("long").alias("deviation"), F.posexplode("whitened").alias("place", "whitened"))
    return each.select(
        "vec_id", (F.col("place") + 1).alias("component"), F.lit(model["n"]).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(shares, F.col("place") + 1).alias("explained"), F.lit(model["identity_error"]).alias("identity_error"),
    )
