"""Whitening of embeddings by principal components.

One pass counts the vectors and sums every dimension exactly; a second sums the
products of centred entries, in each task first, so that one matrix a task is
shuffled; the symmetric matrix (dimension x dimension, whatever the number of
rows) is reduced to tridiagonal form by Householder reflections, its leading
eigenvalues are found by bisection on Sturm counts, their vectors by inverse
iteration, orthogonalised again inside clusters of close eigenvalues, and
carried back; every row is projected on the broadcast components.

Entries are first put on a grid: x = floor(1024 * c) + 100000, a long.

Defined cases: vectors that are null, empty, of another than the commonest
dimension, or hold null or non-finite entries are dropped; zero vectors stay.
Rows that occur more than once count as often.  Entries beyond the grid's
range (2**62) are put at its ends.  Components whose eigenvalue is not above
rounding (dimension * 2**-52 of the trace) do not exist: vectors that are all
equal, or a single one, have none and give no rows, as an empty table does.
A deviation that does not fit a long is null.  Extra columns are not handed on.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import store
from vigil.llm.vectors import dimension, matrix

COMPONENTS = 8
SCALE, SHIFT, FAR = 1024.0, 100000, float(1 << 62)
LOW = (1 << 31) - 1


def finite(c: str) -> Column:
    """Not null or empty, no null or non-finite entry; zeros are allowed."""
    x = F.col(c).cast("array<double>")
    ok = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(ok & (F.size(x) > 0), F.lit(False))


def grid(col: pa.Array, dim: int) -> np.ndarray:
    """Vectors as longs."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(matrix(col, dim) * SCALE), -FAR, FAR).astype(np.int64) + SHIFT


# ------------------------------------------------------------ what is summed


def totals(vectors: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sums of every dimension."""
    def add(batches):
        n, high, low = 0, np.zeros(dim, np.int64), np.zeros(dim, np.int64)
        for b in batches:
            x = grid(b.column(0), dim)
            n, high, low = n + len(x), high + (x >> 31).sum(0), low + (x & LOW).sum(0)
        if n:
            yield pa.RecordBatch.from_pydict({"at": np.arange(dim, dtype=np.int32), "n": np.full(dim, n), "high": high,
                                              "low": low})

    got = (vectors.mapInArrow(add, "at int, n long, high long, low long").groupBy("at")
           .agg(F.sum("n").alias("n"), F.sum(F.col("high").cast("decimal(38,0)")).alias("high"),
                F.sum(F.col("low").cast("decimal(38,0)")).alias("low")).orderBy("at").collect())
    return (got[0].n, [(int(r.high) << 31) + int(r.low) for r in got]) if got else (0, [])


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n: the whole part of the mean leaves before anything is rounded."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return (x - whole).astype(np.float64) - rest


def covariance(vectors: DataFrame, dim: int, n: int, sums: list[int]) -> np.ndarray:
    """Covariance with divisor n.  Every task sums its own products first."""
    i, j = np.triu_indices(dim)

    def add(batches):
        total, seen = np.zeros((dim, dim)), False
        for b in batches:
            z = centred(grid(b.column(0), dim), n, sums)
            total, seen = total + z.T @ z, True
        for k in range(0, len(i) if seen else 0, 1 << 16):
            at = slice(k, k + (1 << 16))
            yield pa.RecordBatch.from_pydict({"i": i[at].astype(np.int32), "j": j[at].astype(np.int32),
                                              "v": total[i[at], j[at]]})

    out = np.zeros((dim, dim))
    for r in vectors.mapInArrow(add, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r.i, r.j] = out[r.j, r.i] = r.v / n
    return out


# ------------------------------------- eigenvalues of a small symmetric matrix


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, subdiagonal and Householder vectors (unit; the k-th acts on
    the elements after k) of the tridiagonal form of a symmetric matrix."""
    a, mirrors = v.copy(), []
    for k in range(len(a) - 2):
        x = a[k + 1:, k].copy()
        size = np.linalg.norm(x)
        x[0] += math.copysign(size, x[0])
        norm = np.linalg.norm(x)
        u = x / norm if norm > 0 else np.zeros_like(x)
        mirrors.append(u)
        a[k + 1:, k:] -= 2 * np.outer(u, u @ a[k + 1:, k:])
        a[k:, k + 1:] -= 2 * np.outer(a[k:, k + 1:] @ u, u)
    return np.diag(a).copy(), np.diag(a, -1).copy(), mirrors


def below(diag: np.ndarray, off: np.ndarray, at: np.ndarray, tiny: float) -> np.ndarray:
    """Sturm count: how many eigenvalues are smaller than each of ``at``."""
    q = diag[0] - at
    count = (q < 0).astype(np.int64)
    for d, o in zip(diag[1:], off, strict=True):
        q = np.where(np.abs(q) < tiny, -tiny, q)
        q = d - at - o * o / q
        count += q < 0
    return count


def leading(diag: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, each bisected to the last bit."""
    reach = np.abs(np.append(off, 0)) + np.abs(np.insert(off, 0, 0))
    low, high = np.full(k, (diag - reach).min()), np.full(k, (diag + reach).max())
    scale = max(float(np.abs(low).max()), float(np.abs(high).max()), 1e-300)
    low, high = low - scale * 1e-12, high + scale * 1e-12
    want = len(diag) - np.arange(k)             # the j-th largest has d - j eigenvalues up to itself
    for _ in range(200):
        mid = (low + high) / 2
        if ((mid <= low) | (mid >= high)).all():
            break
        over = below(diag, off, mid, scale * 1e-300) >= want
        high, low = np.where(over, mid, high), np.where(over, low, mid)
    return (low + high) / 2


def solve_shifted(diag: np.ndarray, off: np.ndarray, shift: float, b: np.ndarray, tiny: float) -> np.ndarray:
    """x with (T - shift) x = b by elimination with row exchanges; a pivot that
    vanishes is ``tiny``."""
    n = len(diag)
    main, up, up2, x = diag - shift, np.append(off, 0.0), np.zeros(n), b.copy()
    for i in range(n - 1):
        low = off[i]
        if abs(low) > abs(main[i]):
            f = main[i] / low
            main[i], next_up, next_up2 = low, main[i + 1], up[i + 1]
            main[i + 1], up[i + 1] = up[i] - f * next_up, -f * next_up2
            up[i], up2[i] = next_up, next_up2
            x[i], x[i + 1] = x[i + 1], x[i] - f * x[i + 1]
        else:
            main[i] = main[i] if abs(main[i]) >= tiny else tiny
            f = low / main[i]
            main[i + 1] -= f * up[i]
            x[i + 1] -= f * x[i]
    for i in range(n - 1, -1, -1):
        rest = (up[i] * x[i + 1] if i + 1 < n else 0.0) + (up2[i] * x[i + 2] if i + 2 < n else 0.0)
        x[i] = (x[i] - rest) / (main[i] if abs(main[i]) >= tiny else tiny)
        if abs(x[i]) > 1e150:
            x /= abs(x[i])
    return x


def eigenvectors(diag: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Columns: unit vectors by inverse iteration; each is made orthogonal to
    the earlier ones of its cluster (values closer than 1e-3 of the largest)
    at every step."""
    n, rng = len(diag), np.random.default_rng(12)
    scale = max(float(np.abs(diag).max()), float(np.abs(off).max()) if n > 1 else 0.0, 1e-300)
    out, start = np.zeros((n, len(values))), 0
    for j, value in enumerate(values):
        if j and values[j - 1] - value > 1e-3 * scale:
            start = j
        cluster, x = out[:, start:j], rng.standard_normal(n)
        for _ in range(6):
            x = solve_shifted(diag, off, value, x / np.linalg.norm(x), scale * 2.0 ** -52)
            x /= np.abs(x).max()
            for _ in range(2):
                x -= cluster @ (cluster.T @ x)
        out[:, j] = x / np.linalg.norm(x)
    return out


def principal(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading eigenvalues above rounding, falling, and unit eigenvectors as
    columns; the largest entry of each is positive."""
    dim, trace = len(v), float(np.trace(v))
    if not trace > 0:
        return np.zeros(0), np.zeros((dim, 0))
    diag, off, mirrors = tridiagonal(v)
    values = leading(diag, off, min(k, dim))
    values = values[values > dim * 2.0 ** -52 * trace]
    vectors = eigenvectors(diag, off, values)
    for at in range(len(mirrors) - 1, -1, -1):
        u = mirrors[at]
        vectors[at + 1:] -= 2 * np.outer(u, u @ vectors[at + 1:])
    for j in range(vectors.shape[1]):
        vectors[:, j] *= math.copysign(1 / np.linalg.norm(vectors[:, j]), vectors[np.abs(vectors[:, j]).argmax(), j])
    return values, vectors


# --------------------------------------------------------------------- rows


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum of (n * x - S) squared over the dimensions, exact."""
    whole, rest = [s // n for s in sums], [s % n for s in sums]
    z = x - np.array(whole, np.int64)                                # n * z - rest = n * x - S
    if len(x) and (float(np.abs(z.astype(np.float64)).max()) + 1) * n < math.sqrt(2.0 ** 62 / max(x.shape[1], 1)):
        return ((n * z - np.array(rest, np.int64)) ** 2).sum(1).tolist()
    exact = ((z.astype(object) * n - np.array(rest, object)) ** 2).sum(1) if len(x) else []
    return [int(e) if e < 1 << 63 else None for e in exact]


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
           components: int = COMPONENTS) -> DataFrame:
    """Per row and component: (id, component, n, deviation, whitened,
    explained, identity_error); see the module's text."""
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = vectors.where(finite(vector_col)).select(id_col, F.col(vector_col).cast("array<double>").alias("v"))
    dim = dimension(rows, "v")
    rows = rows.where(F.size("v") == dim)
    n, sums = totals(rows.select("v"), dim) if dim else (0, [])
    if not n:
        return spark.createDataFrame([], schema)
    v = covariance(rows.select("v"), dim, n, sums)
    values, axes = principal(v, components)
    k = len(values)
    if not k:
        return spark.createDataFrame([], schema)
    onto = axes / np.sqrt(values)

    def project(batches):
        for b in batches:
            x = grid(b.column(1), dim)
            w = centred(x, n, sums) @ onto
            flat = pa.array(w.reshape(-1))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(deviations(x, n, sums), pa.int64()),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * k), flat)],
                [id_col, "deviation", "w"])

    projected = store(rows.mapInArrow(project, f"`{id_col}` {kind}, deviation long, w array<double>"), "whitened")
    error = identity_error(spark, projected, k)
    explained = F.array(*[F.lit(float(e / np.trace(v))) for e in values])
    return (projected.select(id_col, "deviation", F.posexplode("w").alias("at", "whitened"))
            .select(id_col, (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
                    "whitened", explained[F.col("at")].alias("explained"), F.lit(error).alias("identity_error")))


def identity_error(spark: SparkSession, projected: DataFrame, k: int) -> float:
    """Largest absolute entry of the covariance of the whitened rows less the
    identity, measured on the rows."""
    w = [F.col("w")[i] for i in range(k)]
    mean = projected.agg(*[F.avg(c) for c in w]).first()
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    got = projected.agg(*[F.avg((w[i] - F.lit(mean[i])) * (w[j] - F.lit(mean[j]))) for i, j in pairs]).first()
    return max(abs(g - (i == j)) for g, (i, j) in zip(got, pairs, strict=True))


def op12_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
