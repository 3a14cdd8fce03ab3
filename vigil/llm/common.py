"""Helpers shared by the operators of this subpackage: tables in the shared
scratch folder, column carrying, vectorised word hashing, components."""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.session import ensure_checkpoint_dir

# ---------------------------------------------------------------- scratch


def scratch(spark: SparkSession) -> str:
    """Folder of this session below ``spark.checkpoint.dir`` (shared by all
    executors)."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/tables"


ROWS_PER_FILE = 200_000
ROW_GROUP = 16 << 20      # bytes a writer holds before they go to the file


def store(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared scratch folder and read it back:
    the lineage is cut, and lost executors cost nothing already written.
    ``rows``: about how many there are at most; a small table then goes into
    few files instead of one for each shuffle partition."""
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(2, min(partitions(spark), math.ceil(rows / ROWS_PER_FILE))))
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`store` that nothing reads any more."""
    path = getattr(df, "_scratch_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def is_text(c: Column | str) -> Column:
    """UTF-8 bytes of a text column; null and empty are both zero bytes."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("binary"), F.lit(b""))


def crc32_mod(id_col: str, m: int) -> Column:
    """crc32 of the id written as text, modulo ``m``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(m)


def outside(df: DataFrame, made: list[str]) -> list[str]:
    """Input columns that an operator hands through: all but those named like
    one of its own output columns, which the output replaces."""
    return [c for c in df.columns if c not in made]


# ------------------------------------------------- vectorised word hashing

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_R = np.uint64(0x9E3779B97F4A7C15)           # odd: invertible modulo 2**64
_RINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_S = np.uint64(0xD6E8FEB86659FD93)
_SINV = np.uint64(pow(0xD6E8FEB86659FD93, -1, 2**64))
_BYTES = np.random.default_rng(20260101).integers(0, 2**64, 256, dtype=np.uint64)
_powers: dict[tuple[int, int], np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for reuse up to 4 M entries."""
    key = (int(base), max(1 << 16, 1 << math.ceil(math.log2(max(n, 2)))))
    got = _powers.get(key)
    if got is None:
        got = np.full(key[1], base, np.uint64)
        got[0] = 1
        np.cumprod(got, out=got)
        if key[1] <= 1 << 22:
            _powers[key] = got
    return got[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """Bit mixer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def binary_parts(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary column without nulls."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.binary())
    width = np.int64 if pa.types.is_large_binary(col.type) else np.int32
    bufs = col.buffers()
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(bufs[1], width)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def blocks(off: np.ndarray, size: int):
    """Runs [i, j) of documents of at most ``size`` bytes (one document, if it
    is longer)."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word (run of bytes other than ASCII white space) of
    the documents data[off[k]:off[k+1]], and its document's number."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = ~_SPACE[data]
    first = np.zeros(n + 1, bool)
    first[off[:-1]] = True
    first = first[:n]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | first))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    last = np.zeros(n, bool)
    ends = off[1:][off[1:] > 0] - 1
    last[ends] = True
    ends = np.flatnonzero(word & (~after | last)) + 1
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTES[data] * powers(_R, n), out=total[1:])
    h = (total[ends] - total[starts]) * powers(_RINV, n)[starts]
    return mix64(h), np.searchsorted(off, starts, side="right") - 1


def window_hashes(h: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word and two independent 64-bit hashes of each run of ``width``
    elements that lies in one document."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    at = np.flatnonzero(doc[:n] == doc[width - 1:])
    out = []
    for base, inv, salt in ((_R, _RINV, 0x1F83D9ABFB41BD6B), (_S, _SINV, 0x5BE0CD19137E2179)):
        total = np.empty(len(h) + 1, np.uint64)
        total[0] = 0
        np.cumsum((h ^ np.uint64(salt)) * powers(base, len(h)), out=total[1:])
        out.append(mix64((total[at + width] - total[at]) * powers(inv, len(h))[at]))
    return at, out[0], out[1]


# ------------------------------------------------------------- components


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long): the least
    node reachable.  Alternating large-star and small-star rounds; each round
    is written to the shared folder.  Minima are partial aggregates and the
    joins run between scans, so that a hub is split by adaptive execution."""
    found = store(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "links")
    now = store(found.distinct(), "edges", found.count())
    discard(found)
    before = None
    while True:
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sign[0] == 0 or tuple(sign) == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before, n = tuple(sign), 2 * sign[0]
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = store(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "least", n)
        large = store(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                      .distinct(), "large", n)
        least2 = store(large.groupBy("a").agg(F.min("b").alias("m")), "least", n)
        joined = large.join(least2, "a")
        small = store(joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                      .unionByName(least2.select("a", F.col("m").alias("b"))).distinct(), "small", n)
        for old in (now, least, large, least2):
            discard(old)
        now = small

