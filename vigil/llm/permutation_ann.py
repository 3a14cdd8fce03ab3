"""Approximate nearest neighbours by a permutation index.

Every vector is represented by its ``prefix`` nearest pivots, nearest first.
Each row of the index is posted in the inverted files of its pivots: a block's
file of a pivot holds, row by row, the place the pivot has in the row's order
(the end, if it is missing).  A query reads the files of its own pivots and
ranks rows by footrule distance, the sum of differences of places.  The best ``share`` of a block's rows are
reranked by inner product on the original vectors in double precision.

Inner products become distances by one added component that makes all rows
equally long, as is usual for maximum inner product search.  That length is a
high quantile of the sample's, so that a few long rows do not make all others
look alike; rows above it are reranked for every query.  Pivots are the first
of a bounded sample by a hash of the id (``sample`` rows) whose directions are
no near copies of one another, and near copies where the prefix would be short
without them; every row is indexed.

Rows are dealt into blocks by a hash of their id, queries into batches; each
batch meets each block once, and blocks' results are merged by rank.

Defined cases: vectors that are null, zero, hold a null or non-finite
component or have another dimension than most take no part, nor do rows
without id; ties in the measure go to the smaller id; rows that occur more
than once are candidates each; of an empty table nothing is returned; extra
columns are not returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import partitions, store
from vigil.llm.vectors import dimension, matrix, usable

PIVOTS, PREFIX, SHARE, SAMPLE = 256, 64, 0.4, 4096
BLOCK, BATCH = 16384, 2048
USUAL = 0.95             # share of the sample's lengths up to which rows are lifted; longer rows are always reranked


class Pivots:
    def __init__(self, vectors: np.ndarray, usual: float, count: int, prefix: int):
        self.usual = usual
        kept, spare, ways = [], [], np.zeros((0, vectors.shape[1]))
        for i, x in enumerate(vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))):
            if len(kept) == count:
                break
            if not len(ways) or (ways @ x).max() < 0.9:
                kept.append(i)
                ways = np.vstack([ways, x])
            else:
                spare.append(i)
        kept += spare[:max(0, min(count, prefix) - len(kept))]      # near copies, rather than a short prefix
        self.rows = self._lift(vectors[kept])
        self.prefix = min(prefix, len(kept), 127)

    def _lift(self, x: np.ndarray) -> np.ndarray:
        x = x / np.maximum(self.usual, np.sqrt((x * x).sum(1, keepdims=True)))
        return np.hstack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1, keepdims=True)))])

    def order(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Numbers of the nearest pivots of each row, nearest first."""
        if query:
            x = np.hstack([x / np.sqrt((x * x).sum(1, keepdims=True)), np.zeros((len(x), 1))])
        else:
            x = self._lift(x)
        return np.argsort(-(x @ self.rows.T), axis=1, kind="stable")[:, :self.prefix].astype(np.uint16)


def build_index(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS,
                prefix: int = PREFIX, sample: int = SAMPLE) -> tuple[DataFrame, Pivots | None, int]:
    """(index rows with id, vector and pivot order; pivots; dimension)."""
    spark = df.sparkSession
    good = df.where(usable(vector) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    dim = dimension(good, "v")
    good = good.where(F.size("v") == dim)
    n = good.count()
    if not n:
        return good.select("id", "v", F.lit(0).cast("long").alias("row"), F.lit(0).alias("block"), F.lit(b"").alias("places")), None, dim
    first = good.orderBy(F.xxhash64("id"), "id").limit(sample).toPandas()["v"]
    first = np.array(first.tolist(), np.float64)
    usual = float(np.quantile(np.sqrt((first * first).sum(1)), USUAL, method="higher"))
    piv = Pivots(first, usual, pivots, prefix)
    blocks = max(-(-n // BLOCK), min(partitions(spark), 32))

    def order(batches):
        for b in batches:
            places = piv.order(matrix(b.column(1), dim), False)
            yield b.append_column("places", pa.array([p.tobytes() for p in places], pa.binary()))

    # ids may repeat: every row has a key, fixed by writing it
    index = good.mapInArrow(order, "id long, v array<double>, places binary").withColumns(
        {"row": F.monotonically_increasing_id(), "block": F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")})
    return store(index, "permutations"), piv, dim


def search(index: DataFrame, pivots: Pivots | None, dim: int, queries: Column, k: int = 20,
           share: float = SHARE) -> DataFrame:
    """The ``k`` nearest found of each index row where ``queries`` holds:
    query_id, rank, vec_id, score."""
    spark = index.sparkSession
    if pivots is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = index.where(queries)
    blocks = index.agg(F.max("block")).first()[0] + 1
    batches = max(1, -(-asked.count() // BATCH))
    left = asked.select("id", "row", "v", F.pmod(F.xxhash64("row"), F.lit(batches)).cast("int").alias("batch"),
                        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = index.select("id", "row", "v", "places", "block",
                         F.explode(F.sequence(F.lit(0), F.lit(batches - 1))).alias("batch"))
    prefix, count, usual = pivots.prefix, len(pivots.rows), pivots.usual * (1 + 1e-9)

    def meet(q, x):
        out = ([], [], [], [])
        if q.num_rows and x.num_rows:
            x = x.sort_by("id")
            ids, own, rows = x["id"].to_numpy(), x["row"].to_numpy(), matrix(x["v"], dim)
            places = np.frombuffer(b"".join(x["places"].to_pylist()), np.uint16).reshape(len(ids), prefix)
            # the pivots' inverted files: the place of the pivot in each row's order
            files = np.full((count, len(ids)), prefix, np.uint8)
            files[places, np.arange(len(ids))[:, None]] = np.arange(prefix, dtype=np.uint8)
            asked_ids, asked_own, asked_rows = q["id"].to_numpy(), q["row"].to_numpy(), matrix(q["v"], dim)
            long = np.flatnonzero(np.sqrt((rows * rows).sum(1)) > usual)
            ranked = len(ids) - len(long)
            most = min(ranked, max(10 * k, int(np.ceil(share * len(ids)))))
            near, far = np.empty((2, prefix, len(ids)), np.uint8)
            rank = np.arange(prefix, dtype=np.uint8)[:, None]
            for i, me, v, order in zip(asked_ids, asked_own, asked_rows, pivots.order(asked_rows, True)):
                np.take(files, order, axis=0, out=near)
                np.maximum(near, rank, out=far)
                np.minimum(near, rank, out=near)
                np.subtract(far, near, out=far)
                half = prefix // 2                                   # two differences still fit a byte
                footrule = np.add(far[:half], far[half:2 * half], out=near[:half]).sum(0, dtype=np.uint32)
                if prefix % 2:
                    footrule += far[-1]
                footrule[own == me] = 1 << 20
                footrule[long] = 1 << 21
                best = np.arange(len(ids))
                if most < ranked:                                   # ties at the edge go to smaller ids
                    cut = np.partition(footrule, most - 1)[most - 1]
                    sure = np.flatnonzero(footrule < cut)
                    best = np.concatenate([sure, np.flatnonzero(footrule == cut)[:most - len(sure)], long])
                best = best[own[best] != me]
                score = rows[best] @ v
                top = np.lexsort((ids[best], -score))[:k]
                out[0].append(np.full(len(top), i))
                out[1].append(ids[best[top]])
                out[2].append(score[top])
                out[3].append(np.full(len(top), me))
        cols = [np.concatenate(o) if o else np.zeros(0) for o in out]
        return pa.table({"query_id": pa.array(cols[0].astype(np.int64)), "vec_id": pa.array(cols[1].astype(np.int64)),
                         "score": pa.array(cols[2].astype(np.float64)), "query_row": pa.array(cols[3].astype(np.int64))})

    near = left.groupBy("block", "batch").cogroup(right.groupBy("block", "batch")).applyInArrow(
        meet, "query_id long, vec_id long, score double, query_row long")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_query(spark, sf_dir):
    index, pivots, dim = build_index(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return search(index, pivots, dim, F.col("id") % 20 == 0)
