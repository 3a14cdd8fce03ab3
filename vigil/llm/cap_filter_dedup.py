"""Near-duplicate vectors by spherical-cap filters.

Filter directions are structured random product codes: a random rotation deals
the components into four blocks, each with a codebook of random directions,
and a filter is one codeword from each.  A vector is list-decoded to all
filters whose cap it lies in, the cap's height being set so that each vector
lies in ``caps`` of them: the best sums of one score per block, found exactly
by merging best sums of two blocks.  Vectors that share a filter meet there
and are verified by cosine in double precision.  There are as many independent
rotations as keep the chance to miss a pair at the threshold at ``MISS``, by a
simulation for the dimension, the size of the table and the threshold; in low
dimensions, and where too many would be needed, all pairs of a label are
compared.

Equal vectors are one class with a count.  A pair that shares several filters
is counted at the smallest only, and a filter reports for each vector the
number of its links and a spanning forest, never its pairs.  Cells of more
than ``BLOCK`` vectors are cut into pairs of blocks.

Defined cases: vectors that are null, zero or hold a null or non-finite
component, and rows with a null label, link with nothing; rows without id
link with nothing, have no component and are kept; equal rows link; vectors of
different dimension do not; extra columns pass through, one named like an
output column is replaced.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import components, outside, store
from vigil.llm.vectors import usable

CAPS = 24
MISS = 1e-4              # chance, at most, that a pair at the threshold shares no filter of any rotation
PAIRS = 4000             # random pairs by which the chance for one rotation is estimated
LOW, MOST = 16, 8        # below that dimension, or beyond so many rotations, all pairs of a label are compared
BLOCK = 8192
MADE = ["n_links", "component_id", "kept"]


class Turn:
    """Product code for vectors of one dimension, under one rotation."""

    def __init__(self, dim: int, size: int, caps: int, seed: int):
        rng = np.random.default_rng(seed)
        self.turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.cuts = np.array_split(np.arange(dim), 4)
        self.books = []
        for c in self.cuts:
            book = rng.standard_normal((size, max(1, len(c))))[:, :len(c)]
            length = np.sqrt((book * book).sum(1, keepdims=True))
            self.books.append(book / np.where(length > 0, length, 1))
        self.size, self.caps = size, min(caps, size**4)

    def _best(self, score: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = min(self.caps, score.shape[1])
        at = np.argsort(-score, axis=1, kind="stable")[:, :k]
        return np.take_along_axis(score, at, 1), np.take_along_axis(word, at, 1)

    def decode(self, unit: np.ndarray) -> np.ndarray:
        """Filters of each unit vector, sorted."""
        x, halves = unit @ self.turn, []
        for a, b in ((0, 1), (2, 3)):
            one, two = (x[:, self.cuts[i]] @ self.books[i].T for i in (a, b))
            both = (one[:, :, None] + two[:, None, :]).reshape(len(x), -1)
            halves.append(self._best(both, np.broadcast_to(np.arange(both.shape[1]), both.shape)))
        (s, w), (t, z) = halves
        score = (s[:, :, None] + t[:, None, :]).reshape(len(x), -1)
        word = (w[:, :, None] * self.size**2 + z[:, None, :]).reshape(len(x), -1)
        return np.sort(self._best(score, word)[1], axis=1)


class Code:
    """``turns`` product codes under independent rotations; with none of them
    all vectors share one filter, and are so compared exactly."""

    def __init__(self, dim: int, size: int, caps: int, turns: int):
        self.turns = [Turn(dim, size, caps, 7 + dim + 100_003 * k) for k in range(turns)]

    def decode(self, unit: np.ndarray) -> np.ndarray:
        """Filters of each unit vector, sorted."""
        if not self.turns:
            return np.zeros((len(unit), 1), np.int64)
        return np.hstack([t.decode(unit) + k * t.size**4 for k, t in enumerate(self.turns)])


@lru_cache(8)
def code(dim: int, size: int, caps: int, turns: int) -> Code:
    return Code(dim, size, caps, turns)


def miss(dim: int, size: int, caps: int, least: float) -> float:
    """Upper estimate of the chance that a pair at the threshold shares no
    filter of one rotation.  By the rotation it is the same for every pair."""
    rng = np.random.default_rng(dim)
    missed, per = 0, 40
    for seed in range(PAIRS // per):                  # a rotation and codebooks of their own for each few pairs
        x, y = rng.standard_normal((2, per, dim))
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        y -= (y * x).sum(1, keepdims=True) * x
        y /= np.sqrt((y * y).sum(1, keepdims=True))
        t = Turn(dim, size, caps, 1_000_003 + seed)
        a, b = t.decode(x), t.decode(least * x + np.sqrt(max(0.0, 1 - least * least)) * y)
        missed += int((~(a[:, :, None] == b[:, None, :]).any((1, 2))).sum())
    return (missed + 2 * missed**0.5 + 3) / PAIRS


def turns_needed(dim: int, size: int, caps: int, least: float) -> int:
    """Rotations that keep the chance to miss a pair at ``MISS``; 0 stands for
    comparing all pairs of a label, where the dimension is low or too many
    rotations would be needed."""
    if dim < LOW:
        return 0
    p = miss(dim, size, caps, least)
    need = int(np.ceil(np.log(MISS) / np.log(p))) if p < 1 else MOST + 1
    return need if need <= MOST else 0


def _unit(blobs: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _cell(unit, node, size, half, filters, here, least, cross):
    """Links of one cell: node, links counted here; forest edges."""
    n, links, done = len(node), np.zeros(len(node), np.int64), np.zeros(len(node), bool)
    a, b, parent = [], [], np.arange(n)

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for at in range(0, n, 512):
        near = unit[at:at + 512] @ unit.T >= least
        for r in np.flatnonzero(near.sum(1) > 1) if len(near) else []:
            i = at + r
            j = np.flatnonzero(near[r])
            j = j[j > i]
            if cross:
                j = j[half[j] != half[i]]
            if not len(j):
                continue
            shared = [np.intersect1d(filters[i], filters[x], assume_unique=True)[0] == here for x in j] \
                if len(j) < 8 else _first_shared(filters[i], filters[j]) == here
            j = j[np.asarray(shared)]
            links[i] += size[j].sum()
            links[j] += size[i]
            for x in j:
                p, q = root(i), root(x)
                if p != q:
                    parent[q] = p
                    a.append(node[i])
                    b.append(node[x])
    return links, a, b


def _first_shared(mine: np.ndarray, others: np.ndarray) -> np.ndarray:
    at = np.searchsorted(mine, others).clip(max=len(mine) - 1)
    return np.where(mine[at] == others, others, np.iinfo(np.int64).max).min(1)


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label",
                    least: float = 0.98, caps: int = CAPS) -> DataFrame:
    """Input columns, then n_links, component_id and kept."""
    rest = outside(df, MADE)
    # negative zero is zero, so that equal vectors are equal as keys
    x = F.transform(F.col(vector).cast("array<double>"), lambda v: v + F.lit(0.0))
    takes_part = usable(vector) & F.col(label).isNotNull() & F.col(id_col).isNotNull()
    marked = df.select(*rest, F.when(takes_part, F.col(label).cast("string")).alias("_l"),
                       F.when(takes_part, x).alias("_v"))
    # a class of equal vectors has a key of its own: one id may stand for different vectors
    classes = store(marked.where("_v is not null").groupBy("_l", "_v").agg(
        F.min(F.col(id_col).cast("long")).alias("least"), F.count("*").alias("size"))
        .select("_l", "_v", F.monotonically_increasing_id().alias("node"), "size", "least"), "vector-classes", df.count())
    count = classes.count()
    words = int(min(256, max(4, np.ceil((count / 2) ** 0.25))))
    turns = {r[0]: turns_needed(r[0], words, caps, least) for r in classes.select(F.size("_v")).distinct().collect()}

    def post(vectors):
        def run(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    b = batch.slice(at, 1024)
                    lists = b.column(1).to_pylist()
                    by_dim: dict[int, list[int]] = {}
                    for r, v in enumerate(lists):
                        by_dim.setdefault(len(v), []).append(r)
                    for dim, rows in by_dim.items():
                        blobs = [np.array(lists[r], np.float64).tobytes() for r in rows]
                        f = code(dim, words, caps, turns[dim]).decode(_unit(blobs))
                        k, take = f.shape[1], pa.array(np.repeat(rows, f.shape[1]), pa.int64())
                        cols = [b.column(0).take(take), pa.array(np.full(len(take), dim, np.int32)), pa.array(f.ravel())]
                        names = ["label", "dim", "filter"]
                        if vectors:
                            cols += [b.column(2).take(take), b.column(3).take(take),
                                     pa.array([x for x in blobs for _ in range(k)], pa.binary())]
                            names += ["node", "size", "vec"]
                        yield pa.RecordBatch.from_arrays(cols, names)
        return run

    key = ["label", "dim", "filter"]
    kinds = "label string, dim int, filter long"
    big = store(classes.mapInArrow(post(False), kinds).groupBy(*key).agg(F.count("*").alias("n"))
                .where(F.col("n") > BLOCK).select(*key, F.ceil(F.col("n") / BLOCK).cast("int").alias("cuts")), "big-cells",
                count * caps // BLOCK)
    posts = classes.mapInArrow(post(True), kinds + ", node long, size long, vec binary")
    if big.isEmpty():
        cells = posts.withColumns({"half": F.lit(0), "part": F.lit(-1)})
    else:
        own = F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int")
        # part (i, j) holds blocks i and j: within a block once, across blocks the crossing pairs
        pair = F.transform(F.sequence(F.lit(0), F.col("cuts") - 1),
                           lambda j: F.least(own, j) * F.col("cuts") + F.greatest(own, j))
        cells = (posts.join(big, key, "left").withColumn("half", F.coalesce(own, F.lit(0)))
                 .withColumn("part", F.explode(F.coalesce(pair, F.array(F.lit(-1)))))
                 .drop("cuts"))

    def compare(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            new = cell_starts(t)
            if new[-1]:
                yield from found(t.slice(0, new[-1]), new[:-1])
            held = t.slice(new[-1])
        if held is not None:
            yield from found(held, cell_starts(held))

    def cell_starts(t):
        change = np.zeros(t.num_rows, bool)
        change[0] = True
        for c in ("filter", "part", "dim"):
            v = t[c].to_numpy()
            change[1:] |= v[1:] != v[:-1]
        names = t["label"].combine_chunks().dictionary_encode()
        names = names.indices.to_numpy() if not isinstance(names, pa.ChunkedArray) else \
            t["label"].to_pandas().astype("category").cat.codes.to_numpy()
        change[1:] |= names[1:] != names[:-1]
        return np.flatnonzero(change)

    def found(t, starts):
        out = ([], [], [], [])
        half, node, size, filt = (t[c].to_numpy() for c in ("half", "node", "size", "filter"))
        part, dims = t["part"].to_numpy(), t["dim"].to_numpy()
        for i, j in zip(starts, np.append(starts[1:], t.num_rows)):
            if j - i < 2:
                continue
            unit = _unit(t["vec"].slice(i, j - i).to_pylist())
            near = unit @ unit.T >= least if j - i <= 512 else None
            if near is not None and near.sum() == j - i:
                continue
            filters = code(int(dims[i]), words, caps, turns[int(dims[i])]).decode(unit)
            cross = part[i] >= 0 and len(np.unique(half[i:j])) > 1
            links, a, b = _cell(unit, node[i:j], size[i:j], half[i:j], filters, filt[i], least, cross)
            hit = np.flatnonzero(links)
            out[0].extend(node[i:j][hit].tolist())
            out[1].extend([None] * len(hit))
            out[2].extend(links[hit].tolist())
            out[0].extend(a)
            out[1].extend(b)
            out[2].extend([None] * len(a))
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()),
                                              pa.array(out[2], pa.int64())], ["node", "other", "links"])

    order = ["label", "dim", "filter", "part"]
    seen = store(cells.repartition(*order).sortWithinPartitions(*order).mapInArrow(
        compare, "node long, other long, links long"), "cap-links")
    comp = components(seen.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    links = seen.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    rooted = store(classes.join(links, "node", "left").join(comp, "node", "left").select(
        "_l", "_v", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"),
        F.coalesce("component", "node").alias("root"), "least"), "vector-links", count)
    roots = store(rooted.groupBy("root").agg(F.min("least").alias("component")), "vector-roots", count)
    found_classes = store(rooted.join(roots, "root").select("_l", "_v", "n_links", "component"), "vector-components", count)
    me = F.col(id_col).cast("long")
    return (marked.join(found_classes, ["_l", "_v"], "left")
            .select(*rest, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component", me).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("component_id") == me, F.lit(True))))


def op4_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    return near_duplicates(rows).select("vec_id", "n_links", "component_id", "kept")
