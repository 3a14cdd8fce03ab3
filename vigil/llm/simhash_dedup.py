"""SimHash near-duplicates by anchor-point covering.

64-bit SimHash fingerprints over word shingles; fingerprints that differ in
at most ``max_bits`` bits are linked, links are closed to components.

Pairs are found by covering codes.  The 64 bits are dealt into three groups;
of at most four differing bits, at most one falls into some group.  The
anchors of a group are the words of a covering code: a perfect Hamming code
on 15 of its bits, times all words on the others, covering radius 1.  A
fingerprint is at home at the anchor it decodes to and is replicated to every
anchor within the covering radius plus the group's share of the threshold, so
two linked fingerprints meet at the home anchor of either.

Defined cases: null and empty texts have fingerprint 0 and link like any
other; rows with a null id get a fingerprint but no component; rows with one
id and equal texts share a component, rows with one id and other texts have
that of their text; extra columns pass through, one named
like an output column is replaced.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import components, is_text, outside, store

SEED = 42
BLOCK = 16384        # rows of one anchor compared in one task; larger cells are cut into block pairs
DENSE = 64           # cells above this emit a spanning forest instead of pairs
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def simhash(data: bytes, shingle: int) -> int:
    """Fingerprint of one text (UTF-8 bytes)."""
    words = data.translate(_LOWER).split()
    n = len(words)
    if n == 0:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, n)
    starts, ends = starts[:n - k + 1].tolist(), ends[k - 1:].tolist()
    set_bits = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), 16384):
        h = np.array([digest(joined[i:j], SEED) for i, j in zip(starts[at:at + 16384], ends[at:at + 16384])],
                     np.uint64)
        set_bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, text: str = "text", shingle: int = 4) -> DataFrame:
    """Input columns other than ``text``, then fingerprint (long, two's
    complement)."""
    rest = [c for c in outside(df, ["fingerprint"]) if c != text]
    src = df.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(rest)], is_text(text).alias("t"))

    def run(batches):
        for b in batches:
            fp = np.array([simhash(x, shingle) for x in b.column(b.num_columns - 1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp.view(np.int64))],
                                             [*b.schema.names[:-1], "fp"])

    kinds = ", ".join([f"c{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(rest)] + ["fp long"])
    return src.mapInArrow(run, kinds).toDF(*rest, "fingerprint")


# ---------------------------------------------------------------- anchors

GROUPS = ((0, 21), (21, 21), (42, 22))      # first bit, bits


@lru_cache(1)
def _syndromes() -> np.ndarray:
    """Hamming(15, 11) syndrome of each 15-bit word: xor of the numbers (from
    1) of its set bits; 0 for the code's own words."""
    word, out = np.arange(1 << 15), np.zeros(1 << 15, np.int64)
    for i in range(15):
        out ^= np.where(word >> i & 1, i + 1, 0)
    return out


@lru_cache(None)
def _flips(bits: int, radius: int) -> np.ndarray:
    """All masks of at most ``radius`` of ``bits`` bits."""
    return np.array([sum(1 << i for i in c) for k in range(radius + 1) for c in combinations(range(bits), k)], np.int64)


def anchors_of(fp: np.ndarray, max_bits: int):
    """Yield (rows, anchor, home) for each group: all anchors within covering
    radius plus the group's share of the threshold of each fingerprint."""
    radius, share = 1, max_bits // len(GROUPS)
    syn = _syndromes()
    for g, (first, bits) in enumerate(GROUPS):
        x = ((fp >> np.uint64(first)) & np.uint64((1 << bits) - 1)).astype(np.int64)
        s = syn[x & 0x7FFF]
        home = np.where(s > 0, x ^ (1 << np.maximum(s - 1, 0)), x)
        for m in _flips(bits, radius + share):
            c = x ^ m
            at = np.flatnonzero(syn[c & 0x7FFF] == 0)
            yield at, (g << 32) | c[at], c[at] == home[at]


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _compare(cell: np.ndarray, fp: np.ndarray, node: np.ndarray, home: np.ndarray, max_bits: int):
    """Links among the rows of each cell (rows sorted by cell)."""
    cut = np.flatnonzero(np.diff(cell)) + 1
    first, last = np.concatenate(([0], cut)), np.concatenate((cut, [len(cell)]))
    size = np.repeat(last - first, last - first)
    a, b = [], []
    idx, k = np.flatnonzero(size <= DENSE), 1
    while True:                                   # pairs k rows apart, in all small cells at once
        idx = idx[idx + k < len(cell)]
        idx = idx[cell[idx + k] == cell[idx]]
        if not len(idx):
            break
        hit = idx[(_bits(fp[idx] ^ fp[idx + k]) <= max_bits) & (home[idx] | home[idx + k])]
        a.append(node[hit])
        b.append(node[hit + k])
        k += 1
    for i, j in zip(first, last):
        if j - i > DENSE:                         # dense cell: a spanning forest, never all pairs
            left, f = np.arange(i, j), fp
            while len(left):
                seed, left, todo = left[0], left[1:], [left[0]]
                while todo and len(left):
                    near = _bits(f[left] ^ f[todo.pop()]) <= max_bits
                    if near.any():
                        new = left[near]
                        a.append(np.full(len(new), node[seed]))
                        b.append(node[new])
                        todo.extend(new.tolist())
                        left = left[~near]
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(a), np.concatenate(b)


def links(classes: DataFrame, max_bits: int) -> DataFrame:
    """(a, b) links between distinct fingerprints; ``classes`` has
    fingerprint and node.  Per anchor, a spanning forest of what is linked."""
    if max_bits // len(GROUPS) > 1:
        raise ValueError("at most five differing bits are supported")

    def post(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                b = batch.slice(at, 8192)
                fp = b.column(0).to_numpy().view(np.uint64)
                node = b.column(1).to_numpy()
                got = list(anchors_of(fp, max_bits))
                rows = np.concatenate([x[0] for x in got])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([x[1] for x in got])), pa.array(fp[rows].view(np.int64)),
                     pa.array(node[rows]), pa.array(np.concatenate([x[2] for x in got]))],
                    ["anchor", "fp", "node", "home"])

    posts = store(classes.select("fingerprint", "node").mapInArrow(
        post, "anchor long, fp long, node long, home boolean"), "anchors")
    big = store(posts.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
                .select("anchor", F.ceil(F.col("n") / BLOCK).cast("int").alias("cuts")), "big-anchors",
                posts.count() // BLOCK)
    if big.isEmpty():
        cells = posts.withColumn("part", F.lit(0))
    else:
        own = F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int")
        pair = F.transform(F.sequence(F.lit(0), F.col("cuts") - 1),
                           lambda j: F.least(own, j) * F.col("cuts") + F.greatest(own, j))
        cells = (posts.join(big, "anchor", "left")
                 .withColumn("part", F.explode(F.coalesce(pair, F.array(F.lit(0)))))
                 .select("anchor", "fp", "node", "home", "part"))

    def compare(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            anchor, part = t["anchor"].to_numpy(), t["part"].to_numpy()
            last = int(np.flatnonzero((anchor != anchor[-1]) | (part != part[-1]))[-1]) + 1 \
                if (anchor[0] != anchor[-1] or part[0] != part[-1]) else 0
            held = t.slice(last)
            if last:
                yield from found(t.slice(0, last))
        if held is not None:
            yield from found(held)

    def found(t):
        anchor, part = t["anchor"].to_numpy(), t["part"].to_numpy()
        cell = np.concatenate(([0], np.cumsum((np.diff(anchor) != 0) | (np.diff(part) != 0))))
        a, b = _compare(cell, t["fp"].to_numpy().view(np.uint64), t["node"].to_numpy(),
                        t["home"].to_numpy(zero_copy_only=False), max_bits)
        for at in range(0, len(a), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(a[at:at + 100_000]), pa.array(b[at:at + 100_000])], ["a", "b"])

    return (cells.repartition("anchor", "part").sortWithinPartitions("anchor", "part")
            .mapInArrow(compare, "a long, b long"))


def simhash_components(df: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 4,
                       max_bits: int = 4) -> DataFrame:
    """Input columns other than ``text``, then fingerprint (long) and
    component_id (smallest id reachable by links; null for a null id)."""
    made = ["fingerprint", "component_id"]
    rest = [c for c in outside(df, made) if c != text]
    marked = store(fingerprints(df.select(*rest, text), text, shingle), "fingerprints")
    # a class is known by its fingerprint: one id may stand for different texts
    classes = store(marked.where(F.col(id_col).isNotNull()).groupBy("fingerprint")
                    .agg(F.min(F.col(id_col).cast("long")).alias("least"))
                    .select("fingerprint", F.col("fingerprint").alias("node"), "least"), "classes", marked.count())
    comp = components(links(classes, max_bits))
    count = classes.count()
    rooted = store(classes.join(comp, "node", "left")
                   .select("fingerprint", F.coalesce("component", "node").alias("root"), "least"), "rooted", count)
    roots = store(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "roots", count)
    groups = store(rooted.join(roots, "root").select("fingerprint", "component_id"), "groups", count)
    return (marked.join(groups, "fingerprint", "left")
            .select(*rest, "fingerprint",
                    F.when(F.col(id_col).isNotNull(), F.col("component_id")).alias("component_id")))


def hex16(c: str):
    """A long as 16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(F.col(c)), 16, "0"))


def op10_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return simhash_components(docs).select("doc_id", hex16("fingerprint").alias("fingerprint"), "component_id")
