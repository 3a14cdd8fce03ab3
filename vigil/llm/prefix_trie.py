"""Prefix trie of conversations by truncation peeling.

Every turn becomes a row of fixed size: 128 bits of the role and text and the
byte length of the text.  Positions inside a conversation come from one range
sort of all turns; the key of a prefix is the exclusive-or of the hashes of its
(position, turn) pairs, so running keys come from a second range sort, and a
conversation of any length is spread over tasks (what a task's first
conversation had before is added from a table with two rows a task at most).

The trie is peeled from the deepest level.  The nodes of a level are what is
left of the deeper ones once their last turn is stripped, merged by key with
the conversations that end there; counts, leaves, savings and the smallest
member are summed up in the same grouping, which merges in the tasks first, so
a first turn that a third of all conversations share is no hot key.  Thin
levels are peeled together: consecutive levels with at most ``BAND`` rows in
all (level sizes never grow with depth, so a few probes bound them) are dealt
by the prefix above them and peeled inside the tasks.  Rounds therefore follow
the number of rows, not the longest conversation.

Ids of the conversations that end at a node are range-sorted, written as text
in chunks, and hashed chunk by chunk in order.

Defined cases: rows without a conversation id are left out; null roles and
texts are empty; turns are ordered by number, null first, ties by the hash of
role and text, so rows that occur more than once are turns of their own; an
empty table has no nodes, not even a root; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from vigil.llm.common import partitions, scratch, store

BAND = 8192              # rows of levels that are peeled together
CHUNK = 4096             # ids in one piece of text
NODE = ("d long, a long, b long, pa long, pb long, conv long, convs long, kids long, leaves long, saved long, ended long")


# -------------------------------------------------------------- running values


def sorted_runs(df: DataFrame, order: list, name: str) -> DataFrame:
    """Rows range-sorted by ``order`` (conversation ``c`` first) and written,
    with ``pid`` (the task), ``nth`` (place among the task's rows of c, from 1)
    and ``xa``, ``xb`` (exclusive-or of a and b up to here, in the task)."""
    made = StructType([*df.schema.fields, StructField("pid", IntegerType()), *[StructField(x, LongType()) for x in ("nth", "xa", "xb")]])
    n = partitions(df.sparkSession)

    def run(batches):
        pid, last, before, xa, xb = TaskContext.get().partitionId(), None, 0, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            c = batch.column("c").to_numpy(zero_copy_only=False)
            at = np.arange(len(c))
            new = np.append(c[0] != last, c[1:] != c[:-1])
            start = np.maximum.accumulate(np.where(new, at, 0))
            carried = start == 0 if not new[0] else np.zeros(len(c), bool)
            out = []
            for col, carry in (("a", xa), ("b", xb)):
                run_x = np.bitwise_xor.accumulate(batch.column(col).to_numpy(zero_copy_only=False))
                base = np.where(start > 0, run_x[start - 1], 0)
                out.append(run_x ^ base ^ np.where(carried, carry, 0))
            nth = at - start + 1 + np.where(carried, before, 0)
            last, before, xa, xb = c[-1], int(nth[-1]), int(out[0][-1]), int(out[1][-1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(c), pid, np.int32)), pa.array(nth.astype(np.int64)),
                 pa.array(out[0]), pa.array(out[1])], [*batch.schema.names, "pid", "nth", "xa", "xb"])

    return store(df.repartitionByRange(n, *order).sortWithinPartitions(*order)
                 .mapInArrow(run, made), name)


def carried_over(runs: DataFrame) -> DataFrame:
    """(c, pid, n0, a0, b0): what earlier tasks had of a conversation, for the
    conversations that cross a border: two rows a task at most."""
    edge = Window.partitionBy("pid")
    ends = (runs.groupBy("pid", "c").agg(F.max("nth").alias("n"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b")))
    crossing = (ends.withColumn("first", F.min("c").over(edge)).withColumn("last", F.max("c").over(edge))
                .where("c = first OR c = last"))
    before = Window.partitionBy("c").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    return (crossing.select("c", "pid", F.sum("n").over(before).alias("n0"), F.bit_xor("a").over(before).alias("a0"),
                            F.bit_xor("b").over(before).alias("b0")).where("n0 IS NOT NULL"))


def whole_runs(runs: DataFrame) -> DataFrame:
    """``runs`` with nth, xa and xb over all tasks."""
    zero = F.lit(0).cast("long")
    # as many rows as there are borders between tasks
    return (runs.join(F.broadcast(store(carried_over(runs), "borders", 1)), ["c", "pid"], "left")
            .withColumn("nth", F.col("nth") + F.coalesce("n0", zero))
            .withColumn("xa", F.col("xa").bitwiseXOR(F.coalesce("a0", zero)))
            .withColumn("xb", F.col("xb").bitwiseXOR(F.coalesce("b0", zero))).drop("pid", "n0", "a0", "b0"))


def ranked_turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(c, idx from 1, hash: 128 bits of role and text, bytes) per turn."""
    said = F.concat(F.octet_length("r").cast("string").cast("binary"), F.lit(b":"), F.col("r"), F.col("x"))
    rows = (df.where(F.col(conv).isNotNull())
            .select(F.col(conv).cast("long").alias("c"), F.col(turn).alias("t"),
                    F.coalesce(F.col(role).cast("binary"), F.lit(b"")).alias("r"),
                    F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("x"))
            .select("c", "t", F.unhex(F.substring(F.sha2(said, 256), 1, 32)).alias("hash"),
                    F.octet_length("x").cast("long").alias("bytes"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")))
    runs = sorted_runs(store(rows, "turns"), [F.col("c"), F.col("t").asc_nulls_first(), F.col("hash")], "turn-runs")
    return store(whole_runs(runs).select("c", F.col("nth").alias("idx"), "hash", "bytes"), "ranked")


def prefixes(turns: DataFrame) -> DataFrame:
    """``turns`` (c, pos from 1, hash, bytes, last) -> (c, d, a, b: key of the
    prefix, pa, pb: key of the prefix one shorter, bytes, last)."""
    terms = turns.select("c", F.col("pos").alias("d"), F.xxhash64(F.lit(1), "hash", "pos").alias("a"),
                         F.xxhash64(F.lit(2), "hash", "pos").alias("b"), "bytes", "last")
    runs = sorted_runs(store(terms, "terms"), [F.col("c"), F.col("d")], "prefix-runs")
    return (whole_runs(runs).select("c", "d", F.col("xa").alias("a"), F.col("xb").alias("b"),
                                    F.col("xa").bitwiseXOR(F.col("a")).alias("pa"), F.col("xb").bitwiseXOR(F.col("b")).alias("pb"),
                                    "bytes", "last"))


# -------------------------------------------------------------------- levels


def bands(levels: DataFrame) -> list[tuple[int, int]]:
    """Ranges of depths, from the deepest, peeled together.  Probes are all
    depths below 16 and eight in each doubling beyond, so at most some 500
    numbers reach the driver; a level has at most as many rows as the probe
    above it."""
    step = F.expr("shiftleft(1L, greatest(0, cast(floor(log2(d)) AS int) - 3))")
    probe = {r.d: r["count"] for r in levels.where(F.col("d") % step == 0).groupBy("d").count().collect()}
    if not probe:
        return []
    deepest = levels.agg(F.max("d")).first()[0]
    points = sorted(probe)
    out: list[tuple[int, int]] = []
    room = 0
    for lo, up in reversed(list(zip(points, [*points[1:], deepest + 1], strict=True))):
        width, top = max(1, BAND // probe[lo]), up - 1
        if out and room >= (up - lo) * probe[lo]:
            out[-1] = (lo, out[-1][1])
            room -= (up - lo) * probe[lo]
            continue
        while top >= lo:
            out.append((max(lo, top - width + 1), top))
            top -= width
        room = BAND - (out[-1][1] - out[-1][0] + 1) * probe[lo]
    return out


def local_peel(low: int):
    """Peel all levels above ``low`` of the nodes of one task; all that lies
    under a prefix is in one task."""
    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        p = pa.Table.from_batches(held).to_pandas().sort_values("d", ascending=False, kind="stable").reset_index(drop=True)
        where = pd.Series(np.arange(len(p)), index=pd.MultiIndex.from_arrays([p["a"], p["b"]]))
        d, ended, size = (p[c].to_numpy() for c in ("d", "ended", "bytes"))
        convs, kids, leaves, saved, conv = (p[c].to_numpy().copy() for c in ("convs", "kids", "leaves", "saved", "conv"))
        up = where.reindex(pd.MultiIndex.from_arrays([p["pa"], p["pb"]])).to_numpy()
        for level in np.unique(d)[::-1]:
            at = np.flatnonzero(d == level)
            leaves[at] = np.where(kids[at] == 0, 1, leaves[at])
            saved[at] += (convs[at] - 1) * size[at]
            if level > low:
                to = up[at].astype(np.int64)
                for total, part in ((convs, convs[at]), (leaves, leaves[at]), (saved, saved[at]), (kids, 1)):
                    np.add.at(total, to, part)
                np.minimum.at(conv, to, conv[at])
        out = p[["d", "a", "b", "pa", "pb"]].assign(conv=conv, convs=convs, kids=kids, leaves=leaves, saved=saved, ended=ended)
        yield from pa.Table.from_pandas(out, preserve_index=False).to_batches()
    return run


FAR = (1 << 63) - 1      # the smallest member of a node that nothing has reached yet


def peel(levels: DataFrame, turnless: DataFrame) -> DataFrame:
    """Nodes of the trie: depth, key, parent's key, smallest member and what
    is summed over members and subtree.  ``levels``: see :func:`prefixes`;
    ``turnless``: (c) of conversations without turns."""
    spark = levels.sparkSession
    ranges = bands(levels)
    lows = np.array(sorted(lo for lo, _ in ranges), np.int64)
    number = F.pandas_udf(lambda d: pd.Series(np.searchsorted(lows, d.to_numpy(), side="right").astype(np.int32)), "int")
    path = f"{scratch(spark)}/levels-{uuid.uuid4().hex}"
    # files follow the size of a band: one that holds most rows is spread over tasks
    (levels.withColumn("band", number("d")).repartitionByRange(partitions(spark), "band", "c")
     .write.partitionBy("band").parquet(path))
    everything = spark.read.schema(StructType([*levels.schema.fields, StructField("band", IntegerType())])).parquet(path) if ranges else None
    long0 = F.lit(0).cast("long")
    none = F.lit(None).cast("long")
    left, done = None, []
    for lo, hi in ranges:
        rows = everything.where(F.col("band") == int(np.searchsorted(lows, lo, side="right")))
        if hi > lo:
            under = Window.partitionBy("c").orderBy("d")             # at most hi - lo + 1 rows
            rows = rows.withColumn("ba", F.first("pa").over(under)).withColumn("bb", F.first("pb").over(under))
        else:
            rows = rows.withColumn("ba", none).withColumn("bb", none)
        ends = F.col("last").cast("long")
        rows = rows.select("d", "a", "b", "pa", "pb", "ba", "bb", "bytes", F.when(F.col("last"), F.col("c")).alias("conv"),
                           ends.alias("ended"), ends.alias("convs"), long0.alias("kids"), long0.alias("leaves"), long0.alias("saved"))
        merged = merge(rows if left is None else rows.unionByName(left))
        if hi > lo:
            nodes = (merged.repartition(partitions(spark), "ba", "bb").drop("ba", "bb")
                     .withColumn("conv", F.coalesce("conv", F.lit(FAR))).mapInArrow(local_peel(lo), NODE))
        else:
            nodes = closed(merged)
        nodes = store(nodes, f"nodes-{lo}")
        done.append(nodes)
        left = stripped(nodes.where(F.col("d") == lo))
    ended = turnless.select(
        long0.alias("d"), long0.alias("a"), long0.alias("b"), *[none.alias(c) for c in ("pa", "pb", "ba", "bb")], long0.alias("bytes"),
        F.col("c").alias("conv"), F.lit(1).cast("long").alias("ended"), F.lit(1).cast("long").alias("convs"),
        *[long0.alias(c) for c in ("kids", "leaves", "saved")])
    root = store(closed(merge(ended if left is None else ended.unionByName(left))), "nodes-root")
    return spark.read.schema(root.schema).parquet(*[n._scratch_path for n in [*done, root]])


def merge(rows: DataFrame) -> DataFrame:
    """Conversations that end at a node, what is left of its children, and the
    way to its parent, as one row a node."""
    return (rows.groupBy("d", "a", "b")
            .agg(*[F.max(c).alias(c) for c in ("pa", "pb", "ba", "bb", "bytes")], F.min("conv").alias("conv"),
                 *[F.sum(c).alias(c) for c in ("ended", "convs", "kids", "leaves", "saved")]))


def closed(merged: DataFrame) -> DataFrame:
    """Nodes whose children have all been merged."""
    return merged.select("d", "a", "b", "pa", "pb", "conv", "convs", "kids",
                         F.when(F.col("kids") == 0, F.lit(1).cast("long")).otherwise(F.col("leaves")).alias("leaves"),
                         (F.col("saved") + (F.col("convs") - 1) * F.coalesce("bytes", F.lit(0).cast("long"))).alias("saved"), "ended")


def stripped(nodes: DataFrame) -> DataFrame:
    """Nodes without their last turn: what they add to their parents."""
    none = F.lit(None).cast("long")
    return nodes.select((F.col("d") - 1).alias("d"), F.col("pa").alias("a"), F.col("pb").alias("b"),
                        *[none.alias(c) for c in ("pa", "pb", "ba", "bb", "bytes")], "conv", F.lit(0).cast("long").alias("ended"),
                        "convs", F.lit(1).cast("long").alias("kids"), "leaves", "saved")


# ---------------------------------------------------------- ids of the ended


def ids_digest(ended: DataFrame) -> DataFrame:
    """(a, b, ends_sha256) over the ids ``c`` that end at a key, ascending,
    comma-joined.  Ids are sorted over all tasks and become pieces of text, a
    piece for CHUNK ids; the pieces of a key are hashed one after another."""
    def pieces(batches):
        key, ids = None, []

        def text():
            return {"a": key[0], "b": key[1], "first": ids[0], "ids": ",".join(map(str, ids))}
        for batch in batches:
            out = []
            for a, b, c in zip(*(batch.column(x).to_pylist() for x in "abc"), strict=True):
                if ids and ((a, b) != key or len(ids) == CHUNK):
                    out.append(text())
                    ids = []
                key = (a, b)
                ids.append(c)
            if out:
                yield pa.RecordBatch.from_pylist(out, piece)
        if ids:
            yield pa.RecordBatch.from_pylist([text()], piece)

    def digests(batches):
        key, sha = None, None
        for batch in batches:
            out = []
            for a, b, ids in zip(*(batch.column(x).to_pylist() for x in ("a", "b", "ids")), strict=True):
                if (a, b) == key:
                    sha.update(b"," + ids.encode())
                    continue
                if sha:
                    out.append({"a": key[0], "b": key[1], "ends_sha256": sha.hexdigest()})
                key, sha = (a, b), hashlib.sha256(ids.encode())
            if out:
                yield pa.RecordBatch.from_pylist(out, digest)
        if sha:
            yield pa.RecordBatch.from_pylist([{"a": key[0], "b": key[1], "ends_sha256": sha.hexdigest()}], digest)

    piece = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
    digest = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("ends_sha256", pa.string())])
    n = partitions(ended.sparkSession)
    cut = store(ended.repartitionByRange(n, "a", "b", "c").sortWithinPartitions("a", "b", "c")
                .mapInArrow(pieces, "a long, b long, first long, ids string"), "ended-ids")
    return (cut.repartition("a", "b").sortWithinPartitions("a", "b", "first")
            .mapInArrow(digests, "a long, b long, ends_sha256 string"))


# --------------------------------------------------------------------- trie


def trie(turns: DataFrame, turnless: DataFrame) -> DataFrame:
    """Per node: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.  ``turns``: (c, pos from
    1, hash, bytes, last); ``turnless``: (c)."""
    levels = store(prefixes(turns), "prefixes")
    nodes = peel(levels, turnless)
    zero = F.lit(0).cast("long")
    ended = store(levels.where("last").select("a", "b", "c").unionByName(turnless.select(zero.alias("a"), zero.alias("b"), "c")), "ended")
    shas = store(ids_digest(ended), "ended-digests")
    named = store(nodes.join(shas, ["a", "b"], "left"), "named-nodes")
    parents = nodes.where("kids > 0").select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv").alias("parent_conv_id"))
    return (named.join(parents, ["pa", "pb"], "left")
            .select(F.col("conv").alias("conv_id"), F.col("d").alias("depth"), "parent_conv_id", F.col("convs").alias("n_convs"),
                    F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
                    F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")))


def conversation_trie(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The trie of the conversations as they are."""
    ranked = ranked_turns(df, conv, turn, role, text)
    sizes = store(ranked.groupBy("c").agg(F.max("idx").alias("n")), "sizes")
    return trie(ranked.join(sizes, "c").select("c", F.col("idx").alias("pos"), "hash", "bytes", (F.col("idx") == F.col("n")).alias("last")),
                sizes.where("n = 0").select("c"))


def rebuilt(ranked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, turnless) after every conversation c has got the first h turns
    of conversation c - c % 5 for its own first h, h = crc32(c) % 9."""
    sizes = store(ranked.groupBy("c").agg(F.max("idx").alias("n"))
                  .withColumn("h", F.crc32(F.col("c").cast("string").cast("binary")) % 9), "sizes")
    whole = sizes.withColumn("base", F.col("c") - F.col("c") % 5)
    plan = store(whole.join(sizes.select(F.col("c").alias("base"), F.col("n").alias("m")), "base", "left")
                 .select("c", "n", "h", "base", F.least("h", F.coalesce("m", F.lit(0).cast("long"))).alias("got")), "rebuild")
    own = (ranked.where(F.col("idx") > F.crc32(F.col("c").cast("string").cast("binary")) % 9)
           .join(plan.select("c", "n", "h", "got"), "c")
           .select("c", (F.col("idx") - F.col("h") + F.col("got")).alias("pos"), "hash", "bytes", (F.col("idx") == F.col("n")).alias("last")))
    given = (plan.where("got > 0").select("c", "n", "h", "got", "base", F.explode(F.sequence(F.lit(1).cast("long"), "got")).alias("idx"))
             .join(ranked.where("idx <= 8").select(F.col("c").alias("base"), "idx", "hash", "bytes"), ["base", "idx"])
             .select("c", F.col("idx").alias("pos"), "hash", "bytes",
                     ((F.col("idx") == F.col("got")) & (F.col("n") <= F.col("h"))).alias("last")))
    return own.unionByName(given), plan.where("got = 0 AND n <= h").select("c")


def op11_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(*rebuilt(ranked_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))
