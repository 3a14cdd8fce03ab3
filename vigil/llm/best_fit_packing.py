"""Best-fit packing of tokenised documents by exact-complement hashing.

Each text becomes ids of a public byte-level BPE and an end id; only longer
documents are cut, into pieces of the sequence length, the first piece taking
what is left over.  Which lengths share a sequence depends on the lengths
alone, so the plan is made from the histogram of lengths, which has at most
``size`` entries whatever the corpus: sums of one, two and three lengths are
indexed, from the longest length down the gap is looked up there, and what fills
it exactly is consumed as often as the counts allow; what is left is packed best
fit.
Pieces are then numbered within their length, by partition, and take their
places from the plan.

The ids are those of the ``tokenizers`` library with the vocabulary file named
by a parameter; encoding runs on the same ranks with ``tiktoken``, which gives
the same ids (tested), and falls back to ``tokenizers`` on texts it refuses.

Defined cases: null is the empty text, which is the end id alone; rows that
occur more than once are packed once each; extra columns pass through, one
named like an output column is replaced; an empty table packs to no rows.
"""

from __future__ import annotations

import json
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import outside, store

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
END = 2
SIZE = 1024
MADE = ["piece", "start", "length", "ids", "sequence_id", "offset"]
FLUSH = 8 << 20          # bytes of ids held before a batch goes out


@lru_cache(2)
def encoder(path: str):
    """text -> little-endian unsigned 32-bit ids, as tokenizers gives them
    without special tokens added."""
    import tiktoken
    from tokenizers import Tokenizer
    spec = json.load(open(path, encoding="utf-8"))
    vocab = spec["model"]["vocab"]
    # the byte alphabet of byte-level BPE: printable bytes stand for themselves
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]      # fixed values
    to_byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
    ranks = {bytes(to_byte[c] for c in token): i for token, i in vocab.items()
             if all(c in to_byte for c in token)}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {k: v for k, v in ranks.items() if v not in special.values()}
    fast = tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    slow = Tokenizer.from_file(path)
    slow.no_truncation()
    slow.no_padding()

    def run(text: str) -> bytes:
        try:
            return fast.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()
        except BaseException as e:      # its Rust code panics on some very long runs
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return np.array(slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    return run


def pieces(df: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, size: int = SIZE) -> DataFrame:
    """Input columns other than ``text``, then piece, start, length, ids
    (little-endian unsigned 32-bit, as binary), and the piece's number among
    those of its length in its partition (part, nth).  Written to the shared
    folder."""
    rest = [c for c in outside(df, [*MADE, "part", "nth"]) if c != text]
    src = df.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(rest)], F.coalesce(F.col(text), F.lit("")).alias("t"))
    end = np.array([END], "<u4").tobytes()

    def run(batches):
        encode, seen, part = encoder(vocabulary), Counter(), TaskContext.get().partitionId()

        def out(b, row, cols):
            at = pa.array(row, pa.int32())
            return pa.RecordBatch.from_arrays(
                [*(b.column(i).take(at) for i in range(len(rest))), pa.array(cols[0], pa.int32()),
                 pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary()),
                 pa.array([part] * len(row), pa.int32()), pa.array(cols[4], pa.int64())],
                [*b.schema.names[:len(rest)], *MADE[:4], "part", "nth"])

        for b in batches:
            row, cols, held = [], ([], [], [], [], []), 0
            for r, t in enumerate(b.column(len(rest))):
                ids = encode(t.as_py()) + end
                n = len(ids) // 4
                lengths = [n] if n <= size else [n % size] * (n % size > 0) + [size] * (n // size)
                at = 0
                for p, k in enumerate(lengths):
                    row.append(r)
                    for c, v in zip(cols, (p, at, k, ids[4 * at:4 * (at + k)], seen[k])):
                        c.append(v)
                    seen[k] += 1
                    at += k
                held += len(ids)
                if held > FLUSH:
                    yield out(b, row, cols)
                    row, cols, held = [], ([], [], [], [], []), 0
            if row:
                yield out(b, row, cols)

    kinds = ", ".join([f"c{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(rest)]
                      + ["piece int, start long, length long, ids binary, part int, nth long"])
    made = src.mapInArrow(run, kinds).toDF(*rest, *MADE[:4], "part", "nth")
    return store(made, "pieces")


class Sums:
    """Index of the sums of one, two and three of the lengths at hand.

    Under each sum below ``size``: the pairs that make it, longer parts first,
    and the lengths that make it with a pair of no longer ones.  Lengths run out
    and never come back, so entries that can no longer be met are left behind
    for good."""

    def __init__(self, left: np.ndarray):
        self.left, size = left, len(left)
        have = np.flatnonzero(left)
        one, two = (x.ravel() for x in np.meshgrid(have, have, indexing="ij"))
        ok = (one >= two) & (one + two < size)
        one, total = one[ok], (one + two)[ok]
        order = np.lexsort((-one, total))
        self.longer, self.at = one[order], np.searchsorted(total[order], np.arange(size + 1))
        self.next = self.at[:-1].copy()                # first pair of each sum that may still be met
        self.have = have[::-1].tolist()

    def pairs(self, total: int, most: int):
        """Pairs of that sum whose longer part is at most ``most``."""
        left, end = self.left, self.at[total + 1]
        while self.next[total] < end and not (left[a := self.longer[self.next[total]]] and left[total - a]):
            self.next[total] += 1
        first = self.next[total]
        first += int(np.searchsorted(-self.longer[first:end], -most))
        for a in self.longer[first:end].tolist():
            if left[a] and left[total - a]:
                yield a, total - a

    def of(self, total: int):
        """What makes ``total`` exactly: one length, then two, then three."""
        left = self.left
        if left[total]:
            yield (total,)
        yield from self.pairs(total, total)
        for a in self.have:
            rest = total - a
            if 3 * a < total:
                return
            if rest > 1 and left[a] and self.next[rest] < self.at[rest + 1]:
                for pair in self.pairs(rest, a):
                    yield (a, *pair)


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, how many such sequences) from the number of
    pieces of each length."""
    left = np.zeros(size + 1, np.int64)
    for k, n in counts.items():
        left[k] = n
    out = [((size,), int(left[size]))] if left[size] else []
    left[size] = 0

    def use(lengths):
        times = min(int(left[k]) // n for k, n in Counter(lengths).items())
        if times:
            out.append((tuple(lengths), times))
            for k in lengths:
                left[k] -= times
        return times

    sums = Sums(left)
    for k in range(size - 1, 0, -1):               # exact complements of the gap a length leaves
        if left[k]:
            for more in sums.of(size - k):
                use((k, *more))
                if not left[k]:
                    break
    for k in range(size - 1, 0, -1):               # residue: best fit, longest first
        while left[k]:
            lengths, gap = [k], size - k
            left[k] -= 1
            while gap:
                fit = np.flatnonzero(left[:gap + 1] > 0)
                if not len(fit):
                    break
                lengths.append(int(fit[-1]))
                left[fit[-1]] -= 1
                gap -= int(fit[-1])
            for x in lengths:
                left[x] += 1
            use(lengths)
    return out


def assign(made: DataFrame, size: int = SIZE) -> DataFrame:
    """Pieces with their sequence_id and offset; part and nth are used up."""
    counts = made.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {r[0]: r[1] for r in made.groupBy("length").count().collect()}   # at most ``size`` rows
    slots: dict[int, list[tuple[int, int, int]]] = {}      # length -> (first number, first sequence, offset)
    sequence, taken = 0, Counter()
    for lengths, times in plan(histogram, size):
        at = 0
        for k in lengths:
            slots.setdefault(k, []).append((taken[k], sequence, at))
            taken[k] += times
            at += k
        sequence += times
    tables = {k: np.array(v, np.int64) for k, v in slots.items()}
    before = counts.withColumn("base", F.sum("n").over(
        Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))) \
        .select("length", "part", F.coalesce("base", F.lit(0)).alias("base"))
    rest = [c for c in made.columns if c not in ("part", "nth")]
    placed = (made.join(before, ["length", "part"]).withColumn("number", F.col("base") + F.col("nth"))
              .select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(rest)], F.col("length").alias("length"), "number"))

    def run(batches):
        for b in batches:
            k, number = b.column(len(rest)).to_numpy(), b.column(len(rest) + 1).to_numpy()
            seq, off = np.zeros(len(k), np.int64), np.zeros(len(k), np.int64)
            order = np.argsort(k, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(k[order])) + 1) if len(k) else []:
                t = tables[int(k[group[0]])]
                at = np.searchsorted(t[:, 0], number[group], side="right") - 1
                seq[group] = t[at, 1] + number[group] - t[at, 0]
                off[group] = t[at, 2]
            yield pa.RecordBatch.from_arrays([*b.columns[:len(rest)], pa.array(seq), pa.array(off)],
                                             [*b.schema.names[:len(rest)], "s", "o"])

    kinds = ", ".join([f"c{i} {made.schema[c].dataType.simpleString()}" for i, c in enumerate(rest)] + ["s long, o long"])
    return placed.mapInArrow(run, kinds).toDF(*rest, "sequence_id", "offset")


def pack(df: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, size: int = SIZE) -> DataFrame:
    """One row per piece: input columns other than ``text``, then piece,
    start, length, ids, sequence_id and offset."""
    return assign(pieces(df, text, vocabulary, size), size)


def packed_digests(docs: DataFrame) -> DataFrame:
    """The packing with a checksum in place of the ids: they are not shuffled."""
    made = pieces(docs.select("doc_id", "text"))
    return (assign(made.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
            .select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"))


def op3_query(spark, sf_dir):
    return packed_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
