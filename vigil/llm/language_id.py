"""Language identification by prediction by partial matching.

For each language a tree of byte contexts of order 0 to 3 holds, under each
context, how often each byte followed.  The cost of a byte is the exact code
length, -log2 of its probability in the longest context that has seen it,
times the escape probability d / (n + d) of every longer context (n symbols
seen, d of them distinct); a byte seen in no context costs eight bits more.
The tree is frozen before scoring; a text's language is the one whose tree
codes the whole text in the fewest bits.

Trees are learned from a sample of labelled rows: ``sample_docs`` is the
expected bound per language on distinct texts, which are taken by a hash, whole
and once each.  All contexts of the sample are kept, over all 256 byte values
(ASCII letters are folded to lower case).

Defined cases: null texts and texts without a letter give ``und`` with score
0, and so does everything if there is nothing to learn from; ties go to the
language first in order; extra columns pass through, one named like an output
column is replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import binary_parts, blocks, crc32_mod, is_text, outside

ORDER = 3
BLOCK = 1 << 20
MADE = ["lang_pred", "score"]
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
SLOTS = 22                                     # bits of a lookup table


def _symbols(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For each byte itself and the three before it as one 32-bit number; a
    text begins as if after three zero bytes."""
    now = FOLD[data].astype(np.uint32)
    starts = off[:-1][off[:-1] < len(data)]
    code = now.copy()
    for k in range(1, ORDER + 1):
        before = np.empty_like(now)
        before[0], before[1:] = 0, now[:-1]
        before[starts] = 0
        code |= before << np.uint32(8 * k)
        now = before
    return code


class Lookup:
    """Row numbers of sorted 32-bit keys, by a table of hashed slots; a slot
    that two keys share is searched."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.table = np.full(1 << SLOTS, -1, np.int32)
        self.table[self._slot(keys)] = np.arange(len(keys), dtype=np.int32)

    @staticmethod
    def _slot(codes: np.ndarray) -> np.ndarray:
        return (codes * np.uint32(2654435761)) >> np.uint32(32 - SLOTS)

    def rows(self, codes: np.ndarray) -> np.ndarray:
        """Row of each code, -1 if it is no key."""
        row = self.table[self._slot(codes)]
        other = np.flatnonzero((row >= 0) & (self.keys[row] != codes)) if len(self.keys) else []
        if len(other):
            at = np.searchsorted(self.keys, codes[other]).clip(max=len(self.keys) - 1)
            row[other] = np.where(self.keys[at] == codes[other], at, -1)
        return row


def _shares(count: np.ndarray, context: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Cost of each symbol seen (counts with their contexts, numbers below
    ``size``), and each context's escape cost (0 where nothing was seen)."""
    total, kinds = np.bincount(context, count, size), np.bincount(context, minlength=size)
    with np.errstate(divide="ignore", invalid="ignore"):
        escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
        return -np.log2(count / (total + kinds)[context]), escape


class Trees:
    """Frozen context trees as cost tables."""

    def __init__(self, langs: list[str], counts: pd.DataFrame):
        self.langs, n = langs, len(langs)
        self.four = np.sort(counts["gram"].unique()).astype(np.uint32)
        low = np.uint32(0xFFFFFF)
        # strings of three bytes: a context of order 3, or a context of order 2 and its symbol
        self.three = np.unique(np.concatenate([self.four >> np.uint32(8), self.four & low]))
        self.cost4 = np.zeros((len(self.four), n), np.float32)
        self.cost3, self.escape3 = np.zeros((2, len(self.three), n), np.float32)
        self.cost2, self.escape2 = np.zeros((2, 1 << 16, n), np.float32)
        for k in range(n):
            c = counts[counts["lang"] == k]
            grams, count = c["gram"].to_numpy(np.int64), c["n"].to_numpy(np.float64)
            cost = np.full(1, 8.0)                     # order -1: all bytes alike
            for order in (0, 1):
                seen = np.bincount(grams & ((1 << 8 * order + 8) - 1), count, 1 << 8 * order + 8)
                at = np.flatnonzero(seen)
                bits, escape = _shares(seen[at], at >> 8, 1 << 8 * order)
                cost = np.repeat(escape, 256) + np.tile(cost, 256 if order == 1 else 256 // len(cost))
                cost[at] = bits
            self.cost2[:, k] = cost
            thirds, back = np.unique(grams & 0xFFFFFF, return_inverse=True)
            bits, self.escape2[:, k] = _shares(np.bincount(back, count), thirds >> 8, 1 << 16)
            self.cost3[:, k] = self.escape2[self.three >> np.uint32(8), k] + self.cost2[self.three & np.uint32(0xFFFF), k]
            self.cost3[np.searchsorted(self.three, thirds), k] = bits
            context = np.searchsorted(self.three, grams >> 8)
            bits, self.escape3[:, k] = _shares(count, context, len(self.three))
            self.cost4[:, k] = self.escape3[np.searchsorted(self.three, self.four >> np.uint32(8)), k] + \
                self.cost3[np.searchsorted(self.three, self.four & low), k]
            self.cost4[np.searchsorted(self.four, grams), k] = bits
        self._index = None

    def __getstate__(self):
        return self.__dict__ | {"_index": None}

    def lengths(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Code length in bits of each text under each language's tree."""
        if self._index is None:
            self._index = Lookup(self.four), Lookup(self.three)
        four, three = self._index
        out = np.zeros((len(off) - 1, len(self.langs)))
        if not len(data):
            return out
        code = _symbols(data, off)
        row = four.rows(code)
        bits = self.cost4[row] if len(self.four) else np.zeros((len(row), len(self.langs)), np.float32)
        rare = np.flatnonzero(row < 0)
        new = code[rare]
        context, last = three.rows(new >> np.uint32(8)), three.rows(new & np.uint32(0xFFFFFF))
        back = self.escape2[(new >> np.uint32(8)) & np.uint32(0xFFFF)] + self.cost2[new & np.uint32(0xFFFF)]
        if len(self.three):
            back = np.where((last >= 0)[:, None], self.cost3[last], back)
            back += np.where((context >= 0)[:, None], self.escape3[context], np.float32(0))
        bits[rare] = back
        full = np.flatnonzero(np.diff(off) > 0)
        out[full] = np.add.reduceat(bits, off[full], axis=0, dtype=np.float64)
        return out


def learn(docs: DataFrame, text: str, lang: str, train: Column, sample_docs: int = 1500) -> Trees | None:
    """Trees from a sample of the rows where ``train`` holds and ``lang`` is
    not null."""
    rows = docs.where(train & F.col(lang).isNotNull() & F.col(text).isNotNull()).withColumn("_h", F.xxhash64(text))
    sizes = {r[0]: max(1, r[1]) for r in rows.groupBy(lang).agg(F.approx_count_distinct("_h")).collect()}
    if not sizes:
        return None
    langs = sorted(sizes)
    scale = 1 << 30
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(int(min(1.0, sample_docs / sizes[k]) * scale)))])
    rank = F.create_map(*[x for i, k in enumerate(langs) for x in (F.lit(k), F.lit(i))])
    # equal texts are learned once, however often they occur
    sample = (rows.where(F.pmod("_h", F.lit(scale)) < share[F.col(lang)])
              .groupBy(rank[F.col(lang)].alias("lang"), "_h").agg(F.first(is_text(text)).alias("t")).select("lang", "t"))

    def count_grams(batches):
        for b in batches:
            of, (data, off) = b.column(0).to_numpy(), binary_parts(b.column(1))
            for i, j in blocks(off, BLOCK):
                code = _symbols(data[off[i]:off[j]], off[i:j + 1] - off[i]) if off[j] > off[i] else []
                key = (np.repeat(of[i:j].astype(np.int64), np.diff(off[i:j + 1])) << 32) | np.asarray(code, np.int64)
                key, n = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.astype(np.int64))], ["key", "n"])

    got = (sample.mapInArrow(count_grams, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toPandas())
    key = got["key"].to_numpy(np.int64)
    return Trees(langs, pd.DataFrame({"lang": key >> 32, "gram": key & 0xFFFFFFFF, "n": got["n"].to_numpy()}))


def identify(df: DataFrame, trees: Trees | None, text: str = "text") -> DataFrame:
    """Input columns, then lang_pred and score (the share of the best language
    if all were equally likely before)."""
    rest = outside(df, MADE)
    src = df.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(rest)], is_text(text).alias("t"),
                    F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    if trees is None:
        return src.drop("t", "letters").toDF(*rest).withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})

    def run(batches):
        for b in batches:
            data, off = binary_parts(b.column(len(rest)))
            bits = [trees.lengths(data[off[i]:off[j]], off[i:j + 1] - off[i]) for i, j in blocks(off, BLOCK)]
            bits = np.concatenate(bits) if bits else np.zeros((0, len(trees.langs)))
            best = bits.argmin(1)
            p = 1 / np.exp2(np.minimum(bits.min(1, keepdims=True) - bits, 0)).sum(1) if len(bits) else np.zeros(0)
            ok = b.column(len(rest) + 1).to_numpy(zero_copy_only=False)
            names = [trees.langs[k] if o else "und" for k, o in zip(best, ok)]
            yield pa.RecordBatch.from_arrays([*b.columns[:len(rest)], pa.array(names, pa.string()),
                                              pa.array(np.where(ok, p, 0.0))], [*b.schema.names[:len(rest)], *MADE])

    kinds = ", ".join([f"c{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(rest)]
                      + ["lang_pred string", "score double"])
    return src.mapInArrow(run, kinds).toDF(*rest, *MADE)


def op6_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fold = crc32_mod("doc_id", 4)
    trees = learn(docs, "text", "lang", fold != 2)
    out = identify(docs.select("doc_id", "text", (fold == 2).alias("held_out")), trees)
    return out.select("doc_id", "held_out", "lang_pred", "score")
