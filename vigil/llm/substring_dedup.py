"""Substring dedup with a count-min prefilter.

Every word (run of bytes other than ASCII white space) that lies in a window
of ``width`` consecutive words whose sequence also starts anywhere else, in
the same document or another, is removed.  Windows are judged on the input.
The merged partition sketches only choose which windows are grouped exactly
(see :mod:`vigil.llm.sketch`); they overestimate, so none is lost.

Defined cases: null, empty and shorter texts lose nothing; rows that occur
more than once are copies of each other; extra columns pass through, one named
like an output column is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import binary_parts, blocks, is_text, outside, partitions, window_hashes, word_hashes
from vigil.llm.sketch import KeySet, Plan, chunked, covered, repeated_windows

BLOCK = 1 << 20
MADE = ["kept_text", "n_words", "n_removed"]


def remove_repeats(df: DataFrame, text: str = "text", width: int = 35, as_is: bool = False) -> DataFrame:
    """Input columns other than ``text``, then kept_text (kept words joined by
    one space; with ``as_is`` a text that loses nothing is returned as it
    stands, null included), n_words and n_removed."""
    rest = [c for c in outside(df, MADE) if c != text]
    src = df.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(rest)], is_text(text).alias("t"),
                    F.col(text).isNull().alias("none"))
    size = src.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    plan = Plan(size, size // 6, partitions(df.sparkSession))
    texts = chunked(src, plan)

    def parts(t: pa.Table):
        data, off = binary_parts(t["t"])
        for i, j in blocks(off, BLOCK):
            h, doc = word_hashes(data[off[i]:off[j]], off[i:j + 1] - off[i])
            yield (i, j, doc, len(h), *window_hashes(h, doc, width))

    def windows(t: pa.Table):
        for *_, a, b in parts(t):
            yield a, b

    def mark(t, reply):
        keys = KeySet(reply["keys"].to_pylist())
        kept, total, gone = [], [], []
        data, off = binary_parts(t["t"])
        for i, j, doc, n, at, a, b in parts(t):
            out = covered(at[keys.has(a, b)], width, n)
            cut = np.searchsorted(doc, np.arange(j - i + 1))
            for k in range(j - i):
                mine, raw = out[cut[k]:cut[k + 1]], data[off[i + k]:off[i + k + 1]].tobytes()
                lost = int(mine.sum())
                total.append(len(mine))
                gone.append(lost)
                if as_is and not lost:
                    kept.append(raw)
                else:
                    words = raw.split()
                    kept.append(b" ".join(w for w, x in zip(words, mine.tolist()) if not x) if lost else b" ".join(words))
        none = t["none"].to_pylist()
        if as_is:
            kept = [None if x else k for k, x in zip(kept, none)]
        cols = {f"c{i}": t[f"c{i}"] for i in range(len(rest))}
        return pa.table(cols | {"kept": pa.array(kept, pa.binary()), "n": pa.array(total, pa.int64()),
                                "gone": pa.array(gone, pa.int64())})

    keys = repeated_windows(texts, plan, windows)
    kinds = ", ".join([f"c{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(rest)]
                      + ["kept binary", "n long", "gone long"])
    done = texts.groupBy("chunk").cogroup(keys.groupBy("chunk")).applyInArrow(mark, kinds)
    return done.withColumn("kept", F.col("kept").cast("string")).toDF(*rest, *MADE)


def op1_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed",
                                       F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
