"""Fixed table schemas of the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILES = T.StructType([
    T.StructField("package_id", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("size", T.LongType()),
    T.StructField("content", T.StringType()),
])

LINES = T.StructType([
    T.StructField("package_id", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("line_no", T.IntegerType()),
    T.StructField("line", T.StringType()),
])

ORD = T.StructType([
    T.StructField("eng", T.IntegerType()),      # ast 0, pattern 1, manifest 2, residue 3
    T.StructField("path", T.StringType()),
    T.StructField("phase", T.IntegerType()),
    T.StructField("line", T.IntegerType()),
    T.StructField("k", T.LongType()),
])

FINDINGS = T.StructType([
    T.StructField("package_id", T.StringType()),
    T.StructField("rule_id", T.StringType()),
    T.StructField("engine", T.StringType()),
    T.StructField("layer", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("line", T.IntegerType()),
    T.StructField("snippet", T.StringType()),
    T.StructField("evidence", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("remediation", T.StringType()),
    T.StructField("refs", T.ArrayType(T.StringType())),
    T.StructField("ord", ORD),
])

FINDING_COLUMNS = [f.name for f in FINDINGS.fields]

# One rule hit before it is placed in a file/line context.
HIT = T.StructType([
    T.StructField("rule_id", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("evidence", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("remediation", T.StringType()),
    T.StructField("refs", T.ArrayType(T.StringType())),
    T.StructField("snippet", T.StringType()),
    T.StructField("phase", T.IntegerType()),
    T.StructField("k", T.LongType()),
    T.StructField("group", T.StringType()),
])

ENGINE_RANK = {"ast": 0, "pattern": 1, "manifest": 2, "residue": 3}


def _c(v, dtype=None) -> Column:
    if isinstance(v, Column):
        return v.cast(dtype) if dtype is not None else v
    if isinstance(v, (list, tuple)):
        c = F.array(*[F.lit(x) for x in v]) if v else F.array()
        return c.cast(dtype or T.ArrayType(T.StringType()))
    return F.lit(v).cast(dtype) if dtype is not None else F.lit(v)


def hit(rule_id, severity, confidence, title, description, evidence=None, tags=(), remediation=None,
        refs=(), snippet=None, phase=0, k=0, group=None) -> Column:
    """A HIT struct from literals or columns."""
    return F.struct(
        _c(rule_id, T.StringType()).alias("rule_id"),
        _c(severity, T.StringType()).alias("severity"),
        _c(confidence, T.DoubleType()).alias("confidence"),
        _c(title, T.StringType()).alias("title"),
        _c(description, T.StringType()).alias("description"),
        _c(evidence, T.StringType()).alias("evidence"),
        _c(list(tags) if not isinstance(tags, Column) else tags, T.ArrayType(T.StringType())).alias("tags"),
        _c(remediation, T.StringType()).alias("remediation"),
        _c(list(refs) if not isinstance(refs, Column) else refs, T.ArrayType(T.StringType())).alias("refs"),
        _c(snippet, T.StringType()).alias("snippet"),
        _c(phase, T.IntegerType()).alias("phase"),
        _c(k, T.LongType()).alias("k"),
        _c(group, T.StringType()).alias("group"),
    )


def findings_from_hits(df: DataFrame, engine: str, layer: str, path: Column | str = "path",
                       line: Column | str | None = "line_no", default_snippet: Column | None = None,
                       hits_col: str = "h") -> DataFrame:
    """Turn rows holding one HIT struct in ``hits_col`` into FINDINGS rows."""
    path_c = F.col(path) if isinstance(path, str) else path
    line_c = (F.col(line) if isinstance(line, str) else line) if line is not None else F.lit(None)
    h = F.col(hits_col)
    snip = F.coalesce(h["snippet"], default_snippet) if default_snippet is not None else h["snippet"]
    return df.select(
        F.col("package_id"), h["rule_id"].alias("rule_id"), F.lit(engine).alias("engine"),
        F.lit(layer).alias("layer"), h["severity"].alias("severity"), h["confidence"].alias("confidence"),
        h["title"].alias("title"), h["description"].alias("description"), path_c.cast("string").alias("path"),
        line_c.cast("int").alias("line"), snip.alias("snippet"), h["evidence"].alias("evidence"),
        h["tags"].alias("tags"), h["remediation"].alias("remediation"), h["refs"].alias("refs"),
        F.struct(F.lit(ENGINE_RANK[engine]).alias("eng"), path_c.cast("string").alias("path"),
                 h["phase"].alias("phase"), line_c.cast("int").alias("line"), h["k"].alias("k")).alias("ord"),
    )


def empty_findings(spark) -> DataFrame:
    return spark.createDataFrame([], FINDINGS)
