"""Corpus analytics A1-A14 over ``scores`` and ``findings`` of a scan, and
SRC12 (reading stored per-package scan reports back into those tables).

Everything is an aggregate, a join against a tiny fixed dimension, or an
ordered limit where the limit is the report (top rules, riskiest
packages).  The systematic sample ranks packages globally without funnelling
them through one task: range partitioning + per-partition counts + offsets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.scoring import SEVERITIES, active

GRADES = ["A", "B", "C", "D", "F"]


def _share(count_col: str, total: F.Column) -> F.Column:
    return F.round(F.col(count_col) * 100.0 / total, 1)


def grade_distribution(scores: DataFrame) -> DataFrame:
    """A1: packages per grade with percentage; grades without packages kept."""
    spark = scores.sparkSession
    dim = spark.createDataFrame([(g, i) for i, g in enumerate(GRADES)], "grade string, gi int")
    c = scores.groupBy("grade").agg(F.count("*").alias("n"))
    j = F.broadcast(dim).join(c, "grade", "left").fillna(0, ["n"])
    return j.select("grade", F.col("n").cast("long").alias("n"),
                    _share("n", F.sum("n").over(Window.partitionBy())).alias("pct"))


def severity_distribution(findings: DataFrame) -> DataFrame:
    """A2: active findings per severity with percentage."""
    spark = findings.sparkSession
    dim = spark.createDataFrame([(s,) for s in SEVERITIES], "severity string")
    c = active(findings).groupBy("severity").agg(F.count("*").alias("n"))
    j = F.broadcast(dim).join(c, "severity", "left").fillna(0, ["n"])
    return j.select("severity", F.col("n").cast("long").alias("n"),
                    _share("n", F.sum("n").over(Window.partitionBy())).alias("pct"))


def top_rules(findings: DataFrame, k: int = 15) -> DataFrame:
    """A3: most frequent rules (the limit is the report)."""
    c = active(findings).groupBy("rule_id").agg(F.count("*").alias("hits"))
    top = c.orderBy(F.desc("hits"), "rule_id").limit(k)
    return top.select(F.row_number().over(Window.orderBy(F.desc("hits"), "rule_id")).alias("rank"),
                      "rule_id", "hits")


def rule_severity_matrix(findings: DataFrame) -> DataFrame:
    """A4: rule x severity counts (pivot on the 5 known severities)."""
    return active(findings).groupBy("rule_id").pivot("severity", SEVERITIES).agg(F.count(F.lit(1))) \
        .fillna(0, SEVERITIES)


def tag_distribution(scores: DataFrame) -> DataFrame:
    """A5: packages per behavior tag and their share of all packages."""
    total = scores.agg(F.count("*").alias("total"))
    t = scores.select("package_id", F.explode("behavior_tags").alias("tag")).groupBy("tag") \
        .agg(F.countDistinct("package_id").alias("packages"))
    return t.crossJoin(F.broadcast(total)).select("tag", "packages", _share("packages", F.col("total")).alias("pct"))


def riskiest_packages(scores: DataFrame, k: int = 10) -> DataFrame:
    """Worst grade first, then critical, high, medium counts, then name."""
    order = F.when(F.col("grade") == "F", 0).when(F.col("grade") == "D", 1).when(F.col("grade") == "C", 2) \
        .when(F.col("grade") == "B", 3).otherwise(4)
    return scores.select("package_id", "grade", "n_critical", "n_high", "n_medium", "n_low",
                         order.alias("go")) \
        .orderBy("go", F.desc("n_critical"), F.desc("n_high"), F.desc("n_medium"), "package_id").limit(k).drop("go")


def safe_packages(scores: DataFrame) -> DataFrame:
    """Grade-A packages by name."""
    return scores.where(F.col("grade") == "A").select("package_id").orderBy("package_id")


def findings_per_package(findings: DataFrame, packages: DataFrame) -> DataFrame:
    """Per-package active counts by severity and in total."""
    c = active(findings).groupBy("package_id").agg(
        *[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in SEVERITIES], F.count("*").alias("total"))
    return packages.select("package_id").join(c, "package_id", "left") \
        .fillna(0, [f"n_{s}" for s in SEVERITIES] + ["total"])


def findings_histogram(findings: DataFrame, packages: DataFrame) -> DataFrame:
    """Packages by active-finding count bucket (50 falls in 21-50)."""
    per = findings_per_package(findings, packages)
    n = F.col("total")
    b = (F.when(n == 0, "0").when(n <= 5, "1-5").when(n <= 10, "6-10").when(n <= 20, "11-20")
         .when(n <= 50, "21-50").otherwise("50+"))
    spark = findings.sparkSession
    dim = spark.createDataFrame([(x, i) for i, x in enumerate(["0", "1-5", "6-10", "11-20", "21-50", "50+"])],
                                "bucket string, bi int")
    c = per.groupBy(b.alias("bucket")).agg(F.count("*").alias("packages"))
    return F.broadcast(dim).join(c, "bucket", "left").fillna(0, ["packages"]).select("bucket", "bi", "packages")


def platform_distribution(platforms: DataFrame) -> DataFrame:
    """A10: packages per detected platform."""
    return platforms.groupBy("platform").agg(F.count("*").alias("packages"))


def packages_with(findings: DataFrame) -> DataFrame:
    """Packages having a critical finding, an S8 finding, an S13 finding."""
    a = active(findings)
    crit = a.where(F.col("severity") == "critical").select(F.lit("critical").alias("criterion"), "package_id")
    s8 = a.where(F.col("rule_id") == "S8").select(F.lit("S8").alias("criterion"), "package_id")
    s13 = a.where(F.col("rule_id") == "S13").select(F.lit("S13").alias("criterion"), "package_id")
    return crit.unionByName(s8).unionByName(s13).distinct()


def scan_time_stats(reports: DataFrame) -> DataFrame:
    """Mean scan time (the report's number) plus p50 / p95 / max."""
    return scan_time_history(scan_time_sketches(reports.withColumn("batch", F.lit(0)), "batch"))


def scan_time_sketches(reports: DataFrame, batch: str, k: int = 800) -> DataFrame:
    """One row per batch of reports: exact count, sum and maximum of the scan
    times and a mergeable quantile sketch (KLL; ``k`` of 800 keeps ranks within
    about 0.5 %).  Stored with the batch, it stands for its reports: history is
    summed up without reading them again."""
    d = F.col("scan_duration_ms").cast("long")
    return reports.groupBy(batch).agg(F.count(d).alias("scans"), F.sum(d).alias("total_ms"), F.max(d).alias("max_ms"),
                                      F.kll_sketch_agg_bigint(d, F.lit(k)).alias("sketch"))


def scan_time_history(sketches: DataFrame, *by: str) -> DataFrame:
    """A12 over stored batches: sketches are merged, no report is read."""
    q = lambda x: F.when(F.col("scans") > 0, F.kll_sketch_get_quantile_bigint("sketch", F.lit(x)))
    merged = sketches.where("scans > 0").groupBy(*by).agg(
        F.sum("scans").alias("scans"), F.sum("total_ms").alias("total_ms"), F.max("max_ms").alias("max_ms"),
        F.kll_merge_agg_bigint("sketch").alias("sketch"))
    return merged.select(*by, "scans", (F.col("total_ms") / F.col("scans")).alias("avg_ms"), q(0.5).alias("p50_ms"),
                         q(0.95).alias("p95_ms"), "max_ms", "total_ms")


def global_rank(df: DataFrame, key: str, n_partitions: int | None = None) -> DataFrame:
    """0-based rank of rows by ``key`` without a single-task window.

    Rows are range-partitioned and sorted inside partitions; each row's
    partition id and position come from ``monotonically_increasing_id``;
    the per-partition counts (one row per partition) are prefix-summed and
    joined back as offsets."""
    n = n_partitions or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    s = df.repartitionByRange(n, key).sortWithinPartitions(key) \
        .withColumn("_mid", F.monotonically_increasing_id())
    s = s.withColumn("_pid", F.shiftright("_mid", 33)).withColumn("_pos", F.col("_mid").bitwiseAND((1 << 33) - 1))
    s = s.checkpoint()  # freeze ids: counts and rows must see the same numbering
    counts = s.groupBy("_pid").agg(F.count("*").alias("_n"))
    offs = counts.select("_pid", (F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)))
                         .alias("_off")).fillna(0, ["_off"])
    return s.join(F.broadcast(offs), "_pid").select(*df.columns, (F.col("_off") + F.col("_pos")).alias("rank"))


def group_rank(df: DataFrame, group: list[str], order: list[str], n_partitions: int | None = None) -> DataFrame:
    """1-based position of each row inside its group by ``order``, without a
    per-group window: a global rank over range-partitioned (group, order)
    keys, minus the rank of the group's first row.  A group holding a third
    of all rows spans many partitions instead of one task."""
    keyed = df.withColumn("_gk", F.struct(*[F.col(c) for c in group + order]))
    r = global_rank(keyed, "_gk", n_partitions)
    first = r.groupBy(*group).agg(F.min("rank").alias("_first"))
    return r.join(first, group).select(*df.columns, (F.col("rank") - F.col("_first") + 1).alias("n"))


def systematic_sample(files: DataFrame, every: int = 34) -> DataFrame:
    """Packages that have code files, by name, every ``every``-th one
    (ranks 0, every, 2*every, ...).  A sampling operator: the modulo is the
    feature."""
    code = files.where(F.regexp_extract("path", r"(\.[^./]*)$", 1).isin(".py", ".js", ".ts", ".sh", ".mjs", ".cjs",
                                                                         ".jsx", ".tsx", ".bash")) \
        .select("package_id").distinct()
    r = global_rank(code, "package_id")
    return r.where(F.col("rank") % every == 0).select("package_id", "rank")


def scan_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Two scan versions per package: active findings before / after,
    reduction percentage and grade change (full outer join on package)."""
    from ..operators.scoring import grade_expr

    def summary(f, tag):
        c = active(f).groupBy("package_id").agg(
            *[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in SEVERITIES], F.count("*").alias("n"))
        return c.select("package_id", F.col("n").alias(f"n_{tag}"), grade_expr().alias(f"grade_{tag}"))

    b, a = summary(before, "before"), summary(after, "after")
    j = b.join(a, "package_id", "full_outer")
    nb, na = F.coalesce("n_before", F.lit(0)), F.coalesce("n_after", F.lit(0))
    return j.select("package_id", nb.alias("n_before"), na.alias("n_after"),
                    F.when(nb > 0, F.round((nb - na) * 100.0 / nb, 1)).alias("reduction_pct"),
                    F.coalesce("grade_before", F.lit("A")).alias("grade_before"),
                    F.coalesce("grade_after", F.lit("A")).alias("grade_after"))


def finding_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per-finding difference of two scans on (package, rule, path, line, title)."""
    k = ["package_id", "rule_id", "path", "line", "title"]
    gone = active(before).select(*k).exceptAll(active(after).select(*k)).withColumn("change", F.lit("removed"))
    new = active(after).select(*k).exceptAll(active(before).select(*k)).withColumn("change", F.lit("added"))
    return gone.unionByName(new)


# ------------------------------------------------------------------ SRC12
REPORT_FINDING = T.StructType([
    T.StructField("rule_id", T.StringType()), T.StructField("engine", T.StringType()),
    T.StructField("layer", T.StringType()), T.StructField("severity", T.StringType()),
    T.StructField("confidence", T.DoubleType()), T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()), T.StructField("file_path", T.StringType()),
    T.StructField("line", T.IntegerType()), T.StructField("code_snippet", T.StringType()),
    T.StructField("evidence", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("remediation", T.StringType()), T.StructField("references", T.ArrayType(T.StringType())),
    T.StructField("suppressed", T.BooleanType()),
])
REPORT = T.StructType([
    T.StructField("target", T.StructType([T.StructField("path", T.StringType()),
                                          T.StructField("platform", T.StringType()),
                                          T.StructField("url", T.StringType())])),
    T.StructField("grade", T.StringType()), T.StructField("risk_level", T.StringType()),
    T.StructField("key_risks", T.ArrayType(T.StringType())),
    T.StructField("behavior_tags", T.ArrayType(T.StringType())),
    T.StructField("findings", T.ArrayType(REPORT_FINDING)),
    T.StructField("scan_duration_ms", T.LongType()),
    T.StructField("_scan_meta", T.StructType([T.StructField("author", T.StringType()),
                                              T.StructField("skill", T.StringType()),
                                              T.StructField("author_skill", T.StringType()),
                                              T.StructField("scan_time_s", T.DoubleType())])),
])


def read_scan_reports(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """SRC12: stored per-package scan JSON -> (reports/scores, findings).

    The package id is ``_scan_meta.author_skill`` when present, else the
    target path.  Each file is one multi-line JSON object, or with
    ``multi_line=False`` JSON lines as ``write_scan_json`` writes them (a
    package in several parts then has as many report rows)."""
    r = spark.read.schema(REPORT).option("multiLine", str(multi_line).lower()).json(path)
    pid = F.coalesce(F.col("_scan_meta.author_skill"), F.col("target.path"))
    reports = r.select(pid.alias("package_id"), F.col("target.platform").alias("platform"), "grade", "risk_level",
                       "key_risks", "behavior_tags", "scan_duration_ms")
    f = r.select(pid.alias("package_id"), F.inline("findings")).select(
        "package_id", "rule_id", "engine", "layer", "severity", "confidence", "title", "description",
        F.col("file_path").alias("path"), "line", F.col("code_snippet").alias("snippet"), "evidence", "tags",
        "remediation", F.col("references").alias("refs"), "suppressed")
    return reports, f
