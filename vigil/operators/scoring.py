"""Suppression, scoring, gating and report sinks over ``findings``.

All per-package outputs are aggregates whose size is bounded by the number
of distinct rules / severities, never by the number of findings, so a
package holding a third of all rows still reduces map-side first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import py_strip, severity_rank, severity_score
from ..rules import packs as R
from ..sources.files import to_lines

SEVERITIES = ["critical", "high", "medium", "low", "info"]


# ------------------------------------------------------------------ SRC11
def parse_ignore_files(files: DataFrame, name: str = R.IGNORE_FILE) -> DataFrame:
    """``RULE[:glob[:line]]`` entries of each package's ignore file ->
    (package_id, rule_id, glob, line).  Blank and ``#`` lines are skipped;
    an entry whose line part is not an integer is dropped."""
    ln = to_lines(files.where(F.col("path") == name))
    e = py_strip(F.col("line"))
    parts = F.split(e, ":")
    rows = ln.select("package_id", e.alias("e"), parts.alias("p")).where((F.col("e") != "") & ~F.col("e").startswith("#"))
    line_txt = F.get(F.col("p"), 2)
    out = rows.select(
        "package_id", F.get(F.col("p"), 0).alias("rule_id"),
        F.coalesce(F.get(F.col("p"), 1), F.lit("*")).alias("glob"),
        F.expr("try_cast(trim(get(p, 2)) AS INT)").alias("line"), line_txt.alias("line_txt"))
    return out.where(F.col("line_txt").isNull() | F.col("line").isNotNull()).drop("line_txt")


def glob_regex(glob: Column) -> Column:
    """fnmatch translation as a column expression: ``*`` any text, ``?`` any
    character, ``[seq]`` and ``[!seq]`` one character; a bracket that is never
    closed and everything else stand for themselves."""
    tokens = F.regexp_extract_all(glob, F.lit(r"(?s)\[!?\]?[^\]]*\]|."), 0)

    def piece(t):
        negated = t.startswith("[!")
        skip = F.when(negated, 3).otherwise(2)
        inner = F.substr(t, skip, F.length(t) - skip)
        # reversed ranges match nothing and are dropped; then all but '-' is escaped
        ranges = F.regexp_extract_all(inner, F.lit("(?s).-."), 0)
        bad = F.filter(ranges, lambda r: F.ascii(F.substring(r, 1, 1)) > F.ascii(F.substring(r, 3, 1)))
        kept = F.aggregate(bad, inner, lambda acc, r: F.replace(acc, r, F.lit("")))
        body = F.regexp_replace(kept, r"([\\\[\]&~|^])", r"\\$1")
        bracket = (F.when(body == "", F.when(negated, F.lit(".")).otherwise(F.lit("(?!)")))
                   .otherwise(F.concat(F.lit("["), F.when(negated, F.lit("^")).otherwise(F.lit("")), body, F.lit("]"))))
        return (F.when(t == "*", F.lit(".*")).when(t == "?", F.lit("."))
                .when((F.length(t) > 2) & t.startswith("["), bracket)
                .otherwise(F.concat(F.lit("\\Q"), t, F.lit("\\E"))))

    return F.concat(F.lit("^(?s:"), F.array_join(F.transform(tokens, piece), ""), F.lit(")$"))


PLACE = ["package_id", "rule_id", "path", "line"]
SIZES = (0, 2, 4, 8, 16, 32, 64, 128)


def glob_key(glob: Column) -> Column:
    """What a glob is filed under: its plain beginning or its plain end,
    whichever is longer, cut to one of SIZES characters.  Every path that
    matches has it among its ``path_keys``."""
    def cut(c):
        size = F.lit(0)
        for n in SIZES[1:]:
            size = F.when(F.length(c) >= n, n).otherwise(size)
        return size

    head = F.regexp_extract(glob, r"^([^*?\[]*)", 1)
    tail = F.regexp_extract(glob, r"([^*?\]]*)$", 1)      # a bracket that is never closed stands for itself
    return (F.when(cut(head) >= cut(tail), F.concat(F.lit("<"), F.substring(head, F.lit(1), cut(head))))
            .otherwise(F.concat(F.lit(">"), F.right(tail, cut(tail)))))


def path_keys(path: Column) -> Column:
    """The beginnings and ends of a path that globs are filed under."""
    return F.array_compact(F.array(*[F.when(F.length(path) >= n, F.concat(F.lit("<"), F.substring(path, 1, n))) for n in SIZES],
                                   *[F.when(F.length(path) >= n, F.concat(F.lit(">"), F.right(path, F.lit(n)))) for n in SIZES[1:]]))


def apply_suppressions(findings: DataFrame, suppressions: DataFrame) -> DataFrame:
    """F-SUP: set ``suppressed`` (rows are kept).  Exact rule id, glob on the
    finding path (``*`` also matches findings without a path), optional line.

    The distinct places of the findings meet the entries: ``*`` and plain
    paths by equi-joins.  Globs with wildcards are filed under their plain
    beginning or end and places are looked up by theirs, so a regex runs only
    where package, rule and that piece agree.  The places found are then one flag
    joined to the findings, which are read twice (materialise them first)."""
    s = suppressions.select("package_id", "rule_id", "glob", F.col("line").alias("s_line")).distinct()
    at = findings.select("package_id", "rule_id", F.coalesce("path", F.lit("")).alias("path"),
                         F.coalesce("line", F.lit(-1)).alias("line")).distinct()
    same_line = F.col("s_line").isNull() | (F.col("s_line") == F.col("line"))
    wild = F.col("glob").rlike(r"[*?\[]")
    anywhere = at.join(s.where("glob = '*'").drop("glob"), ["package_id", "rule_id"])
    exact = at.join(s.where(~wild).withColumnRenamed("glob", "path").where("path <> ''"),
                    ["package_id", "rule_id", "path"])
    filed = (s.where(wild & (F.col("glob") != "*"))
             .select("package_id", "rule_id", "s_line", glob_key(F.col("glob")).alias("key"), glob_regex(F.col("glob")).alias("rx")))
    globbed = (at.where("path <> ''").withColumn("key", F.explode(path_keys(F.col("path"))))
               .join(filed, ["package_id", "rule_id", "key"]).where(F.regexp_like("path", F.col("rx"))))
    hit = anywhere.where(same_line).select(*PLACE)
    for x in (exact, globbed):
        hit = hit.unionByName(x.where(same_line).select(*PLACE))
    flag = hit.distinct().select("package_id", "rule_id", F.col("path").alias("_p"), F.col("line").alias("_l"),
                                 F.lit(True).alias("_hit"))
    keyed = findings.withColumns({"_p": F.coalesce("path", F.lit("")), "_l": F.coalesce("line", F.lit(-1))})
    return (keyed.join(flag, ["package_id", "rule_id", "_p", "_l"], "left")
            .select(*findings.columns, F.coalesce("_hit", F.lit(False)).alias("suppressed")))


def inline_suppressions(findings: DataFrame, lines: DataFrame) -> DataFrame:
    """F-INL (off by default in the pipeline): ``# scan:ignore R1,R2`` on the
    finding's own line suppresses the listed rules: one join of the findings
    with the marked lines."""
    marks = (lines.where(F.col("line").rlike(R.INLINE_IGNORE)).select(
        "package_id", "path", F.col("line_no").alias("line"),
        F.explode(F.array_distinct(F.transform(F.split(F.regexp_extract("line", R.INLINE_IGNORE, 1), ","), lambda x: F.trim(x))))
        .alias("rule_id"), F.lit(True).alias("_inline")).distinct())
    return (findings.join(marks, ["package_id", "path", "line", "rule_id"], "left")
            .select(*[F.coalesce("_inline", "suppressed").alias(c) if c == "suppressed" else F.col(c) for c in findings.columns]))


# ------------------------------------------------------------------ scoring
def active(findings: DataFrame) -> DataFrame:
    return findings.where(~F.coalesce(F.col("suppressed"), F.lit(False)))


def severity_counts(findings: DataFrame) -> DataFrame:
    """F-CNT: active counts per severity and package."""
    a = active(findings)
    return a.groupBy("package_id").agg(*[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in SEVERITIES])


def grade_expr() -> Column:
    c, h, m, lo = (F.col("n_critical"), F.col("n_high"), F.col("n_medium"), F.col("n_low"))
    return (F.when((c >= 1) | (h >= 3), "F").when((h >= 1) | (m >= 5), "D")
            .when(m >= 1, "C").when(lo >= 1, "B").otherwise("A"))


def risk_level_expr(grade: Column) -> Column:
    e = None
    for g, label, _ in R.GRADE_INFO:
        e = F.when(grade == g, label.lower()) if e is None else e.when(grade == g, label.lower())
    return e


def grades(packages: DataFrame, findings: DataFrame) -> DataFrame:
    """F-GRD: every package gets a grade; packages without active findings are A."""
    cnt = severity_counts(findings)
    j = packages.select("package_id").join(cnt, "package_id", "left").fillna(0, [f"n_{s}" for s in SEVERITIES])
    g = grade_expr()
    return j.select("package_id", *[F.col(f"n_{s}").cast("long").alias(f"n_{s}") for s in SEVERITIES],
                    g.alias("grade"), risk_level_expr(g).alias("risk_level"))


def key_risks(findings: DataFrame, top: int = 5) -> DataFrame:
    """F-RSK: per package, one line per rule (its worst, earliest finding),
    worst first, at most ``top``; info findings never count."""
    a = active(findings).where(F.col("severity") != "info")
    text = F.concat(F.upper("severity"), F.lit(": "), F.col("title"), F.lit(" ("), F.col("rule_id"), F.lit(")"))
    per_rule = a.groupBy("package_id", "rule_id").agg(
        F.min(F.struct((-severity_score(F.col("severity"))).alias("neg"), F.col("ord").alias("ord"),
                       text.alias("text"))).alias("r"))
    return per_rule.groupBy("package_id").agg(
        F.slice(F.array_sort(F.collect_list("r")), 1, top)["text"].alias("key_risks"))


def behavior_tags(findings: DataFrame) -> DataFrame:
    """F-TAG: sorted set of behavior tags per package (``S11/…`` counts as S11)."""
    spark = findings.sparkSession
    dim = spark.createDataFrame(R.BEHAVIOR_TAGS, "rid string, tag string")
    a = active(findings).select("package_id", F.regexp_extract("rule_id", r"^([^/]+)", 1).alias("rid"))
    return a.join(F.broadcast(dim), "rid").groupBy("package_id").agg(
        F.array_sort(F.collect_set("tag")).alias("behavior_tags"))


def scores(packages: DataFrame, findings: DataFrame) -> DataFrame:
    """``scores``: grade, risk level, counts, key risks and tags per package."""
    g = grades(packages, findings)
    k = key_risks(findings)
    t = behavior_tags(findings)
    return (g.join(k, "package_id", "left").join(t, "package_id", "left")
            .withColumn("key_risks", F.coalesce("key_risks", F.array().cast("array<string>")))
            .withColumn("behavior_tags", F.coalesce("behavior_tags", F.array().cast("array<string>"))))


def fail_on(findings: DataFrame, packages: DataFrame, threshold: str = "high") -> DataFrame:
    """F-GATE: true when an active finding is at or above ``threshold``."""
    t = R.SEVERITY_RANK[threshold]
    a = active(findings).groupBy("package_id").agg(
        F.bool_or(severity_rank(F.col("severity")) <= t).alias("fail"))
    return packages.select("package_id").join(a, "package_id", "left").select(
        "package_id", F.coalesce("fail", F.lit(False)).alias("fail"))


# ------------------------------------------------------------------ sinks
def grade_summary(scores_df: DataFrame) -> DataFrame:
    """SNK3: grade, label, recommendation and counts per package."""
    spark = scores_df.sparkSession
    dim = spark.createDataFrame(R.GRADE_INFO, "grade string, label string, recommendation string")
    return scores_df.join(F.broadcast(dim), "grade").select(
        "package_id", "grade", "label", "recommendation", *[f"n_{s}" for s in SEVERITIES])


def layered_report(findings: DataFrame, verbose: bool = False) -> DataFrame:
    """SNK4: active findings by layer, worst first; info only when verbose."""
    a = active(findings)
    if not verbose:
        a = a.where(F.col("severity") != "info")
    lr = F.when(F.col("layer") == "behavior", 0).when(F.col("layer") == "metadata", 1).otherwise(2)
    return a.select("*", lr.alias("layer_rank"), severity_score(F.col("severity")).alias("score")) \
        .orderBy("package_id", "layer_rank", F.desc("score"), "ord")


def detail_order(findings: DataFrame) -> DataFrame:
    """SNK5: findings by severity rank with ``path:line`` location text."""
    loc = F.when(F.col("line").isNotNull(), F.concat_ws(":", "path", F.col("line").cast("string"))) \
        .otherwise(F.col("path"))
    return active(findings).select("package_id", "rule_id", "severity", "title", loc.alias("location"),
                                   "remediation", severity_rank(F.col("severity")).alias("rank"), "ord") \
        .orderBy("package_id", "rank", "ord")


def _level() -> Column:
    return F.when(F.col("severity").isin("critical", "high"), "error").otherwise("warning")


def sarif_rules(findings: DataFrame) -> DataFrame:
    """SNK2 rules: one per (package, rule_id), titled and levelled by its
    first finding."""
    return active(findings).groupBy("package_id", "rule_id").agg(
        F.min(F.struct("ord", "title", _level().alias("level"))).alias("x")) \
        .select("package_id", "rule_id", F.col("x.title").alias("name"), F.col("x.level").alias("level"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """SNK2 results: level error for critical/high else warning; uri '.'
    and startLine 1 when missing."""
    return active(findings).select(
        "package_id", F.col("rule_id").alias("ruleId"), _level().alias("level"),
        F.col("description").alias("message"), F.coalesce(F.nullif(F.col("path"), F.lit("")), F.lit(".")).alias("uri"),
        F.coalesce(F.nullif(F.col("line"), F.lit(0)), F.lit(1)).alias("startLine"), "ord")


PART_ROWS = 5000     # findings in one nested document; a package with more has several


def _parts(findings: DataFrame) -> DataFrame:
    """Findings with their number in the package (from 0, in report order)
    and the number of their document part."""
    from ..plans.analytics import group_rank
    ranked = group_rank(findings, ["package_id"], ["ord", "title"])
    return ranked.withColumn("part", F.floor((F.col("n") - 1) / PART_ROWS).cast("int"))


def sarif_documents(findings: DataFrame, tool: str = "vigil", version: str = "1.0") -> DataFrame:
    """SNK2: (package_id, part, ``$schema``, version, runs): SARIF 2.1.0.  A
    package with more than PART_ROWS findings gets several documents, each
    with the rules its results use."""
    a = _parts(active(findings))
    level = _level()
    rule = F.struct(F.col("rule_id").alias("id"), F.struct(F.col("title").alias("text")).alias("shortDescription"),
                    F.struct(level.alias("level")).alias("defaultConfiguration"))
    rules = a.groupBy("package_id", "part", "rule_id").agg(F.min(F.struct("n", rule.alias("r"))).alias("x")) \
        .groupBy("package_id", "part").agg(F.array_sort(F.collect_list("x"))["r"].alias("rules"))
    uri = F.coalesce(F.nullif(F.col("path"), F.lit("")), F.lit("."))
    result = F.struct(
        F.col("rule_id").alias("ruleId"), level.alias("level"), F.struct(F.col("description").alias("text")).alias("message"),
        F.array(F.struct(F.struct(
            F.struct(uri.alias("uri")).alias("artifactLocation"),
            F.struct(F.coalesce(F.nullif(F.col("line"), F.lit(0)), F.lit(1)).alias("startLine")).alias("region"),
        ).alias("physicalLocation"))).alias("locations"))
    results = a.groupBy("package_id", "part").agg(
        F.array_sort(F.collect_list(F.struct("n", result.alias("r"))))["r"].alias("results"))
    driver = F.struct(F.lit(tool).alias("name"), F.lit(version).alias("version"), F.col("rules"))
    return results.join(rules, ["package_id", "part"]).select(
        "package_id", "part", F.lit("https://json.schemastore.org/sarif-2.1.0.json").alias("$schema"),
        F.lit("2.1.0").alias("version"),
        F.array(F.struct(F.struct(driver.alias("driver")).alias("tool"), F.col("results"))).alias("runs"))


def scan_documents(scores_df: DataFrame, findings: DataFrame, platforms: DataFrame | None = None) -> DataFrame:
    """SNK1: the nested scan result, one row per package (and part, beyond
    PART_ROWS findings): target, grade, risk_level, key_risks, behavior_tags
    and findings[] with the report's field names, suppressed ones included."""
    finding = F.struct(
        "rule_id", "engine", "layer", "severity", "confidence", "title", "description",
        F.col("path").alias("file_path"), "line", F.col("snippet").alias("code_snippet"), "evidence", "tags",
        "remediation", F.col("refs").alias("references"), "suppressed")
    parts = _parts(findings).groupBy("package_id", "part").agg(
        F.array_sort(F.collect_list(F.struct("n", finding.alias("f"))))["f"].alias("findings"))
    s = scores_df if platforms is None else scores_df.join(platforms, "package_id", "left")
    platform = F.lit(None).cast("string") if platforms is None else F.col("platform")
    target = F.struct(F.col("package_id").alias("path"), platform.alias("platform"),
                      F.lit(None).cast("string").alias("url"))
    return s.join(parts, "package_id", "left").select(
        "package_id", F.coalesce("part", F.lit(0)).alias("part"), target.alias("target"), "grade", "risk_level",
        "key_risks", "behavior_tags", F.coalesce("findings", F.array()).alias("findings"),
        F.lit(0).cast("long").alias("scan_duration_ms"))


def write_scan_json(scores_df: DataFrame, findings: DataFrame, out_dir: str, mode: str = "overwrite",
                    platforms: DataFrame | None = None) -> None:
    """SNK1 as JSON lines of nested results, which ``read_scan_reports`` reads
    back.  Files follow the partitions, not the packages."""
    scan_documents(scores_df, findings, platforms).drop("package_id", "part").write.mode(mode).json(out_dir)


def write_sarif(findings: DataFrame, out_dir: str, mode: str = "overwrite") -> None:
    """SNK2 as JSON lines, one SARIF document each."""
    sarif_documents(findings).drop("package_id", "part").write.mode(mode).json(out_dir)
