"""Registered queries: Spark builders and their DuckDB oracle SQL.

Every query reads the driver's tables through the seeded corpus, so its
work grows with them.  Column names are identical on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scoring as S
from ..operators import text_rules as TR
from ..rules import packs as R
from ..sources.corpus import seeded_files
from ..sources.files import scanned_files, stored_files, to_lines
from ..sources.rule_packs import RulePack
from . import code_expectations as X
from . import oracle as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

FIND_COLS = ["package_id", "path", "line", "rule_id", "severity", "title"]


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ------------------------------------------------------------------ shared inputs
def corpus(spark: SparkSession, sf_dir: str):
    files = seeded_files(spark, sf_dir)
    scanned = scanned_files(files)
    return files, scanned, to_lines(scanned)


def _line_rule(spark, sf_dir, rules, where=None, cols=FIND_COLS):
    _, _, lines = corpus(spark, sf_dir)
    f = TR.text_findings(lines, rules=rules)
    if where is not None:
        f = f.where(where)
    return f.select(*cols)


def _sql_rows(rows_sql: str, cols=("package_id", "path", "line", "rule_id", "severity", "title")) -> str:
    return O.with_corpus(f"SELECT {', '.join(cols)} FROM ({rows_sql})")


# ------------------------------------------------------------------ text rules
@register("p1_credentials", _sql_rows(O.p1_rows()))
def p1_credentials(spark, sf_dir):
    return _line_rule(spark, sf_dir, ("P1",))


@register("p4_hardcoded_ip", _sql_rows(O.p4_ip_rows()))
def p4_hardcoded_ip(spark, sf_dir):
    return _line_rule(spark, sf_dir, ("P4",), F.col("severity") == "medium")


@register("p4_dynamic_dns", _sql_rows(O.p4_ddns_rows()))
def p4_dynamic_dns(spark, sf_dir):
    return _line_rule(spark, sf_dir, ("P4",), F.col("severity") == "high")


@register("p6_prompt_injection", _sql_rows(O.p6_rows()))
def p6_prompt_injection(spark, sf_dir):
    return _line_rule(spark, sf_dir, ("P6",))


@register("p8_ioc", _sql_rows(O.p8_rows() .split("UNION ALL")[0]))
def p8_ioc(spark, sf_dir):
    return _line_rule(spark, sf_dir, ("P8",), F.col("title").startswith("IOC match"))


@register("p8_suspicious_tld", _sql_rows(O.p8_rows().split("UNION ALL")[1]))
def p8_suspicious_tld(spark, sf_dir):
    return _line_rule(spark, sf_dir, ("P8",), F.col("title").startswith("URL with suspicious TLD"))


@register("p9_long_lines", _sql_rows(O.p9_long_rows()))
def p9_long_lines(spark, sf_dir):
    return _line_rule(spark, sf_dir, ("P9",))


@register("p10_manipulation", _sql_rows(O.p10_rows(), ("package_id", "path", "line", "rule_id", "severity",
                                                         "title", "evidence")))
def p10_manipulation(spark, sf_dir):
    return _line_rule(spark, sf_dir, ("P10",), cols=FIND_COLS + ["evidence"])


# ------------------------------------------------------------------ minimum slice: P4a + P9b -> grade
def slice_findings(lines: DataFrame) -> DataFrame:
    f = TR.text_findings(lines, rules=("P4", "P9"))
    return f.where(~((F.col("rule_id") == "P4") & (F.col("severity") == "high")))


SLICE_SQL = (f"SELECT package_id, rule_id, severity FROM ({O.p4_ip_rows()}) "
             f"UNION ALL SELECT package_id, rule_id, severity FROM ({O.p9_long_rows()})")


def _grade_sql(findings_sql: str, packages_sql: str = "SELECT DISTINCT package_id FROM files") -> str:
    return f"""SELECT p.package_id,
  CAST(coalesce(n_critical, 0) AS BIGINT) AS n_critical, CAST(coalesce(n_high, 0) AS BIGINT) AS n_high,
  CAST(coalesce(n_medium, 0) AS BIGINT) AS n_medium, CAST(coalesce(n_low, 0) AS BIGINT) AS n_low,
  CAST(coalesce(n_info, 0) AS BIGINT) AS n_info,
  CASE WHEN coalesce(n_critical, 0) >= 1 OR coalesce(n_high, 0) >= 3 THEN 'F'
       WHEN coalesce(n_high, 0) >= 1 OR coalesce(n_medium, 0) >= 5 THEN 'D'
       WHEN coalesce(n_medium, 0) >= 1 THEN 'C' WHEN coalesce(n_low, 0) >= 1 THEN 'B' ELSE 'A' END AS grade
FROM ({packages_sql}) p LEFT JOIN (
  SELECT package_id, count(*) FILTER (WHERE severity = 'critical') AS n_critical,
    count(*) FILTER (WHERE severity = 'high') AS n_high, count(*) FILTER (WHERE severity = 'medium') AS n_medium,
    count(*) FILTER (WHERE severity = 'low') AS n_low, count(*) FILTER (WHERE severity = 'info') AS n_info
  FROM ({findings_sql}) GROUP BY package_id) c ON p.package_id = c.package_id"""


@register("grade", O.with_corpus(_grade_sql(SLICE_SQL)))
def grade(spark, sf_dir):
    files, _, lines = corpus(spark, sf_dir)
    packages = files.select("package_id").distinct()
    f = slice_findings(lines).withColumn("suppressed", F.lit(False))
    return S.grades(packages, f).drop("risk_level")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The minimum slice end to end: files -> lines -> P4a + P9b -> grade."""
    return grade(spark, sf_dir)


@register("p2_encoded_payload", _sql_rows(O.p2_rows(), FIND_COLS + ["evidence"]))
def p2_encoded_payload(spark, sf_dir):
    return _line_rule(spark, sf_dir, ("P2",), cols=FIND_COLS + ["evidence"])


@register("p3_escape_obfuscation", _sql_rows(O.p3_rows(), FIND_COLS + ["description"]))
def p3_escape_obfuscation(spark, sf_dir):
    return _line_rule(spark, sf_dir, ("P3",), cols=FIND_COLS + ["description"])


@register("p3_decoded_evidence", O.with_corpus(f"""SELECT {', '.join(FIND_COLS)}, 'Decoded: seq = "ABCDEFGHI"' AS evidence
FROM ({O.p3_rows()})"""))
def p3_decoded_evidence(spark, sf_dir):
    """the evidence of P3 is the decoded line (the corpus plants one such line)."""
    _, _, lines = corpus(spark, sf_dir)
    return TR.text_findings(lines, ("P3",), p3_decode=True).select(*FIND_COLS, "evidence")


@register("p7_entropy", _sql_rows(O.p7_rows(), FIND_COLS + ["evidence"]))
def p7_entropy(spark, sf_dir):
    return _line_rule(spark, sf_dir, ("P7",), cols=FIND_COLS + ["evidence"])


@register("p5_signatures", _sql_rows(O.p5_rows(), FIND_COLS + ["evidence"]))
def p5_signatures(spark, sf_dir):
    _, scanned, _ = corpus(spark, sf_dir)
    return TR.p5_signatures(scanned).select(*FIND_COLS, "evidence")


# ------------------------------------------------------------------ rule packs made from tables
def page_hosts(spark, sf_dir):
    return (spark.read.parquet(f"{sf_dir}/pages.parquet")
            .select(F.lower(F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1)).alias("host")).where("host <> ''").distinct())


def page_domains(spark, sf_dir):
    """Hosts of the pages and their last two labels."""
    h = page_hosts(spark, sf_dir)
    two = h.select(F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1).alias("host")).where("host <> ''")
    return h.unionByName(two).distinct()


def _escaped(c):
    return F.regexp_replace(c, r"([\\!-/:-@\[-`{-~])", r"\\$1")


@register("pack_dynamic_dns", _sql_rows(O.pack_dns_rows()))
def pack_dynamic_dns(spark, sf_dir):
    _, _, lines = corpus(spark, sf_dir)
    pack = RulePack(dynamic_dns=page_domains(spark, sf_dir).select(F.concat(F.lit("*."), F.col("host")).alias("glob")))
    return TR.text_findings(lines, ("P4",), pack=pack).where("severity = 'high'").select(*FIND_COLS)


@register("pack_iocs", _sql_rows(O.pack_ioc_rows(), FIND_COLS + ["evidence"]))
def pack_iocs(spark, sf_dir):
    _, _, lines = corpus(spark, sf_dir)
    d = page_domains(spark, sf_dir)
    iocs = d.select(F.concat(_escaped(F.col("host")), F.lit("/")).alias("pattern"),
                    F.when(F.length("host") % 2 == 0, "high").otherwise("medium").alias("severity"),
                    F.concat(F.lit("Listed host "), F.col("host")).alias("description"))
    return TR.text_findings(lines, ("P8",), pack=RulePack(c2_patterns=iocs)) \
        .where(F.col("title").startswith("IOC match")).select(*FIND_COLS, "evidence")


@register("pack_tlds", _sql_rows(O.pack_tld_rows(), FIND_COLS + ["evidence"]))
def pack_tlds(spark, sf_dir):
    """Every suffix of a page's host is a TLD of the pack."""
    _, _, lines = corpus(spark, sf_dir)
    labels = F.split("host", r"\.")
    tlds = page_hosts(spark, sf_dir).select(F.explode(F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda k: F.concat(F.lit("."), F.array_join(F.slice(labels, k, F.size(labels)), ".")))).alias("tld"))
    return TR.text_findings(lines, ("P8",), pack=RulePack(suspicious_tlds=tlds)) \
        .where(F.col("title").startswith("URL with suspicious TLD")).select(*FIND_COLS, "evidence")


@register("pack_signatures", _sql_rows(O.pack_signature_rows(), FIND_COLS + ["evidence"]))
def pack_signatures(spark, sf_dir):
    """Beginnings of benchmark passages as signatures."""
    _, scanned, _ = corpus(spark, sf_dir)
    item = F.col("item_id").cast("string")
    sigs = spark.read.parquet(f"{sf_dir}/benchmark.parquet").where(F.length("text") >= 30).select(
        F.concat(F.lit("B-"), item).alias("id"), F.concat(F.lit("Benchmark passage "), item).alias("name"),
        _escaped(F.substring("text", 1, 30)).alias("pattern"), F.lit(True).alias("multiline"), F.lit("low").alias("severity"),
        F.array(F.lit("benchmark")).alias("tags"), F.array().cast("array<string>").alias("refs"))
    return TR.p5_signatures(scanned, sigs).select(*FIND_COLS, "evidence")


@register("p9_obfuscation", _sql_rows(O.p9_obf_rows()))
def p9_obfuscation(spark, sf_dir):
    _, scanned, _ = corpus(spark, sf_dir)
    return TR.p9_obfuscation(scanned).select(*FIND_COLS)


@register("p6_skill_injection", _sql_rows(O.p6_skill_rows(), FIND_COLS + ["evidence"]))
def p6_skill_injection(spark, sf_dir):
    files, _, _ = corpus(spark, sf_dir)
    skill = files.where(F.col("path") == "SKILL.md")
    return TR.p6_skill_injection(skill, to_lines(skill)).select(*FIND_COLS, "evidence")


# ------------------------------------------------------------------ code rules (Python parse -> no SQL twin)
def _code_inputs(spark, sf_dir):
    from ..operators.code_rules import code_inputs
    _, scanned, _ = corpus(spark, sf_dir)
    return scanned, code_inputs(scanned)


S_COLS = FIND_COLS + ["evidence"]


@register("s_rules", O.with_corpus(f"SELECT {', '.join(S_COLS)} FROM ({X.s_rows()})"))
def s_rules(spark, sf_dir):
    """S1-S10, S12-S14 over every parsed .py file of the corpus."""
    from ..operators.code_rules import code_findings
    scanned, inp = _code_inputs(spark, sf_dir)
    return code_findings(scanned, inputs=inp).select(*S_COLS)


def _s_rule(rule):
    def run(spark, sf_dir):
        from ..operators.code_rules import code_findings
        scanned, inp = _code_inputs(spark, sf_dir)
        return code_findings(scanned, rules=(rule,), inputs=inp).select(*S_COLS)
    return run


for _r in ("S1", "S2", "S3", "S4", "S5", "S6", "S7", "S8", "S9", "S10", "S12", "S13", "S14"):
    QUERIES[_r.lower() + "_code"] = _s_rule(_r)
    ORACLE[_r.lower() + "_code"] = O.with_corpus(
        f"SELECT {', '.join(S_COLS)} FROM ({X.s_rows()}) WHERE rule_id = '{_r}'")


@register("reaching_defs", O.with_corpus(X.reference_rows()))
def reaching_defs_q(spark, sf_dir):
    """For every name use, the definition it reads."""
    from ..operators.taint import name_refs, reaching_defs, split_facts
    from ..sources.code_facts import code_facts
    _, scanned, _ = corpus(spark, sf_dir)
    p = split_facts(code_facts(scanned))
    return reaching_defs(p["defs"], name_refs(p["exprs"], p["leaves"]))


@register("taint_levels", O.with_corpus(X.definition_rows()))
def taint_levels(spark, sf_dir):
    """Resolved taint level of every assignment."""
    _, inp = _code_inputs(spark, sf_dir)
    return inp["state"].select("package_id", "path", "def_key", "level", "src_type", "src_desc")


# ------------------------------------------------------------------ manifest rules
def _mani(fn_name, cols=FIND_COLS):
    def run(spark, sf_dir):
        from ..operators import manifest_rules as M
        files, _, _ = corpus(spark, sf_dir)
        return getattr(M, fn_name)(files).select(*cols)
    return run


QUERIES["m4_typosquat"] = _mani("typosquat")
ORACLE["m4_typosquat"] = _sql_rows(O.m4_rows())
QUERIES["m5_install_hook"] = _mani("npm_install_hooks")
ORACLE["m5_install_hook"] = _sql_rows(O.m5_hook_rows())
QUERIES["m5_pip_cmdclass"] = _mani("pip_cmdclass")
ORACLE["m5_pip_cmdclass"] = _sql_rows(O.m5_pip_rows())
QUERIES["m2b_dangerous_tool"] = _mani("dangerous_tools")
ORACLE["m2b_dangerous_tool"] = O.with_corpus(
    f"SELECT package_id, path, line, rule_id, severity, title FROM ({O.m2b_tool_rows()})", O.skill_section_cte())
QUERIES["m2b_broad_permission"] = _mani("broad_permissions")
ORACLE["m2b_broad_permission"] = O.with_corpus(
    f"SELECT package_id, path, line, rule_id, severity, title FROM ({O.m2b_perm_rows()})", O.mcp_cte())
QUERIES["m6_malformed_manifest"] = _mani("malformed_manifest")
ORACLE["m6_malformed_manifest"] = O.with_corpus(
    f"SELECT package_id, path, line, rule_id, severity, title FROM ({O.m6_rows()})", O.mcp_cte())


@register("m7_debug_artifacts", O.with_corpus(
    f"SELECT package_id, path, line, rule_id, severity, title, evidence, remediation FROM ({O.m7_rows()})", O.m7_matches_cte()))
def m7_debug_artifacts(spark, sf_dir):
    from ..operators.manifest_rules import debug_artifacts
    files, _, _ = corpus(spark, sf_dir)
    return debug_artifacts(files).select(*FIND_COLS, "evidence", "remediation")


@register("m7_debug_rollup", O.with_corpus(
    f"SELECT package_id, path, line, rule_id, severity, title, evidence, remediation FROM ({O.m7_rollup_rows()})",
    O.m7_matches_cte()))
def m7_debug_rollup(spark, sf_dir):
    from ..operators.manifest_rules import debug_artifacts
    files, _, _ = corpus(spark, sf_dir)
    return debug_artifacts(files, R.DEBUG_PER_PATTERN).where(F.col("path").isNull()) \
        .select(*FIND_COLS, "evidence", "remediation")


@register("category", O.with_corpus(O.category_rows().replace("WITH descs", "SELECT * FROM (WITH descs", 1) + ")"))
def category(spark, sf_dir):
    from ..operators.manifest_rules import detect_category
    files, _, _ = corpus(spark, sf_dir)
    return detect_category(files)


@register("platform", O.with_corpus(O.platform_rows()))
def platform(spark, sf_dir):
    from ..sources.files import detect_platform
    files, _, _ = corpus(spark, sf_dir)
    return detect_platform(files)


# ------------------------------------------------------------------ suppression and scoring
SUBSET = ("P1", "P4", "P6", "P8", "P9", "P10")


def subset_scan(spark, sf_dir):
    """Text-rule findings of the corpus with the packages' ignore files applied."""
    files, _, lines = corpus(spark, sf_dir)
    f = TR.text_findings(lines, rules=SUBSET)
    f = S.apply_suppressions(f.checkpoint(), S.parse_ignore_files(files))
    return files, f


def full_scan(spark, sf_dir):
    """(files, findings of every engine with suppressions), materialised once
    per session and data folder: the queries below are views of one scan.

    The corpus is stored by kind first: the passes of the scan and the views
    read the columns and kinds they need instead of deriving every file again."""
    done = getattr(spark, "_vigil_scans", {})
    if sf_dir not in done:
        from .scan import scan
        files = stored_files(corpus(spark, sf_dir)[0])
        done[sf_dir] = (files, scan(files).findings.checkpoint())
        spark._vigil_scans = done
    return done[sf_dir]


def _sc(body: str) -> str:
    return O.with_corpus(body, O.scan_ctes())


def _sc_text(body: str) -> str:
    return O.with_corpus(body, O.ignore_cte())


@register("suppressed", _sc("SELECT package_id, path, line, rule_id, severity, title, suppressed FROM tfs"))
def suppressed(spark, sf_dir):
    _, f = full_scan(spark, sf_dir)
    return f.select(*FIND_COLS, "suppressed")


INLINE_RULES = ("P1", "P8")


@register("inline_suppressed", O.with_corpus(f"""SELECT package_id, path, line, rule_id, severity, title,
  line % 2 = 0 AND rule_id IN {INLINE_RULES} AS suppressed FROM ({O.text_subset_rows()}) WHERE rule_id <> 'P6'"""))
def inline_suppressed(spark, sf_dir):
    """F-INL: every second line carries a comment that ignores two rules."""
    _, _, lines = corpus(spark, sf_dir)
    f = TR.text_findings(lines, ("P1", "P4", "P8", "P9", "P10")).withColumn("suppressed", F.lit(False))
    mark = F.lit(f"  # scan:ignore {','.join(INLINE_RULES)}")
    marked = lines.withColumn("line", F.when(F.col("line_no") % 2 == 0, F.concat("line", mark)).otherwise(F.col("line")))
    return S.inline_suppressions(f, marked).select(*FIND_COLS, "suppressed")


@register("report_roundtrip", _sc("SELECT package_id, path, line, rule_id, severity, title, suppressed FROM tfs"))
def report_roundtrip(spark, sf_dir):
    """SNK1 and SRC12: the scan written as nested JSON reports and read back as findings."""
    import uuid

    from ..session import ensure_checkpoint_dir
    from .analytics import read_scan_reports
    files, f = full_scan(spark, sf_dir)
    out = f"{ensure_checkpoint_dir(spark)}/reports-{uuid.uuid4().hex}"
    S.write_scan_json(S.scores(files.select("package_id").distinct(), f), f, out)
    return read_scan_reports(spark, out, multi_line=False)[1].select(*FIND_COLS, "suppressed")


@register("scan_time_history", """SELECT o_orderpriority AS platform, count(*) AS scans, sum(d) / count(*) AS avg_ms, max(d) AS max_ms,
  CAST(sum(d) AS BIGINT) AS total_ms, true AS p50_in_bounds, true AS p95_in_bounds
FROM (SELECT o_orderpriority, CAST(floor(o_totalprice) AS BIGINT) AS d FROM orders) GROUP BY o_orderpriority""")
def scan_time_history_q(spark, sf_dir):
    """A12 over stored batches: one sketch a month and platform, merged; ranks
    of the quantiles are measured on the reports (within 2 %)."""
    from ..session import shared_table
    from . import analytics as A
    reports = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderpriority").alias("platform"), F.date_format("o_orderdate", "yyyy-MM").alias("month"),
        F.floor("o_totalprice").alias("scan_duration_ms"))
    batches = shared_table(A.scan_time_sketches(reports.withColumn("batch", F.struct("platform", "month")), "batch")
                           .select("batch.*", "scans", "total_ms", "max_ms", "sketch"), "scan-times", ["platform"])
    h = A.scan_time_history(batches, "platform")
    d = F.col("scan_duration_ms")
    ranks = reports.join(h.select("platform", "p50_ms", "p95_ms"), "platform").groupBy("platform").agg(
        *[((F.avg((d < F.col(c)).cast("double")) <= q + 0.02) & (F.avg((d <= F.col(c)).cast("double")) >= q - 0.02))
          .alias(c.replace("_ms", "_in_bounds")) for c, q in (("p50_ms", 0.5), ("p95_ms", 0.95))])
    return h.join(ranks, "platform").select("platform", "scans", "avg_ms", "max_ms", "total_ms", "p50_in_bounds", "p95_in_bounds")


@register("ignore_entries", O.with_corpus(
    'SELECT package_id, rule_id, gpat AS "glob", line FROM sup_ok', O.ignore_cte()))
def ignore_entries(spark, sf_dir):
    files, _, _ = corpus(spark, sf_dir)
    return S.parse_ignore_files(files)


@register("severity_grades", _sc(_grade_sql(
    "SELECT package_id, rule_id, severity FROM act")))
def severity_grades(spark, sf_dir):
    files, f = full_scan(spark, sf_dir)
    return S.grades(files.select("package_id").distinct(), f).drop("risk_level")


@register("key_risks", _sc(O.key_risks_rows()))
def key_risks_q(spark, sf_dir):
    files, f = full_scan(spark, sf_dir)
    k = S.key_risks(f)
    return files.select("package_id").distinct().join(k, "package_id", "left").select(
        "package_id", F.coalesce("key_risks", F.array().cast("array<string>")).alias("key_risks"))


@register("behavior_tags", _sc(O.behavior_tags_rows()))
def behavior_tags_q(spark, sf_dir):
    files, f = full_scan(spark, sf_dir)
    t = S.behavior_tags(f)
    return files.select("package_id").distinct().join(t, "package_id", "left").select(
        "package_id", F.coalesce("behavior_tags", F.array().cast("array<string>")).alias("behavior_tags"))


@register("fail_on", _sc(f"""SELECT p.package_id, coalesce(a.fail, false) AS fail
FROM (SELECT DISTINCT package_id FROM files) p LEFT JOIN (
  SELECT package_id, bool_or({O.rank_of('severity')} <= 2) AS fail FROM act GROUP BY package_id) a
  ON p.package_id = a.package_id"""))
def fail_on_q(spark, sf_dir):
    files, f = full_scan(spark, sf_dir)
    return S.fail_on(f, files.select("package_id").distinct(), "high")


def _description_sql() -> str:
    """Description of a text-rule finding, from its rule and title."""
    tactics = " ".join(
        f"WHEN a.title = {O.q('Agent manipulation: ' + label)} THEN " + O.q(
            f"Text contains a psychological manipulation pattern ({tactic}) that can exploit LLM alignment training to "
            "make agents disable safety features, leak data, or self-destruct.") for tactic, label in R.TACTIC_LABELS)
    tld = (f"{O.q('URL uses TLD ' + chr(39))} || replace(a.title, 'URL with suspicious TLD: ', '') || "
           + O.q(chr(39) + " frequently associated with malicious activity"))
    return f"""CASE WHEN a.rule_id = 'P1' THEN 'Found ' || replace(a.title, 'Hardcoded credential: ', '') || ' pattern in source code'
  WHEN a.rule_id = 'P4' AND a.severity = 'medium' THEN 'Public IP address found in source code'
  WHEN a.rule_id = 'P4' THEN 'Code references a dynamic DNS service commonly used for C2'
  WHEN a.rule_id = 'P6' THEN 'Text contains a known prompt injection pattern'
  WHEN a.rule_id = 'P8' AND starts_with(a.title, 'IOC match') THEN 'URL matches known malicious infrastructure pattern'
  WHEN a.rule_id = 'P8' THEN {tld}
  WHEN a.rule_id = 'P9' THEN 'Line is ' || CAST(length(l.line) AS VARCHAR) || ' characters long' {tactics} END"""


@register("sarif_results", _sc_text(f"""SELECT a.package_id, a.rule_id AS ruleId,
  CASE WHEN a.severity IN ('critical', 'high') THEN 'error' ELSE 'warning' END AS level, {_description_sql()} AS message,
  coalesce(nullif(a.path, ''), '.') AS uri, coalesce(a.line, 1) AS startLine
FROM act a LEFT JOIN lines l ON l.package_id = a.package_id AND l.path = a.path AND l.line_no = a.line"""))
def sarif_results_q(spark, sf_dir):
    _, f = subset_scan(spark, sf_dir)
    return S.sarif_results(f).drop("ord")


def _all_descriptions_sql() -> str:
    """Description of any finding of the corpus: by rule and title, of code
    findings by the snippet planted (d: the document)."""
    fs = "Broad filesystem permission: "
    after = lambda text: f"replace(a.title, {O.q(text)}, '')"
    told = lambda head, what, tail: f"{O.q(head)} || {what} || {O.q(tail)}"
    m1 = " ".join(
        f"WHEN a.rule_id = 'M1' AND a.title = {O.q(f'Unexpected capability for {cat} skill: {cap}')} THEN " + O.q(
            f"A '{cat}' skill would not normally require '{cap}' capability. Allowed capabilities for this category: "
            + ", ".join(sorted(allowed))) for cat, allowed, sus in R.CAPABILITY_BASELINES for cap in sus)
    p5 = " ".join(f"WHEN a.title = {O.q('Malicious signature: ' + name)} THEN {O.q(f'Matched known malicious signature {sid}: {name}')}"
                  for sid, name, *_ in R.SIGNATURES)
    escapes = f"len(regexp_extract_all(l.line, {O.q(R.HEX_ESCAPE)})) + len(regexp_extract_all(l.line, {O.q(R.UNICODE_ESCAPE)}))"
    code = X.message_case("replace(a.rule_id, 'S11/', '')", "a.path", "d.snip_no")
    return f"""CASE WHEN a.rule_id = 'P2' THEN 'Base64 string decodes to potentially malicious content'
  WHEN a.rule_id = 'P3' THEN 'Line contains ' || CAST({escapes} AS VARCHAR) || ' escape sequences, possible obfuscation' {p5}
  WHEN a.rule_id = 'P6' AND a.eng = 2 THEN 'SKILL.md description contains text that attempts to override LLM instructions'
  WHEN a.rule_id = 'P7' THEN 'String has high randomness, possibly a secret or encoded payload'
  WHEN starts_with(a.title, 'Code obfuscation') THEN 'Obfuscation pattern detected, common in malicious code'
  WHEN starts_with(a.rule_id, 'P') THEN {_description_sql()}
  WHEN a.rule_id = 'M4' THEN 'Dependency name is 1 edit away from popular package "' || regexp_extract(a.title, 'similar to "(.*)"', 1) || '"'
  WHEN a.rule_id = 'M5' AND a.path = 'setup.py' THEN 'setup.py overrides install/develop cmdclass, code executes during pip install'
  WHEN a.rule_id = 'M5' THEN {told("package.json contains ", after("Install-time script: "), " script that executes during npm install")}
  WHEN a.rule_id = 'M2b' AND a.path = 'SKILL.md' THEN {told("SKILL.md declares a tool '", after("Skill requests dangerous tool: "), "' that grants powerful/dangerous capabilities")}
  WHEN a.title = {O.q(fs + "filesystem")} THEN 'Manifest requests broad filesystem access: /'
  WHEN a.title = {O.q(fs + "fs")} THEN 'Manifest requests broad filesystem access: ["~/docs"]'
  WHEN a.rule_id = 'M2b' THEN {told("Manifest declares wildcard/unrestricted permission for '", after("Overly broad permission: "), "'")}
  WHEN a.rule_id = 'M6' THEN 'Could not parse ' || a.path || ': invalid JSON' {m1}
  WHEN a.rule_id = 'M2a' THEN {told("Code uses '", after("Undeclared capability: "), "' capability but it is not declared in ")} || a.path || '. This may indicate hidden behavior.'
  WHEN a.rule_id = 'M7' THEN {told("Found '", "a.path", "' which is a ")} || replace({after("Publishable package contains ")}, ': ' || a.path, '')
    || '. This type of file should not be included in published packages.'
  WHEN starts_with(a.rule_id, 'S11/') THEN '[install-time] ' || {code}
  ELSE {code} END"""


@register("sarif_results_all", _sc(f"""SELECT a.package_id, a.rule_id AS ruleId,
  CASE WHEN a.severity IN ('critical', 'high') THEN 'error' ELSE 'warning' END AS level, {_all_descriptions_sql()} AS message,
  coalesce(nullif(a.path, ''), '.') AS uri, coalesce(a.line, 1) AS startLine
FROM act a LEFT JOIN lines l ON l.package_id = a.package_id AND l.path = a.path AND l.line_no = a.line AND starts_with(a.rule_id, 'P')
LEFT JOIN docs d ON d.package_id = a.package_id AND 'd' || CAST(d.doc_id AS VARCHAR) || d.ext = a.path AND starts_with(a.rule_id, 'S')"""))
def sarif_results_all_q(spark, sf_dir):
    """Results of every engine (sarif_results: the line rules of SUBSET only)."""
    _, f = full_scan(spark, sf_dir)
    return S.sarif_results(f).drop("ord")


@register("sarif_rules", _sc("""SELECT package_id, rule_id, name, level FROM (
  SELECT package_id, rule_id, title AS name,
         CASE WHEN severity IN ('critical', 'high') THEN 'error' ELSE 'warning' END AS level,
         row_number() OVER (PARTITION BY package_id, rule_id ORDER BY eng, path NULLS FIRST, phase, line NULLS FIRST, k, title) AS rn FROM act)
WHERE rn = 1"""))
def sarif_rules_q(spark, sf_dir):
    _, f = full_scan(spark, sf_dir)
    return S.sarif_rules(f)


def _grade_summary_sql() -> str:
    labels = " ".join(f"WHEN '{g}' THEN {O.q(lbl)}" for g, lbl, _ in R.GRADE_INFO)
    recs = " ".join(f"WHEN '{g}' THEN {O.q(rec)}" for g, _, rec in R.GRADE_INFO)
    return _sc(f"""SELECT package_id, grade, CASE grade {labels} END AS label, CASE grade {recs} END AS recommendation,
  n_critical, n_high, n_medium, n_low, n_info FROM ({_grade_sql("SELECT package_id, rule_id, severity FROM act")})""")


@register("grade_summary", _grade_summary_sql())
def grade_summary_q(spark, sf_dir):
    files, f = full_scan(spark, sf_dir)
    return S.grade_summary(S.grades(files.select("package_id").distinct(), f))


@register("layered_report", _sc(f"""SELECT package_id, CASE WHEN eng = 2 AND NOT starts_with(rule_id, 'S11') THEN 'metadata' ELSE 'behavior' END AS layer, rule_id, severity, title, path, line,
  {O.score_of('severity')} AS score FROM act WHERE severity <> 'info'"""))
def layered_report_q(spark, sf_dir):
    _, f = full_scan(spark, sf_dir)
    return S.layered_report(f).select("package_id", "layer", "rule_id", "severity", "title", "path", "line", "score")


@register("detail_order", _sc(f"""SELECT package_id, rule_id, severity, title,
  CASE WHEN line IS NOT NULL THEN path || ':' || CAST(line AS VARCHAR) ELSE path END AS location,
  {O.rank_of('severity')} AS rank FROM act"""))
def detail_order_q(spark, sf_dir):
    _, f = full_scan(spark, sf_dir)
    return S.detail_order(f).select("package_id", "rule_id", "severity", "title", "location", "rank")


# ------------------------------------------------------------------ fleet residue
def fleet(spark, sf_dir):
    from ..sources import fleet as FL
    return FL.host_files(spark, sf_dir), FL.host_lines(spark, sf_dir), FL.host_packages(spark, sf_dir)


def _residue(fn_name, src):
    def run(spark, sf_dir):
        from ..operators import residue_rules as RR
        hf, hl, hp = fleet(spark, sf_dir)
        arg = {"files": hf, "lines": hl, "packages": hp}[src]
        return getattr(RR, fn_name)(arg).select("package_id", "rule_id", "severity", "title", "path", "line")
    return run


_FLEET_SQL = O.fleet_ctes()
_RES_SQL = O.residue_rows()
for _key, _fn, _src, _rid in [
        ("r1_crontab", "r1_crontab", "lines", "R1"), ("r2_launch_agents", "r2_launch_agents", "files", "R2"),
        ("r3_systemd", "r3_systemd", "files", "R3"), ("r4_sudoers", "r4_sudoers", "files", "R4"),
        ("r5_shell_config", "r5_shell_config", "lines", "R5"), ("r6_git_hooks", "r6_git_hooks", "files", "R6"),
        ("r7_residue_dirs", "r7_residue_dirs", "files", "R7"), ("r8_credentials", "r8_credentials", "files", "R8"),
        ("r9_hosts", "r9_hosts", "lines", "R9"), ("r10_packages", "r10_packages", "packages", "R10")]:
    QUERIES[_key] = _residue(_fn, _src)
    ORACLE[_key] = (f"WITH {_FLEET_SQL}\nSELECT package_id, rule_id, severity, title, path, line "
                    f"FROM ({_RES_SQL}) WHERE rule_id = '{_rid}'")


@register("cleanup_plan", f"""WITH {_FLEET_SQL}
SELECT host_id, CAST(row_number() OVER (PARTITION BY host_id ORDER BY ph, path NULLS FIRST, line NULLS FIRST, rule_id, title, content)
         AS INTEGER) AS n, type, rule_id, title,
  CASE WHEN type <> 'remove_crontab' THEN path END AS path, CASE WHEN type = 'remove_line' THEN line END AS line,
  CASE WHEN type IN ('remove_line', 'remove_crontab') THEN content END AS content,
  CASE WHEN type = 'fix_permissions' THEN '600' END AS target_mode
FROM (SELECT package_id AS host_id, CAST(substr(rule_id, 2) AS INTEGER) AS ph, rule_id, title, path, line, content,
    CASE WHEN rule_id IN ('R2', 'R3', 'R4', 'R6', 'R7') AND path IS NOT NULL THEN 'remove_file'
         WHEN rule_id = 'R5' AND path IS NOT NULL AND line IS NOT NULL THEN 'remove_line'
         WHEN rule_id = 'R8' AND path IS NOT NULL THEN 'fix_permissions'
         WHEN rule_id = 'R1' THEN 'remove_crontab' END AS type
  FROM ({O.residue_rows(content=True)})) WHERE type IS NOT NULL""")
def cleanup_plan_q(spark, sf_dir):
    """The plan itself, every action with its number in the host."""
    from ..operators import residue_rules as RR
    hf, hl, hp = fleet(spark, sf_dir)
    return RR.cleanup_plan(RR.residue_findings(hf, hl, hp))


# ------------------------------------------------------------------ corpus analytics (over the full scan)
def subset_scores(spark, sf_dir):
    files, f = full_scan(spark, sf_dir)
    return files, f, S.scores(files.select("package_id").distinct(), f)


_GRADES_SQL = _grade_sql("SELECT package_id, rule_id, severity FROM act")


@register("grade_distribution", _sc(f"""SELECT d.grade, CAST(coalesce(c.n, 0) AS BIGINT) AS n,
  round(coalesce(c.n, 0) * 100.0 / sum(coalesce(c.n, 0)) OVER (), 1) AS pct
FROM (SELECT unnest(['A', 'B', 'C', 'D', 'F']) AS grade) d
LEFT JOIN (SELECT grade, count(*) AS n FROM ({_GRADES_SQL}) GROUP BY grade) c ON d.grade = c.grade"""))
def grade_distribution_q(spark, sf_dir):
    from .analytics import grade_distribution
    _, _, sc = subset_scores(spark, sf_dir)
    return grade_distribution(sc)


@register("severity_distribution", _sc("""SELECT d.severity, CAST(coalesce(c.n, 0) AS BIGINT) AS n,
  round(coalesce(c.n, 0) * 100.0 / sum(coalesce(c.n, 0)) OVER (), 1) AS pct
FROM (SELECT unnest(['critical', 'high', 'medium', 'low', 'info']) AS severity) d
LEFT JOIN (SELECT severity, count(*) AS n FROM act GROUP BY severity) c ON d.severity = c.severity"""))
def severity_distribution_q(spark, sf_dir):
    from .analytics import severity_distribution
    _, f = full_scan(spark, sf_dir)
    return severity_distribution(f)


@register("top_rules", _sc("""SELECT CAST(row_number() OVER (ORDER BY hits DESC, rule_id) AS INTEGER) AS rank, rule_id, hits
FROM (SELECT rule_id, count(*) AS hits FROM act GROUP BY rule_id) ORDER BY hits DESC, rule_id LIMIT 15"""))
def top_rules_q(spark, sf_dir):
    from .analytics import top_rules
    _, f = full_scan(spark, sf_dir)
    return top_rules(f)


@register("rule_severity_matrix", _sc("""SELECT rule_id,
  count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'high') AS high,
  count(*) FILTER (WHERE severity = 'medium') AS medium, count(*) FILTER (WHERE severity = 'low') AS low,
  count(*) FILTER (WHERE severity = 'info') AS info FROM act GROUP BY rule_id"""))
def rule_severity_matrix_q(spark, sf_dir):
    from .analytics import rule_severity_matrix
    _, f = full_scan(spark, sf_dir)
    return rule_severity_matrix(f)


@register("tag_distribution", _sc(f"""SELECT tag, count(DISTINCT package_id) AS packages,
  round(count(DISTINCT package_id) * 100.0 / (SELECT count(DISTINCT package_id) FROM files), 1) AS pct
FROM (SELECT package_id, unnest(behavior_tags) AS tag FROM ({O.behavior_tags_rows()})) GROUP BY tag"""))
def tag_distribution_q(spark, sf_dir):
    from .analytics import tag_distribution
    _, _, sc = subset_scores(spark, sf_dir)
    return tag_distribution(sc)


@register("riskiest_packages", _sc(f"""SELECT package_id, grade, n_critical, n_high, n_medium, n_low
FROM ({_GRADES_SQL}) ORDER BY CASE grade WHEN 'F' THEN 0 WHEN 'D' THEN 1 WHEN 'C' THEN 2 WHEN 'B' THEN 3 ELSE 4 END,
  n_critical DESC, n_high DESC, n_medium DESC, package_id LIMIT 10"""))
def riskiest_packages_q(spark, sf_dir):
    from .analytics import riskiest_packages
    _, _, sc = subset_scores(spark, sf_dir)
    return riskiest_packages(sc)


@register("safe_packages", _sc(f"SELECT package_id FROM ({_GRADES_SQL}) WHERE grade = 'A'"))
def safe_packages_q(spark, sf_dir):
    from .analytics import safe_packages
    _, _, sc = subset_scores(spark, sf_dir)
    return safe_packages(sc)


@register("findings_per_package", _sc(f"""SELECT package_id, n_critical, n_high, n_medium, n_low, n_info,
  n_critical + n_high + n_medium + n_low + n_info AS total FROM ({_GRADES_SQL})"""))
def findings_per_package_q(spark, sf_dir):
    from .analytics import findings_per_package
    files, f = full_scan(spark, sf_dir)
    return findings_per_package(f, files.select("package_id").distinct())


@register("findings_histogram", _sc(f"""SELECT d.bucket, d.bi, CAST(coalesce(c.packages, 0) AS BIGINT) AS packages
FROM (SELECT unnest(['0', '1-5', '6-10', '11-20', '21-50', '50+']) AS bucket,
             unnest([0, 1, 2, 3, 4, 5]) AS bi) d
LEFT JOIN (SELECT CASE WHEN t = 0 THEN '0' WHEN t <= 5 THEN '1-5' WHEN t <= 10 THEN '6-10' WHEN t <= 20 THEN '11-20'
                       WHEN t <= 50 THEN '21-50' ELSE '50+' END AS bucket, count(*) AS packages
           FROM (SELECT package_id, n_critical + n_high + n_medium + n_low + n_info AS t FROM ({_GRADES_SQL}))
           GROUP BY 1) c ON d.bucket = c.bucket"""))
def findings_histogram_q(spark, sf_dir):
    from .analytics import findings_histogram
    files, f = full_scan(spark, sf_dir)
    return findings_histogram(f, files.select("package_id").distinct())


@register("platform_distribution", O.with_corpus(
    f"SELECT platform, count(*) AS packages FROM ({O.platform_rows()}) GROUP BY platform"))
def platform_distribution_q(spark, sf_dir):
    from ..sources.files import detect_platform
    from .analytics import platform_distribution
    files, _, _ = corpus(spark, sf_dir)
    return platform_distribution(detect_platform(files))


@register("packages_with", _sc("""SELECT DISTINCT 'critical' AS criterion, package_id FROM act WHERE severity = 'critical'
UNION SELECT DISTINCT 'S8', package_id FROM act WHERE rule_id = 'S8'
UNION SELECT DISTINCT 'S13', package_id FROM act WHERE rule_id = 'S13'"""))
def packages_with_q(spark, sf_dir):
    from .analytics import packages_with
    _, f = full_scan(spark, sf_dir)
    return packages_with(f)


@register("systematic_sample", O.with_corpus("""SELECT package_id, CAST(rk AS BIGINT) AS rank FROM (
  SELECT package_id, row_number() OVER (ORDER BY package_id) - 1 AS rk FROM (
    SELECT DISTINCT package_id FROM files
    WHERE regexp_extract(path, '(\\.[^./]*)$', 1) IN ('.py', '.js', '.ts', '.sh', '.mjs', '.cjs', '.jsx', '.tsx', '.bash')))
WHERE rk % 34 = 0"""))
def systematic_sample_q(spark, sf_dir):
    from .analytics import systematic_sample
    files, _, _ = corpus(spark, sf_dir)
    return systematic_sample(files, 34)


@register("scan_diff", _sc(f"""SELECT coalesce(b.package_id, a.package_id) AS package_id,
  coalesce(b.t, 0) AS n_before, coalesce(a.t, 0) AS n_after,
  CASE WHEN coalesce(b.t, 0) > 0 THEN round((coalesce(b.t, 0) - coalesce(a.t, 0)) * 100.0 / b.t, 1) END AS reduction_pct,
  coalesce(b.grade, 'A') AS grade_before, coalesce(a.grade, 'A') AS grade_after
FROM (SELECT package_id, n_critical + n_high + n_medium + n_low + n_info AS t, grade
      FROM ({_grade_sql("SELECT package_id, rule_id, severity FROM tfs")}) WHERE n_critical + n_high + n_medium + n_low + n_info > 0) b
FULL OUTER JOIN (SELECT package_id, n_critical + n_high + n_medium + n_low + n_info AS t, grade
      FROM ({_GRADES_SQL}) WHERE n_critical + n_high + n_medium + n_low + n_info > 0) a
  ON a.package_id = b.package_id"""))
def scan_diff_q(spark, sf_dir):
    """The scan without suppressions (before) against the scan with the
    packages' ignore files applied (after)."""
    from .analytics import scan_diff
    _, f = full_scan(spark, sf_dir)
    before = f.withColumn("suppressed", F.lit(False))
    return scan_diff(before, f)


# ------------------------------------------------------------------ capabilities, M1, M2a
def _behavior_caps(spark, sf_dir):
    from ..operators.manifest_rules import actual_capabilities
    files, f = full_scan(spark, sf_dir)
    return files, actual_capabilities(f.where(F.col("engine") != "manifest"))


@register("capabilities", _sc("SELECT package_id, cap FROM caps"))
def capabilities_q(spark, sf_dir):
    _, caps = _behavior_caps(spark, sf_dir)
    return caps


@register("m1_capability_baseline", _sc(f"SELECT package_id, path, line, rule_id, severity, title FROM ({O.m1_rows()})"))
def m1_capability_baseline(spark, sf_dir):
    from ..operators.manifest_rules import capability_baseline
    files, caps = _behavior_caps(spark, sf_dir)
    return capability_baseline(files, caps).select(*FIND_COLS)


@register("m2a_undeclared", _sc(f"SELECT package_id, path, line, rule_id, severity, title FROM ({O.m2a_rows()})"))
def m2a_undeclared(spark, sf_dir):
    from ..operators.manifest_rules import undeclared_capabilities
    files, caps = _behavior_caps(spark, sf_dir)
    return undeclared_capabilities(files, caps).select(*FIND_COLS)


# ------------------------------------------------------------------ full pipeline (code rules inside: rows-only)
@register("s11_install_time", O.with_corpus(X.s11_rows()))
def s11_install_time(spark, sf_dir):
    """Code findings of install-hook files and cmdclass setup.py, elevated."""
    from ..operators.code_rules import code_findings
    from ..operators.manifest_rules import install_refs, install_time_elevation, manifest_subset
    files, _, _ = corpus(spark, sf_dir)
    refs = install_refs(manifest_subset(files), files)
    code = code_findings(files.join(refs, ["package_id", "path"], "left_semi"))
    return install_time_elevation(code, refs).select(*FIND_COLS)


def _scores_sql() -> str:
    risk = " ".join(f"WHEN '{g}' THEN {O.q(label.lower())}" for g, label, _ in R.GRADE_INFO)
    return _sc(f"""SELECT g.package_id, g.grade, CASE g.grade {risk} END AS risk_level, g.n_critical, g.n_high, g.n_medium,
  g.n_low, g.n_info, k.key_risks, t.behavior_tags
FROM ({_GRADES_SQL}) g JOIN ({O.key_risks_rows()}) k ON k.package_id = g.package_id
JOIN ({O.behavior_tags_rows()}) t ON t.package_id = g.package_id""")


@register("scan_scores", _scores_sql())
def scan_scores(spark, sf_dir):
    """Every engine, suppression and scoring: one row per package."""
    files, f = full_scan(spark, sf_dir)
    return S.scores(files.select("package_id").distinct(), f).select(
        "package_id", "grade", "risk_level", "n_critical", "n_high", "n_medium", "n_low", "n_info", "key_risks",
        "behavior_tags")


# ------------------------------------------------------------------ taint machinery on event-derived facts (SQL oracle)
@register("taint_events_reach", f"WITH {O.event_defs_cte()}\nSELECT package_id, path, name, use_key, reach FROM reach")
def taint_events_reach(spark, sf_dir):
    """T1 on facts synthesised from ``events``."""
    from ..operators.taint import name_refs, reaching_defs, split_facts
    from ..sources.event_facts import event_facts
    p = split_facts(event_facts(spark, sf_dir))
    return reaching_defs(p["defs"], name_refs(p["exprs"], p["leaves"]))


@register("taint_events_levels", O.event_levels_sql())
def taint_events_levels(spark, sf_dir):
    """T2 fixpoint on facts synthesised from ``events``."""
    from ..operators.taint import propagate_taint
    from ..sources.event_facts import event_facts
    state, _ = propagate_taint(event_facts(spark, sf_dir).checkpoint())
    return state.select("package_id", "path", "def_key", "level", "src_type", "src_desc")
