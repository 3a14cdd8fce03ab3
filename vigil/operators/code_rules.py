"""Code rules S1-S14 as relational predicates over code facts + taint.

Each call fact carries its callee's dotted name; sink membership is a
column predicate (exact name, or same last segment with a module prefix or
client-like receiver).  Argument taint comes from T2's resolution joined
on the argument's expression id.  Order columns reproduce the reference's
per-file order: pass-2 calls (S1, S4/S9, S6, S7, S12, S2/S3, S5), then S8,
then S10, then S13/S14.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.membership import key_bitmap, may_hold
from ..functions.text import py_strip
from ..rules import packs as R
from ..schemas import findings_from_hits, hit
from ..session import shared_table
from ..sources.code_facts import code_facts
from ..sources.files import to_lines
from .taint import FILE, propagate_taint, split_facts

PH_CALL, PH_S8, PH_S10, PH_S1314 = 0, 1, 2, 3


def _last_seg(col: Column) -> Column:
    return F.element_at(F.split(col, r"\."), -1)


def _starts_any(col: Column, prefixes) -> Column:
    c = None
    for p in prefixes:
        x = col.startswith(p)
        c = x if c is None else (c | x)
    return c


def _suffix_sink(name: Column, sinks) -> Column:
    """name ends with '.<last segment of some sink>'."""
    lasts = sorted({s.split(".")[-1] for s in sinks})
    return name.contains(".") & _last_seg(name).isin(*lasts)


def is_shell_sink(n: Column) -> Column:
    return n.isin(*R.SHELL_SINKS) | (_suffix_sink(n, R.SHELL_SINKS) & _starts_any(n, R.SHELL_PREFIXES))


def _client_receiver(n: Column) -> Column:
    recv = F.regexp_extract(n, r"^(.*)\.[^.]*$", 1)
    c = None
    for s in R.CLIENT_SUFFIXES:
        x = recv.endswith(s)
        c = x if c is None else (c | x)
    return n.contains(".") & c


def is_network_sink(n: Column, sinks=R.NETWORK_SINKS) -> Column:
    return n.isin(*sinks) | (_suffix_sink(n, sinks) & (_starts_any(n, R.NET_PREFIXES) | _client_receiver(n)))


def is_deser_sink(n: Column) -> Column:
    return n.isin(*R.DESER_SINKS) | (_suffix_sink(n, R.DESER_SINKS) & _starts_any(n, R.DESER_PREFIXES))


def code_inputs(files: DataFrame) -> dict[str, DataFrame]:
    """Parse once, store the facts by kind, resolve taint; shared by all S rules."""
    facts = shared_table(code_facts(files), "code-facts", ["kind"])
    parts = split_facts(facts)
    state, resolved = propagate_taint(facts)
    parts["state"] = state
    parts["resolved"] = resolved
    return parts


def _with_arg0(calls: DataFrame, resolved: DataFrame) -> DataFrame:
    r = resolved.select(*FILE, F.col("expr").alias("arg0_expr"), F.col("level").alias("a_level"),
                        F.col("src_type").alias("a_type"), F.col("src_desc").alias("a_desc"))
    return calls.join(r, [*FILE, "arg0_expr"], "left")


def _emit(df: DataFrame, h: Column, line: Column | None = None) -> DataFrame:
    line = F.col("line") if line is None else line
    return findings_from_hits(df.select(*FILE, line.alias("line_no"), h.alias("h")).where(F.col("h").isNotNull()),
                              "ast", "behavior")


def _conf_known(level: Column) -> Column:
    return F.when(level.isNotNull() & (level != "unknown"), 0.9).otherwise(0.7)


def s1_shell(c: DataFrame) -> DataFrame:
    n, lv, sh = F.col("name"), F.col("a_level"), F.col("shell_true")
    has = F.col("n_args") > 0
    sev = (F.when(~has, "medium").when(lv == "literal", F.when(sh, "medium"))
           .when(lv == "external", "critical").when(sh, "high").otherwise("medium"))
    ev = (F.when(~has, F.lit("No arguments detected")).when(lv == "literal", F.lit("Constant command argument"))
          .when(lv == "external", F.concat(F.lit("Unsanitized input from "), F.col("a_desc"), F.lit(" flows to "), n,
                                           F.lit("()")))
          .otherwise(F.concat(F.lit("Variable argument (origin: "), lv, F.lit(")"))))
    h = F.when(is_shell_sink(n) & sev.isNotNull(), hit(
        "S1", sev, F.when(has, _conf_known(lv)).otherwise(0.7),
        F.concat(F.lit("Shell command execution"), F.when(sh, F.lit(" (shell=True)")).otherwise(F.lit(""))),
        F.concat(F.lit("Code calls "), n, F.lit("() which can execute arbitrary system commands")),
        evidence=ev, tags=["execution", "shell"],
        remediation="Use subprocess.run() with explicit argument list. Avoid shell=True. Never pass untrusted input.",
        refs=["MITRE T1059.004"], phase=PH_CALL, k=F.col("seq") * 10 + 0))
    return _emit(c, h)


def s4_s9_network(c: DataFrame) -> DataFrame:
    n, lv, url = F.col("name"), F.col("a_level"), F.col("arg0_str")
    has_url = url.isNotNull() & (url != "")
    has_arg = F.col("n_args") > 0
    bl = None
    for b in R.SSRF_BLACKLIST:
        bl = F.when(url.contains(b), F.lit(b)) if bl is None else bl.when(url.contains(b), F.lit(b))
    pv = None
    for p in R.SSRF_PRIVATE_PREFIXES:
        pv = F.when(url.contains(p), F.lit(p)) if pv is None else pv.when(url.contains(p), F.lit(p))
    snippet_refs9 = ["MITRE T1552.005"]
    s9_meta = hit("S9", "critical", 0.95, "SSRF: Request targets internal/metadata service",
                  F.concat(F.lit("Network request targets "), bl,
                           F.lit(" which is a cloud metadata or internal service")),
                  evidence=F.concat(F.lit("URL contains blacklisted target: "), bl), tags=["network", "ssrf"],
                  remediation="Never allow requests to metadata endpoints or internal services.",
                  refs=snippet_refs9, phase=PH_CALL, k=F.col("seq") * 10 + 1)
    s9_priv = hit("S9", "high", 0.85, "SSRF: Request targets private network",
                  "Network request targets private IP range",
                  evidence=F.concat(F.lit("URL targets private network range: "), pv, F.lit("*")),
                  tags=["network", "ssrf"], remediation="Verify this internal request is expected.",
                  refs=snippet_refs9, phase=PH_CALL, k=F.col("seq") * 10 + 1)
    s9_ext = hit("S9", "high", 0.85, "SSRF: Request URL controlled by external input",
                 F.concat(F.lit("Network request URL comes from external source ("), F.col("a_desc"), F.lit(")")),
                 evidence=F.concat(F.lit("URL from "), F.col("a_desc"), F.lit(" → "), n, F.lit("()")),
                 tags=["network", "ssrf"], remediation="Validate and allowlist URLs before making requests.",
                 refs=["MITRE T1552.005", "CWE-918"], phase=PH_CALL, k=F.col("seq") * 10 + 1)

    def s4(sev, ev):
        return hit("S4", sev, 0.8, "Outbound network request",
                   F.concat(F.lit("Code makes outbound network request via "), n, F.lit("()")),
                   evidence=ev, tags=["network"], remediation="Verify the request target is expected and trusted.",
                   refs=["MITRE T1071.001"], phase=PH_CALL, k=F.col("seq") * 10 + 1)

    h = (F.when(~is_network_sink(n), F.lit(None))
         .when(has_url & bl.isNotNull(), s9_meta)
         .when(has_url & pv.isNotNull(), s9_priv)
         .when(has_url, s4("medium", F.concat(F.lit("Hardcoded URL: "), F.substring(url, 1, 80))))
         .when(has_arg & (lv == "external"), s9_ext)
         .when(has_arg, s4("medium", F.concat(F.lit("Variable URL (taint: "), lv, F.lit(")"))))
         .otherwise(s4("low", F.lit("Network call detected"))))
    return _emit(c, h)


def s5_env(c: DataFrame) -> DataFrame:
    n = F.col("name")
    env = F.coalesce(F.col("arg0_str"), F.lit(""))
    up = F.upper(env)
    sens = None
    for w in R.SENSITIVE_ENV_WORDS:
        x = up.contains(w)
        sens = x if sens is None else (sens | x)
    info = hit("S5", "info", 0.8,
               F.concat(F.lit("Reads environment variable"), F.when(env != "", F.concat(F.lit(": "), env))
                        .otherwise(F.lit(""))),
               F.concat(F.lit("Code reads environment variable via "), n, F.lit("()")),
               evidence=F.concat(F.lit("Reads env var: "), env), tags=["env_var"], phase=PH_CALL,
               k=F.col("seq") * 10 + 6)
    med = hit("S5", "medium", 0.8, F.concat(F.lit("Reads sensitive environment variable: "), env),
              F.concat(F.lit("Code reads environment variable via "), n, F.lit("()")),
              evidence=F.concat(F.lit("Reads sensitive env var: "), env), tags=["env_var", "credential_access"],
              remediation="Ensure this variable is used only for its intended purpose.", phase=PH_CALL,
              k=F.col("seq") * 10 + 6)
    h = F.when(n.isin("os.getenv", "os.environ.get") & ~up.isin(*R.SAFE_ENV_VARS),
               F.when(sens, med).otherwise(info))
    return _emit(c, h)


def s6_exec(c: DataFrame) -> DataFrame:
    n, lv = F.col("name"), F.col("a_level")
    sink = (n.isin(*R.DYNAMIC_EXEC_SINKS) | _last_seg(n).isin(*R.DYNAMIC_EXEC_SINKS)) & (n != "re.compile")
    sev = F.when(lv == "literal", "medium").when(lv == "external", "critical").otherwise("high")
    ev = (F.when(lv == "literal", F.lit("Constant argument (not recommended but predictable)"))
          .when(lv == "external", F.concat(F.lit("External input from "), F.col("a_desc"), F.lit(" flows to "), n,
                                           F.lit("()")))
          .otherwise(F.concat(F.lit("Variable argument (origin: "), lv, F.lit(")"))))
    h = F.when(sink & (F.col("n_args") > 0), hit(
        "S6", sev, _conf_known(lv), F.concat(F.lit("Dynamic code execution via "), n, F.lit("()")),
        F.concat(F.lit("Code uses "), n, F.lit("() to execute dynamically constructed code")), evidence=ev,
        tags=["execution", "dynamic"],
        remediation=F.concat(F.lit("Use ast.literal_eval() for safe evaluation. Avoid "), n,
                             F.lit("() with untrusted input.")),
        refs=["MITRE T1059.006"], phase=PH_CALL, k=F.col("seq") * 10 + 2))
    return _emit(c, h)


def s7_import(c: DataFrame) -> DataFrame:
    n, lv = F.col("name"), F.col("a_level")
    sink = n.isin(*R.DYNAMIC_IMPORT_FUNCS) | n.endswith("import_module")
    ext = lv == "external"
    h = F.when(sink & (F.col("n_args") > 0) & (lv != "literal"), hit(
        "S7", F.when(ext, "critical").otherwise("high"), 0.85, "Dynamic module import with variable name",
        F.concat(F.lit("Code dynamically imports a module via "), n, F.lit("()")),
        evidence=F.when(ext, F.concat(F.lit("Module name from "), F.col("a_desc")))
        .otherwise(F.concat(F.lit("Variable module name (origin: "), lv, F.lit(")"))),
        tags=["execution", "import"], remediation="Use an allowlist of permitted module names.",
        refs=["MITRE T1129"], phase=PH_CALL, k=F.col("seq") * 10 + 3))
    return _emit(c, h)


def s12_deser(c: DataFrame) -> DataFrame:
    n = F.col("name")
    lv = F.when(F.col("n_args") > 0, F.col("a_level")).otherwise(F.lit("unknown"))
    safe = n.contains("yaml.load") & F.coalesce(F.col("loader").contains("Safe") | F.col("loader").contains("safe"),
                                                F.lit(False))
    sev = F.when(lv == "external", "critical").when(lv == "literal", "medium").otherwise("high")
    h = F.when(is_deser_sink(n) & ~safe, hit(
        "S12", sev, 0.9, F.concat(F.lit("Unsafe deserialization via "), n, F.lit("()")),
        F.concat(F.lit("Code uses "), n, F.lit("() which can execute arbitrary code during deserialization")),
        evidence=F.concat(F.lit("Data source taint: "), lv), tags=["deserialization", "execution"],
        remediation="Replace pickle with JSON or MessagePack. Use yaml.safe_load() instead of yaml.load().",
        refs=["MITRE T1059.006", "CWE-502"], phase=PH_CALL, k=F.col("seq") * 10 + 4))
    return _emit(c, h)


def s2_s3_files(c: DataFrame) -> DataFrame:
    n, p, lv = F.col("name"), F.col("arg0_str"), F.col("a_level")
    is_open = (n.isin("open", "builtins.open") | n.endswith(".open")) & (F.col("n_args") > 0)
    literal_path = p.isNotNull() & (p != "")
    mode = F.col("mode")
    is_write = mode.contains("w") | mode.contains("a") | mode.contains("x")
    wr = None
    for cp in R.SENSITIVE_WRITE_PATHS_CRITICAL:
        base = cp.rstrip("/")
        cond = p.contains(base) | p.startswith(base)
        wr = F.when(cond, F.lit(cp)) if wr is None else wr.when(cond, F.lit(cp))
    rd = None
    for sev, paths in R.SENSITIVE_READ_PATHS:
        for sp in paths:
            v = F.struct(F.lit(sev).alias("sev"), F.lit(sp).alias("sp"))
            rd = F.when(p.contains(sp), v) if rd is None else rd.when(p.contains(sp), v)
    k = F.col("seq") * 10 + 5
    s3_ext = hit("S3", "high", 0.8, "File operation with externally-controlled path",
                 "File path comes from external input", evidence=F.concat(F.lit("Path from "), F.col("a_desc")),
                 tags=["file_access", "path_injection"],
                 remediation="Validate and sanitize file paths. Use an allowlist of permitted directories.",
                 refs=["CWE-22"], phase=PH_CALL, k=k)
    s3_w = hit("S3", "critical", 0.95, "Writes to critical system file", F.concat(F.lit("Code writes to "), p),
               evidence=F.concat(F.lit("Write target: "), p), tags=["file_write", "system_modification"],
               remediation="Do not modify system configuration files.", refs=["MITRE T1546.004"],
               phase=PH_CALL, k=k)
    s2 = hit("S2", rd["sev"], 0.95, F.concat(F.lit("Reads sensitive file: "), rd["sp"]),
             F.concat(F.lit("Code reads "), p, F.lit(" which may contain credentials")),
             evidence=F.concat(F.lit("Read target: "), p), tags=["file_read", "credential_access"],
             remediation="Remove direct access to sensitive files. Use a secrets manager or ssh-agent.",
             refs=["MITRE T1552.004"], phase=PH_CALL, k=k)
    h = (F.when(~is_open, F.lit(None))
         .when(~literal_path, F.when(lv == "external", s3_ext))
         .when(is_write, F.when(wr.isNotNull(), s3_w))
         .when(rd.isNotNull(), s2))
    return _emit(c, h)


def s8_exfil(calls: DataFrame, args: DataFrame, resolved: DataFrame) -> DataFrame:
    sinks = calls.where(is_network_sink(F.col("name"), R.NETWORK_SEND_SINKS)).select(
        *FILE, "seq", "line", "name")
    r = resolved.select(*FILE, "expr", "level", "src_type", "src_desc")
    a = args.join(sinks, [*FILE, "seq"]).join(r, [*FILE, "expr"], "left") \
        .where((F.col("level") == "external") & F.col("src_type").isin("env_var", "file_read"))
    is_kw = F.col("pos") < 0
    via = F.when(is_kw, F.concat(F.col("kw"), F.lit("="))).otherwise(F.format_string("arg[%d]", F.col("pos")))
    h = hit("S8", "critical", F.when(is_kw, 0.9).otherwise(0.85), "Sensitive data exfiltration detected",
            F.concat(F.lit("Sensitive data from "), F.col("src_desc"), F.lit(" sent via "), F.col("name"), F.lit("()")),
            evidence=F.concat(F.col("src_desc"), F.lit(" → "), via, F.lit(" → "), F.col("name"), F.lit("()")),
            tags=["exfiltration", "network", "credential_access"],
            remediation=F.when(is_kw, F.lit("Remove data exfiltration code. Report this skill as malicious."))
            .otherwise(F.lit("Remove data exfiltration code.")),
            refs=["MITRE T1041"], phase=PH_S8,
            k=F.col("seq") * 1000 + F.when(is_kw, F.lit(0)).otherwise(F.lit(500) + F.col("pos")))
    return _emit(a, h)


def s10_download_exec(lits: DataFrame) -> DataFrame:
    from ..functions.text import first_match
    idx = first_match(F.col("value"), R.PIPE_TO_SHELL)
    h = F.when(idx.isNotNull(), hit(
        "S10", "critical", 0.95, "Download-and-execute pattern in string", "String contains a pipe-to-shell pattern",
        evidence=F.concat(F.lit("Pattern: "), F.substring("value", 1, 100)), tags=["execution", "network", "supply_chain"],
        remediation="Never execute downloaded content. Pin dependencies and verify checksums.",
        refs=["MITRE T1105", "MITRE T1059"], phase=PH_S10, k=F.col("seq")))
    return _emit(lits, h)


def s13_s14_markers(lits: DataFrame) -> DataFrame:
    """First string constant (walk order) per line that holds a persistence
    or system-config marker; S13 wins over S14 for that constant."""
    v = F.col("value")
    lv = F.lower(v)
    m13 = None
    for mk in R.PERSISTENCE_MARKERS:
        x = lv.contains(mk.lower()) & (F.length(v) > 3)
        m13 = F.when(x, F.lit(mk)) if m13 is None else m13.when(x, F.lit(mk))
    m14 = None
    for mk in R.SYSTEM_CONFIG_MARKERS:
        x = lv.contains(mk.lower())
        m14 = F.when(x, F.lit(mk)) if m14 is None else m14.when(x, F.lit(mk))
    cand = lits.select(*FILE, "seq", "line", "value", m13.alias("m13"), m14.alias("m14")) \
        .where(F.col("m13").isNotNull() | F.col("m14").isNotNull())
    first = cand.groupBy(*FILE, "line").agg(F.min(F.struct("seq", "value", "m13", "m14")).alias("x")) \
        .select(*FILE, "line", "x.*")
    crit13 = None
    for mk in R.PERSISTENCE_CRITICAL:
        x = v.contains(mk)
        crit13 = x if crit13 is None else (crit13 | x)
    s13 = hit("S13", F.when(crit13, "critical").otherwise("high"), 0.75, "Persistence mechanism reference",
              F.concat(F.lit("Code references persistence path: "), F.substring(v, 1, 80)),
              evidence=F.concat(F.lit("String contains persistence indicator: "), F.col("m13")), tags=["persistence"],
              remediation="Skills should not install system services or modify startup configuration.",
              refs=["MITRE T1543.001"], phase=PH_S1314, k=F.col("seq"))
    s14 = hit("S14", F.when(v.contains("sudoers"), "critical").otherwise("high"), 0.75,
              "System configuration modification reference",
              F.concat(F.lit("Code references system config: "), F.substring(v, 1, 80)),
              evidence=F.concat(F.lit("String contains system config path: "), F.col("m14")),
              tags=["system_modification"], remediation="Skills must not modify system configuration.",
              refs=["MITRE T1548.003"], phase=PH_S1314, k=F.col("seq"))
    return _emit(first, F.when(F.col("m13").isNotNull(), s13).otherwise(s14))


CALL_RULES = ("S1", "S2", "S3", "S4", "S5", "S6", "S7", "S8", "S9", "S10", "S12", "S13", "S14")


def code_findings(files: DataFrame, rules=CALL_RULES, inputs: dict | None = None) -> DataFrame:
    """All S findings of the ``.py`` files in ``files``."""
    p = inputs if inputs is not None else code_inputs(files)
    # calls with their first argument's taint feed seven rules: join once
    c = _with_arg0(p["calls"], p["resolved"]).checkpoint()
    outs = []
    if "S1" in rules:
        outs.append(s1_shell(c))
    if "S4" in rules or "S9" in rules:
        outs.append(s4_s9_network(c))
    if "S6" in rules:
        outs.append(s6_exec(c))
    if "S7" in rules:
        outs.append(s7_import(c))
    if "S12" in rules:
        outs.append(s12_deser(c))
    if "S2" in rules or "S3" in rules:
        outs.append(s2_s3_files(c))
    if "S5" in rules:
        outs.append(s5_env(c))
    if "S8" in rules:
        outs.append(s8_exfil(p["calls"], p["args"], p["resolved"]))
    if "S10" in rules:
        outs.append(s10_download_exec(p["lits"]))
    if "S13" in rules or "S14" in rules:
        outs.append(s13_s14_markers(p["lits"]))
    df = outs[0]
    for o in outs[1:]:
        df = df.unionByName(o)
    return with_snippets(df.where(F.col("rule_id").isin(*rules)), files)


def with_snippets(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Fill ``snippet`` with a finding's line and the lines around it.

    Only lines near findings are shuffled: files and then lines that hold none
    are dropped where they are read, by bitmaps of the places (a superset
    passes), and the join of the lines left is exact."""
    findings = findings.checkpoint()
    at = findings.select(*FILE, "line").distinct().withColumn(
        "line_no", F.explode(F.array(*[F.col("line") + d for d in (-1, 0, 1)])))
    count = findings.count()
    if not count:
        return findings
    py = may_hold(files.where(F.col("path").endswith(".py")), key_bitmap(findings, FILE, count), FILE)
    place = [*FILE, "line_no"]
    text = may_hold(to_lines(py).withColumnRenamed("line", "text"), key_bitmap(at, place, 3 * count), place)
    near = (text.join(at, place)
            .groupBy(*FILE, "line").agg(F.collect_list(F.struct("line_no", "text")).alias("n"))   # three lines at most
            .select(*FILE, "line", py_strip(F.array_join(F.array_sort("n")["text"], "\n")).alias("near")))
    cols = findings.columns
    return (findings.join(near, [*FILE, "line"], "left")
            .withColumn("snippet", F.coalesce("near", F.lit(""))).select(*cols))
