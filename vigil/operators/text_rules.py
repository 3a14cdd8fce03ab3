"""Text rules P1-P10 as DataFrame transforms over ``lines`` / ``files``.

Line rules are column builders of ``array<HIT>`` for one line, so the full scan
evaluates all of them in one projection over the exploded lines and only lines
that hit go on.  File rules (P5, P9a) work on whole contents.  P10 keeps one
finding per (file, tactic) with a partial-aggregating ``min(struct)``, not a
window.
"""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import (any_match, b64_decode_lenient, explode_hits, first_match, gate, newline_count, pick, py_fixed, shannon_entropy, snippet)
from ..functions.membership import key_bitmap, may_hold
from ..rules import packs as R
from ..schemas import HIT, empty_findings, findings_from_hits, hit
from ..sources.rule_packs import RulePack, compiles
from .pattern_index import Gates, matches, rows_of

HITS = T.ArrayType(HIT)


# phase of each rule inside one file's scan order
PH_LINE, PH_P5, PH_P7, PH_P8, PH_P9A, PH_P9B, PH_P10 = 0, 1, 2, 3, 4, 5, 6
# first order key of each line rule: a range of its own, however many hits a line has
K_P1, K_P2, K_P3, K_P4_IP, K_P4_DNS, K_P6 = (i << 40 for i in range(6))


def _compact(*arrays: Column) -> Column:
    return F.array_compact(F.concat(*arrays))


def _one(cond: Column, h: Column) -> Column:
    return F.array(F.when(cond, h))


# ---------------------------------------------------------------- P1
def is_test_path(path: Column) -> Column:
    return F.lower(path).rlike("|".join(R.TEST_PATH_WORDS))


# ---------------------------------------------------------------- P2
def _p2_from(toks: Column) -> Column:
    def one(t, i):
        dec = b64_decode_lenient(t)
        sev = (F.when(dec.rlike(R.B64_SHELL_WORDS), "critical")
               .when(dec.rlike(R.B64_URL), "high")
               .when(dec.rlike(R.B64_CODE_WORDS), "high"))
        return F.when(sev.isNotNull(), hit(
            "P2", sev, 0.85, "Base64 encoded suspicious content",
            "Base64 string decodes to potentially malicious content",
            evidence=F.concat(F.lit("Decoded: "), F.substring(dec, 1, 100)),
            tags=["obfuscation", "encoded_payload"], remediation="Remove obfuscated content. Use plain text.",
            phase=PH_LINE, k=F.lit(K_P2) + i))
    return F.when(F.size(toks) > 0, F.transform(toks, one)).otherwise(F.array().cast(HITS))


def _p3_from(line: Column, hx: Column, ux: Column) -> Column:
    total = hx + ux
    cond = (((hx >= R.ESCAPE_MIN) | (ux >= R.ESCAPE_MIN)) & ~line.rlike(R.REGEX_CONTEXT)
            & ~line.rlike(R.MAGIC_BYTES) & ~line.rlike(R.CHAR_CLASS_RANGE))
    return _one(cond, hit("P3", "medium", 0.7, "Hex/Unicode escape obfuscation",
                          F.format_string("Line contains %d escape sequences, possible obfuscation", total),
                          evidence=F.format_string("%d escape sequences", total), tags=["obfuscation"],
                          remediation="Use plain text strings. Obfuscation is a red flag.",
                          phase=PH_LINE, k=K_P3))


# ---------------------------------------------------------------- P3
def p3_counts(line: Column) -> tuple[Column, Column]:
    return F.regexp_count(line, F.lit(R.HEX_ESCAPE)), F.regexp_count(line, F.lit(R.UNICODE_ESCAPE))


# ---------------------------------------------------------------- P4
def public_ip_ok(ip: Column, line: Column) -> Column:
    """Reference filters for one dotted quad found on ``line``."""
    octets_ok = F.forall(F.split(ip, r"\."), lambda o: o.cast("int") <= 255)
    private = None
    for pfx in R.IP_SKIP_PREFIXES:
        c = ip.startswith(pfx)
        private = c if private is None else (private | c)
    pos = F.instr(line, ip)
    ctx = F.substring(line, F.greatest(pos - 15, F.lit(1)), F.least(pos - 1, F.lit(15)))
    five = F.regexp_extract(line, R.FIVE_PART, 0)
    return (octets_ok & ~private & ~F.lower(line).contains("version")
            & ~ctx.rlike(R.VERSION_CONTEXT) & ~((five != "") & five.contains(ip)))


def ddns_patterns(globs=R.DYNAMIC_DNS_GLOBS) -> list[str]:
    """Built-in list, then pack globs turned into escaped regexes (dots kept
    literal), duplicates dropped."""
    return list(dict.fromkeys([*R.DYNAMIC_DNS_PATTERNS, *(re.escape(g.lstrip("*")) for g in globs)]))


def ddns_hit() -> Column:
    return hit("P4", "high", 0.85, "Dynamic DNS domain detected",
               "Code references a dynamic DNS service commonly used for C2", tags=["network", "suspicious_domain"],
               remediation="Verify this domain is legitimate.", phase=PH_LINE, k=K_P4_DNS)


# ---------------------------------------------------------------- P7
def suspicious_tlds() -> list[str]:
    """Built-in and pack TLDs, de-duplicated and sorted (deterministic)."""
    return sorted(set(R.SUSPICIOUS_TLDS_BUILTIN + R.SUSPICIOUS_TLDS_PACK))


def _p7_from(toks: Column) -> Column:
    # the entropy of a token is computed once, before it is tested and quoted
    measured = F.transform(toks, lambda t: F.struct(t.alias("t"), shannon_entropy(t).alias("e")))

    def one(x, i):
        t, e = x["t"], x["e"]
        cond = (~t.rlike(R.UUID_PATTERN) & ~t.rlike(R.PLACEHOLDER_PATTERN)
                & ~any_match(t, [p for _, p, _ in R.SECRET_PATTERNS])
                & (e > R.ENTROPY_THRESHOLD) & (F.length(t) > 20))
        return F.when(cond, hit(
            "P7", "medium", 0.6, F.concat(F.lit("High-entropy string (entropy="), py_fixed(e, 1), F.lit(")")),
            "String has high randomness, possibly a secret or encoded payload",
            evidence=F.concat(F.lit("String length="), F.length(t).cast("string"), F.lit(", entropy="), py_fixed(e, 2),
                              F.lit(" (threshold=4.5)")),
            tags=["entropy", "possible_secret"],
            remediation="If this is a secret, move to environment variable or secrets manager.",
            phase=PH_P7, k=i))

    return F.when(F.size(toks) > 0, F.transform(measured, one)).otherwise(F.array().cast(HITS))


# ---------------------------------------------------------------- P8
def ioc_hit(url: Column, severity: Column, description: Column, i: Column) -> Column:
    return hit("P8", severity, 0.9, F.concat(F.lit("IOC match: "), description),
               "URL matches known malicious infrastructure pattern",
               evidence=F.concat(F.lit("URL: "), F.substring(url, 1, 100)), tags=["ioc", "network", "c2"],
               remediation="This URL matches known malicious infrastructure. Remove immediately.", phase=PH_P8, k=i * 2)


def tld_hit(url: Column, tld: Column, i: Column) -> Column:
    return hit("P8", "medium", 0.7, F.concat(F.lit("URL with suspicious TLD: "), tld),
               F.concat(F.lit("URL uses TLD '"), tld, F.lit("' frequently associated with malicious activity")),
               evidence=F.concat(F.lit("URL: "), F.substring(url, 1, 100)), tags=["ioc", "network", "suspicious_tld"],
               remediation="Verify this domain is legitimate.", phase=PH_P8, k=i * 2 + 1)


TLD_END = r"(?:[:/\s]|$)"


def _p8_from(urls: Column, skip=()) -> Column:
    """Hits of the shipped IOC patterns and TLDs (``skip``: see _stage1)."""
    iocs, tlds = R.IOC_PATTERNS, suspicious_tlds()

    def ioc(u, i):
        idx = first_match(u, ["(?i)" + p for p, _, _ in iocs])
        return F.when(idx.isNotNull(), ioc_hit(u, pick([s for _, s, _ in iocs], idx), pick([d for _, _, d in iocs], idx), i))

    def tld(u, i):
        idx = first_match(u, ["(?i)" + re.escape(t) + TLD_END for t in tlds])
        return F.when(idx.isNotNull(), tld_hit(u, pick(tlds, idx), i))

    parts = [F.transform(urls, f) for f, name in ((ioc, "ioc"), (tld, "tld")) if name not in skip]
    return F.when(F.size(urls) > 0, F.concat(*parts)).otherwise(F.array().cast(HITS))


# ---------------------------------------------------------------- P9b
def p9_long_hits(line: Column) -> Column:
    n = F.length(line)
    return _one(n > R.LONG_LINE, hit(
        "P9", "medium", 0.6, "Extremely long line (possible minified/obfuscated code)",
        F.format_string("Line is %d characters long", n), tags=["obfuscation"],
        remediation="Review if code minification is expected.",
        snippet=F.concat(F.substring(line, 1, 100), F.lit("...")), phase=PH_P9B, k=0))


# ---------------------------------------------------------------- P10
def p10_candidates(line: Column, may: Column, gates: Gates) -> Column:
    """Every manipulation pattern hit on a line; ``group`` = tactic and
    ``k`` = pattern index.  Reduced to one per (file, tactic) later."""
    labels = dict(R.TACTIC_LABELS)
    out = []
    for i, (p, tactic, sev) in enumerate(R.MANIPULATION_PATTERNS):
        out.append(F.when(gates.rlike(may, line, p), hit(
            "P10", sev, 0.75, "Agent manipulation: " + labels[tactic],
            (f"Text contains a psychological manipulation pattern ({tactic}) that can exploit LLM "
             "alignment training to make agents disable safety features, leak data, or self-destruct."),
            evidence=F.concat(F.lit("Matched: "), F.substring(F.regexp_extract(line, p, 0), 1, 80)),
            tags=["manipulation", "social_engineering", tactic],
            remediation=("Remove manipulation language. If this is a red-team test, add to the ignore file. "
                         "Agent-facing text should not contain patterns that exploit alignment training."),
            refs=["OWASP LLM01", "CWE-693"], phase=PH_P10, k=i, group=tactic)))
    return F.array(*out)


# ---------------------------------------------------------------- line projection
LINE_RULES = ("P1", "P2", "P3", "P4", "P6", "P7", "P8", "P9", "P10")


DDNS = "(?i)(?:" + "|".join(ddns_patterns()) + ")"


def _gates(rules, skip=()) -> Gates:
    """The patterns of ``rules`` that a line's literals decide on."""
    rx = []
    if "P1" in rules:
        rx += [p for _, p, _ in R.SECRET_PATTERNS]
    if "P4" in rules and "ddns" not in skip:
        rx += [DDNS]
    if "P6" in rules:
        rx += [p for p, _ in R.PROMPT_INJECTION_PATTERNS]
    if "P8" in rules and not {"ioc", "tld"} <= set(skip):
        rx += [R.URL_PATTERN]
    if "P10" in rules:
        rx += [p for p, *_ in R.MANIPULATION_PATTERNS]
    return Gates(rx)


def _stage1(rules, gates: Gates, skip=()) -> list[Column]:
    """Per-line inputs of the rules, each regex evaluated at most once per
    line and only where its required literals occur (``_may``: the bits of
    ``gates``).  ``skip``: parts whose pack section is a table (``ddns``,
    ``ioc``, ``tld``) and has a pass of its own."""
    L, MAY = F.col("line"), F.col("_may")
    empty = F.array().cast("array<string>")

    def gated_all(rx, group):
        g = gates.open(MAY, rx)
        e = F.regexp_extract_all(L, F.lit(rx), group)
        return e if g is None else F.when(g, e).otherwise(empty)

    c = []
    if "P1" in rules:
        c += [gates.first_match(MAY, L, [p for _, p, _ in R.SECRET_PATTERNS]).alias("_p1")]
    if "P2" in rules:
        c += [F.regexp_extract_all(L, F.lit(R.B64_TOKEN), 1).alias("_b64")]
    if "P3" in rules:
        hx, ux = p3_counts(L)
        c += [F.when(L.contains("\\x"), hx).otherwise(0).alias("_hx"),
              F.when(L.contains("\\u"), ux).otherwise(0).alias("_ux")]
    if "P4" in rules:
        c += [F.when(L.contains("."), F.regexp_extract_all(L, F.lit(R.IPV4_SPARK), 1)).otherwise(empty).alias("_ips"),
              (F.lit(False) if "ddns" in skip else gates.rlike(MAY, L, DDNS)).alias("_ddns")]
    if "P6" in rules:
        c += [gates.first_match(MAY, L, [p for p, _ in R.PROMPT_INJECTION_PATTERNS]).alias("_p6")]
    if "P7" in rules:
        c += [F.regexp_extract_all(L, F.lit(R.QUOTED_TOKEN), 1).alias("_tok")]
    if "P8" in rules and not {"ioc", "tld"} <= set(skip):
        c += [gated_all(R.URL_PATTERN, 0).alias("_urls")]
    if "P10" in rules:
        c += [F.array_compact(p10_candidates(L, MAY, gates)).alias("_p10")]
    return c


def _stage2(rules, skip=()) -> list[Column]:
    """array<HIT> pieces built from the stage-1 columns."""
    L, P = F.col("line"), F.col("path")
    out = []
    if "P1" in rules:
        idx = F.col("_p1")
        name = pick([n for n, _, _ in R.SECRET_PATTERNS], idx)
        sev = pick([s for _, _, s in R.SECRET_PATTERNS], idx)
        cond = idx.isNotNull() & ~L.rlike(R.PLACEHOLDER_PATTERN) & ~is_test_path(P)
        out.append(_one(cond, hit("P1", sev, 0.9, F.concat(F.lit("Hardcoded credential: "), name),
                                  F.concat(F.lit("Found "), name, F.lit(" pattern in source code")),
                                  tags=["credential", "hardcoded_secret"],
                                  remediation="Move to environment variable or secrets manager.",
                                  refs=["CWE-798"], phase=PH_LINE, k=K_P1)))
    if "P2" in rules:
        out.append(_p2_from(F.col("_b64")))
    if "P3" in rules:
        out.append(_p3_from(L, F.col("_hx"), F.col("_ux")))
    if "P4" in rules:
        ips = F.col("_ips")
        out.append(F.when(F.size(ips) > 0, F.transform(ips, lambda ip, i: F.when(public_ip_ok(ip, L), hit(
            "P4", "medium", 0.7, F.concat(F.lit("Hardcoded public IP: "), ip),
            "Public IP address found in source code", tags=["network", "hardcoded_ip"],
            remediation="Use domain names with verified ownership instead of bare IPs.",
            phase=PH_LINE, k=F.lit(K_P4_IP) + i)))).otherwise(F.array().cast(HITS)))
        out.append(_one(F.col("_ddns"), ddns_hit()))
    if "P6" in rules:
        idx = F.col("_p6")
        sev = pick([s for _, s in R.PROMPT_INJECTION_PATTERNS], idx)
        out.append(_one(idx.isNotNull(), hit("P6", sev, 0.8, "Prompt injection pattern detected",
                                             "Text contains a known prompt injection pattern",
                                             tags=["prompt_injection"], remediation="Remove prompt injection content.",
                                             refs=["OWASP LLM01"], phase=PH_LINE, k=K_P6)))
    if "P7" in rules:
        out.append(_p7_from(F.col("_tok")))
    if "P8" in rules and not {"ioc", "tld"} <= set(skip):
        out.append(_p8_from(F.col("_urls"), skip))
    if "P9" in rules:
        out.append(p9_long_hits(L))
    if "P10" in rules:
        out.append(F.col("_p10"))
    return out


def text_findings(lines: DataFrame, rules=LINE_RULES, p3_decode: bool = False, iocs=None,
                  pack: RulePack | None = None) -> DataFrame:
    """All line-level P findings.

    Stage 1 evaluates every regex once per line into plain columns; stage 2
    assembles hit arrays from them; ``explode`` drops lines without hits (no
    filter in front of it, so nothing is evaluated twice).  P10 keeps one
    finding per (file, tactic) and so has a pass and a group-by of its own;
    the findings of all other rules are never shuffled.  Sections that
    ``pack`` gives (``iocs``: its c2_patterns alone) are rule tables of any
    length and have passes of their own."""
    pack = pack or RulePack()
    if iocs is not None:
        pack = replace(pack, c2_patterns=iocs)
    tables = [("ddns", "P4", pack.dynamic_dns, p4_pack_dns), ("ioc", "P8", pack.c2_patterns, p8_pack_iocs),
              ("tld", "P8", pack.suspicious_tlds, p8_pack_tlds)]
    tables = [(name, section, fn) for name, rule, section, fn in tables if section is not None and rule in rules]
    skip = {name for name, _, _ in tables}
    plain = [r for r in rules if r != "P10"]
    parts = [_line_findings(lines, plain, p3_decode, skip)] if plain else []
    if "P10" in rules:
        f = _line_findings(lines, ["P10"], False)
        best = f.groupBy("package_id", "path", F.col("tags")[2].alias("_g")).agg(
            F.min(F.struct(F.col("line").alias("_l"), F.col("ord.k").alias("_k"), F.struct(*f.columns).alias("row")))
            .alias("b"))
        parts.append(best.select("b.row.*"))
    parts += [fn(lines, section) for _, section, fn in tables]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _line_findings(lines: DataFrame, rules, p3_decode: bool, skip=()) -> DataFrame:
    gates = _gates(rules, skip)
    s0 = lines.select("package_id", "path", "line_no", "line", gates.bits(F.col("line")).alias("_may"))
    s1 = s0.select("package_id", "path", "line_no", "line", *_stage1(rules, gates, skip))
    hits = _stage2(rules, skip) or [F.array().cast(HITS)]
    s2 = s1.select("package_id", "path", "line_no", "line", _compact(*hits).alias("hs"))
    flat = explode_hits(s2, ["package_id", "path", "line_no", "line"], F.col("hs"), "h")
    if p3_decode and "P3" in rules:
        # F10 on hit rows only (they still carry their line): no join back to lines
        from ..functions.udfs import unicode_escape_evidence
        is3 = F.col("h.rule_id") == "P3"
        dec = unicode_escape_evidence(F.when(is3, F.col("line")))
        flat = flat.withColumn("h", F.when(is3 & dec.isNotNull(), F.col("h").withField("evidence", dec))
                               .otherwise(F.col("h")))
    return findings_from_hits(flat, "pattern", "behavior", default_snippet=snippet(F.col("line")))


# ---------------------------------------------------------------- P4b, P8 with rule tables
AT_LINE = ["package_id", "path", "line_no"]


def _placed(df: DataFrame) -> DataFrame:
    return findings_from_hits(df, "pattern", "behavior", default_snippet=snippet(F.col("line")))


def p4_pack_dns(lines: DataFrame, globs) -> DataFrame:
    """P4b with a table of globs beside the built-in patterns: one finding a
    line, whichever matches."""
    def patterns():
        yield from R.DYNAMIC_DNS_PATTERNS
        for (g,) in rows_of(globs, ["glob"], ["glob"]) if isinstance(globs, DataFrame) else ((g,) for g in globs):
            if g and g.lstrip("*"):
                yield re.escape(g.lstrip("*"))
    m = matches(lines.select(*AT_LINE, "line"), "line", (("(?i)" + p, (p,)) for p in patterns()), "pattern string")
    return _placed(m.groupBy(*AT_LINE).agg(F.first("line").alias("line")).withColumn("h", ddns_hit()))


def _urls(lines: DataFrame) -> DataFrame:
    """One row per URL of a line: AT_LINE, line, i (its place), url."""
    may = gate(F.col("line"), F.lower("line"), R.URL_PATTERN)
    return (lines if may is None else lines.where(may)).select(
        *AT_LINE, "line", F.posexplode(F.regexp_extract_all("line", F.lit(R.URL_PATTERN), 0)).alias("i", "url"))


def p8_pack_iocs(lines: DataFrame, iocs) -> DataFrame:
    """P8a with a table of patterns: per URL the first of the pack (of a
    DataFrame: by pattern).  Patterns that do not compile are skipped."""
    spark = lines.sparkSession
    rules = (("(?i)" + p, (sev or "high", desc or "Known IOC match"))
             for p, sev, desc in rows_of(iocs, ["pattern", "severity", "description"], ["pattern", "severity", "description"])
             if p and compiles(spark, "(?i)" + p))
    m = matches(_urls(lines), "url", rules, "severity string, description string")
    if m is None:
        return empty_findings(spark)
    best = m.groupBy(*AT_LINE, "i").agg(F.min(F.struct("j", "severity", "description", "url", "line")).alias("b")) \
        .select(*AT_LINE, "i", "b.*")
    return _placed(best.withColumn("h", ioc_hit(F.col("url"), F.col("severity"), F.col("description"), F.col("i"))))


def p8_pack_tlds(lines: DataFrame, tlds) -> DataFrame:
    """P8b with a table of TLDs beside the built-in ones: per URL the
    alphabetically first that ends one of its parts.

    The parts of a URL end at ``:``, ``/`` or its end, and a TLD ends a part
    when it is the part's last labels.  The trie of reversed host names is
    walked as an equi-join: every part is looked up by its last 1, 2, ...
    labels, down to the longest entry of the pack.  Entries that are no plain
    labels are matched as patterns."""
    spark = lines.sparkSession
    given = tlds.select(F.col("tld")) if isinstance(tlds, DataFrame) else \
        spark.createDataFrame([(t,) for t in tlds], "tld string")
    built_in = spark.createDataFrame([(t,) for t in R.SUSPICIOUS_TLDS_BUILTIN], "tld string")
    every = given.unionByName(built_in).where("tld <> ''").distinct().withColumn("plain", F.col("tld").rlike(r"^(\.[^.:/\s]+)+$"))
    table = every.where("plain").groupBy(F.lower("tld").alias("key")).agg(F.min("tld").alias("tld")).checkpoint()
    size = table.agg(F.count("*"), F.max(F.size(F.split("key", r"\.")) - 1)).first()
    urls = _urls(lines)
    labels = F.split(F.lower("part"), r"\.")
    n = F.size("labels")
    last = F.transform(F.sequence(F.lit(1), F.least(n - 1, F.lit(size[1]))),
                       lambda k: F.concat(F.lit("."), F.array_join(F.slice("labels", n - k + 1, k), ".")))
    keyed = (urls.withColumn("part", F.explode(F.array_distinct(F.split("url", "[:/]")))).withColumn("labels", labels)
             .where(n > 1).withColumn("key", F.explode(last)).drop("part", "labels"))
    # labels that are in no pack are dropped where they are made; what is left is joined exactly
    found = may_hold(keyed, key_bitmap(table, ["key"], size[0]), ["key"]).join(table, "key").select(*urls.columns, "tld")
    odd = matches(urls, "url", (("(?i)" + re.escape(t) + TLD_END, (t,)) for (t,) in
                                rows_of(every.where("NOT plain"), ["tld"], ["tld"])), "tld string")
    if odd is not None:
        found = found.unionByName(odd.select(*found.columns))
    best = found.groupBy(*AT_LINE, "i").agg(F.min("tld").alias("tld"), F.first("url").alias("url"), F.first("line").alias("line"))
    return _placed(best.withColumn("h", tld_hit(F.col("url"), F.col("tld"), F.col("i"))))


# ---------------------------------------------------------------- P5 (whole file)
SIGNATURE_COLUMNS = ["id", "name", "pattern", "multiline", "severity", "tags", "refs"]


def p5_signatures(files: DataFrame, signatures=None) -> DataFrame:
    """First match of every signature in every file.

    The shipped signatures are plan literals, each regex compiled once per
    task and gated by its required literals.  ``signatures`` (a DataFrame or
    rows: id, name, pattern, multiline, severity, tags, refs) is a rule table
    of any length: one pass over a file names the rules that may match, only
    those run.  A pattern that does not compile is skipped.  A finding's order
    key is its signature's position (of a DataFrame: by id and pattern) among
    those that compile."""
    from ..sources.corpus import LINE_BREAKS
    spark = files.sparkSession

    def found(j, sid, name, rx, sev, tags, refs):
        # prefix before the first match -> its line; computed only for files that match
        line = newline_count(F.split(F.col("content"), rx, 2)[0]) + 1
        return F.struct(line.cast("int").alias("line_no"), hit(
            "P5", sev, 0.9, F.concat(F.lit("Malicious signature: "), name),
            F.concat(F.lit("Matched known malicious signature "), sid, F.lit(": "), name),
            evidence=F.concat(F.lit("Signature "), sid, F.lit(" matched (SHA256: "),
                              F.substring(F.sha2(F.col("content"), 256), 1, 16), F.lit("...)")),
            tags=F.concat(F.array(F.lit("malicious_signature")), tags),
            remediation="This file matches a known malicious pattern. Do not install or execute.",
            refs=refs, phase=PH_P5, k=j).alias("h"))

    def regex(pattern, multiline):
        return ("(?i)(?s)" if multiline else "(?i)") + pattern

    text = files.select("package_id", "path", "content")
    if signatures is None:
        strings = lambda v: F.array(*[F.lit(x) for x in v]).cast("array<string>")
        gates = Gates(regex(pat, multi) for _, _, pat, multi, *_ in R.SIGNATURES)
        arms = [F.when(gates.rlike(F.col("_may"), F.col("content"), regex(pat, multi)),
                       found(F.lit(j), F.lit(sid), F.lit(name), F.lit(regex(pat, multi)), F.lit(sev), strings(tags), strings(refs)))
                for j, (sid, name, pat, multi, sev, tags, refs) in enumerate(R.SIGNATURES)]
        flat = explode_hits(text.withColumn("_may", gates.bits(F.col("content"))), ["package_id", "path", "content"],
                            F.array_compact(F.array(*arms)), "x")
    else:
        rules = ((regex(pat, multi), (sid, name, sev, list(tags or []), list(refs or [])))
                 for sid, name, pat, multi, sev, tags, refs in rows_of(signatures, SIGNATURE_COLUMNS, ["id", "pattern"])
                 if pat and compiles(spark, regex(pat, multi)))
        m = matches(text, "content", rules, "id string, name string, severity string, tags array<string>, refs array<string>")
        if m is None:
            return empty_findings(spark)
        flat = m.select("package_id", "path", "content",
                        found(*(F.col(c) for c in ("j", "id", "name", "rx", "severity", "tags", "refs"))).alias("x"))
    flat = flat.select("package_id", "path", "content", "x.line_no", "x.h")
    # snippet: the matched line of the file (python splitlines numbering)
    line_text = F.get(F.split(F.col("content"), LINE_BREAKS, -1), F.col("line_no") - 1)
    return findings_from_hits(flat, "pattern", "behavior", default_snippet=F.coalesce(snippet(line_text), F.lit("")))


# ---------------------------------------------------------------- P9a (whole file, every match)
def p9_obfuscation(files: DataFrame) -> DataFrame:
    """Every match of the language's obfuscation patterns, with its line.

    Files without the literals every match must contain are dropped in the
    JVM by substring search; no backtracking regex runs there, so a long
    chain cannot overflow its stack.  The others go through an Arrow-batched
    ``finditer`` (exact line numbers for patterns whose ``\\s`` may cross
    lines)."""
    from ..functions.udfs import MATCHES, obfuscation_matches
    p, c = F.col("path"), F.col("content")
    is_js = p.endswith(".js") | p.endswith(".mjs") | p.endswith(".cjs")

    def may_match(patterns):
        cond = F.lit(False)
        for x, _ in patterns:
            g = gate(c, F.lower(c), x)
            cond = F.lit(True) if g is None else cond | g
        return cond

    cand = files.where((is_js & may_match(R.JS_OBFUSCATION_PATTERNS))
                       | (p.endswith(".py") & may_match(R.PY_OBFUSCATION_PATTERNS)))
    ms = cand.select("package_id", "path", "content", is_js.alias("is_js")).mapInPandas(obfuscation_matches, MATCHES)
    descs = [d for _, d in R.JS_OBFUSCATION_PATTERNS] + [d for _, d in R.PY_OBFUSCATION_PATTERNS]
    out = ms.select("package_id", "path", "line_no", hit(
        "P9", "high", 0.8, F.concat(F.lit("Code obfuscation: "), pick(descs, F.col("idx"))),
        "Obfuscation pattern detected, common in malicious code", tags=["obfuscation"],
        remediation="Request unobfuscated source. Obfuscation in skills is a strong malice indicator.",
        snippet=F.col("snippet"), phase=PH_P9A, k=F.col("idx") * F.lit(1 << 40) + F.col("k")).alias("h"))
    return findings_from_hits(out, "pattern", "behavior")


# ---------------------------------------------------------------- P6b (SKILL.md description)
def p6_skill_injection(files: DataFrame, lines: DataFrame, max_chars: int | None = None) -> DataFrame:
    """SKILL.md, whole (or its first ``max_chars`` characters), first
    injection pattern only; line = first line that contains the matched text
    (case-insensitive)."""
    skill = files.where(F.col("path") == "SKILL.md")
    head = F.col("content") if max_chars is None else F.substring(F.col("content"), 1, max_chars)
    pats = ["(?i)" + p for p in R.SKILL_INJECTION_PATTERNS]
    idx = first_match(head, pats)
    matched = F.element_at(F.array(*[F.regexp_extract(head, p, 0) for p in pats]), (idx + 1).cast("int"))
    m = skill.select("package_id", "path", matched.alias("matched")).where(F.col("matched").isNotNull())
    ln = lines.where(F.col("path") == "SKILL.md").alias("l")
    first_line = m.alias("m").join(ln, (F.col("m.package_id") == F.col("l.package_id"))
                                   & F.lower(F.col("l.line")).contains(F.lower(F.col("m.matched"))), "left") \
        .groupBy(F.col("m.package_id").alias("package_id"), F.col("m.matched").alias("matched")) \
        .agg(F.min("l.line_no").alias("line_no"))
    out = first_line.select("package_id", F.lit("SKILL.md").alias("path"), "line_no", hit(
        "P6", "critical", 0.9, "Prompt injection detected in skill description",
        "SKILL.md description contains text that attempts to override LLM instructions",
        evidence=F.concat(F.lit("Matched pattern: "), F.col("matched")),
        tags=["prompt_injection", "social_engineering"],
        remediation="Remove prompt injection text from skill description.", refs=["OWASP LLM01"],
        snippet=F.col("matched"), phase=0, k=0).alias("h"))
    return findings_from_hits(out, "manifest", "metadata")
