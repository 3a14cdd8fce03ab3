"""DuckDB twins of the seeded corpus, for the SQL correctness oracle.

Every function returns SQL text over the driver's pre-registered views
(``documents``, ``pages``, ``part``, ...).  ``corpus_ctes()`` rebuilds the
``files`` / ``scanned`` / ``lines`` tables exactly like
:mod:`vigil.sources.corpus` and :mod:`vigil.sources.files` do in Spark, so a
rule's SQL only has to state the rule.
"""

from __future__ import annotations

import re

from ..rules import packs as R
from ..sources import corpus as C

# RE2 spelling of the line-break set (same text works for both engines)
LB = C.LINE_BREAKS
PY_WS_RE2 = (r"[\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
             r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
NL = "chr(10)"


def q(s: str) -> str:
    """SQL string literal (DuckDB keeps backslashes literally)."""
    return "'" + s.replace("'", "''") + "'"


def case_pick(expr: str, values: list[str]) -> str:
    arms = " ".join(f"WHEN {i} THEN {q(v)}" for i, v in enumerate(values))
    return f"(CASE {expr} {arms} END)"


def first_match(col: str, patterns: list[str], values: list[str] | None = None) -> str:
    """CASE returning values[i] (default: i) of the first matching pattern."""
    vals = values if values is not None else [str(i) for i in range(len(patterns))]
    arms = " ".join(f"WHEN regexp_matches({col}, {q(p)}) THEN {q(v) if values is not None else v}"
                    for p, v in zip(patterns, vals))
    return f"(CASE {arms} END)"


def any_match(col: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({col}, {q(p)})" for p in patterns) + ")"


def py_strip(col: str) -> str:
    return f"regexp_replace({col}, {q('^' + PY_WS_RE2 + '+|' + PY_WS_RE2 + '+\\z')}, '', 'g')"


def snippet(col: str, n: int = 120) -> str:
    return f"substring({py_strip(col)}, 1, {n})"


def pkg(table: str, key: str) -> str:
    per, step = C.PER_PACKAGE[table]
    return f"('pkg' || CAST(({key} // {per}) * {step} AS VARCHAR))"


def doc_pkg(alias: str = "") -> str:
    return f"CASE WHEN {alias}source = {q(C.HOT_SOURCE)} THEN 'pkg0' ELSE {pkg('documents', alias + 'doc_id')} END"


def corpus_ctes() -> str:
    """``WITH`` body defining files, scanned and lines."""
    ext = case_pick("doc_id % 6", C.DOC_EXTS)
    every, at = C.CLEAN_PACKAGES
    snip_no = (f"CASE WHEN (doc_id // 10) % {every} = {at} AND coalesce(source, '') <> {q(C.HOT_SOURCE)} "
               f"THEN {C.HARMLESS} ELSE doc_id % {len(C.SNIPPETS)} END")
    snip = case_pick(f"({snip_no})", C.SNIPPETS)
    art = case_pick(f"page_id % {len(C.ARTIFACT_PATHS)}", C.ARTIFACT_PATHS)
    dep = (f"CASE WHEN p_partkey % 50 < {len(C.PLANTED_DEPS)} AND (p_partkey // 20) % 3 = 0 THEN {case_pick('p_partkey % 50', C.PLANTED_DEPS)} "
           f"ELSE replace(coalesce(p_name, 'pkg'), ' ', '-') END")
    tool = case_pick(f"(conv_id * 7 + turn) % {len(C.SKILL_TOOLS)}", C.SKILL_TOOLS)
    item = f"CASE WHEN turn % 5 = 4 THEN '#### ' || {tool} ELSE '- ' || {tool} END"
    desc = case_pick(f"pk % {len(C.DESCRIPTIONS)}", C.DESCRIPTIONS)
    skill_desc = f"CASE WHEN pk % 6 = 0 THEN {q(C.SKILL_INJECTION)} ELSE {desc} END"
    pdesc = case_pick(f"pk % {len(C.DESCRIPTIONS)}", C.DESCRIPTIONS)
    hook_k = case_pick(f"pk % {len(C.NPM_HOOKS)}", [h for h, _ in C.NPM_HOOKS])
    hook_v = case_pick(f"pk % {len(C.NPM_HOOKS)}", [v for _, v in C.NPM_HOOKS])
    ext_l = case_pick("l.doc_id % 6", C.DOC_EXTS)
    hooks = " ".join(f"UNION ALL SELECT package_id, {q(p)}, {q(C.HOOK_PY)} FROM pkgs WHERE pk % {len(C.NPM_HOOKS)} = {r}"
                     for r, p in C.HOOK_FILES)
    scanned_sfx = ", ".join(q(s) for s in R.SCANNED_SUFFIXES)
    excl = ", ".join(q(d) for d in R.EXCLUDED_DIRS)
    return f"""
docs AS (
  SELECT doc_id, {doc_pkg()} AS package_id, coalesce(text, '') AS text, {ext} AS ext, {snip_no} AS snip_no,
         {snip} AS snippet FROM documents),
doc_files AS (
  SELECT package_id, 'd' || CAST(doc_id AS VARCHAR) || ext AS path,
         (CASE WHEN ext LIKE '%.py' THEN '# ' || regexp_replace(text, {q(LB)}, {NL} || '# ', 'g') ELSE text END)
           || {NL} || snippet || {NL} AS content
  FROM docs),
art_files AS (
  SELECT {pkg('pages', 'page_id')} AS package_id, replace({art}, '{{id}}', CAST(page_id AS VARCHAR)) AS path,
         coalesce(html, '') AS content FROM pages),
deps AS (
  SELECT DISTINCT {pkg('part', 'p_partkey')} AS package_id, {dep} AS dep FROM part),
pkgs AS (
  SELECT DISTINCT package_id, CAST(regexp_extract(package_id, '(\\d+)$', 1) AS INTEGER) AS pk FROM deps),
dep_obj AS (
  SELECT package_id, json_group_object(dep, '^1.0.0') AS dj,
         '# requirements' || {NL} || string_agg(dep || '>=1.0', {NL} ORDER BY dep) || {NL} AS reqs
  FROM deps GROUP BY package_id),
pkg_json AS (
  SELECT p.package_id, p.pk,
         CAST(json_object('name', p.package_id, 'description', {pdesc},
                          'scripts', json_object({hook_k}, {hook_v}), 'dependencies', d.dj) AS VARCHAR) AS content,
         d.reqs
  FROM pkgs p JOIN dep_obj d ON p.package_id = d.package_id),
man_files AS (
  SELECT package_id, 'package.json' AS path, content FROM pkg_json WHERE pk % 4 <> 1
  UNION ALL SELECT package_id, 'requirements.txt', reqs FROM pkg_json WHERE pk % 4 < 2
  UNION ALL SELECT package_id, 'setup.py',
     CASE WHEN pk % 8 = 0 THEN {q(C.SETUP_PY_CMDCLASS)} ELSE {q(C.SETUP_PY_PLAIN)} END FROM pkgs WHERE pk % 4 < 2
  {hooks}),
mcp_items AS (
  SELECT {pkg('supplier', 's_suppkey')} AS package_id, s_suppkey,
         CASE WHEN s_suppkey % 5 = 0 THEN 'network' WHEN s_suppkey % 5 = 1 THEN 'shell'
              ELSE 'tool_' || CAST(s_suppkey AS VARCHAR) END AS name FROM supplier),
mcp_files AS (
  SELECT package_id, 'mcp.json' AS path,
         CASE WHEN pk % 9 = 4 THEN '{{"tools": ' || tools
              ELSE '{{"tools": ' || tools || ', "permissions": ' ||
                   CASE WHEN pk % 4 = 0 THEN '{{"filesystem": "/", "network": true}}'
                        WHEN pk % 4 = 1 THEN '{{"shell": "*"}}' WHEN pk % 4 = 2 THEN '{{"fs": ["~/docs"]}}'
                        ELSE '{{}}' END || '}}' END AS content
  FROM (SELECT package_id, CAST(regexp_extract(package_id, '(\\d+)$', 1) AS INTEGER) AS pk,
               CAST(to_json(list({{'name': name}} ORDER BY s_suppkey)) AS VARCHAR) AS tools
        FROM mcp_items GROUP BY package_id)),
ign_rows AS (
  SELECT {doc_pkg('d.')} AS package_id, l.doc_id,
         CASE WHEN l.toxic = 1 THEN 'P4:d' || CAST(l.doc_id AS VARCHAR) || {ext_l}
              WHEN l.quality = 0 THEN 'P7:d' || CAST(l.doc_id AS VARCHAR) || '*' END AS entry
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
ign_files AS (
  SELECT package_id, {q(R.IGNORE_FILE)} AS path,
         '# suppressions' || {NL} || 'S5' || {NL} || string_agg(entry, {NL} ORDER BY doc_id) || {NL} AS content
  FROM ign_rows WHERE entry IS NOT NULL GROUP BY package_id),
skill_items AS (
  SELECT {pkg('conversations', 'conv_id')} AS package_id, conv_id, turn, {item} AS item,
         regexp_replace(coalesce(text, ''), {q(LB)}, ' ', 'g') AS said FROM conversations),
skill_files AS (
  SELECT package_id, 'SKILL.md' AS path,
         '# Skill ' || package_id || {NL} || '## Description' || {NL} || {skill_desc} || {NL} || '## Example' || {NL}
           || string_agg(said, {NL} ORDER BY conv_id, turn) || {NL} || '## Tools' || {NL} || string_agg(item, {NL} ORDER BY conv_id, turn) || {NL} AS content
  FROM (SELECT *, CAST(regexp_extract(package_id, '(\\d+)$', 1) AS INTEGER) AS pk FROM skill_items)
  GROUP BY package_id, pk),
files AS (
  SELECT package_id, path, content FROM doc_files
  UNION ALL SELECT package_id, path, content FROM art_files
  UNION ALL SELECT package_id, path, content FROM man_files
  UNION ALL SELECT package_id, path, content FROM skill_files
  UNION ALL SELECT package_id, path, content FROM mcp_files
  UNION ALL SELECT package_id, path, content FROM ign_files),
scanned AS (
  SELECT * FROM files
  WHERE regexp_extract(path, '(\\.[^./]*)$', 1) IN ({scanned_sfx})
    AND NOT list_has_any(list_slice(string_split(path, '/'), 1, len(string_split(path, '/')) - 1), [{excl}])),
split_lines AS (
  SELECT package_id, path, string_split_regex(content, {q(LB)}) AS parts FROM scanned),
lines AS (
  SELECT package_id, path, CAST(line_no AS INTEGER) AS line_no, line FROM (
    SELECT package_id, path, unnest(range(1, len(parts) + 1)) AS line_no, unnest(parts) AS line, len(parts) AS n
    FROM split_lines)
  WHERE NOT (line_no = n AND line = ''))"""


def with_corpus(body: str, extra_ctes: str = "") -> str:
    ctes = corpus_ctes()
    if extra_ctes:
        ctes += ",\n" + extra_ctes
    return f"WITH {ctes}\n{body}"


# ---------------------------------------------------------------- rule SQL pieces
def is_test_path(col: str) -> str:
    return f"regexp_matches(lower({col}), {q('|'.join(R.TEST_PATH_WORDS))})"


def p1_rows() -> str:
    pats = [p for _, p, _ in R.SECRET_PATTERNS]
    names = [n for n, _, _ in R.SECRET_PATTERNS]
    sevs = [s for _, _, s in R.SECRET_PATTERNS]
    return f"""SELECT package_id, path, line_no AS line, 'P1' AS rule_id,
  {first_match('line', pats, sevs)} AS severity,
  'Hardcoded credential: ' || {first_match('line', pats, names)} AS title,
  1 AS eng, 0 AS phase, CAST(0 AS BIGINT) AS k
FROM lines
WHERE {any_match('line', pats)} AND NOT regexp_matches(line, {q(R.PLACEHOLDER_PATTERN)})
  AND NOT {is_test_path('path')}"""


def ip_ok(ip: str, line: str) -> str:
    private = " OR ".join(f"starts_with({ip}, {q(p)})" for p in R.IP_SKIP_PREFIXES)
    pos = f"instr({line}, {ip})"
    ctx = f"substring({line}, greatest({pos} - 15, 1), least({pos} - 1, 15))"
    five = f"regexp_extract({line}, {q(R.FIVE_PART)}, 0)"
    return (f"(list_bool_and(list_transform(string_split({ip}, '.'), lambda o: CAST(o AS INTEGER) <= 255))"
            f" AND NOT ({private}) AND NOT contains(lower({line}), 'version')"
            f" AND NOT regexp_matches({ctx}, {q(R.VERSION_CONTEXT)})"
            f" AND NOT ({five} <> '' AND contains({five}, {ip})))")


def p4_ip_rows() -> str:
    return f"""SELECT package_id, path, line_no AS line, 'P4' AS rule_id, 'medium' AS severity,
  'Hardcoded public IP: ' || ip AS title, 1 AS eng, 0 AS phase, CAST(3000 + i - 1 AS BIGINT) AS k
FROM (SELECT package_id, path, line_no, line, unnest(ips) AS ip, unnest(range(1, len(ips) + 1)) AS i
      FROM (SELECT *, regexp_extract_all(line, {q(R.IPV4_RE2)}, 1) AS ips FROM lines) WHERE len(ips) > 0)
WHERE {ip_ok('ip', 'line')}"""


def ddns_patterns() -> list[str]:
    out = list(R.DYNAMIC_DNS_PATTERNS)
    for g in R.DYNAMIC_DNS_GLOBS:
        rx = re.escape(g.lstrip("*"))
        if rx not in out:
            out.append(rx)
    return out


def p4_ddns_rows() -> str:
    rx = "(?i)(?:" + "|".join(ddns_patterns()) + ")"
    return f"""SELECT package_id, path, line_no AS line, 'P4' AS rule_id, 'high' AS severity,
  'Dynamic DNS domain detected' AS title, 1 AS eng, 0 AS phase, CAST(4000 AS BIGINT) AS k
FROM lines WHERE regexp_matches(line, {q(rx)})"""


def p6_rows() -> str:
    pats = [p for p, _ in R.PROMPT_INJECTION_PATTERNS]
    sevs = [s for _, s in R.PROMPT_INJECTION_PATTERNS]
    return f"""SELECT package_id, path, line_no AS line, 'P6' AS rule_id, {first_match('line', pats, sevs)} AS severity,
  'Prompt injection pattern detected' AS title, 1 AS eng, 0 AS phase, CAST(5000 AS BIGINT) AS k
FROM lines WHERE {any_match('line', pats)}"""


def p9_long_rows() -> str:
    return f"""SELECT package_id, path, line_no AS line, 'P9' AS rule_id, 'medium' AS severity,
  'Extremely long line (possible minified/obfuscated code)' AS title, 1 AS eng, 5 AS phase, CAST(0 AS BIGINT) AS k
FROM lines WHERE length(line) > {R.LONG_LINE}"""


def suspicious_tlds() -> list[str]:
    return sorted(set(R.SUSPICIOUS_TLDS_BUILTIN + R.SUSPICIOUS_TLDS_PACK))


def p8_rows() -> str:
    iocs = R.IOC_PATTERNS
    ipats = ["(?i)" + p for p, _, _ in iocs]
    tlds = suspicious_tlds()
    tpats = ["(?i)" + re.escape(t) + r"(?:[:/\s]|$)" for t in tlds]
    base = f"""(SELECT package_id, path, line_no, unnest(urls) AS url, unnest(range(1, len(urls) + 1)) AS i
      FROM (SELECT *, regexp_extract_all(line, {q(R.URL_PATTERN)}, 0) AS urls FROM lines) WHERE len(urls) > 0)"""
    return f"""SELECT package_id, path, line_no AS line, 'P8' AS rule_id, {first_match('url', ipats, [s for _, s, _ in iocs])} AS severity,
  'IOC match: ' || {first_match('url', ipats, [d for _, _, d in iocs])} AS title, 1 AS eng, 3 AS phase,
  CAST((i - 1) * 2 AS BIGINT) AS k
FROM {base} WHERE {any_match('url', ipats)}
UNION ALL
SELECT package_id, path, line_no AS line, 'P8' AS rule_id, 'medium' AS severity,
  'URL with suspicious TLD: ' || {first_match('url', tpats, tlds)} AS title, 1 AS eng, 3 AS phase,
  CAST((i - 1) * 2 + 1 AS BIGINT) AS k
FROM {base} WHERE {any_match('url', tpats)}"""


# hosts of the pages and their last two labels
PAGE_HOSTS = """(SELECT DISTINCT lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host FROM pages
  WHERE regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) <> '')"""
PAGE_DOMAINS = f"""(SELECT host FROM {PAGE_HOSTS} UNION SELECT regexp_extract(host, '([^.]+\\.[^.]+)$', 1) FROM {PAGE_HOSTS}
  WHERE regexp_extract(host, '([^.]+\\.[^.]+)$', 1) <> '')"""
URLS = f"""(SELECT package_id, path, line_no, unnest(urls) AS url, unnest(range(1, len(urls) + 1)) AS i
  FROM (SELECT *, regexp_extract_all(line, {q(R.URL_PATTERN)}, 0) AS urls FROM lines) WHERE len(urls) > 0)"""


def pack_dns_rows() -> str:
    rx = "(?i)(?:" + "|".join(R.DYNAMIC_DNS_PATTERNS) + ")"
    return f"""SELECT package_id, path, line_no AS line, 'P4' AS rule_id, 'high' AS severity, 'Dynamic DNS domain detected' AS title
FROM lines l WHERE regexp_matches(line, {q(rx)}) OR EXISTS (
  SELECT 1 FROM {PAGE_DOMAINS} d WHERE contains(lower(l.line), '.' || d.host))"""


def pack_ioc_rows() -> str:
    return f"""SELECT package_id, path, line_no AS line, 'P8' AS rule_id, CASE WHEN length(host) % 2 = 0 THEN 'high' ELSE 'medium' END AS severity,
  'IOC match: Listed host ' || host AS title, 'URL: ' || substring(url, 1, 100) AS evidence
FROM (SELECT u.*, d.host, row_number() OVER (PARTITION BY package_id, path, line_no, i
        ORDER BY replace(replace(host, '-', '\\-'), '.', '\\.') || '/') AS rn
      FROM {URLS} u JOIN {PAGE_DOMAINS} d ON contains(lower(u.url), d.host || '/')) WHERE rn = 1"""


def pack_tld_rows() -> str:
    built_in = ", ".join(f"({q(t)})" for t in R.SUSPICIOUS_TLDS_BUILTIN)
    return f"""SELECT package_id, path, line_no AS line, 'P8' AS rule_id, 'medium' AS severity,
  'URL with suspicious TLD: ' || min(tld) AS title, 'URL: ' || substring(url, 1, 100) AS evidence
FROM {URLS} u JOIN (
  SELECT tld FROM (VALUES {built_in}) v(tld) UNION
  SELECT '.' || array_to_string(list_slice(p, k, len(p)), '.') FROM (
    SELECT p, unnest(range(1, len(p) + 1)) AS k FROM (SELECT string_split(host, '.') AS p FROM {PAGE_HOSTS}))) t
  ON regexp_matches(u.url, '(?i)' || replace(t.tld, '.', '\\.') || '(?:[:/\\s]|$)')
GROUP BY package_id, path, line_no, i, url"""


def pack_signature_rows() -> str:
    at = "strpos(lower(content), lower(substring(b.text, 1, 30)))"
    return f"""SELECT package_id, path, CAST(1 + {nl_count(f"substring(content, 1, {at} - 1)")} AS INTEGER) AS line, 'P5' AS rule_id,
  'low' AS severity, 'Malicious signature: Benchmark passage ' || item_id AS title,
  'Signature B-' || item_id || ' matched (SHA256: ' || substring(sha256(content), 1, 16) || '...)' AS evidence
FROM scanned s JOIN benchmark b ON length(b.text) >= 30 AND {at} > 0"""


def p10_rows() -> str:
    labels = dict(R.TACTIC_LABELS)
    arms = []
    for i, (p, tactic, sev) in enumerate(R.MANIPULATION_PATTERNS):
        arms.append(f"""SELECT package_id, path, line_no, {i} AS pidx, {q(tactic)} AS tactic, {q(sev)} AS severity,
  {q('Agent manipulation: ' + labels[tactic])} AS title,
  'Matched: ' || substring(regexp_extract(line, {q(p)}, 0), 1, 80) AS evidence
FROM lines WHERE regexp_matches(line, {q(p)})""")
    cand = "\nUNION ALL\n".join(arms)
    return f"""SELECT package_id, path, line_no AS line, 'P10' AS rule_id, severity, title, 1 AS eng, 6 AS phase,
  CAST(pidx AS BIGINT) AS k, evidence
FROM (SELECT *, row_number() OVER (PARTITION BY package_id, path, tactic ORDER BY line_no, pidx) AS rn
      FROM ({cand})) WHERE rn = 1"""


def text_subset_rows() -> str:
    """Union of the line rules both engines compute identically (no decoded
    payload text): P1, P4, P6, P8, P9 long lines, P10."""
    parts = [p1_rows(), p4_ip_rows(), p4_ddns_rows(), p6_rows(), p8_rows(), p9_long_rows(),
             "SELECT package_id, path, line, rule_id, severity, title, eng, phase, k FROM (" + p10_rows() + ")"]
    return "\nUNION ALL\n".join("SELECT package_id, path, line, rule_id, severity, title, eng, phase, k FROM (" + p + ")"
                                for p in parts)


def nl_count(expr: str) -> str:
    return f"(length({expr}) - length(replace({expr}, {NL}, '')))"


def b64_decode(tok: str) -> str:
    """Python-lenient base64 validity, then strict UTF-8 text (NULL otherwise)."""
    data = f"replace({tok}, '=', '')"
    n = f"length({data})"
    p = f"(length({tok}) - {n})"
    r = f"({n} % 4)"
    ok = f"({r} = 0 OR ({r} = 2 AND {p} >= 2) OR ({r} = 3 AND {p} >= 1))"
    padded = f"({data} || repeat('=', CAST((4 - {r}) % 4 AS INTEGER)))"
    return f"(CASE WHEN {ok} THEN TRY(decode(from_base64({padded}))) END)"


def p2_rows() -> str:
    sev = (f"CASE WHEN regexp_matches(dec, {q(R.B64_SHELL_WORDS)}) THEN 'critical' "
           f"WHEN regexp_matches(dec, {q(R.B64_URL)}) OR regexp_matches(dec, {q(R.B64_CODE_WORDS)}) THEN 'high' END")
    return f"""SELECT package_id, path, line_no AS line, 'P2' AS rule_id, severity,
  'Base64 encoded suspicious content' AS title, 'Decoded: ' || substring(dec, 1, 100) AS evidence
FROM (SELECT *, {sev} AS severity FROM (
  SELECT package_id, path, line_no, {b64_decode('tok')} AS dec FROM (
    SELECT package_id, path, line_no, unnest(toks) AS tok
    FROM (SELECT *, regexp_extract_all(line, {q(R.B64_TOKEN)}, 1) AS toks FROM lines) WHERE len(toks) > 0)))
WHERE severity IS NOT NULL"""


def p3_rows() -> str:
    hx = f"len(regexp_extract_all(line, {q(R.HEX_ESCAPE)}))"
    ux = f"len(regexp_extract_all(line, {q(R.UNICODE_ESCAPE)}))"
    return f"""SELECT package_id, path, line_no AS line, 'P3' AS rule_id, 'medium' AS severity,
  'Hex/Unicode escape obfuscation' AS title,
  'Line contains ' || CAST(hx + ux AS VARCHAR) || ' escape sequences, possible obfuscation' AS description
FROM (SELECT *, {hx} AS hx, {ux} AS ux FROM lines)
WHERE (hx >= {R.ESCAPE_MIN} OR ux >= {R.ESCAPE_MIN}) AND NOT regexp_matches(line, {q(R.REGEX_CONTEXT)})
  AND NOT regexp_matches(line, {q(R.MAGIC_BYTES)}) AND NOT regexp_matches(line, {q(R.CHAR_CLASS_RANGE)})"""


def entropy(tok: str) -> str:
    ch = f"string_split({tok}, '')"
    cnt = f"len(list_filter({ch}, lambda x: x = c))"
    return (f"(CASE WHEN length({tok}) < 2 THEN 0.0 ELSE -list_sum(list_transform(list_distinct({ch}), "
            f"lambda c: ({cnt} / len({ch})) * log2({cnt} / len({ch})))) END)")


def p7_rows() -> str:
    secrets = [p for _, p, _ in R.SECRET_PATTERNS]
    return f"""SELECT package_id, path, line_no AS line, 'P7' AS rule_id, 'medium' AS severity,
  printf('High-entropy string (entropy=%.1f)', e) AS title,
  printf('String length=%d, entropy=%.2f (threshold=4.5)', length(tok), e) AS evidence, k
FROM (SELECT *, {entropy('tok')} AS e FROM (
  SELECT package_id, path, line_no, unnest(toks) AS tok, unnest(range(0, len(toks))) AS k
  FROM (SELECT *, regexp_extract_all(line, {q(R.QUOTED_TOKEN)}, 1) AS toks FROM lines) WHERE len(toks) > 0))
WHERE NOT regexp_matches(tok, {q(R.UUID_PATTERN)}) AND NOT regexp_matches(tok, {q(R.PLACEHOLDER_PATTERN)})
  AND NOT {any_match('tok', secrets)} AND e > {R.ENTROPY_THRESHOLD} AND length(tok) > 20"""


def p5_rows() -> str:
    arms = []
    for j, (sid, name, pat, multi, sev, _tags, _refs) in enumerate(R.SIGNATURES):
        rx = ("(?is)" if multi else "(?i)") + pat
        arms.append(f"""SELECT package_id, path,
  CAST(1 + {nl_count(f"string_split_regex(content, {q(rx)})[1]")} AS INTEGER) AS line,
  'P5' AS rule_id, {q(sev)} AS severity, {q('Malicious signature: ' + name)} AS title,
  {q(f'Signature {sid} matched (SHA256: ')} || substring(sha256(content), 1, 16) || '...)' AS evidence, {j} AS k
FROM scanned WHERE regexp_matches(content, {q(rx)})""")
    return "\nUNION ALL\n".join(arms)


def p9_obf_rows() -> str:
    arms, n = [], 0
    for lang, pats in (("js", R.JS_OBFUSCATION_PATTERNS), ("py", R.PY_OBFUSCATION_PATTERNS)):
        cond = ("(ends_with(path, '.js') OR ends_with(path, '.mjs') OR ends_with(path, '.cjs'))"
                if lang == "js" else "ends_with(path, '.py')")
        for pat, desc in pats:
            pieces = f"string_split_regex(content, {q(pat)})"
            ms = f"regexp_extract_all(content, {q(pat)})"
            line = (f"1 + {nl_count(f'array_to_string(list_slice(pieces, 1, i), {chr(39)}{chr(39)})')}"
                    f" + {nl_count(f'array_to_string(list_slice(ms, 1, i - 1), {chr(39)}{chr(39)})')}")
            arms.append(f"""SELECT package_id, path, CAST({line} AS INTEGER) AS line, 'P9' AS rule_id, 'high' AS severity,
  {q('Code obfuscation: ' + desc)} AS title, {n} AS k
FROM (SELECT package_id, path, pieces, ms, unnest(range(1, len(ms) + 1)) AS i
      FROM (SELECT package_id, path, {pieces} AS pieces, {ms} AS ms FROM scanned
            WHERE {cond} AND regexp_matches(content, {q(pat)})))""")
            n += 1
    return "\nUNION ALL\n".join(arms)


def p6_skill_rows() -> str:
    pats = ["(?i)" + p for p in R.SKILL_INJECTION_PATTERNS]
    head = "content"
    matched = "(CASE " + " ".join(f"WHEN regexp_matches(head, {q(p)}) THEN regexp_extract(head, {q(p)}, 0)"
                                  for p in pats) + " END)"
    return f"""SELECT m.package_id, 'SKILL.md' AS path, min(l.line_no) AS line, 'P6' AS rule_id, 'critical' AS severity,
  'Prompt injection detected in skill description' AS title, 'Matched pattern: ' || m.matched AS evidence
FROM (SELECT package_id, {matched} AS matched FROM (SELECT package_id, {head} AS head FROM files WHERE path = 'SKILL.md')) m
LEFT JOIN (SELECT * FROM lines WHERE path = 'SKILL.md') l
  ON l.package_id = m.package_id AND contains(lower(l.line), lower(m.matched))
WHERE m.matched IS NOT NULL GROUP BY m.package_id, m.matched"""


# ---------------------------------------------------------------- manifest rules
def norm_dep(col: str) -> str:
    return f"regexp_replace(lower({col}), '[-_]', '', 'g')"


def m4_rows() -> str:
    top = "[" + ", ".join(q(t) for t in R.TOP_PACKAGES) + "]"
    return f"""SELECT d.package_id, d.file AS path, CAST(NULL AS INTEGER) AS line, 'M4' AS rule_id, 'critical' AS severity,
  'Possible typo-squatting: "' || d.dep || '" (similar to "' || min(t.top) || '")' AS title
FROM (
  SELECT package_id, 'package.json' AS file, unnest(json_keys(json_extract(content, '$.dependencies'))) AS dep
  FROM files WHERE path = 'package.json' AND json_valid(content)
  UNION ALL
  SELECT package_id, 'requirements.txt' AS file, dep FROM (
    SELECT package_id, trim(regexp_extract(l, '^([^>=<!\\[~; \\t]*)', 1)) AS dep FROM (
      SELECT package_id, {py_strip('x')} AS l FROM (
        SELECT package_id, unnest(string_split_regex(content, {q(LB)})) AS x FROM files
        WHERE path = 'requirements.txt'
          AND package_id IN (SELECT package_id FROM files WHERE path IN ('setup.py', 'pyproject.toml'))))
    WHERE l <> '' AND NOT starts_with(l, '#')) WHERE dep <> ''
) d
JOIN (SELECT unnest({top}) AS top) t ON levenshtein({norm_dep('d.dep')}, {norm_dep('t.top')}) = 1
WHERE {norm_dep('d.dep')} NOT IN (SELECT {norm_dep('x')} FROM (SELECT unnest({top}) AS x))
GROUP BY d.package_id, d.file, d.dep"""


def m5_hook_rows() -> str:
    arms = []
    for h in R.INSTALL_HOOKS:
        s = f"json_extract_string(content, '$.scripts.{h}')"
        arms.append(f"""SELECT package_id, 'package.json' AS path, CAST(NULL AS INTEGER) AS line, 'M5' AS rule_id,
  CASE WHEN regexp_matches({s}, {q(R.HOOK_ESCALATE)}) THEN 'critical' ELSE 'high' END AS severity,
  'Install-time script: {h}' AS title
FROM files WHERE path = 'package.json' AND json_valid(content) AND {s} IS NOT NULL""")
    return "\nUNION ALL\n".join(arms)


def m5_pip_rows() -> str:
    return """SELECT package_id, 'setup.py' AS path, CAST(NULL AS INTEGER) AS line, 'M5' AS rule_id, 'high' AS severity,
  'Custom install command in setup.py' AS title
FROM files WHERE path = 'setup.py' AND contains(content, 'cmdclass')
  AND (contains(content, 'install') OR contains(content, 'develop'))"""


def m2b_tool_rows() -> str:
    tools = ", ".join(q(t) for t in R.DANGEROUS_TOOLS)
    return f"""SELECT package_id, 'SKILL.md' AS path, CAST(NULL AS INTEGER) AS line, 'M2b' AS rule_id, 'high' AS severity,
  'Skill requests dangerous tool: ' || tool AS title, k
FROM (
  SELECT package_id, line_no * 2 AS k, lower(regexp_extract(s, '^[-*]\\s+`?(\\w[\\w_.-]*)`?', 1)) AS tool FROM st
  WHERE sec = 'T' AND kind IS NULL
  UNION ALL
  SELECT package_id, line_no * 2 + 1, lower(regexp_extract(s, '^#{{2,4}}\\s+`?(\\w[\\w_.-]*)`?', 1)) AS tool FROM st
  WHERE sec = 'T' AND kind IS NULL)
WHERE tool IN ({tools})"""


def skill_section_cte() -> str:
    return f"""st AS (
  SELECT *, last_value(kind IGNORE NULLS) OVER (PARTITION BY package_id ORDER BY line_no
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sec
  FROM (SELECT package_id, line_no, s,
          CASE WHEN regexp_matches(s, '(?i)^#{{1,3}}\\s+tools?\\b') THEN 'T'
               WHEN regexp_matches(s, '^#{{1,3}}\\s+') THEN 'H' END AS kind
        FROM (SELECT package_id, line_no, {py_strip('line')} AS s FROM lines WHERE path = 'SKILL.md')))"""


def mcp_cte() -> str:
    return """mcp AS (
  SELECT package_id, path AS manifest, content, json_valid(content) AS ok FROM files WHERE path = 'mcp.json'
  UNION ALL
  SELECT package_id, path, content, json_valid(content) FROM files
  WHERE path = 'manifest.json' AND package_id NOT IN (SELECT package_id FROM files WHERE path = 'mcp.json'))"""


def m6_rows() -> str:
    return """SELECT package_id, manifest AS path, CAST(NULL AS INTEGER) AS line, 'M6' AS rule_id, 'medium' AS severity,
  'Malformed manifest: ' || manifest AS title FROM mcp WHERE NOT ok"""


def m2b_perm_rows() -> str:
    return """SELECT package_id, manifest AS path, CAST(NULL AS INTEGER) AS line, 'M2b' AS rule_id, 'high' AS severity, title
FROM (
  SELECT package_id, manifest, key, v, json_type(v) AS t FROM (
    SELECT package_id, manifest, key, json_extract(content, '$.permissions."' || key || '"') AS v FROM (
      SELECT package_id, manifest, content, unnest(json_keys(json_extract(content, '$.permissions'))) AS key
      FROM mcp WHERE ok AND json_type(json_extract(content, '$.permissions')) = 'OBJECT'))),
LATERAL (
  SELECT 'Overly broad permission: ' || key AS title
  WHERE (t = 'BOOLEAN' AND CAST(v AS VARCHAR) = 'true') OR (t = 'VARCHAR' AND json_extract_string(v, '$') = '*')
  UNION ALL
  SELECT 'Broad filesystem permission: ' || key
  WHERE key IN ('filesystem', 'file', 'fs') AND t IN ('VARCHAR', 'ARRAY')
    AND (CASE WHEN t = 'VARCHAR' THEN json_extract_string(v, '$') ELSE CAST(v AS VARCHAR) END = '/'
         OR contains(CAST(v AS VARCHAR), '~') OR contains(CAST(v AS VARCHAR), '*')))"""


def glob_re2(g: str) -> str:
    from ..functions.text import path_glob_regex
    return path_glob_regex(g)


def m7_matches_cte() -> str:
    arms = []
    excl = ", ".join(q(d) for d in R.DEBUG_EXCLUDED_DIRS)
    for i, (g, desc, sev, advice) in enumerate(R.DEBUG_ARTIFACTS):
        arms.append(f"SELECT package_id, path, strlen(content) AS size, {i} AS pi, {q(g)} AS pat, {q(desc)} AS descr, "
                    f"{q(sev)} AS sev, {q(advice)} AS advice FROM files WHERE regexp_matches(path, {q(glob_re2(g))}) "
                    f"AND NOT list_has_any(string_split(path, '/'), [{excl}])")
    return "m7 AS (\n" + "\nUNION ALL\n".join(arms) + ")"


def human_size(col: str) -> str:
    return (f"CASE WHEN {col} > 1048576 THEN printf('%.1f MB', {col} / 1024 / 1024) "
            f"WHEN {col} > 1024 THEN printf('%.1f KB', {col} / 1024) ELSE CAST({col} AS VARCHAR) || ' bytes' END")


def m7_rows() -> str:
    return f"""SELECT package_id, path, CAST(NULL AS INTEGER) AS line, 'M7' AS rule_id, sev AS severity,
  'Publishable package contains ' || lower(descr) || ': ' || path AS title,
  'File: ' || path || ' (' || {human_size('size')} || ')' AS evidence, advice AS remediation, pi * 2 AS k FROM m7"""


def m7_rollup_rows() -> str:
    return f"""SELECT package_id, CAST(NULL AS VARCHAR) AS path, CAST(NULL AS INTEGER) AS line, 'M7' AS rule_id,
  sev AS severity, 'Multiple ' || lower(descr) || ' files found (' || CAST(n AS VARCHAR) || ' total)' AS title,
  'Total: ' || CAST(n AS VARCHAR) || ' files matching ' || pat AS evidence, advice AS remediation
FROM (SELECT package_id, pi, pat, descr, sev, advice, count(*) AS n FROM m7 GROUP BY ALL)
WHERE n > {R.DEBUG_PER_PATTERN}"""


def category_rows() -> str:
    ranks = " ".join(f"WHEN path = {q(n)} THEN {i}" for i, n in enumerate(R.DESCRIPTION_FILES))
    names = ", ".join(q(n) for n in R.DESCRIPTION_FILES)
    counts = []
    for i, (cat, kws) in enumerate(R.CATEGORY_KEYWORDS):
        n = " + ".join(f"CAST(contains(d, {q(k)}) AS INTEGER)" for k in kws)
        counts.append(f"SELECT package_id, {q(cat)} AS category, {i} AS ci, {n} AS n FROM descs")
    return f"""WITH descs AS (
  SELECT package_id, lower(string_agg(t, {NL} ORDER BY r)) AS d FROM (
    SELECT package_id, CASE {ranks} END AS r, content AS t
    FROM files WHERE path IN ({names})
    UNION ALL
    SELECT package_id, 10, json_extract_string(content, '$.description') FROM files
    WHERE path = 'package.json' AND json_valid(content)
      AND coalesce(json_extract_string(content, '$.description'), '') <> '')
  GROUP BY package_id),
counts AS ({' UNION ALL '.join(counts)})
SELECT package_id, category FROM (
  SELECT *, row_number() OVER (PARTITION BY package_id ORDER BY n DESC, ci) AS rn FROM counts WHERE n > 0)
WHERE rn = 1"""


def platform_rows() -> str:
    return """SELECT package_id,
  CASE WHEN bool_or(path = 'SKILL.md') THEN 'clawhub' WHEN bool_or(path IN ('mcp.json', 'manifest.json')) THEN 'mcp'
       WHEN bool_or(path = 'package.json') THEN 'npm'
       WHEN bool_or(path IN ('setup.py', 'pyproject.toml', 'requirements.txt')) THEN 'pip' END AS platform
FROM files GROUP BY package_id"""


# ---------------------------------------------------------------- suppression and scoring
def ignore_cte() -> str:
    return f"""sup AS (
  SELECT package_id, p[1] AS rule_id, CASE WHEN len(p) > 1 THEN p[2] ELSE '*' END AS gpat,
         CASE WHEN len(p) > 2 THEN TRY_CAST(trim(p[3]) AS INTEGER) END AS line, len(p) AS np
  FROM (SELECT package_id, string_split(e, ':') AS p FROM (
    SELECT package_id, {py_strip('x')} AS e FROM (
      SELECT package_id, unnest(string_split_regex(content, {q(LB)})) AS x FROM files WHERE path = {q(R.IGNORE_FILE)}))
    WHERE e <> '' AND NOT starts_with(e, '#'))),
sup_ok AS (
  SELECT package_id, rule_id, gpat, line,
         '^(?s:' || array_to_string(list_transform(string_split(gpat, ''), lambda c:
            CASE WHEN c = '*' THEN '.*' WHEN c = '?' THEN '.' ELSE '\\Q' || c || '\\E' END), '') || ')$' AS rx
  FROM sup WHERE np <= 2 OR line IS NOT NULL),
tf AS ({text_subset_rows()}),
tfs AS (
  SELECT tf.*, EXISTS (SELECT 1 FROM sup_ok s WHERE s.package_id = tf.package_id AND s.rule_id = tf.rule_id
      AND (s.gpat = '*' OR (tf.path IS NOT NULL AND tf.path <> '' AND regexp_matches(tf.path, s.rx)))
      AND (s.line IS NULL OR tf.line = s.line)) AS suppressed
  FROM tf),
act AS (SELECT * FROM tfs WHERE NOT suppressed)"""


def score_of(col: str) -> str:
    return (f"CASE {col} WHEN 'critical' THEN 25 WHEN 'high' THEN 15 WHEN 'medium' THEN 5 "
            f"WHEN 'low' THEN 1 ELSE 0 END")


def rank_of(col: str) -> str:
    return (f"CASE {col} WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 "
            f"WHEN 'low' THEN 4 ELSE 5 END")


def key_risks_rows() -> str:
    return f"""SELECT p.package_id, coalesce(k.key_risks, CAST([] AS VARCHAR[])) AS key_risks FROM
  (SELECT DISTINCT package_id FROM files) p LEFT JOIN (
  SELECT package_id, list(txt ORDER BY neg, eng, path NULLS FIRST, phase, line NULLS FIRST, k, txt) AS key_risks FROM (
    SELECT *, row_number() OVER (PARTITION BY package_id ORDER BY neg, eng, path NULLS FIRST, phase, line NULLS FIRST, k, txt) AS rn FROM (
      SELECT *, row_number() OVER (PARTITION BY package_id, rule_id ORDER BY neg, eng, path NULLS FIRST, phase, line NULLS FIRST, k, txt) AS rr
      FROM (SELECT *, -({score_of('severity')}) AS neg,
                   upper(severity) || ': ' || title || ' (' || rule_id || ')' AS txt
            FROM act WHERE severity <> 'info'))
    WHERE rr = 1) WHERE rn <= 5 GROUP BY package_id) k ON p.package_id = k.package_id"""


def behavior_tags_rows() -> str:
    arms = " ".join(f"WHEN {q(r)} THEN {q(t)}" for r, t in R.BEHAVIOR_TAGS)
    return f"""SELECT p.package_id, coalesce(t.tags, CAST([] AS VARCHAR[])) AS behavior_tags FROM
  (SELECT DISTINCT package_id FROM files) p LEFT JOIN (
  SELECT package_id, list(DISTINCT tag ORDER BY tag) AS tags FROM (
    SELECT package_id, CASE regexp_extract(rule_id, '^([^/]+)', 1) {arms} END AS tag FROM act)
  WHERE tag IS NOT NULL GROUP BY package_id) t ON p.package_id = t.package_id"""


# ---------------------------------------------------------------- the whole scan
# tags of each rule's findings that name a capability (by rule; P5 by signature)
RULE_TAGS = {
    "P1": ["credential", "hardcoded_secret"], "P2": ["obfuscation", "encoded_payload"], "P3": ["obfuscation"],
    "P4": ["network"], "P6": ["prompt_injection"], "P7": ["entropy", "possible_secret"], "P8": ["ioc", "network"],
    "P9": ["obfuscation"], "P10": ["manipulation", "social_engineering"],
    "S1": ["execution", "shell"], "S2": ["file_read", "credential_access"], "S4": ["network"], "S5": ["env_var"],
    "S6": ["execution", "dynamic"], "S7": ["execution", "import"], "S8": ["exfiltration", "network", "credential_access"],
    "S9": ["network", "ssrf"], "S10": ["execution", "network", "supply_chain"], "S12": ["deserialization", "execution"],
    "S13": ["persistence"], "S14": ["system_modification"]}


def _ranked(rows: str, eng: int, phase: str, k: str = "0") -> str:
    return (f"SELECT package_id, path, line, rule_id, severity, title, {eng} AS eng, {phase} AS phase, "
            f"CAST({k} AS BIGINT) AS k FROM ({rows})")


def behavior_rows() -> str:
    """Findings of the code and text engines."""
    from .code_expectations import s_rows
    phase = "CASE rule_id WHEN 'S8' THEN 1 WHEN 'S10' THEN 2 WHEN 'S13' THEN 3 WHEN 'S14' THEN 3 ELSE 0 END"
    parts = [text_subset_rows(), _ranked(p2_rows(), 1, "0", "1000"), _ranked(p3_rows(), 1, "0", "2000"),
             _ranked(p5_rows(), 1, "1", "k"), _ranked(p7_rows(), 1, "2", "k"), _ranked(p9_obf_rows(), 1, "4", "k"),
             _ranked(s_rows(), 0, phase)]
    return "\nUNION ALL\n".join(parts)


def metadata_rows() -> str:
    """Findings of the manifest engine."""
    from .code_expectations import s11_rows
    hook = " ".join(f"WHEN {q('Install-time script: ' + h)} THEN {i}" for i, h in enumerate(R.INSTALL_HOOKS))
    return "\nUNION ALL\n".join([
        _ranked(m5_hook_rows(), 2, "1", f"CASE title {hook} END"), _ranked(m4_rows(), 2, "4"),
        _ranked(m5_pip_rows(), 2, "2"), _ranked(m2b_tool_rows(), 2, "0", "k"), _ranked(m6_rows(), 2, "3"),
        _ranked(m2b_perm_rows(), 2, "3", "CASE WHEN starts_with(title, 'Broad') THEN 1 ELSE 2 END"),
        _ranked(m1_rows(), 2, "5"), _ranked(m2a_rows(), 2, "6"), _ranked(m7_rows(), 2, "7", "k"),
        _ranked(s11_rows(), 2, "1"), _ranked(p6_skill_rows(), 2, "0")])


def scan_ctes() -> str:
    """Every engine's findings (tf), with suppressions (tfs), the active ones
    (act), and the capabilities behind M1 and M2a."""
    tc = dict(R.TAG_CAPABILITY)
    rc = " ".join(f"WHEN {q(r)} THEN {q(c)}" for r, c in R.RULE_CAPABILITY)
    tags = [(f"rule_id = {q(r)}", t) for r, ts in RULE_TAGS.items() for t in ts]
    tags += [("rule_id = 'S3' AND severity = 'critical'", t) for t in ("file_write", "system_modification")]
    tags += [("rule_id = 'S5' AND severity = 'medium'", "credential_access")]
    tags += [(f"rule_id = 'P5' AND title = {q('Malicious signature: ' + name)}", t)
             for _, name, _, _, _, ts, _ in R.SIGNATURES for t in ts]
    by_tag = " ".join(f"UNION ALL SELECT package_id, {q(tc[t])} FROM bf WHERE {cond}" for cond, t in tags if t in tc)
    base = ignore_cte()
    sup = base[:base.index("tf AS (")]
    rest = base[base.index("tfs AS ("):]
    return f"""{sup}{skill_section_cte()},
{mcp_cte()},
{decl_cte()},
{m7_matches_cte()},
bf AS ({behavior_rows()}),
caps AS (
  SELECT DISTINCT package_id, cap FROM (
    SELECT package_id, CASE rule_id {rc} END AS cap FROM bf {by_tag}) WHERE cap IS NOT NULL),
tf AS (SELECT * FROM bf UNION ALL {metadata_rows()}),
{rest}"""


# ---------------------------------------------------------------- fleet (residue)
def fleet_ctes() -> str:
    from ..sources import fleet as FL
    kw = case_pick(f"c_custkey % {len(R.AGENT_KEYWORDS)}", R.AGENT_KEYWORDS)
    rd = case_pick(f"c_custkey % {len(R.KNOWN_RESIDUE_DIRS)}", R.KNOWN_RESIDUE_DIRS)
    os_ = case_pick("c_nationkey % 3", FL.OS_BY_NATION)

    def hf(cond, parent, name, is_dir="false", size="0", mode="33188", is_exec="false", head="''"):
        return (f"SELECT host_id, os, {parent} || '/' || {name} AS path, {name} AS name, {parent} AS parent, "
                f"{is_dir} AS is_dir, CAST({size} AS BIGINT) AS size, CAST({mode} AS INTEGER) AS mode, "
                f"{is_exec} AS is_exec, {head} AS head FROM hosts WHERE {cond}")
    hs = "CAST(host_id AS VARCHAR)"
    files = [
        hf("host_id % 4 = 0", "'~/Library/LaunchAgents'", "'com.' || kw || '.helper.plist'"),
        hf("host_id % 4 = 1", "'~/Library/LaunchAgents'", f"'com.apple.update' || {hs} || '.plist'"),
        hf("host_id % 5 = 0", "'/etc/systemd/system'", "kw || '-sync.service'"),
        hf("host_id % 11 = 0", "'/etc/sudoers.d'", "kw || '-nopasswd'"),
        hf("host_id % 6 = 0", f"'~/Projects/p' || {hs} || '/.git/hooks'", "'post-commit'", is_exec="true",
           head=f"'#!/bin/sh' || {NL} || kw || ' sync' || {NL}"),
        hf("host_id % 6 = 1", f"'~/Projects/p' || {hs} || '/.git/hooks'", "'pre-commit.sample'", is_exec="true",
           head=f"'#!/bin/sh' || {NL} || '# agent sample' || {NL}"),
        hf("host_id % 3 = 0", "'~/.config'", "rd", is_dir="true"),
        hf("host_id % 7 = 0", "'~/.claude'", "'credentials.json'",
           mode="CASE WHEN host_id % 14 = 0 THEN 33188 ELSE 33152 END"),
    ]
    cache = ("SELECT host_id, os, '~/.config/' || rd || '/o' || CAST(o_orderkey AS VARCHAR) || '.bin' AS path, "
             "'o' || CAST(o_orderkey AS VARCHAR) || '.bin' AS name, '~/.config/' || rd AS parent, false AS is_dir, "
             "CAST(o_totalprice * 1000 AS BIGINT) AS size, 33188 AS mode, false AS is_exec, '' AS head "
             "FROM orders JOIN hosts ON o_custkey = host_id WHERE host_id % 3 = 0")
    ok = "o_orderkey"

    def fmt(t):
        return f"replace(replace(replace({t}, '{{kw}}', kw), '{{o}}', CAST({ok} AS VARCHAR)), '{{m}}', CAST({ok} % 250 AS VARCHAR))"
    cron = fmt(case_pick(f"{ok} % {len(FL.CRON_LINES)}", FL.CRON_LINES))
    shp = case_pick(f"{ok} % 3", FL.SHELL_FILES)
    shl = fmt(case_pick(f"CAST(floor({ok} / 3) AS BIGINT) % {len(FL.SHELL_LINES)}", FL.SHELL_LINES))
    hol = fmt(case_pick(f"{ok} % {len(FL.HOSTS_LINES)}", FL.HOSTS_LINES))
    pkn = fmt(case_pick(f"{ok} % {len(FL.PKG_NAMES)}", FL.PKG_NAMES))
    return f"""hosts AS (
  SELECT c_custkey AS host_id, {os_} AS os, {kw} AS kw, {rd} AS rd FROM customer),
host_files AS ({' UNION ALL '.join(files + [cache])}),
hl AS (
  SELECT host_id, o_orderkey, 'crontab' AS path, {cron} AS line FROM orders JOIN hosts ON o_custkey = host_id
  UNION ALL SELECT host_id, o_orderkey, {shp}, {shl} FROM orders JOIN hosts ON o_custkey = host_id
  UNION ALL SELECT host_id, o_orderkey, '/etc/hosts', {hol} FROM orders JOIN hosts ON o_custkey = host_id),
host_lines AS (
  SELECT host_id, path, CAST(row_number() OVER (PARTITION BY host_id, path ORDER BY o_orderkey) AS INTEGER) AS line_no,
         line FROM hl),
host_packages AS (
  SELECT host_id, 'pip' AS manager, {pkn} AS name, '1.' || CAST({ok} % 10 AS VARCHAR) AS version
  FROM orders JOIN hosts ON o_custkey = host_id)"""


def has_kw(col: str) -> str:
    return "(" + " OR ".join(f"contains({col}, {q(k)})" for k in R.AGENT_KEYWORDS) + ")"


def residue_rows(content: bool = False) -> str:
    """Expected residue findings; with ``content`` also the line R1 and R5 quote."""
    more = (lambda x: f", {x}") if content else (lambda x: "")
    stem = "regexp_replace(name, '\\.[^.]*$', '')"
    la = ", ".join(q(d) for d in R.LAUNCH_AGENT_DIRS)
    sd = ", ".join(q(d) for d in R.SYSTEMD_DIRS)
    sc_paths = ", ".join(q(p) for p, _ in R.SHELL_CONFIGS)
    sc_sev = " ".join(f"WHEN {q(p)} THEN {q(s)}" for p, s in R.SHELL_CONFIGS)
    r5 = " UNION ALL ".join(
        f"SELECT host_id, path, line_no, {q('Shell config modification: ' + d)} AS title, CASE path {sc_sev} END AS sev, "
        f"substring({py_strip('line')}, 1, 120) AS content "
        f"FROM host_lines WHERE path IN ({sc_paths}) AND regexp_matches(line, {q(p)})"
        for p, d in R.SHELL_CONFIG_PATTERNS)
    roots = "|".join(r.replace(".", "\\.") for r in R.GIT_HOOK_ROOTS)
    hook_rx = f"^(?:{roots})(?:/[^/]+){{0,3}}/\\.git/hooks$"
    rroots = ", ".join(q(r) for r in R.RESIDUE_ROOTS)
    rdirs = ", ".join(q(d) for d in R.KNOWN_RESIDUE_DIRS)
    root_rx = "^(" + "|".join(r.replace(".", "\\.") for r in R.RESIDUE_ROOTS) + ")/([^/]+)/"
    creds = ", ".join(q(c) for c in R.CREDENTIAL_FILES)
    std = ", ".join(q(s) for s in R.STANDARD_HOSTS)
    strip = py_strip("line")
    return f"""
SELECT CAST(host_id AS VARCHAR) AS package_id, 'R1' AS rule_id,
  CASE WHEN {has_kw('lower(s)')} THEN 'high' ELSE 'medium' END AS severity,
  CASE WHEN {has_kw('lower(s)')} THEN 'Suspicious crontab entry' ELSE 'Crontab entry runs from temporary directory' END AS title,
  CAST(NULL AS VARCHAR) AS path, CAST(NULL AS INTEGER) AS line{more('substring(s, 1, 120) AS content')}
FROM (SELECT host_id, {strip} AS s FROM host_lines WHERE path = 'crontab')
WHERE s <> '' AND NOT starts_with(s, '#') AND ({has_kw('lower(s)')} OR regexp_matches(s, {q(R.CRON_TMP)}))
UNION ALL
SELECT CAST(host_id AS VARCHAR), 'R2', 'high', 'Suspicious LaunchAgent: ' || name, path, NULL{more('NULL')} FROM host_files
WHERE os = 'macos' AND parent IN ({la}) AND ends_with(name, '.plist') AND {has_kw(f'lower({stem})')}
UNION ALL
SELECT CAST(host_id AS VARCHAR), 'R3', 'high', 'Suspicious systemd service: ' || name, path, NULL{more('NULL')} FROM host_files
WHERE os = 'linux' AND parent IN ({sd}) AND ends_with(name, '.service') AND {has_kw(f'lower({stem})')}
UNION ALL
SELECT CAST(host_id AS VARCHAR), 'R4', 'critical', 'Suspicious sudoers modification: ' || name, path, NULL{more('NULL')}
FROM host_files WHERE os = 'macos' AND parent = '/etc/sudoers.d' AND NOT is_dir AND {has_kw('lower(name)')}
UNION ALL
SELECT CAST(host_id AS VARCHAR), 'R5', sev, title, path, line_no{more('content')} FROM ({r5})
UNION ALL
SELECT DISTINCT CAST(host_id AS VARCHAR), 'R6', 'medium', 'Agent-related git hook: ' || name, path, NULL{more('NULL')} FROM host_files
WHERE regexp_matches(parent, {q(hook_rx)}) AND NOT is_dir AND is_exec AND NOT ends_with(name, '.sample')
  AND {has_kw("lower(coalesce(head, ''))")}
UNION ALL
SELECT CAST(d.host_id AS VARCHAR), 'R7', 'low',
  'Residual directory: ' || d.name || ' (' || printf('%.1f', coalesce(s.b, 0) / 1048576) || ' MB)', d.path, NULL{more('NULL')}
FROM (SELECT * FROM host_files WHERE is_dir AND parent IN ({rroots}) AND lower(name) IN ({rdirs})) d
LEFT JOIN (SELECT host_id, regexp_extract(path, {q(root_rx)}, 1) || '/' || regexp_extract(path, {q(root_rx)}, 2) AS p,
                  sum(size) AS b FROM host_files WHERE NOT is_dir AND regexp_matches(path, {q(root_rx)}) GROUP BY ALL) s
  ON d.host_id = s.host_id AND d.path = s.p
UNION ALL
SELECT CAST(host_id AS VARCHAR), 'R8', CASE WHEN mode & 4 <> 0 THEN 'high' ELSE 'medium' END,
  'Residual credentials: ' || name || ' (perms: ' || right(format('{{:o}}', mode), 3) || ')', path, NULL{more('NULL')}
FROM host_files WHERE path IN ({creds})
UNION ALL
SELECT CAST(host_id AS VARCHAR), 'R9', 'medium', 'Non-standard /etc/hosts entry: ' || hn, '/etc/hosts', line_no{more('NULL')} FROM (
  SELECT host_id, line_no, lower(string_split_regex(s, '\\s+')[2]) AS hn
  FROM (SELECT host_id, line_no, {strip} AS s FROM host_lines WHERE path = '/etc/hosts')
  WHERE s <> '' AND NOT starts_with(s, '#'))
WHERE hn IS NOT NULL AND hn NOT IN ({std}) AND {has_kw('hn')}
UNION ALL
SELECT CAST(host_id AS VARCHAR), 'R10', 'low', 'Residual pip package: ' || name || '==' || coalesce(version, '?'),
  NULL, NULL{more('NULL')} FROM host_packages WHERE manager = 'pip' AND {has_kw('lower(name)')}"""


# ---------------------------------------------------------------- capabilities
def m1_rows() -> str:
    rows_ = []
    for cat, allowed, sus in R.CAPABILITY_BASELINES:
        for s in sus:
            rows_.append(f"SELECT {q(cat)} AS category, {q(s)} AS cap")
    cat_sql = category_rows().replace("WITH descs", "(WITH descs", 1) + ")"
    return f"""SELECT c.package_id, CAST(NULL AS VARCHAR) AS path, CAST(NULL AS INTEGER) AS line, 'M1' AS rule_id,
  'high' AS severity, 'Unexpected capability for ' || g.category || ' skill: ' || c.cap AS title
FROM caps c JOIN {cat_sql} g ON c.package_id = g.package_id
JOIN ({' UNION ALL '.join(rows_)}) d ON d.category = g.category AND d.cap = c.cap"""


def m2a_rows() -> str:
    return """SELECT c.package_id, m.manifest AS path, CAST(NULL AS INTEGER) AS line, 'M2a' AS rule_id, 'high' AS severity,
  'Undeclared capability: ' || c.cap AS title
FROM caps c JOIN (SELECT DISTINCT package_id, manifest FROM decl) m ON c.package_id = m.package_id
WHERE NOT EXISTS (SELECT 1 FROM decl d WHERE d.package_id = c.package_id AND d.cap = c.cap)"""


def decl_cte() -> str:
    return """decl AS (
  SELECT * FROM (
    SELECT package_id, manifest, CASE WHEN json_type(t) = 'VARCHAR' THEN json_extract_string(t, '$')
                                      ELSE json_extract_string(t, '$.name') END AS cap
    FROM (SELECT package_id, manifest, unnest(json_extract(content, '$.tools[*]')) AS t FROM mcp
          WHERE ok AND json_type(json_extract(content, '$.tools')) = 'ARRAY')
    UNION ALL
    SELECT package_id, manifest, json_extract_string(r, '$.name')
    FROM (SELECT package_id, manifest, unnest(json_extract(content, '$.resources[*]')) AS r FROM mcp
          WHERE ok AND json_type(json_extract(content, '$.resources')) = 'ARRAY'))
  WHERE cap IS NOT NULL AND cap <> '')"""


# ---------------------------------------------------------------- taint over event-derived facts
def event_defs_cte() -> str:
    return """ev AS (
  SELECT 'src' || CAST(user_id % 20 AS VARCHAR) AS package_id, 'u' || CAST(user_id AS VARCHAR) || '.py' AS path,
         event_id AS def_key, 'v' || CAST(event_id % 5 AS VARCHAR) AS name,
         'v' || CAST((event_id * 3 + 1) % 5 AS VARCHAR) AS ref, event_type AS t FROM events),
refs AS (
  SELECT package_id, path, ref AS name, def_key AS use_key FROM ev WHERE t IN ('error', 'purchase', 'signup')
  UNION
  SELECT DISTINCT package_id, path, 'v' || CAST(i AS VARCHAR), 4611686018427387904 FROM ev, range(5) r(i)),
reach AS (
  SELECT r.package_id, r.path, r.name, r.use_key, d.def_key AS reach FROM refs r
  ASOF LEFT JOIN ev d ON r.package_id = d.package_id AND r.path = d.path AND r.name = d.name
    AND r.use_key > d.def_key)"""


def event_levels_sql() -> str:
    return f"""WITH RECURSIVE {event_defs_cte()},
dd AS (
  SELECT e.*, r.reach FROM ev e LEFT JOIN reach r
    ON e.package_id = r.package_id AND e.path = r.path AND e.ref = r.name AND e.def_key = r.use_key
    AND e.t IN ('error', 'purchase', 'signup')),
res(package_id, path, def_key, level, src_type, src_desc) AS (
  SELECT package_id, path, def_key,
    CASE t WHEN 'view' THEN 'literal' WHEN 'click' THEN 'external' WHEN 'purchase' THEN 'internal' ELSE 'unknown' END,
    CASE WHEN t = 'click' THEN 'env_var' END, CASE WHEN t = 'click' THEN 'os.getenv()' END
  FROM dd WHERE t IN ('view', 'click') OR reach IS NULL
  UNION ALL
  SELECT d.package_id, d.path, d.def_key,
    CASE WHEN r.level = 'external' THEN 'external'
         WHEN d.t = 'error' THEN r.level
         WHEN d.t = 'purchase' THEN CASE WHEN r.level = 'literal' THEN 'literal' ELSE 'internal' END
         ELSE 'unknown' END,
    CASE WHEN r.level = 'external' THEN r.src_type END, CASE WHEN r.level = 'external' THEN r.src_desc END
  FROM dd d JOIN res r ON d.package_id = r.package_id AND d.path = r.path AND d.reach = r.def_key
  WHERE d.t IN ('error', 'purchase', 'signup'))
SELECT package_id, path, def_key, level, src_type, src_desc FROM res"""
