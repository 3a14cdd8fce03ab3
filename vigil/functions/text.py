"""Scalar column functions (all JVM-side built-ins, no Python UDFs)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters Python's str.strip() removes (str.isspace), as a regex class
PY_WS = (r"[\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
         r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")


def lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def pick(values, idx0: Column) -> Column:
    """values[idx0] for a 0-based index column (null when idx0 is null)."""
    return F.element_at(lit_array(values), (idx0 + 1).cast("int"))


def first_match(col: Column, patterns) -> Column:
    """0-based index of the first pattern that matches ``col`` (or null).

    A lazily evaluated CASE chain: later patterns are not tried once one
    matched, like a ``break`` in a loop.
    """
    expr = None
    for i, p in enumerate(patterns):
        expr = F.when(col.rlike(p), F.lit(i)) if expr is None else expr.when(col.rlike(p), F.lit(i))
    return expr


def scoped(pattern: str) -> str:
    """Wrap a pattern so a leading inline flag only applies to itself."""
    if pattern.startswith("(?i)"):
        return "(?i:" + pattern[4:] + ")"
    return "(?:" + pattern + ")"


def any_match(col: Column, patterns) -> Column:
    """True when any pattern matches (each keeps its own flags)."""
    return col.rlike("|".join(scoped(p) for p in patterns))


# the same characters as a list, for trim functions (linear, no regex)
PY_SPACES = "".join(chr(c) for c in (*range(9, 14), *range(0x1c, 0x21), 0x85, 0xa0, 0x1680, *range(0x2000, 0x200b),
                                     0x2028, 0x2029, 0x202f, 0x205f, 0x3000))


def py_strip(col: Column) -> Column:
    """Python ``str.strip()``: drop leading / trailing Unicode whitespace."""
    return F.btrim(col, F.lit(PY_SPACES))


def snippet(line: Column, n: int = 120) -> Column:
    return F.substring(py_strip(line), 1, n)


def newline_count(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))


def py_fixed(x: Column, digits: int) -> Column:
    """Python ``f"{x:.{digits}f}"``: ties go to the even digit (Java's
    formatter rounds them up)."""
    return F.format_string(f"%.{digits}f", F.bround(x, digits))


def shannon_entropy(s: Column) -> Column:
    """Shannon entropy in bits per character; strings shorter than 2 give 0."""
    n = F.length(s).cast("double")

    def term(acc, c):
        p = (n - F.length(F.replace(s, c, F.lit("")))) / n
        return acc - p * F.log(2.0, p)

    return F.when(F.length(s) < 2, F.lit(0.0)).otherwise(
        F.aggregate(F.array_distinct(F.split(s, "")), F.lit(0.0), term))


def b64_decode_lenient(token: Column) -> Column:
    """Decode like Python's ``base64.b64decode`` (non-validating) then
    ``bytes.decode('utf-8', errors='replace')``.  Null when Python raises.

    With n data characters and p trailing '=': n % 4 == 0 always decodes,
    n % 4 == 1 never, n % 4 == 2 needs p >= 2, n % 4 == 3 needs p >= 1.
    """
    data = F.regexp_replace(token, "=", "")
    n = F.length(data)
    p = F.length(token) - n
    r = n % 4
    ok = (r == 0) | ((r == 2) & (p >= 2)) | ((r == 3) & (p >= 1))
    padded = F.concat(data, F.repeat(F.lit("="), ((4 - r) % 4).cast("int")))
    binary = F.when(ok, F.try_to_binary(padded, F.lit("base64")))
    return F.make_valid_utf8(binary.cast("string"))


def human_size(size: Column) -> Column:
    mb = F.lit(1024 * 1024)
    return (F.when(size > mb, F.format_string("%.1f MB", F.bround(size / 1024 / 1024, 1)))
            .when(size > 1024, F.format_string("%.1f KB", F.bround(size / 1024, 1)))
            .otherwise(F.concat(size.cast("string"), F.lit(" bytes"))))


def step_up(severity: Column) -> Column:
    return (F.when(severity == "low", "medium").when(severity == "medium", "high")
            .when(severity == "high", "critical").when(severity == "critical", "critical")
            .when(severity == "info", "low"))


def severity_rank(severity: Column) -> Column:
    return (F.when(severity == "critical", 1).when(severity == "high", 2)
            .when(severity == "medium", 3).when(severity == "low", 4).otherwise(5))


def severity_score(severity: Column) -> Column:
    return (F.when(severity == "critical", 25).when(severity == "high", 15)
            .when(severity == "medium", 5).when(severity == "low", 1).otherwise(0))


def path_glob_regex(glob: str) -> str:
    """pathlib-style glob relative to a root: ``**/`` = any directories
    (including none), ``*`` stays inside one path segment, and ``dir/**``
    matches files below ``dir``."""
    parts = glob.split("/")
    rx = []
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part == "**":
            rx.append(".+" if last else "(?:[^/]+/)*")
            continue
        seg = "".join("[^/]*" if ch == "*" else "[^/]" if ch == "?" else re.escape(ch) for ch in part)
        rx.append(seg if last else seg + "/")
    return "^" + "".join(rx) + "$"


# ---------------------------------------------------------------- literal prefilter
def required_atoms(pattern: str) -> tuple[list[str], bool] | None:
    """Literal strings such that every match of ``pattern`` contains at
    least one of them (the idea of RE2's FilteredRE2), and whether they must
    be compared case-insensitively.  ``None`` when no such set exists.

    Derived from Python's own regex parser: a literal run is an atom set of
    one; a sequence may use the set of any one of its parts (the longest
    shortest atom wins); an alternation needs a set from every branch and
    unions them; a repeat keeps its body's set only when it must occur."""
    try:
        import re._parser as sre
        from re._constants import (ASSERT, ASSERT_NOT, AT, BRANCH, IN, LITERAL, MAX_REPEAT, MIN_REPEAT,
                                   SUBPATTERN)
    except ImportError:  # pragma: no cover
        return None
    try:
        parsed = sre.parse(pattern)
    except Exception:
        return None
    icase = bool(parsed.state.flags & re.IGNORECASE) or "(?i" in pattern

    def best(sets):
        sets = [s for s in sets if s]
        if not sets:
            return None
        return max(sets, key=lambda s: (min(len(a) for a in s), -len(s)))

    folded = [False]

    def case_pair(op, av):
        """[hH]-style class: one letter in both cases -> that letter."""
        if op == IN and len(av) == 2 and all(o == LITERAL for o, _ in av):
            a, b = chr(av[0][1]), chr(av[1][1])
            if a != b and a.lower() == b.lower():
                return a.lower()
        return None

    def seq(items):
        cands, run = [], []
        for op, av in items:
            if op == LITERAL:
                run.append(chr(av))
                continue
            ch = case_pair(op, av)
            if ch is not None:
                folded[0] = True
                run.append(ch)
                continue
            if run:
                cands.append(["".join(run)])
                run = []
            if op in (AT, ASSERT, ASSERT_NOT):
                continue
            cands.append(node(op, av))
        if run:
            cands.append(["".join(run)])
        return best(cands)

    def node(op, av):
        if op == SUBPATTERN:
            return seq(av[-1])
        if op == BRANCH:
            out = []
            for alt in av[1]:
                s = seq(alt)
                if not s:
                    return None
                out += s
            return sorted(set(out))
        if op in (MAX_REPEAT, MIN_REPEAT):
            lo, _hi, body = av
            return seq(body) if lo >= 1 else None
        if op == IN and not icase:
            return None
        return None

    atoms = seq(list(parsed))
    if not atoms:
        return None
    icase = icase or folded[0]
    if icase:
        atoms = sorted({a.lower() for a in atoms})
    return atoms, icase


def gate(line: Column, lower_line: Column, pattern: str) -> Column | None:
    """Cheap necessary condition for ``line rlike pattern`` (or None)."""
    r = required_atoms(pattern)
    if r is None:
        return None
    atoms, icase = r
    src = lower_line if icase else line
    c = None
    for a in atoms:
        x = src.contains(a)
        c = x if c is None else (c | x)
    return c


def explode_hits(df, keep, arr: Column, alias: str):
    """Explode an array of hits, dropping rows without any.

    ``explode_outer`` + a null filter *after* the generator: with a plain
    ``explode`` Spark infers ``size(arr) > 0`` and pushes it below the
    projection that builds ``arr``, evaluating every rule twice."""
    return df.select(*keep, F.explode_outer(arr).alias(alias)).where(F.col(alias).isNotNull())
