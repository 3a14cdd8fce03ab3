"""SRC4: user rule packs (YAML files or DataFrames) for the data-driven rules.

A pack file has these sections: ``signatures`` (id, name, pattern,
multiline, severity, tags, references), ``dynamic_dns`` (globs),
``suspicious_tlds`` and ``c2_patterns`` (pattern, severity, description).  A
section that is given takes the place of the shipped list of that name; the
patterns and TLDs that are part of a rule itself stay.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..rules import packs as R

SIGNATURE_SCHEMA = ("id string, name string, pattern string, multiline boolean, severity string, "
                    "tags array<string>, refs array<string>")


@dataclass(frozen=True)
class RulePack:
    """Sections of a pack; None: the shipped one.  Each is an iterable or a
    DataFrame: ``signatures`` (SIGNATURE_SCHEMA; a DataFrame is taken by id),
    ``dynamic_dns`` (glob), ``suspicious_tlds`` (tld), ``c2_patterns``
    (pattern, severity, description; a DataFrame is taken by pattern)."""
    signatures: object = None
    dynamic_dns: object = None
    suspicious_tlds: object = None
    c2_patterns: object = None


def load_rule_pack(path: str) -> dict:
    """Parse one YAML pack (driver side; packs are a few KB)."""
    import yaml
    with open(path, encoding="utf-8") as fh:
        return yaml.safe_load(fh) or {}


def signature_rows(pack: dict) -> list[tuple]:
    return [(s.get("id", "unknown"), s.get("name", "Unknown signature"), s.get("pattern", ""),
             bool(s.get("multiline", False)), s.get("severity", "high"), list(s.get("tags", []) or []),
             list(s.get("references", []) or [])) for s in pack.get("signatures") or [] if s.get("pattern")]


def rule_pack(*paths: str) -> RulePack:
    """The sections of one or more YAML files; of one that several files have,
    the entries follow each other."""
    got: dict[str, list] = {}
    for path in paths:
        for section, entries in load_rule_pack(path).items():
            if section in ("signatures", "dynamic_dns", "suspicious_tlds", "c2_patterns"):
                got.setdefault(section, []).extend(entries or [])
    if "signatures" in got:
        got["signatures"] = signature_rows(got)
    if "c2_patterns" in got:
        got["c2_patterns"] = [(c["pattern"], c.get("severity", "high"), c.get("description", "Known IOC match"))
                              for c in got["c2_patterns"] if c.get("pattern")]
    return RulePack(**got)


def signatures_df(spark: SparkSession, pack: dict | None = None) -> DataFrame:
    """Signatures of ``pack`` (default: the built-in list) as a DataFrame."""
    rows = signature_rows(pack) if pack is not None else [
        (i, n, p, m, s, list(t), list(r)) for i, n, p, m, s, t, r in R.SIGNATURES]
    return spark.createDataFrame(rows, SIGNATURE_SCHEMA)


def compiles(spark: SparkSession, pattern: str) -> bool:
    """Whether the JVM accepts a user's pattern."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import IllegalArgumentException
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
        return True
    except (Py4JJavaError, IllegalArgumentException):
        return False
