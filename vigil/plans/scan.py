"""The scan pipeline: files -> findings -> suppression -> scores.

One call scans every package in ``files``.  Engines are chosen by name
(F-CAPS); the manifest engine consumes the behavior findings (capabilities)
and the code findings (S11), as in the scanner it re-implements.  The
findings table is checkpointed once (shared checkpoint folder) before the
suppression joins and the scoring aggregates read it several times.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.membership import key_bitmap, may_hold
from ..operators import scoring as S
from ..operators import text_rules as TR
from ..schemas import FINDING_COLUMNS
from ..sources.files import is_scanned, scanned_files, to_lines
from ..sources.rule_packs import RulePack

DEFAULT_ENGINES = ("ast", "pattern", "manifest")   # the residue engine reads host inventories: operators.residue_rules


@dataclass
class ScanResult:
    findings: DataFrame   # FINDINGS + suppressed
    scores: DataFrame     # one row per package


def _union(parts: list[DataFrame]) -> DataFrame:
    df = parts[0].select(*FINDING_COLUMNS)
    for p in parts[1:]:
        df = df.unionByName(p.select(*FINDING_COLUMNS))
    return df


def collect_findings(files: DataFrame, engines=DEFAULT_ENGINES, p3_decode: bool = True,
                     manifests: DataFrame | None = None, pack: RulePack | None = None) -> DataFrame:
    """Un-suppressed findings of the selected engines for all packages.
    ``pack``: rule tables that take the place of shipped ones.

    The behavior findings (code + text engines) are checkpointed once: the
    manifest engine reads them for capabilities and S11, and the result
    reads them again, without recomputing the rules."""
    from ..schemas import empty_findings
    if unknown := set(engines) - set(DEFAULT_ENGINES):
        raise ValueError(f"engines of a package scan are {DEFAULT_ENGINES}, not {sorted(unknown)}")
    scanned = scanned_files(files)
    parts: list[DataFrame] = []
    m = refs = code = None
    if "manifest" in engines:
        from ..operators.manifest_rules import install_refs, manifest_findings, manifest_subset
        m = manifests if manifests is not None else manifest_subset(files).checkpoint()
    if "ast" in engines:
        from ..operators.code_rules import code_findings
        parsed = scanned
        if m is not None:
            # install scripts count wherever they lie, in excluded directories too: parsed along, for S11 only.
            # Other files are dropped by a bitmap of the scripts; the few that pass are left out by S11's own join.
            refs = install_refs(m, files).checkpoint()
            hidden = refs.where(~is_scanned(F.col("path")))
            if count := hidden.count():
                where = ["package_id", "path"]
                parsed = scanned.unionByName(may_hold(files.where(~is_scanned(F.col("path"))), key_bitmap(hidden, where, count), where))
        code = code_findings(parsed).checkpoint()
        parts.append(code.where(is_scanned(F.col("path"))))
    if "pattern" in engines:
        lines = to_lines(scanned)
        text = TR.text_findings(lines, p3_decode=p3_decode, pack=pack)
        parts += [text, TR.p5_signatures(scanned, pack.signatures if pack else None), TR.p9_obfuscation(scanned)]
    behavior = _union(parts).checkpoint() if parts else empty_findings(files.sparkSession)
    out = [behavior]
    if m is not None:
        out.append(manifest_findings(files, behavior, code, manifests=m, refs=refs))
        skill = m.where(F.col("path") == "SKILL.md")
        out.append(TR.p6_skill_injection(skill, to_lines(skill)))
    return _union(out)


def scan(files: DataFrame, engines=DEFAULT_ENGINES, suppressions: DataFrame | None = None,
         inline_ignores: bool = False, checkpoint: bool = True, pack: RulePack | None = None) -> ScanResult:
    """Scan all packages.  ``suppressions`` (package_id, rule_id, glob, line)
    adds to each package's own ignore file; ``pack`` replaces shipped rule
    lists."""
    from ..operators.manifest_rules import manifest_subset
    manifests = manifest_subset(files).checkpoint()
    findings = collect_findings(files, engines, manifests=manifests, pack=pack)
    if checkpoint:
        findings = findings.checkpoint()
    sup = S.parse_ignore_files(manifests)
    if suppressions is not None:
        sup = sup.unionByName(suppressions.select(*sup.columns))
    findings = S.apply_suppressions(findings, sup)
    if inline_ignores:
        findings = S.inline_suppressions(findings, to_lines(scanned_files(files)))
    packages = files.select("package_id").distinct()
    return ScanResult(findings, S.scores(packages, findings))
