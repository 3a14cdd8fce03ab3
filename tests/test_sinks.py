"""Inline suppressions, JSON / SARIF sinks, finding-level scan diff."""
import json
import os
import tempfile

from pyspark.sql import functions as F

from conftest import rows
from vigil.operators import scoring as S
from vigil.operators import text_rules as TR
from vigil.plans import analytics as A
from vigil.plans.scan import scan
from vigil.sources.files import scanned_files, to_lines


def test_inline_suppression(make_files):
    files = make_files({"a.py": 'K = "AKIA' + 'PLOKMIJNUHBYGVTF"  # scan:ignore P1,P7\nJ = "AKIA' + 'ABCDEFGHIJKLMNOP"\n'})
    lines = to_lines(scanned_files(files))
    f = TR.text_findings(lines, ("P1",)).withColumn("suppressed", F.lit(False))
    got = sorted(rows(S.inline_suppressions(f, lines), "line", "suppressed"))
    assert got == [(1, True), (2, False)]


def test_json_and_sarif_sinks(make_files):
    r = scan(make_files({"creds.py": 'AWS_KEY = "AKIA' + 'PLOKMIJNUHBYGVTF"\n'}), engines=("pattern",))
    out = tempfile.mkdtemp(prefix="vigil-out-")
    S.write_scan_json(r.scores, r.findings, f"{out}/scan")
    S.write_sarif(r.findings, f"{out}/sarif")
    reports, findings = A.read_scan_reports(r.findings.sparkSession, f"{out}/scan", multi_line=False)
    assert rows(reports, "package_id", "grade") == [("pkg", "F")]
    cols = [c for c in findings.columns if c != "suppressed"]
    assert sorted(map(str, rows(findings, *cols))) == sorted(map(str, rows(r.findings, *cols)))
    docs = [json.loads(x) for p in os.listdir(f"{out}/sarif") if p.endswith(".json") for x in open(f"{out}/sarif/{p}")]
    assert [d["version"] for d in docs] == ["2.1.0"] and docs[0]["$schema"].endswith("sarif-2.1.0.json")
    run = docs[0]["runs"][0]
    assert run["tool"]["driver"]["rules"][0]["defaultConfiguration"] == {"level": "error"}
    x = run["results"][0]
    assert (x["ruleId"], x["level"]) == ("P1", "error")
    assert x["message"]["text"] == "Found AWS Access Key pattern in source code"
    assert x["locations"][0]["physicalLocation"] == {
        "artifactLocation": {"uri": "creds.py"}, "region": {"startLine": 1}}


def test_ignore_globs(spark):
    paths = ["src/a.py", "src/b.py", "src/c.py", "x[1].py", "a/b.js", "-.py", "^.py"]
    f = spark.createDataFrame([("p", "P1", x, i, False) for i, x in enumerate(paths)],
                              "package_id string, rule_id string, path string, line int, old boolean")

    def hit(glob, line=None):
        s = spark.createDataFrame([("p", "P1", glob, line)], "package_id string, rule_id string, glob string, line int")
        return {x[0] for x in rows(S.apply_suppressions(f, s).where("suppressed"), "path")}
    import fnmatch
    for g in ("src/[ab].py", "src/[!ab].py", "src/[a-b].py", "*.py", "x[[]1].py", "[z-a].py", "?.py", "[!z-a].py", "[]a].py",
              "src/a.py", "[^x].py", "[a", "*"):
        assert hit(g) == {p for p in paths if g == "*" or fnmatch.fnmatchcase(p, g)}, g
    assert hit("*", 1) == {"src/b.py"}


def test_finding_diff(spark):
    cols = "package_id string, rule_id string, path string, line int, title string, suppressed boolean"
    before = spark.createDataFrame([("p", "P1", "a", 1, "t", False), ("p", "P4", "a", 2, "u", False)], cols)
    after = spark.createDataFrame([("p", "P1", "a", 1, "t", False), ("p", "S1", "b", 3, "v", False)], cols)
    got = sorted(rows(A.finding_diff(before, after), "rule_id", "change"))
    assert got == [("P4", "removed"), ("S1", "added")]


def test_sarif_results_of_every_engine(spark):
    """One result for each unsuppressed finding of the whole scan, whatever its engine."""
    from collections import Counter

    from vigil.plans.registry import QUERIES, full_scan
    sf = "/root/testdata/sf0.001"
    found = QUERIES["sarif_results_all"](spark, sf).collect()
    _, f = full_scan(spark, sf)
    want = Counter((r.package_id, r.rule_id) for r in f.where("not suppressed").collect())
    assert Counter((r.package_id, r.ruleId) for r in found) == want
    rules = {r.ruleId for r in found}
    assert {"P2", "P3", "P7"} & rules and any(x[0] == "S" for x in rules) and any(x[0] == "M" for x in rules)
    assert all(r.message and r.uri and r.startLine >= 1 for r in found)


def test_globs_by_their_plain_pieces(spark):
    """Suppressions against fnmatch on every pair."""
    import fnmatch
    import random
    rng = random.Random(5)
    names = ["".join(rng.choice("ab./-_") for _ in range(rng.choice([0, 1, 3, 9, 40, 140]))) for _ in range(120)]
    globs = {"*", "*.*", "[ab]*", "a?b", "[!a]*", "x[", "[]a]*", "a[b", "*[ab]", "src/*", "*é"}
    for n in names[:60]:
        i, j = sorted((rng.randrange(len(n) + 1), rng.randrange(len(n) + 1)))
        globs |= {n[:i] + "*" + n[j:], n[:i] + "?" + n[i + 1:], n[:i] + "[ab]" + n[i + 1:]}
    find = spark.createDataFrame([("p", "R", n, k, False) for k, n in enumerate(names)],
                                 "package_id string, rule_id string, path string, line int, suppressed boolean").drop("suppressed")
    for g in sorted(globs - {""}):
        assert any(c in g for c in "*?[")
    sup = spark.createDataFrame([("p", "R", g, None) for g in sorted(globs)], "package_id string, rule_id string, glob string, line int")
    keyed = sup.select("glob", S.glob_key(F.col("glob")).alias("k")).collect()
    by_path = {r.path: set(r.k) for r in find.select("path", S.path_keys(F.col("path")).alias("k")).collect()}
    for r in keyed:
        for n in names:
            if n and fnmatch.fnmatchcase(n, r.glob):
                assert r.k in by_path[n], (r, n)
    for g in sorted(globs)[::23]:
        got = {r.path for r in S.apply_suppressions(find, sup.where(F.col("glob") == g)).where("suppressed").collect()}
        assert got == {n for n in names if (n or g == "*") and fnmatch.fnmatchcase(n, g)}, g


def test_merged_scan_times(spark):
    from vigil.plans import analytics as A
    rng = __import__("random").Random(1)
    d = [int(rng.lognormvariate(5, 2)) for _ in range(20_000)] + [7] * 5000
    reports = spark.createDataFrame([(i % 13, x) for i, x in enumerate(d)], "batch int, scan_duration_ms long")
    one = A.scan_time_history(A.scan_time_sketches(reports, "batch")).collect()[0]
    d.sort()
    assert (one.scans, one.total_ms, one.max_ms, one.avg_ms) == (len(d), sum(d), d[-1], sum(d) / len(d))
    for q, v in ((0.5, one.p50_ms), (0.95, one.p95_ms)):
        assert d[int(len(d) * (q - 0.02))] <= v <= d[int(len(d) * (q + 0.02))]
    none = spark.createDataFrame([], "batch int, scan_duration_ms long")
    assert [r.scans for r in A.scan_time_history(A.scan_time_sketches(none, "batch")).collect()] in ([], [None])
