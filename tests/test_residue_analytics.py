"""Fleet residue checks, analytics and the stored-report reader."""
import json
import os
import tempfile

from pyspark.sql import functions as F

from conftest import rows
from vigil.operators import residue_rules as RR
from vigil.plans import analytics as A


def test_residue_checks(spark):
    files = spark.createDataFrame([
        (1, "macos", "~/Library/LaunchAgents/com.claude.helper.plist", "com.claude.helper.plist", "~/Library/LaunchAgents", False, 1, 33188, False, ""),
        (1, "macos", "~/Library/LaunchAgents/com.apple.x.plist", "com.apple.x.plist", "~/Library/LaunchAgents", False, 1, 33188, False, ""),
        (2, "linux", "/etc/systemd/system/mcp-sync.service", "mcp-sync.service", "/etc/systemd/system", False, 1, 33188, False, ""),
        (2, "linux", "~/.claude/credentials.json", "credentials.json", "~/.claude", False, 10, 33188, False, ""),
        (2, "linux", "~/.config/cursor", "cursor", "~/.config", True, 0, 16877, False, ""),
        (2, "linux", "~/.config/cursor/a/b.bin", "b.bin", "~/.config/cursor/a", False, 2 * 1024 * 1024, 33188, False, ""),
    ], "host_id long, os string, path string, name string, parent string, is_dir boolean, size long, mode int, is_exec boolean, head string")
    lines = spark.createDataFrame([
        (1, "crontab", 1, "*/5 * * * * /opt/agent/run"), (1, "crontab", 2, "# x"), (1, "crontab", 3, "0 * * * * /tmp/a.sh"),
        (1, "~/.zshrc", 1, "export PATH=$PATH:~/.openclaw/bin"), (1, "/etc/hosts", 1, "10.0.0.1 mcp-gw.local"),
        (1, "/etc/hosts", 2, "127.0.0.1 localhost")], "host_id long, path string, line_no int, line string")
    pk = spark.createDataFrame([(1, "pip", "claude-sdk", "1.0"), (1, "pip", "numpy", "2")],
                               "host_id long, manager string, name string, version string")
    f = RR.residue_findings(files, lines, pk)
    got = sorted(rows(f, "rule_id", "severity"))
    assert got == [("R1", "high"), ("R1", "medium"), ("R10", "low"), ("R2", "high"), ("R3", "high"),
                   ("R5", "medium"), ("R7", "low"), ("R8", "high"), ("R9", "medium")]
    r7 = f.where("rule_id = 'R7'").collect()[0]
    assert r7.title == "Residual directory: cursor (2.0 MB)"
    assert f.where("rule_id = 'R8'").collect()[0].title == "Residual credentials: credentials.json (perms: 644)"
    plan = RR.cleanup_plan(f)
    assert sorted(rows(plan.where("host_id = '1'"), "n", "type")) == [
        (1, "remove_crontab"), (2, "remove_crontab"), (3, "remove_file"), (4, "remove_line")]


def test_global_rank_and_sample(spark):
    df = spark.createDataFrame([(f"p{i:03d}",) for i in range(100)], "package_id string")
    r = A.global_rank(df, "package_id", 7)
    assert sorted(rows(r, "package_id", "rank")) == [(f"p{i:03d}", i) for i in range(100)]


def test_grade_distribution_keeps_zero_rows(spark):
    sc = spark.createDataFrame([("a", "A"), ("b", "F"), ("c", "F")], "package_id string, grade string")
    got = {g: (n, p) for g, n, p in rows(A.grade_distribution(sc), "grade", "n", "pct")}
    assert got == {"A": (1, 33.3), "B": (0, 0.0), "C": (0, 0.0), "D": (0, 0.0), "F": (2, 66.7)}


def test_read_scan_reports(spark):
    d = tempfile.mkdtemp(prefix="vigil-reports-")
    rep = {"target": {"path": "/tmp/x", "platform": "clawhub", "url": None}, "grade": "C", "risk_level": "caution",
           "key_risks": ["MEDIUM: t (P4)"], "behavior_tags": [], "scan_duration_ms": 15,
           "findings": [{"rule_id": "P4", "engine": "pattern", "layer": "behavior", "severity": "medium",
                         "confidence": 0.7, "title": "t", "description": "d", "file_path": "a.py", "line": 3,
                         "code_snippet": "x", "evidence": None, "tags": ["network"], "remediation": None,
                         "references": [], "suppressed": False}],
           "_scan_meta": {"author": "a", "skill": "s", "author_skill": "a__s", "scan_time_s": 0.1}}
    with open(os.path.join(d, "a__s.json"), "w") as fh:
        json.dump(rep, fh, indent=2)
    reports, findings = A.read_scan_reports(spark, d)
    assert rows(reports, "package_id", "grade", "scan_duration_ms") == [("a__s", "C", 15)]
    assert rows(findings, "package_id", "rule_id", "path", "line") == [("a__s", "P4", "a.py", 3)]
    assert rows(A.scan_time_stats(reports), "avg_ms") == [(15.0,)]
