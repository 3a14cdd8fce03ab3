"""Packs given as YAML or tables, of any length."""
import re

import pytest
import yaml
from conftest import rows
from vigil.operators import pattern_index as PI
from vigil.operators import text_rules as TR
from vigil.rules import packs as R
from vigil.sources.files import scanned_files, to_lines
from vigil.sources.rule_packs import SIGNATURE_SCHEMA, RulePack, rule_pack

TEXT = {
    "a.js": "x\nload('evil.marker')\nfetch('http://a.bad-host.example/x')\nfetch('https://b.co.zz:80/')\n",
    "b.py": "u = 'https://pastebin.com/raw/1'\nv = 'see node.my-dyn.test now'\nw = 'http://c.d.TK'\n",
    "c.md": "nothing here\nhttp://plain.org/y.co.zz/z http://x.tk.org\n",
}
PACK = {
    "signatures": [{"id": "X-1", "name": "Test marker", "pattern": r"evil\.marker", "severity": "high", "tags": ["t"]},
                   {"id": "X-2", "name": "Broken", "pattern": "(unclosed"}, {"id": "X-3", "name": "No literal", "pattern": r"\d{2}:\w\w"}],
    "dynamic_dns": ["*.my-dyn.test"],
    "suspicious_tlds": [".co.zz", ".zz"],
    "c2_patterns": [{"pattern": r"bad-host\.example", "severity": "critical", "description": "Bad host"},
                    {"pattern": r"[unclosed", "severity": "high", "description": "broken"}],
}
COLS = ("path", "line", "rule_id", "severity", "title")


def found(lines, pack, rules=("P4", "P8")):
    return sorted(rows(TR.text_findings(lines, rules, pack=pack), *COLS))


@pytest.fixture
def lines(make_files):
    return to_lines(scanned_files(make_files(TEXT)))


def test_yaml_pack_changes_every_rule(lines, make_files, tmp_path):
    one, two = tmp_path / "a.yaml", tmp_path / "b.yaml"
    one.write_text(yaml.safe_dump({k: PACK[k] for k in ("signatures", "dynamic_dns")}))
    two.write_text(yaml.safe_dump({k: PACK[k] for k in ("suspicious_tlds", "c2_patterns")}))
    pack = rule_pack(str(one), str(two))
    got = found(lines, pack)
    assert [g for g in got if g[2] == "P4" and g[3] == "high"] == [("b.py", 2, "P4", "high", "Dynamic DNS domain detected")]
    assert [g for g in got if g[4].startswith("IOC")] == [("a.js", 3, "P8", "critical", "IOC match: Bad host")]
    assert [(g[0], g[1], g[4][25:]) for g in got if g[4].startswith("URL with")] == [
        ("a.js", 4, ".co.zz"), ("b.py", 3, ".tk"), ("c.md", 2, ".co.zz")]
    sigs = TR.p5_signatures(scanned_files(make_files(TEXT)), pack.signatures)
    assert sorted(rows(sigs, "path", "line", "title")) == [("a.js", 2, "Malicious signature: Test marker")]
    plain = found(lines, None)
    assert ("b.py", 1, "P8", "high", "IOC match: Pastebin raw URL (common C2 payload host)") in plain
    assert not [g for g in got if "Pastebin" in g[4]]              # the section takes the place of the shipped one


def test_dataframe_pack_equals_yaml_pack(spark, lines):
    yes = RulePack(dynamic_dns=PACK["dynamic_dns"], suspicious_tlds=PACK["suspicious_tlds"],
                   c2_patterns=[(c["pattern"], c["severity"], c["description"]) for c in PACK["c2_patterns"]])
    df = RulePack(dynamic_dns=spark.createDataFrame([(g,) for g in yes.dynamic_dns], "glob string"),
                  suspicious_tlds=spark.createDataFrame([(t,) for t in yes.suspicious_tlds], "tld string"),
                  c2_patterns=spark.createDataFrame(yes.c2_patterns, "pattern string, severity string, description string"))
    assert found(lines, df) == found(lines, yes)


def test_shipped_lists_as_tables_give_the_same_findings(lines):
    tables = RulePack(dynamic_dns=R.DYNAMIC_DNS_GLOBS, suspicious_tlds=R.SUSPICIOUS_TLDS_PACK, c2_patterns=R.IOC_PATTERNS)
    cols = ("path", "line", "rule_id", "severity", "title", "evidence", "snippet", "tags", "ord")
    one, two = (sorted(map(str, rows(TR.text_findings(lines, ("P4", "P8"), pack=p), *cols))) for p in (None, tables))
    assert one == two and len(one) >= 2


def test_odd_tlds_and_empty_sections(lines):
    got = found(lines, RulePack(suspicious_tlds=["org/y.co.zz", ".ORG"]))
    assert [(g[0], g[4][25:]) for g in got if g[4].startswith("URL with")] == [("b.py", ".tk"), ("c.md", ".ORG"), ("c.md", ".ORG")]
    nothing = found(lines, RulePack(dynamic_dns=[], suspicious_tlds=[], c2_patterns=[]))
    assert [g[4] for g in nothing if g[2] == "P8"] == ["URL with suspicious TLD: .tk"]


def test_atoms_are_in_every_match():
    for rx, texts in ((r"(?i)evil\.Marker", ["EVIL.marker"]), (r"(?i)(?:foo|ba+r)x{2,}", ["FOOxx", "baarxxx"]),
                      (r"(?i)Ünï-code", ["Ünï-CODE"]), (r"(?i)a\s+bc", ["A \n BC"])):
        got = PI.atoms(rx)
        for t in texts:
            assert got is None or any(a in t.translate(PI._ASCII_LOWER) for a in got)
    assert PI.atoms(r"\d+") is None and PI.atoms(r"(broken") is None


def test_long_signature_pack(spark, make_files, monkeypatch):
    """5,000 rules: no nested loop, no shuffle of contents, the findings of the plan-literal form; blocks change nothing."""
    files = scanned_files(make_files({f"f{i}.js": f"line\nmarker_{i * 37:05d}_x eval(atob('a'))\n" for i in range(30)}))
    pack = [(f"S{i:05d}", f"rule {i}", rf"marker_{i:05d}_\w", False, "high", ["t"], []) for i in range(5000)]
    pack += [(f"T{j}", n, p, m, s, list(t), list(r)) for j, (_, n, p, m, s, t, r) in enumerate(R.SIGNATURES)]
    df = TR.p5_signatures(files, spark.createDataFrame(pack, SIGNATURE_SCHEMA))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and not re.search(r"Exchange (hash|range|SinglePart)", plan)
    got = sorted(rows(df, "path", "line", "title", "evidence"))
    assert sum(t.startswith("Malicious signature: rule ") for _, _, t, _ in got) == 30
    shipped = sorted((p, li, t) for p, li, t, _ in got if "rule " not in t)
    assert shipped == sorted(rows(TR.p5_signatures(files), "path", "line", "title"))
    monkeypatch.setattr(PI, "BLOCK_RULES", 700)
    assert sorted(rows(TR.p5_signatures(files, pack), "path", "line", "title")) == [g[:3] for g in got]
