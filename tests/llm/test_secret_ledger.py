"""Ledger scans against a plain scan of every row."""
import hashlib
import re
from dataclasses import replace

from pyspark.sql import functions as F

from vigil.llm import secret_ledger as S

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
TEXTS = [
    'x password = "hunter22" y', "token=abc", "token=token:abcdef", "API_KEY: 'zzzzzz' apikey=1234567", "KEY secret  :  abcdef",
    "AKIA" + "A1" * 8 + " AKIAAKIA short", "é🦆 " + "0123456789abcdef" * 2 + " DEADBEEF", "a" * 23 + "g" + "b" * 24,
    "-----BEGIN RSA PRIVATE KEY-----\nabc", "ghp_" + "a" * 36 + "!", "xoxb-1234567890-abc", "AIza" + "x" * 35, "plain words only", "", None,
    "passſword=abcdef", "TOKEN=\"" + "Q" * 300000,
]


def plain(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(spans)


def versions(spark, texts):
    rows = [(i if i % 5 else None, f"f{i % 3}", t, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, path string, text string, blob_id string")


def test_against_plain_scan(spark):
    texts = TEXTS * 3
    df = versions(spark, texts).repartition(5)
    got = S.secrets(df.withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256)), ["doc_id", "path", "sha"], "text").collect()
    assert len(got) == len(texts)
    want = {}
    for t in texts:
        want[hashlib.sha256((t or "").encode()).hexdigest()] = plain(t)
    for r in got:
        assert [tuple(s) for s in r.spans or [] if s.rule < 3] == want[r.sha]
    kinds = {S.RULES[s.rule].kind for r in got for s in r.spans or []}
    assert kinds == {r.kind for r in S.RULES}


def test_only_unseen_pairs_are_scanned(spark):
    folder = S.new_ledger(spark)

    def scan(df, rules):
        index = df.select(S.blob_id("text").alias("blob_id"))
        return S.scan(df, "text", index, folder, rules)

    first = versions(spark, TEXTS[:6] * 4)
    assert scan(first, S.BASE) == 6 and scan(first, S.BASE) == 0
    both = versions(spark, TEXTS)
    assert scan(both, S.BASE) == len({t or "" for t in TEXTS}) - 6
    rows = S.read_ledger(spark, folder).collect()
    assert len(rows) == len({r.blob_id for r in rows}) == len({t or "" for t in TEXTS})
    # a rule of a new version, and a new rule: every blob once more, those rules only
    raised = (replace(S.BASE[0], version=2), *S.BASE[1:], S.RULES[3])
    assert scan(both, raised) == len(rows) and scan(both, raised) == 0
    again = S.read_ledger(spark, folder).where(F.exists("done", lambda d: d["version"] == 2)).collect()
    assert {tuple(sorted(d.kind for d in r.done)) for r in again} == {("assign", "pem")}
    # findings of the old version no longer count; the same spans are found by the new one
    old, new = ({bytes(r.blob_id): r.spans for r in S.findings(spark, folder, x).collect()} for x in (S.BASE, raised[:3]))
    assert old == new and old


def test_rows_written_twice_and_broken_runs(spark):
    folder = S.new_ledger(spark)
    df = versions(spark, TEXTS)
    before = S.secrets(df, ["path"], "text", folder).collect()
    ledger = S.read_ledger(spark, folder)
    ledger.limit(5).write.mode("append").parquet(folder)                # a second run that overlapped
    assert sorted(map(str, S.secrets(df, ["path"], "text", folder).collect())) == sorted(map(str, before))
    part = S.new_ledger(spark)
    ledger.limit(4).write.mode("append").parquet(part)                  # a run that broke off
    todo = S.unseen(df.select(S.blob_id("text").alias("blob_id")), S.read_ledger(spark, part), S.RULES)
    assert todo.count() == len({t or "" for t in TEXTS}) - 4
    assert sorted(map(str, S.secrets(df, ["path"], "text", part).collect())) == sorted(map(str, before))


def test_many_blobs_and_empty_table(spark, monkeypatch):
    df = versions(spark, TEXTS)
    want = sorted(map(str, S.secrets(df, ["doc_id", "path"], "text").collect()))
    monkeypatch.setattr(S, "FEW", 0)                                    # ids are not broadcast
    assert sorted(map(str, S.secrets(df, ["doc_id", "path"], "text").collect())) == want
    assert S.secrets(df.limit(0), ["doc_id"], "text").collect() == []
