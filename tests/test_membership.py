"""Bitmap membership, and plans that shuffle no file contents."""
import re

from pyspark.sql import functions as F

from vigil.functions.membership import key_bitmap, may_hold
from vigil.operators import code_rules as C
from vigil.plans.scan import collect_findings
from vigil.sources.files import scanned_files, to_lines


def test_no_key_is_lost_and_few_others_pass(spark):
    keys = spark.range(0, 3000).select(F.col("id").cast("string").alias("a"), (F.col("id") % 7).alias("b"))
    every = spark.range(0, 60000).select(F.col("id").cast("string").alias("a"), (F.col("id") % 7).alias("b"), F.lit("x").alias("c"))
    got = {int(r.a) for r in may_hold(every, key_bitmap(keys, ["a", "b"], 3000), ["a", "b"]).collect()}
    assert set(range(3000)) <= got and len(got) < 3000 + 57000 * 0.05
    assert may_hold(every, key_bitmap(keys.limit(0), ["a", "b"], 0), ["a", "b"]).count() == 0
    full = key_bitmap(keys, ["a", "b"], 1)                       # too narrow: more pass, none is lost
    assert set(range(3000)) <= {int(r.a) for r in may_hold(every, full, ["a", "b"]).collect()}


def shuffled_columns(df):
    """Input columns of every shuffle of a plan."""
    text = df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return [c for block in re.findall(r"\(\d+\) Exchange\n(.*?)\n\n", text, re.S)
            for c in re.findall(r"(\w+)#\d+", re.search(r"Input \[\d+\]: \[(.*)\]", block)[1])]


def test_snippets_shuffle_no_contents(spark, make_files, monkeypatch):
    files = make_files({f"m{i}.py": "import os\n" + ("x = 1\n" * 50) + f"os.system(open('f{i}').read())\ny = 2\n" for i in range(20)})
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        f = C.code_findings(files)
        cols = shuffled_columns(f)
        assert cols and "content" not in cols
        got = f.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got and {r.snippet.splitlines()[1][:9] for r in got if r.line == 52} == {"os.system"}


def test_files_of_install_hooks_are_not_shuffled(spark, make_files, monkeypatch):
    """S11 with broadcasting off: the same findings; contents go through no join."""
    files = make_files({"package.json": '{"scripts": {"postinstall": "python node_modules/x/run.py"}}',
                        "node_modules/x/run.py": "import os, sys\nos.system(sys.argv[1])\n",
                        "node_modules/x/other.py": "import os, sys\nos.system(sys.argv[1])\n"})
    seen = []
    real = C.code_findings

    def watch(f, *a, **k):
        seen.append(f)
        return real(f, *a, **k)
    monkeypatch.setattr(C, "code_findings", watch)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = [(r.rule_id, r.path) for r in collect_findings(files).collect()]
        assert "content" not in shuffled_columns(seen[0]) and len(seen) == 1      # one pass over scanned and hidden scripts
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {g for g in got if g[0].startswith("S11")} == {("S11/S1", "node_modules/x/run.py")}
    assert len(to_lines(scanned_files(files)).collect()) >= 0
