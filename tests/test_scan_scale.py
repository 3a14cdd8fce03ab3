"""What a scan does once: the corpus stored, literals looked for in one pass."""
from pyspark.sql import functions as F

from vigil.operators.pattern_index import Gates
from vigil.rules import packs as R
from vigil.sources.files import stored_files


def test_stored_files_prune_by_kind(spark, make_files):
    files = make_files({"a.py": "x = 1\n", "package.json": "{}", "README.md": "read", "dist/x.js.map": "{}"})
    stored = stored_files(files)
    assert sorted(map(tuple, stored.select(*files.columns).collect())) == sorted(map(tuple, files.collect()))
    assert {r.kind for r in stored.select("kind").distinct().collect()} == {"scan", "scan_manifest", "manifest", "other"}
    plan = stored.where(F.col("kind").isin("manifest", "scan_manifest"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [kind" in plan
    assert stored_files(files.limit(0)).count() == 0


def test_full_scan_reads_the_stored_corpus(spark):
    from vigil.plans.registry import full_scan
    files, _ = full_scan(spark, "/root/testdata/sf0.001")
    assert "kind" in files.columns and all("/files-" in f for f in files.inputFiles())


def test_gates_lose_no_match(spark):
    patterns = [p for p, *_ in R.MANIPULATION_PATTERNS] + [p for p, _ in R.PROMPT_INJECTION_PATTERNS] + \
        [p for _, p, _ in R.SECRET_PATTERNS]
    lines = ["", None, "YOU  Always FAIL", "you are not reliable", "Jailbreak", "ÉMERGENCY emergency: bypass normal procedures",
             "akia" + "0" * 16, "AKIA" + "Z" * 16, "xoxb-1 xoxz", "İgnore all previous rules", "Kelvin ignore prior prompts",
             "plain words", "-----BEGIN PRIVATE KEY-----", "do this while also don't tell", "forget your training \U0001f600"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string").unionByName(
        spark.sql("SELECT 99 AS i, CAST(X'FF6A61696C627265616BFE' AS STRING) AS line"))
    gates = Gates(patterns)
    assert len(gates.bit) == len(set(patterns))
    got = df.select("i", "line", gates.bits(F.col("line")).alias("may")).select(
        F.array(*[gates.rlike(F.col("may"), F.col("line"), p) for p in patterns]).alias("gated"),
        F.array(*[F.col("line").rlike(p) for p in patterns]).alias("plain"),
        gates.first_match(F.col("may"), F.col("line"), patterns).alias("first")).collect()
    for r in got:
        assert [bool(x) for x in r.gated] == [bool(x) for x in r.plain]
        assert r.first == next((i for i, x in enumerate(r.plain) if x), None)
    assert sum(any(r.plain) for r in got if r.plain[0] is not None) >= 8
    many = Gates([f"word{i:03d}" for i in range(80)])      # more patterns than bits: the others are tried everywhere
    one = df.limit(1).select(F.lit("word079").alias("t")).select("t", many.bits(F.col("t")).alias("m"))
    assert one.select(many.rlike(F.col("m"), F.col("t"), "word079")).first()[0]
