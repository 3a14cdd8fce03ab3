"""Benchmark: the scan engine on the seeded corpus of ``$BENCH_SF_DIR``.

Prints ONE JSON line: {"metric", "value", "unit", "queries", "sf", ...}.
The corpus is first written once as a parquet ``files`` table (timed as
``prep``, not part of ``value``); every query then reads that table like a
registry scan would.  Every step's whole result is written to the ``noop`` sink,
so that no column is pruned away.  ``value`` = total seconds of the timed
queries.  The full scan is timed on the corpus ``$BENCH_TIMES`` times over as well
(packages of other names): the difference gives the cost per MB without the fixed
cost of planning and starting some hundred small jobs.
"""
from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from vigil.session import build_session  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    times = int(os.environ.get("BENCH_TIMES", "4"))
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", app="vigil-bench", shuffle_partitions=int(cpus) * 2,
                          extra={"spark.driver.memory": "16g", "spark.ui.enabled": "false"})
    from vigil.operators import manifest_rules as M
    from vigil.operators import residue_rules as RR
    from vigil.operators import text_rules as TR
    from vigil.operators.code_rules import code_findings
    from vigil.plans import analytics as A
    from vigil.plans.scan import scan
    from vigil.sources import fleet as FL
    from vigil.sources.corpus import seeded_files
    from vigil.sources.files import scanned_files, to_lines, write_files_table

    work = tempfile.mkdtemp(prefix="vigil-bench-", dir=os.environ.get("TMPDIR", "/tmp"))
    q: dict[str, float] = {}

    def stored(table, name):
        # a registry table is many files; spread the corpus so every core gets work
        write_files_table(table.repartition(int(cpus) * 4), f"{work}/{name}")
        return spark.read.parquet(f"{work}/{name}")

    def sink(*frames):
        for df in frames:
            df.write.format("noop").mode("overwrite").save()

    def timed(name, fn):
        t = time.time()
        out = fn()
        q[name] = round(time.time() - t, 3)
        return out

    def mb(files):
        return (files.agg(F.sum("size")).first()[0] or 0) / 1e6

    t0 = time.time()
    files = stored(seeded_files(spark, sf_dir), "files")
    # host inventory tables are inputs too: materialise them with the corpus
    FL.host_files(spark, sf_dir).write.parquet(f"{work}/host_files")
    FL.host_lines(spark, sf_dir).write.parquet(f"{work}/host_lines")
    FL.host_packages(spark, sf_dir).write.parquet(f"{work}/host_packages")
    prep = time.time() - t0
    stats = files.agg(F.count("*").alias("n"), F.countDistinct("package_id").alias("p")).first()

    scanned = scanned_files(files)
    text = timed("text_rules", lambda: TR.text_findings(to_lines(scanned)).checkpoint())
    timed("signatures_obfuscation", lambda: sink(TR.p5_signatures(scanned), TR.p9_obfuscation(scanned)))
    timed("code_rules", lambda: sink(code_findings(scanned)))

    def manifest_step():
        m = M.manifest_subset(files).checkpoint()       # as the full scan does
        sink(M.manifest_findings(files, text, None, manifests=m))
    timed("manifest_rules", manifest_step)

    def full(table):
        r = scan(table)
        sink(r.findings, r.scores)
        return r
    res = timed("full_scan", lambda: full(files))
    timed("analytics", lambda: sink(A.grade_distribution(res.scores), A.top_rules(res.findings),
                                    A.rule_severity_matrix(res.findings), A.riskiest_packages(res.scores)))
    hf, hl, hp = (spark.read.parquet(f"{work}/{t}") for t in ("host_files", "host_lines", "host_packages"))
    timed("fleet_residue", lambda: sink(RR.cleanup_plan(RR.residue_findings(hf, hl, hp))))
    total = round(sum(q.values()), 3)

    size, extra = mb(files), {}
    if times > 1:
        copies = files.drop("kind").withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times))))
        large = stored(copies.withColumn("package_id", F.concat("package_id", F.lit("-"), F.col("copy").cast("string"))).drop("copy"), "large")
        t = time.time()
        full(large)
        seconds = time.time() - t
        extra = {"large_full_scan_sec": round(seconds, 3), "large_content_mb": round(mb(large), 2),
                 "full_scan_sec_per_mb_slope": round((seconds - q["full_scan"]) / (size * (times - 1)), 4)}
    print(json.dumps({
        "metric": "scan_engine_total", "value": total, "unit": "sec", "queries": q,
        "sf": os.path.basename(sf_dir).replace("sf", ""),
        "prep_sec": round(prep, 3), "files": stats["n"], "packages": stats["p"], "content_mb": round(size, 2),
        "full_scan_mb_per_s": round(size / q["full_scan"], 3) if q["full_scan"] else None,
        "full_scan_files_per_s": round(stats["n"] / q["full_scan"], 1) if q["full_scan"] else None, **extra,
    }))


if __name__ == "__main__":
    main()
