"""Secret scans with an incremental blob ledger.

A table of versions (any path columns, one content column) may hold the whole
history of many files.  Every content is addressed by its SHA-256; the ledger,
a Parquet folder, holds per scanned blob which rules in which versions have
seen it and the spans they found.  A scan addresses the new table, takes the
pairs of blob and rule version that the ledger lacks, reads each such blob's
content once however many paths carry it, and appends a row for each, also
where nothing was found.  Findings are joined back to all paths.  A rule whose
version is raised is scanned anew, the others are not.

A row of the ledger stands for itself: what a broken run has appended is used
by the next one, and rows that two runs have both written count once.

Spans are code points of the content, end exclusive; matches are leftmost and
do not overlap within a kind.

Defined cases: null content is the empty blob; rows that occur more than once,
null paths included, each get the findings of their content; extra columns are
not handed on; an empty table gives no rows and scans nothing.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import is_text, scratch, store


@dataclass(frozen=True)
class Rule:
    """``group`` of a match must have ``least`` characters, or the match is
    dropped (what it covers stays covered).  ``needs``: strings one of which
    is in the lower-case text of every match; empty: not known."""
    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    needs: tuple[str, ...] = ()
    version: int = 1


# What the task lists, then public token formats.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6,
         ("password", "passwd", "secret", "token", "apikey", "api_key")),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, ("akia",)),
    Rule("hex", r"[0-9a-f]{24,}"),
)
RULES = BASE + (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", needs=("private key-----",)),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", needs=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", needs=("xox",)),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}", needs=("aiza",)),
)
FEW = 20_000            # blobs to scan up to which their ids (32 bytes each) are broadcast
LEDGER = "blob_id binary, done array<struct<kind:string,version:int>>, spans array<struct<kind:string,version:int,start:int,end:int>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("version", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
_DONE = pa.list_(pa.struct([("kind", pa.string()), ("version", pa.int32())]))


def blob_id(content: str) -> Column:
    return F.unhex(F.sha2(is_text(content), 256))


def spans_of(data: bytes, low: bytes, rule: Rule, pattern: re.Pattern) -> list[tuple[int, int]]:
    """Byte spans; patterns are ASCII, so bytes and characters match alike."""
    if rule.needs and not any(w.encode() in low for w in rule.needs):
        return []
    return [m.span() for m in pattern.finditer(data) if len(m.group(rule.group)) >= rule.least]


def code_points(data: bytes, at: list[int]) -> list[int]:
    """Places in UTF-8 bytes as numbers of characters."""
    if not at or data.isascii():
        return at
    later = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) == 0x80)
    return (np.array(at) - np.searchsorted(later, at)).tolist()


# ------------------------------------------------------------------- ledger


def new_ledger(spark: SparkSession) -> str:
    """A folder for a ledger of this session; a lasting one is any folder of
    shared storage."""
    return f"{scratch(spark)}/ledger-{uuid.uuid4().hex}"


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(folder)


def rule_versions(rules: Iterable[Rule]) -> Column:
    return F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).cast("int").alias("version")) for r in rules])


def unseen(index: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob_id, todo): the numbers of the rules that have not seen the blob."""
    done = (ledger.select("blob_id", F.explode("done").alias("d")).groupBy("blob_id").agg(F.collect_set("d").alias("done")))
    number = [F.when(~F.array_contains("done", F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).cast("int").alias("version"))),
                     F.lit(i)) for i, r in enumerate(rules)]
    return (index.select("blob_id").distinct().join(done, "blob_id", "left")
            .withColumn("done", F.coalesce("done", F.slice(rule_versions(rules), 1, 0)))
            .select("blob_id", F.array_compact(F.array(*number)).alias("todo")).where(F.size("todo") > 0))


def scan(versions: DataFrame, content: str, index: DataFrame, folder: str, rules: tuple[Rule, ...]) -> int:
    """Scan what the ledger lacks and append it; returns how many blobs were
    read."""
    spark = versions.sparkSession
    todo = store(unseen(index, read_ledger(spark, folder), rules), "unseen-blobs")
    count = todo.count()
    if not count:
        return 0
    blobs = versions.select(blob_id(content).alias("blob_id"), is_text(content).alias("data"))
    if count <= FEW:
        blobs = blobs.join(F.broadcast(todo.select("blob_id")), "blob_id", "left_semi")
    # copies are merged in the tasks that read them, so a blob with very many paths is not a hot key
    once = blobs.groupBy("blob_id").agg(F.first("data").alias("data")).join(todo, "blob_id")

    def run(batches):
        patterns = [re.compile(r.pattern.encode()) for r in rules]
        for b in batches:
            done, spans = [], []
            for blob, numbers in zip(b.column("data"), b.column("todo").to_pylist(), strict=True):
                data = blob.as_py()
                low = data.lower()
                found = [(rules[i], s, e) for i in numbers for s, e in spans_of(data, low, rules[i], patterns[i])]
                starts, ends = (code_points(data, [f[k] for f in found]) for k in (1, 2))
                done.append([{"kind": rules[i].kind, "version": rules[i].version} for i in numbers])
                spans.append([{"kind": f[0].kind, "version": f[0].version, "start": s, "end": e}
                              for f, s, e in zip(found, starts, ends, strict=True)])
            yield pa.RecordBatch.from_arrays([b.column("blob_id"), pa.array(done, _DONE), pa.array(spans, _SPANS)],
                                             ["blob_id", "done", "spans"])

    once.select("blob_id", "data", "todo").mapInArrow(run, LEDGER).write.mode("append").parquet(folder)
    return count


def findings(spark: SparkSession, folder: str, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob_id, spans array<struct<start, rule, end>>) of blobs with findings
    of the rules' versions, by start, then rule number."""
    number = F.expr("CASE " + " ".join(f"WHEN s.kind = '{r.kind}' AND s.version = {r.version} THEN {i}"
                                       for i, r in enumerate(rules)) + " END")
    return (read_ledger(spark, folder).select("blob_id", F.explode("spans").alias("s"))
            .select("blob_id", F.struct(F.col("s.start").alias("start"), number.alias("rule"), F.col("s.end").alias("end")).alias("s"))
            .where(F.col("s.rule").isNotNull())
            .groupBy("blob_id").agg(F.array_sort(F.collect_set("s")).alias("spans")))


def secrets(versions: DataFrame, paths: list[str], content: str, folder: str | None = None,
            rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Path columns of every row and ``spans`` (null: none) of its content."""
    spark = versions.sparkSession
    folder = folder or new_ledger(spark)
    index = store(versions.select(*[F.col(p).alias(f"p{i}") for i, p in enumerate(paths)],
                                  blob_id(content).alias("blob_id")), "blob-index")
    scan(versions, content, index, folder, rules)
    found = store(findings(spark, folder, rules), "blob-findings")
    return (index.join(found, "blob_id", "left")
            .select(*[F.col(f"p{i}").alias(p) for i, p in enumerate(paths)], "spans"))


def written(spans: Column, rules: tuple[Rule, ...]) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(kinds, s["rule"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op13_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"], "text")
    none = F.expr("CAST(array() AS array<struct<start:int,rule:int,end:int>>)")
    spans = F.coalesce(F.col("spans"), none)

    def count(i: int) -> Column:
        return F.size(F.filter(spans, lambda s: s["rule"] == i)).cast("long")

    base = written(F.filter(spans, lambda s: s["rule"] < len(BASE)), RULES)
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        F.sha2(base.cast("binary"), 256).alias("base_sha256"), written(spans, RULES).alias("spans"))
