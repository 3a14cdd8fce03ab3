"""File sources: package trees in storage, scanned-file filter, numbered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..rules.packs import EXCLUDED_DIRS, SCANNED_SUFFIXES
from .corpus import LINE_BREAKS


def _resolved(spark: SparkSession, root: str) -> str:
    """``root`` as Hadoop qualifies it: the form file paths come back in."""
    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString().rstrip("/")


def _below(raw: DataFrame, root: str, package_depth: int) -> DataFrame:
    """Package id and package-relative path from a file's path: what follows
    the root, whatever scheme and number of slashes both are written with."""
    plain = lambda c: F.regexp_replace(c, r"^([a-zA-Z][\w+.-]*:)?/+", "/")
    tail = F.expr("substring(_plain, _n)")
    df = raw.withColumns({"_plain": plain(F.col("path")), "_n": F.length(plain(F.lit(root))) + 2})
    seg = F.split(tail, "/")
    return df.withColumns({"package_id": F.array_join(F.slice(seg, 1, package_depth), "/"),
                           "path": F.array_join(F.slice(seg, package_depth + 1, 1 << 20), "/")}).drop("_plain", "_n")


def list_package_tree(spark: SparkSession, root: str, package_depth: int = 1) -> DataFrame:
    """SRC2: (package_id, path, size) of every file below ``root``; no file
    is opened."""
    raw = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length"))
    return _below(raw, _resolved(spark, root), package_depth).select("package_id", "path", F.col("length").alias("size"))


def read_package_tree(spark: SparkSession, root: str, package_depth: int = 1, names: str | None = None,
                      below: int | None = None) -> DataFrame:
    """Read the files below ``root`` as ``files`` rows.

    The first ``package_depth`` path segments below ``root`` name the
    package; the rest is the package-relative path.  Content is decoded as
    UTF-8 with invalid bytes replaced by U+FFFD.  ``names`` is a Hadoop glob
    on the file name: others are not opened (``text_names()`` covers what the
    rules read; ``list_package_tree`` serves the rules that need paths only).
    Files of ``below`` bytes or more are left out, not opened either."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if names:
        reader = reader.option("pathGlobFilter", names)
    raw = reader.load(root)
    if below is not None:
        raw = raw.where(F.col("length") < below)
    raw = raw.select("path", "length", "content")
    return _below(raw, _resolved(spark, root), package_depth).select(
        "package_id", "path", F.col("length").alias("size"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


GIANT = 64 << 20         # bytes from which a file's lines are read in ranges


def read_tree_lines(spark: SparkSession, root: str, package_depth: int = 1, names: str | None = None,
                    giant: int = GIANT) -> DataFrame:
    """SRC3 from storage: the lines of the files below ``root``.  Files of
    ``giant`` bytes or more are read in byte ranges by many tasks, the others
    whole (opening each once); both give the same rows."""
    small = read_package_tree(spark, root, package_depth, names, below=giant)
    return to_lines(small).unionByName(giant_lines(spark, root, package_depth, names, giant))


def giant_lines(spark: SparkSession, root: str, package_depth: int = 1, names: str | None = None,
                giant: int = GIANT) -> DataFrame:
    """(package_id, path, line_no, line) of files of ``giant`` bytes or more.

    Spark's text source cuts files into byte ranges and stitches lines at the
    cuts.  A line's number is its place in its range plus the lines of the
    ranges before it: one count a range, summed along the file.  Other breaks
    of ``str.splitlines`` cut lines further, inside the range.  A byte order
    mark at the start of a file is dropped."""
    reader = spark.read.option("recursiveFileLookup", "true")
    if names:
        reader = reader.option("pathGlobFilter", names)
    # file_size is a constant of the file: smaller ones are not opened
    raw = (reader.text(root).where(F.col("_metadata.file_size") >= giant)
           .select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
                   F.make_valid_utf8("value").alias("value")))
    rare = None
    for ch in RARE_BREAKS:
        x = F.col("value").contains(ch)
        rare = x if rare is None else (rare | x)
    parts = F.when(rare, F.split("value", LINE_BREAKS, -1)).otherwise(F.array("value"))
    # a task reads a range from its start to its end, so ids rise along the range without gaps
    pieces = raw.select("path", "start", F.explode(parts).alias("line")).withColumn("at", F.monotonically_increasing_id())
    ranges = pieces.groupBy("path", "start").agg(F.min("at").alias("first"), F.count("*").alias("n")).checkpoint()
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select("path", "start", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("lines"))
    if ranges.count() <= 200_000:                  # one row a range (some 100 bytes)
        offsets = F.broadcast(offsets)
    numbered = pieces.join(offsets, ["path", "start"]).withColumn("line_no", (F.col("at") - F.col("first") + F.col("lines") + 1).cast("int"))
    # recorded paths are URIs: %20 and the like are decoded as the binary source does
    return _below(numbered.withColumn("path", F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))),
                  _resolved(spark, root), package_depth).select("package_id", "path", "line_no", "line")


def text_names() -> str:
    """Hadoop glob of the file names whose content some rule reads."""
    from ..operators.manifest_rules import MANIFEST_NAMES
    return "{" + ",".join([*(f"*{s}" for s in SCANNED_SUFFIXES), *sorted(set(MANIFEST_NAMES))]) + "}"


def is_scanned(path):
    """SRC1 predicate: not inside an excluded directory, suffix scanned."""
    segs = F.split(path, "/")
    excluded = F.arrays_overlap(F.slice(segs, 1, F.greatest(F.size(segs) - 1, F.lit(0))),
                                F.array(*[F.lit(d) for d in EXCLUDED_DIRS]))
    suffix = F.regexp_extract(path, r"(\.[^./]*)$", 1)
    return ~excluded & suffix.isin(*SCANNED_SUFFIXES)


def scanned_files(files: DataFrame) -> DataFrame:
    """SRC1: files the code and text rules look at: not inside an excluded
    directory (any path segment), suffix in the scanned set.  On a files
    table written by ``write_files_table`` the ``kind`` partition column
    prunes everything else before any content is read."""
    if "kind" in files.columns:
        files = files.where(F.col("kind").isin("scan", "scan_manifest"))
    return files.where(is_scanned(F.col("path")))


def file_kind(path):
    """Partition value: scan / scan_manifest / manifest / other."""
    from ..operators.manifest_rules import MANIFEST_NAMES
    man = path.isin(*sorted(set(MANIFEST_NAMES)))
    sc = is_scanned(path)
    return (F.when(sc & man, "scan_manifest").when(sc, "scan").when(man, "manifest").otherwise("other"))


def write_files_table(files: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store a files table partitioned by ``kind`` so the text / code rules,
    the manifest rules and the path-only rules each read only the
    partitions they need (partition pruning; content of other files is
    never read)."""
    files.withColumn("kind", file_kind(F.col("path"))).write.mode(mode).partitionBy("kind").parquet(path)


def stored_files(files: DataFrame) -> DataFrame:
    """``files`` written once below the shared checkpoint folder, by ``kind``
    as ``write_files_table`` does, and read back."""
    from ..session import shared_table
    return shared_table(files.withColumn("kind", file_kind(F.col("path"))), "files", ["kind"])


RARE_BREAKS = ["\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]


def to_lines(files: DataFrame) -> DataFrame:
    """SRC3: ``str.splitlines()`` numbering (1-based) of each file.

    The final line terminator is removed before the split, so no trailing
    empty piece has to be filtered after the explode (a filter there would
    make Catalyst re-split the whole content once per line); empty content
    has no lines.  Content whose only break is ``\\n`` (almost all) takes a
    fast path: byte searches for the rare breaks, then a literal split."""
    c = F.col("content")
    rare = None
    for ch in RARE_BREAKS:
        x = c.contains(ch)
        rare = x if rare is None else (rare | x)
    last_break = "(?:" + LINE_BREAKS + ")\\z"
    slow = F.split(F.regexp_replace(c, last_break, ""), LINE_BREAKS, -1)
    trimmed = F.when(c.endswith("\n"), F.expr("substring(content, 1, length(content) - 1)")).otherwise(c)
    fast = F.split(trimmed, "\n", -1)
    parts = F.when(rare, slow).otherwise(fast)
    return files.where(c != "").select(
        "package_id", "path", F.posexplode(parts).alias("pos", "line")).select(
        "package_id", "path", (F.col("pos") + 1).cast("int").alias("line_no"), "line")


def detect_platform(files: DataFrame, override: DataFrame | None = None) -> DataFrame:
    """SRC5: platform per package from the root manifests; first match wins.

    ``override`` (package_id, platform) replaces the detected value.
    """
    p = F.col("path")
    agg = files.groupBy("package_id").agg(
        F.bool_or(p == "SKILL.md").alias("skill"),
        F.bool_or(p.isin("mcp.json", "manifest.json")).alias("mcp"),
        F.bool_or(p == "package.json").alias("npm"),
        F.bool_or(p.isin("setup.py", "pyproject.toml", "requirements.txt")).alias("pip"),
    )
    detected = (F.when(F.col("skill"), "clawhub").when(F.col("mcp"), "mcp")
                .when(F.col("npm"), "npm").when(F.col("pip"), "pip"))
    out = agg.select("package_id", detected.alias("platform"))
    if override is not None:
        out = out.join(override.withColumnRenamed("platform", "forced"), "package_id", "left") \
            .select("package_id", F.coalesce("forced", "platform").alias("platform"))
    return out
