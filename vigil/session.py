"""SparkSession construction and cluster-shared scratch locations."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that every job of the engine relies on.  On a cluster these are
# normally supplied by spark-defaults; ``build_session`` only fills gaps.
ENGINE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
    # duplicate JSON object keys: the last one wins, as in Python's json
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # Rule dimensions are tiny and fixed; anything bigger must not be
    # broadcast implicitly.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    # checkpoint files go when nothing refers to them any more
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, app: str = "vigil",
                  shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(ENGINE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


# Runtime SQL settings the rule semantics depend on (safe to set on any session)
SEMANTIC_CONF = {"spark.sql.mapKeyDedupPolicy": "LAST_WIN",
                 # rows are whole texts: batches to Python workers stay small
                 "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
                 # ... and so do the vectors a scan decodes them into
                 "spark.sql.parquet.columnarReaderBatchSize": "512"}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the semantic settings and the checkpoint folder to a session
    created elsewhere (e.g. by a job driver), and make the package
    importable by its Python workers."""
    for k, v in SEMANTIC_CONF.items():
        spark.conf.set(k, v)
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers (what
    ``--py-files`` does), once per SparkContext; the mapInPandas parser and
    the pandas UDFs are pickled by reference to their modules."""
    sc = spark.sparkContext
    if getattr(sc, "_vigil_shipped", False):
        return
    import shutil
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="vigil-pyfiles-")
    archive = shutil.make_archive(os.path.join(out, "vigil"), "zip", root_dir=os.path.dirname(pkg_dir),
                                  base_dir=os.path.basename(pkg_dir))
    sc.addPyFile(archive)
    sc._vigil_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the operator configures this to shared storage and we only
    read it.  Only when it is unset (local tests) do we pick a local folder.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not d:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir is not set: on a cluster it must name a folder all executors share")
            d = tempfile.mkdtemp(prefix="vigil-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        sc.setCheckpointDir(d)
    return sc.getCheckpointDir()


def shared_table(df: DataFrame, name: str, partition_by: list[str]) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder, partitioned
    for the filters to come, and read it back: lineage is cut, and readers
    open only the partitions and columns they need."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
