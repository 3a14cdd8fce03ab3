"""The training-data pipeline: five stages over ``documents``.

toxicity -> language ID -> SimHash near-dedup -> substring dedup -> packing.
Each stage takes (spark, docs, sf_dir), works on all that the stage before
kept, and (but the last) returns the columns of documents.

Stage rules: documents scored 0.5 or more for toxicity go; documents without a
letter (language ``und``) go, whatever the code lengths say; of rows whose
fingerprints link exactly one stays, that of the smallest id (a row without id
only if none has one; of repeated ids any one); texts lose their repeated
passages and n_chars follows, texts that lose nothing stay as they are; what is
left is tokenised and packed.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm import best_fit_packing, language_id, simhash_dedup, substring_dedup, toxicity
from vigil.llm.common import crc32_mod, store
from vigil.session import configure


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.learn(docs, labels, crc32_mod("doc_id", 5) != 0)
    return toxicity.score(docs, model).where("predicted = 0").select(*docs.columns)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    trees = language_id.learn(docs, "text", "lang", crc32_mod("doc_id", 4) != 2)
    if trees is None:                       # nothing to learn from: every text with letters may be in some language
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return language_id.identify(docs, trees).where("lang_pred <> 'und'").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    # ids may repeat or be null: rows are told apart by a key that is written once
    keyed = store(docs.withColumn("_row", F.monotonically_increasing_id()), "keyed")
    marked = store(simhash_dedup.simhash_components(keyed.select("_row", "doc_id", "text"), "_row")
                   .select("_row", "doc_id", "component_id"), "near-copies")
    first = store(marked.groupBy("component_id")
                  .agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))["_row"].alias("first"),
                       F.count("*").alias("n")).where("n > 1").select("component_id", "first"), "first-copies")
    gone = marked.join(first, "component_id").where("_row <> first").select("_row")
    return keyed.join(gone, "_row", "left_anti").select(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    return (substring_dedup.remove_repeats(docs, as_is=True)
            .withColumn("text", F.col("kept_text"))
            .withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long"))
                        .otherwise(F.col("n_chars")))
            .select(*docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    return best_fit_packing.packed_digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("best_fit_packing", pack_sequences),
]
# Model fitting, iteration to components and tokenisation are not SQL; the
# tests compare run() with a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
