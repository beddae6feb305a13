"""A corpus pipeline of five stages over ``documents``.

Quality keeps documents of score 0.5 or more; line dedup cuts repeated three-line windows and drops documents that it
leaves without a visible character (empty ones that came in stay); the Jaccard join keeps the document of the smallest
id of each group; secret scans replace every reported span; packing returns the pieces.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from armlight.llm import jaccard, line_dedup, packing, quality, secret_scan
from armlight.llm.queries import vocabulary_path
from armlight.sources.files import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model, "_score").where("_score >= 0.5").drop("_score")


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = line_dedup.drop_repeated_lines(docs).where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^ \t-\r]"))
    changed = F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", changed).select(*docs.columns)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.with_components(docs).where(F.col("component_id").eqNullSafe(F.col("doc_id"))).drop("component_id")


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary_path())


STAGES = [
    ("quality_classifier", keep_good),
    ("line_dedup", cut_lines),
    ("ngram_jaccard_join", keep_one),
    ("secret_scans", hide_secrets),
    ("packing", pack),
]

# tokenizing and fitting a classifier have no SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
