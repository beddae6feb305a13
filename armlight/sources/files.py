"""Scans and sinks."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from armlight.functions.hashing import uniform
from armlight.session import fresh_path


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """CSV with a header line, one file or a folder of part files.

    The schema is given, so the files are read once and only the selected
    columns are parsed.
    """
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=False)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True)


def read_parquet(spark: SparkSession, path: str, columns=None, schema=None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.parquet(path)
    return df.select(*columns) if columns else df


def list_files(spark: SparkSession, prefix: str) -> DataFrame:
    """The files below a prefix, with their sizes; no file content is read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(prefix)
        .select("path", "length")
    )


def rows_by_file(df: DataFrame) -> DataFrame:
    """Row count of each file behind a file-based frame."""
    return df.groupBy(F.col("_metadata.file_name").alias("file_name")).agg(
        F.count(F.lit(1)).alias("n_rows")
    )


def sample_rows(df: DataFrame, fraction: float, seed: int) -> DataFrame:
    """Bernoulli sample; depends on the partitioning of the input."""
    return df.sample(fraction=fraction, seed=seed)


def sample_by_hash(df: DataFrame, key, fraction: float, seed: int) -> DataFrame:
    """Sample that keeps the same rows however the input is partitioned."""
    return df.where(uniform(seed, key) < F.lit(float(fraction)))


def stage(df: DataFrame, label: str, partition_by=None) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Cuts the lineage, survives the loss of executors, and gives Catalyst exact
    file sizes for choosing joins.
    """
    path = fresh_path(df.sparkSession, label)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_metric_log(df: DataFrame, path: str) -> None:
    """Metric log, one folder per policy, so a reader of one policy prunes the rest."""
    df.write.partitionBy("policy").parquet(path)


def read_metric_log(spark: SparkSession, path: str, policies=None) -> DataFrame:
    log = spark.read.parquet(path)
    return log.where(F.col("policy").isin(list(policies))) if policies else log


def positional_columns(df: DataFrame, keys: int = 3):
    """Feature columns and label by position: keys first, label last."""
    return df.columns[keys:-1], df.columns[-1]


def profile(df: DataFrame) -> DataFrame:
    """Per column: rows, nulls, distinct values, minimum and maximum (as double).

    Values are counted per (column, value) first, which is combined map-side, so
    a column with few values costs few shuffled rows and no value becomes hot.
    """
    numeric = {"int", "bigint", "double", "float", "smallint", "tinyint"}
    types = dict(df.dtypes)
    cells = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col(c).cast("string").alias("text"),
            (F.col(c).cast("double") if types[c] in numeric else F.lit(None).cast("double")).alias("number"),
        )
        for c in df.columns
    ]
    long = df.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")
    values = long.groupBy("column_name", "text").agg(
        F.count(F.lit(1)).alias("n"), F.min("number").alias("number")
    )
    return values.groupBy("column_name").agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(F.col("text").isNull(), F.col("n")).otherwise(F.lit(0))).alias("n_null"),
        F.count("text").alias("n_distinct"),
        F.min("number").alias("min_value"),
        F.max("number").alias("max_value"),
    )


