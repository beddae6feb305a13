"""Tables that an operator writes on its way, deleted when their last reader is done."""

from pyspark.sql import DataFrame, SparkSession

from armlight.session import fresh_path


class Scratch:
    def __init__(self, spark: SparkSession):
        self.spark = spark

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        """Writes ``df`` to the shared folder and reads it back."""
        path = fresh_path(self.spark, label)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Deletes the written tables that ``tables`` read. Nothing that is still to be computed may depend on them."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        configuration = self.spark.sparkContext._jsc.hadoopConfiguration()
        for folder in {file.rsplit("/", 1)[0] for table in tables for file in table.inputFiles()}:
            path = hadoop.Path(folder)
            path.getFileSystem(configuration).delete(path, True)
