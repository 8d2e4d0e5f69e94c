"""Tables of iterative operators: one folder per round in the shared folder, removed when replaced."""

import uuid

from pyspark.sql import DataFrame, SparkSession

from .ranking import shared_directory


class Rounds:
    """Owns the stored tables of one computation.

    A stored table has no lineage beyond its files, so lost executors cost no more than the round
    they worked on, and a table that nothing reads any longer can go.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.base = f"{shared_directory(spark)}/repoloom-rounds/{name}-{uuid.uuid4().hex}"
        self.count = 0
        self._stored: list[tuple[DataFrame, str]] = []

    def store(self, df: DataFrame, *replaced: DataFrame) -> DataFrame:
        """The rows, written and read back; then the tables that they replace are removed."""
        folder = f"{self.base}/{self.count}"
        self.count += 1
        df.write.parquet(folder)
        found = self.spark.read.schema(df.schema).parquet(folder)
        self._stored.append((found, folder))
        self.drop(*replaced)
        return found

    def drop(self, *tables: DataFrame) -> None:
        """Removes the files of tables that `store` returned and nothing reads any longer."""
        for table in tables:
            for pair in [x for x in self._stored if x[0] is table]:
                self._stored.remove(pair)
                self._remove(pair[1])

    def _remove(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
