"""The index of a source tree: tables of files, symbols and call edges with the structural queries over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.spans import find_file
from graphloom.operators import graph, resolve
from graphloom.plans.fixpoint import cut
from graphloom.sources.files import parse_files, source_files


class Index:
    def __init__(self, spark: SparkSession, files: DataFrame, symbols: DataFrame, edges: DataFrame):
        self.spark, self.files, self.symbols, self.edges = spark, files, symbols, edges

    @classmethod
    def build(cls, spark: SparkSession, root: str) -> Index:
        return cls.of_files(spark, source_files(spark, root))

    @classmethod
    def of_files(cls, spark: SparkSession, files: DataFrame) -> Index:
        parsed = cut(parse_files(files))
        protos = parsed.select("file_id", F.posexplode("symbols").alias("local", "s")).select("file_id", "local", "s.*")
        symbols = cut(resolve.assign_ids(protos).withColumn("entry", F.col("entry_reason").isNotNull()))
        calls = parsed.select("file_id", F.explode("calls").alias("c")).select("file_id", F.col("c.caller").alias("local"), "c.callee")
        called = calls.join(symbols.select("file_id", "local", F.col("id").alias("caller")), ["file_id", "local"])
        return cls(spark, parsed.select("file_id", "rel_path", "content"), symbols, cut(resolve.resolve_calls(called, symbols)))

    @classmethod
    def cached(cls, spark: SparkSession, root: str, cache: str) -> tuple[Index, bool]:
        """The index of ``root`` from a snapshot below ``cache`` that is keyed by the contents, and whether there was one."""
        files = source_files(spark, root)
        key = files.agg(F.sha2(F.concat_ws(",", F.sort_array(F.collect_list(F.concat("rel_path", F.lit(":"), F.sha2("content", 256))))), 256)).first()[0]
        folder = f"{cache.rstrip('/')}/{key}"
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/edges/_SUCCESS")
        warm = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        if not warm:
            built = cls.of_files(spark, files)
            for name in ("files", "symbols", "edges"):  # edges last: they mark the snapshot as whole
                getattr(built, name).write.mode("overwrite").parquet(f"{folder}/{name}")
        return cls(spark, *(spark.read.parquet(f"{folder}/{n}") for n in ("files", "symbols", "edges"))), warm

    def texts(self) -> DataFrame:
        return self.files.select("file_id", F.col("content").cast("string").alias("text"))

    def find_file(self, path: str) -> DataFrame:
        return find_file(self.files, path)

    def nodes(self) -> DataFrame:
        return self.symbols.select(F.col("id").alias("node"))

    def entry_points(self) -> DataFrame:
        return self.symbols.filter("entry").select("id", "qual", "entry_reason")

    def definition_of(self, name: str) -> int | None:
        return resolve.definition_of(self.spark.createDataFrame([(name,)], "sym string"), self.symbols).first()["id"]

    def _near(self, ids: DataFrame) -> DataFrame:
        return self.symbols.join(ids, "id", "left_semi")

    def callers_of(self, symbol: int) -> DataFrame:
        return self._near(self.edges.filter(F.col("dst") == symbol).select(F.col("src").alias("id")))

    def callees_of(self, symbol: int) -> DataFrame:
        return self._near(self.edges.filter(F.col("src") == symbol).select(F.col("dst").alias("id")))

    def reaches(self, source: int, target: int) -> bool:
        return graph.reaches(self.edges, self.spark.createDataFrame([(source, target)], "src long, dst long")).first()["reaches"]

    def witness(self, source: int, target: int) -> list[int] | None:
        return graph.witness(self.edges, source, target)

    def counts(self) -> tuple[int, int, int]:
        """(files, symbols, edges)."""
        return self.files.count(), self.symbols.count(), self.edges.count()
