"""The persisted index: tables of chunks, parents, postings, vectors, by document."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.durable import cut, release

REQUIRED = ("chunks", "vectors")
OPTIONAL = ("parents", "postings", "links", "headings")


@dataclass(frozen=True)
class Artefacts:
    """Tables under one folder, in ``buckets`` partitions by the hash of the document.

    Writing a document's rows replaces that document's rows only: of the buckets it falls into, the rows of other documents
    are carried over, the rest isn't touched. Writing the same rows again changes nothing.
    """

    spark: SparkSession
    root: str
    buckets: int = 64
    slices: int = 8

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _bucket(self):
        return F.pmod(F.xxhash64("doc_id"), F.lit(self.buckets)).cast("int")

    def save(self, name: str, df: DataFrame, docs: DataFrame | None = None) -> None:
        """``docs`` (doc_id) are replaced even if they have no rows any more; the default is the documents of the rows."""
        docs = cut((docs if docs is not None else df).select("doc_id").distinct())
        rows, old = df.withColumn("bucket", self._bucket()), None
        if self.exists(name):
            held = self.spark.read.parquet(self.path(name))
            old = cut(held.join(F.broadcast(docs.select(self._bucket().alias("bucket")).distinct()), "bucket", "left_semi").join(docs, "doc_id", "left_anti"))
            rows = rows.unionByName(old, allowMissingColumns=True)
        # slices spread a document that holds most of the rows
        spread = rows.repartition("bucket", F.pmod(F.xxhash64(*[c for c in ("chunk_ord", "parent_id", "page") if c in df.columns] or ["doc_id"]), F.lit(self.slices)))
        spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path(name))
        if self.exists(name):  # a bucket all of whose documents lost their rows
            for r in docs.select(self._bucket().alias("bucket")).distinct().join(rows.select("bucket").distinct(), "bucket", "left_anti").collect():
                self._delete(f"{self.path(name)}/bucket={r.bucket}")
        release(docs, old)

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def exists(self, name: str) -> bool:
        """Whether the table has any rows; one that was written without rows is a folder without files."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path(name)}/*=*")
        return len(path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path) or []) > 0

    def load(self, name: str) -> DataFrame | None:
        if not self.exists(name):
            if name in REQUIRED:
                raise FileNotFoundError(self.path(name))
            return None
        return self.spark.read.parquet(self.path(name)).drop("bucket")

    @property
    def ready(self) -> bool:
        return all(map(self.exists, REQUIRED))
