"""Incremental ingest: page files that land in a folder go through the batch pipeline, batch by batch."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..functions.text import strip
from ..plans.durable import cut
from ..plans.pipeline import IngestPipeline
from ..sources.artefacts import Artefacts

PAGE_COLUMNS = ("doc_id", "page_num", "raw_text")
PAGES = "doc_id string, page_num int, raw_text string"


def landing(spark: SparkSession, path: str, schema: str = PAGES, files_per_trigger: int = 64, fmt: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(path)


def ingest_stream(pages: DataFrame, run_batch: Callable[[DataFrame, int], object], checkpoint: str) -> StreamingQuery:
    """Runs the batch pipeline on whatever has landed, then stops; a restart goes on from the checkpoint."""
    step = lambda df, batch: run_batch(df, batch) if not df.isEmpty() else None
    return pages.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_new(store: Artefacts, name: str = "seen") -> Callable[[DataFrame, int], DataFrame]:
    """For each batch the pages whose stripped text no earlier batch had, of equal texts the first page; remembers their hashes.

    Both tables are written by batch: a batch that is run again replaces what it wrote and sees only what earlier
    batches wrote.
    """

    def step(df: DataFrame, batch: int) -> DataFrame:
        spark = store.spark
        h = df.withColumn("h", F.sha2(strip(F.coalesce("raw_text", F.lit(""))), 256))
        first = h.groupBy("h").agg(F.min(F.struct("doc_id", "page_num", "raw_text")).alias("k"))
        if store.exists(name):
            first = first.join(spark.read.parquet(store.path(name)).where(F.col("batch") < batch).select("h"), "h", "left_anti")
        fresh = cut(first)
        for table, rows in (("pages", fresh.select("k.*")), (name, fresh.select("h"))):
            rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(store.path(table))
        return spark.read.parquet(store.path("pages")).where(F.col("batch") == batch).drop("batch")

    return step


def into_index(pipeline: IngestPipeline) -> Callable[[DataFrame, int], dict]:
    """Each batch's documents go through the whole ingest into the stored index.

    A document whose pages land in several batches is ingested again with all of its pages, which replaces its rows;
    so is every document of a batch that is run again.
    """
    store = pipeline.store

    def step(df: DataFrame, batch: int) -> dict:
        df.select(*PAGE_COLUMNS).withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(store.path("pages"))
        landed = store.spark.read.parquet(store.path("pages")).where(F.col("batch") <= batch)
        # the latest delivery of a page counts
        latest = landed.groupBy("doc_id", "page_num").agg(F.max_by("raw_text", F.struct("batch", "raw_text")).alias("raw_text"))
        return pipeline.run(latest.join(df.select("doc_id").distinct(), "doc_id", "left_semi"))

    return step


@dataclass
class JobRegistry(StreamingQueryListener):
    """Status of ingest runs: queued, running, completed or failed, with the rows of each batch."""

    jobs: dict[str, dict] = field(default_factory=dict)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.jobs[str(event.id)] = {"status": "running", "rows": 0, "batches": 0, "error": None}

    def onQueryProgress(self, event) -> None:  # noqa: N802
        job = self.jobs.setdefault(str(event.progress.id), {"status": "running", "rows": 0, "batches": 0, "error": None})
        job["rows"] += event.progress.numInputRows
        job["batches"] += 1

    def onQueryIdle(self, event) -> None: ...  # noqa: N802

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        job = self.jobs.setdefault(str(event.id), {"rows": 0, "batches": 0})
        job |= {"status": "failed" if event.exception else "completed", "error": event.exception}
