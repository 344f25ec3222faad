"""Citations, context and prompt of ranked hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.durable import cut

NOTHING_FOUND = "No relevant content found for your question."


def citation_label(page: Column, section: Column, kind: Column, caption: Column) -> Column:
    some = lambda c: F.when(c != "", c)
    return F.concat_ws(", ", F.concat(F.lit("Page "), F.coalesce(page.cast("string"), F.lit("?"))), some(section), F.coalesce(kind, F.lit("text")), some(caption))


def citations(hits: DataFrame) -> DataFrame:
    """index (the rank) and label of each hit (rank, page, section_heading, chunk_type, caption)."""
    return hits.withColumn("index", F.col("rank")).withColumn("citation", citation_label(F.col("page"), F.col("section_heading"), F.col("chunk_type"), F.col("caption")))


def contexts(cited: DataFrame, content_col: str = "content") -> DataFrame:
    """(query_id, context): the blocks of a query's hits in order. A query has at most top_k of them."""
    block = F.concat(F.lit("[Source "), F.col("index").cast("string"), F.lit(": "), F.col("citation"), F.lit("]\n"), F.trim(F.coalesce(F.col(content_col), F.lit(""))))
    ordered = F.array_sort(F.collect_list(F.struct("index", block.alias("b"))))
    return cited.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["b"]), "\n\n---\n\n").alias("context"))


# The wording of the prompt.
def prompt(question: Column, context: Column) -> Column:
    return F.concat(
        F.lit("Context (retrieved from the document):\n\n"), context, F.lit("\n\n---\n\nQuestion: "), question,
        F.lit("\n\nInstructions: Answer the question using the context above. Cite your sources using [Source N] format. If multiple sources support your answer, cite all of them."),
    )


def image_content(label: Column, description: Column) -> Column:
    return F.concat_ws("\n\n", F.when(label != "", label), description)


def chat_bucket(now_ms: Column, created_ms: Column) -> Column:
    day = 86_400_000
    age = now_ms - created_ms
    return F.when(age < day, "today").when(age < 7 * day, "previous 7 days").otherwise("older")


def chat_title(first_question: Column) -> Column:
    return F.coalesce(F.when(F.length(first_question) > 0, F.substring(first_question, 1, 50)), F.lit("New chat"))


def chats(messages: DataFrame) -> DataFrame:
    """(chat_id, title, n_messages, created, updated, place) of messages (chat_id, at, ts, content), latest chats first; ``at`` orders messages.

    The places come from a range sort and the sizes of its partitions, so no task holds all chats.
    """
    c = messages.groupBy("chat_id").agg(chat_title(F.min_by("content", "at")).alias("title"), F.count(F.lit(1)).alias("n_messages"), F.min("ts").alias("created"), F.max("ts").alias("updated"))
    parts = cut(c.repartitionByRange(F.desc("updated"), F.asc("chat_id")).withColumn("part", F.spark_partition_id()))
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # one row per partition
    before = sizes.withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n")).select("part", "before")
    within = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("updated"), "chat_id"))
    return parts.withColumn("r", within).join(F.broadcast(before), "part").withColumn("place", F.col("r") + F.col("before")).drop("part", "r", "before")
