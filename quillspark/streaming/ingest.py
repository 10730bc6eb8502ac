"""Incremental ingest: new files become entries once, running counts follow."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import classify, entries, segment

#: The state store keeps the ids on disk and reads those it is asked for.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def paragraphs_of(texts: DataFrame, source: str = "source_file", text: str = "text") -> DataFrame:
    """(id, source_file, seq, content): paragraphs of texts with a stable id (source, text and place)."""
    rows = segment.split_paragraphs(texts, source, text)
    return rows.select(F.substring(F.sha2(F.concat_ws("\x1f", source, "seq", "text"), 256), 1, 32).alias("id"), F.col(source).alias("source_file"), "seq", F.col("text").alias("content"))


def described(rows: DataFrame) -> DataFrame:
    """paragraphs_of() with what follows from their text alone: title, type and keywords."""
    rows = rows.withColumn("title", segment.title_of(F.col("content")))
    rows = rows.withColumns({"type": classify.knowledge_type(F.col("title"), F.col("content")), "keywords": classify.keywords(F.concat_ws(" ", "title", "content"))})
    return rows.select("id", "source_file", "seq", "title", "content", "type", "keywords")


def entries_of(texts: DataFrame, source: str = "source_file", text: str = "text") -> DataFrame:
    """Entries of texts: paragraphs with type, keywords and a stable id (source, text and place)."""
    return described(paragraphs_of(texts, source, text))


def ingest(spark: SparkSession, path: str, store: str, checkpoint: str, make: Callable[[DataFrame], DataFrame] = entries_of, known: DataFrame | None = None) -> StreamingQuery:
    """Takes in the JSON-lines files (source_file, text) that are new since the last run and ends.

    The ids that went in are keyed state of the stream, in the checkpoint: a batch looks up its own ids alone, so what it reads does
    not grow with the store. It is written to its own folder, so one that is run again replaces itself. The state is cut into as many parts as the
    session has shuffle partitions in the first run. known: entries (id) of a store that this checkpoint doesn't know of, from
    another writer or from before a checkpoint was lost; they are left out by a join in each batch. Entries of entries_of() are described
    after that, so what is in the store already is only split and looked up."""
    make, tell = (paragraphs_of, described) if make is entries_of else (make, None)
    stream = spark.readStream.schema("source_file string, text string").json(path)
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)

    def put(batch: DataFrame, n: int) -> None:
        new = batch if known is None else entries.delete_ids(batch, known)
        (tell(new) if tell else new).write.mode("overwrite").parquet(f"{store}/batch={n}")

    spark.conf.set(provider, ROCKS)
    try:
        return make(stream).dropDuplicates(["id"]).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.unset(provider) if before is None else spark.conf.set(provider, before)


def running_counts(stream: DataFrame, *by: str) -> DataFrame:
    """A streaming count by columns (write it in complete or update mode)."""
    return stream.groupBy(*by).count()


def topic_texts(rows: DataFrame) -> DataFrame:
    """(source_file, text, timestamp) of a topic's messages (topic, value, timestamp); messages without a value are left out."""
    return rows.where(F.col("value").isNotNull()).select(F.col("topic").alias("source_file"), F.col("value").cast("string").alias("text"), "timestamp")


def read_topic(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Texts of a topic as they come; needs Spark's Kafka package on the class path."""
    return topic_texts(spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load())


def recent_counts(texts: DataFrame, by: str = "source_file", window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(window start, by, n) of topic_texts(): messages by event time; those later than `late` count no more, and their state is dropped."""
    rows = texts.withWatermark("timestamp", late).groupBy(F.window("timestamp", window).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("w.start").alias("start"), by, "n")
