"""Conversation history, traces, request logs and knowledge-base tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from answerlens.functions.text import level_rank
from answerlens.operators.ordered import in_blocks, numbered


def search(logs: DataFrame, kb: str | None = None, start=None, end=None, text: str | None = None, page: int = 1, size: int = 20) -> DataFrame:
    """newest first, a page of at most 50, with the total on every row."""
    size = min(size, 50)
    if kb is not None:
        logs = logs.where(F.col("kb_id") == kb)
    if start is not None:
        logs = logs.where(F.col("created_at") >= start)
    if end is not None:
        logs = logs.where(F.col("created_at") <= end)
    if text:
        logs = logs.where(F.contains("query", F.lit(text)) | F.contains("answer", F.lit(text)))
    total = logs.count()
    return logs.orderBy(F.desc("created_at"), "trace_id").offset((page - 1) * size).limit(size).withColumn("total", F.lit(total).cast("long"))


def statistics(logs: DataFrame, as_of) -> DataFrame:
    """A20"""
    return logs.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.to_date("created_at") == F.lit(as_of)).alias("today"), F.round(F.avg("duration"), 2).alias("mean_duration"), F.round(F.avg(F.col("is_passing").cast("int")) * 100, 2).alias("pass_rate"), F.round(F.avg("score"), 4).alias("mean_score"))


def retained(traces: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Traces not older than so many days before as_of; prunes where dt is the partition column."""
    return traces.where(F.col("dt") >= F.date_sub(F.lit(as_of).cast("date"), days))


def requests(calls: DataFrame) -> DataFrame:
    """Per endpoint."""
    return calls.groupBy("endpoint").agg(F.count(F.lit(1)).alias("n"), F.count_if("error").alias("errors"), F.round(F.sum("duration"), 4).alias("total"), F.round(F.avg("duration"), 4).alias("mean"), F.max("duration").alias("longest"), F.min("duration").alias("shortest"))


def requests_total(calls: DataFrame) -> DataFrame:
    return calls.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("error").cast("int")) * 100, 2).alias("error_rate"), F.round(F.avg("duration"), 4).alias("mean"))


def moving_mean(calls: DataFrame, n: int = 1000, by: str = "endpoint") -> DataFrame:
    """Mean of the last n durations of an endpoint; an endpoint with all calls is spread over all tasks."""
    return in_blocks(calls, [by], ["ts", "event_id"], n - 1, {"moving": F.avg("duration")}).withColumn("moving", F.round("moving", 9))


def lines(logs: DataFrame, level: str, last: int) -> DataFrame:
    """of the last lines (10 to 500), those of the level or above."""
    last = min(max(last, 10), 500)
    return logs.orderBy(F.desc("line_no")).limit(last).where(level_rank(F.col("level")) >= level_rank(F.lit(level)))


def inventory(chunks: DataFrame, kbs: DataFrame) -> DataFrame:
    """Files and chunks of each knowledge base, empty ones too."""
    n = chunks.groupBy("kb_id").agg(F.count_distinct("file_name").alias("files"), F.count(F.lit(1)).alias("chunks"))
    return kbs.join(n, "kb_id", "left").fillna(0, ["files", "chunks"])


def scenario(queries: DataFrame, kbs: DataFrame) -> DataFrame:
    """The request's scenario, else its knowledge base's, else null."""
    k = kbs.select("kb_id", F.col("scenario_id").alias("_kb_scenario"))
    return queries.join(k, "kb_id", "left").withColumn("scenario_id", F.coalesce("scenario_id", "_kb_scenario")).drop("_kb_scenario")


def chunk_id(*columns: Column) -> Column:
    """S3: the same chunk gets the same id on every run."""
    return F.sha2(F.concat_ws("\x1f", *columns), 256)


def append(chunks: DataFrame, path: str) -> None:
    """S3"""
    chunks.write.mode("append").partitionBy("kb_id").parquet(path)


def replace_files(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """All chunks of the incoming files are replaced, by file id."""
    return existing.join(incoming.select("kb_id", "file_id").distinct(), ["kb_id", "file_id"], "left_anti").unionByName(incoming)


def page(chunks: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """S6"""
    return chunks.orderBy("chunk_id").offset(offset).limit(limit)


def pages(chunks: DataFrame, size: int = 100, by: str = "kb_id") -> DataFrame:
    """Every chunk with its page, from 0, and the total of its base; the pages of all bases at once."""
    return numbered(chunks, [by], ["chunk_id"]).withColumn("page", F.expr(f"pos div {size}")).withColumnRenamed("n", "total").drop("pos")


def store_for_lookup(chunks: DataFrame, path: str, row_group: int = 1 << 20) -> None:
    """Chunks in the order of base and id, in small row groups with Bloom filters over the ids."""
    ordered = chunks.repartitionByRange("kb_id", "chunk_id").sortWithinPartitions("kb_id", "chunk_id")
    ordered.write.option("parquet.block.size", row_group).option("parquet.bloom.filter.enabled#chunk_id", "true").option("parquet.bloom.filter.expected.ndv#chunk_id", 100_000).parquet(path)


def lookup(spark: SparkSession, path: str, ids: list) -> DataFrame:
    """The chunks with these ids (few: a filter that Parquet answers from the range and the Bloom filter of each row group)."""
    return spark.read.parquet(path).where(F.col("chunk_id").isin(ids))


def create(kbs: DataFrame, new: DataFrame) -> DataFrame:
    """Names must be new; others are ignored."""
    return kbs.unionByName(new.join(kbs, "kb_id", "left_anti"))


def drop(rows: DataFrame, kb: str) -> DataFrame:
    """Any table without one knowledge base."""
    return rows.where(F.col("kb_id") != kb)
