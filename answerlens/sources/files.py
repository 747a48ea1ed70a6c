"""Files in and out: documents, traces, feedback, logs, reports."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENCODINGS = ("utf-8", "gbk", "gb2312", "latin-1")
SUFFIXES = ("txt", "md", "pdf", "docx", "xlsx", "pptx", "csv")
MOST_BYTES = 10 * 1024 * 1024
TRACE = "trace_id string, kb_id string, query string, status string, start_time string, end_time string, duration double, intent string, stages array<struct<name:string,duration:double,details:string>>, answer string, error string, created_at string, _corrupt_record string"
FEEDBACK = "trace_id string, query string, feedback_type string, intent_type string, intent_correction string, answer_rating int, kb_id string, suggested_action map<string,string>, timestamp string"
RULE = "rule_id string, rule_type string, keywords array<string>, match_type string, intent_types array<string>, kb_ids array<string>, action map<string,string>, description string"


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def admit(files: DataFrame, suffixes: tuple[str, ...] = SUFFIXES, most: int = MOST_BYTES) -> DataFrame:
    """files(path, length, content) with accepted and reason: suffix, size, first bytes."""
    head = F.hex(F.substring("content", 1, 8))
    s = suffix(F.col("path"))
    zipped, pdf = head.startswith("504B0304"), head.startswith("25504446")
    wrong = (s.isin("docx", "xlsx", "pptx") & ~zipped) | ((s == "pdf") & ~pdf) | (s.isin("txt", "md", "csv") & (zipped | pdf))
    reason = F.when(~s.isin(*suffixes), "suffix").when(F.col("length") > most, "size").when(wrong, "content")
    return files.withColumn("reason", reason).withColumn("accepted", reason.isNull())


def documents(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = ("txt", "md")) -> DataFrame:
    """Text files -> path, content, char_count, line_count, decode_error; a file that cannot be read stays as an empty text."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}").load(folder)

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            rows = []
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                text, error = "", "no encoding fits"
                for e in ENCODINGS:
                    try:
                        text, error = bytes(data).decode(e), None
                        break
                    except UnicodeDecodeError:
                        continue
                rows.append((path, text, len(text), text.count("\n") + bool(text), error))
            yield pd.DataFrame(rows, columns=["path", "content", "char_count", "line_count", "decode_error"])

    accepted = admit(raw).where("accepted").select("path", "content")
    return accepted.mapInPandas(run, "path string, content string, char_count long, line_count long, decode_error string")


def counts(spark: SparkSession, folder: str, by: str) -> DataFrame:
    """S1's figures of texts of any length: by, char_count, line_count, decode_error.

    A text is what the files below folder/by=... hold, one after the other.  Files are read
    line by line, in as many tasks as they have ranges; no text is held whole.  A line end
    is part of no longer character in any of the encodings, so an encoding fits a text if
    it fits each of its lines.  A file's byte order mark, which Spark's reader leaves out,
    counts as the characters that it is in UTF-8 or Latin-1; a text with one is taken for
    neither GBK nor GB2312.  A folder whose files are all without a byte has no row.
    """
    read = spark.read.schema(f"value string, {by} string").text(folder, lineSep="\n")
    lines = read.select(by, F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("line"))

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            rows = []
            for (key, path, size), part in pdf.groupby([by, "path", "size"], dropna=False):
                data = [bytes(x) for x in part["line"]]
                sizes: list = []
                for e in ENCODINGS:
                    try:
                        sizes.append(sum(len(x.decode(e)) for x in data))
                    except UnicodeDecodeError:
                        sizes.append(None)
                rows.append((key, path, size, len(data), sum(map(len, data)), sizes))
            yield pd.DataFrame(rows, columns=[by, "path", "size", "lines", "bytes", "chars"])

    each = lines.mapInPandas(run, f"{by} string, path string, size long, lines long, bytes long, chars array<long>")
    fits = [F.when(F.count_if(F.col("chars")[i].isNull()) == 0, F.sum(F.col("chars")[i])).alias(f"c{i}") for i in range(len(ENCODINGS))]
    # every line but a file's last has an end, and the last one has if the file is that much longer
    files = each.groupBy(by, "path").agg(F.sum("lines").alias("lines"), (F.max("size") - F.sum("bytes")).alias("ends"), *fits)
    marked = F.when(F.col("ends") > F.col("lines"), 1).otherwise(0)
    mark = {"utf-8": marked, "latin-1": marked * 3}
    files = files.select(by, (F.col("ends") - marked * 3).alias("ends"), *[(F.col(f"c{i}") + mark[e] if e in mark else F.when(marked == 0, F.col(f"c{i}"))).alias(f"c{i}") for i, e in enumerate(ENCODINGS)])
    total = files.groupBy(by).agg(F.sum("ends").alias("ends"), *[F.when(F.count_if(F.col(f"c{i}").isNull()) == 0, F.sum(f"c{i}")).alias(f"c{i}") for i in range(len(ENCODINGS))])
    chars = F.coalesce(*[F.col(f"c{i}") for i in range(len(ENCODINGS))])
    error = F.when(chars.isNull(), F.lit("no encoding fits"))
    return total.select(by, F.coalesce(chars + F.col("ends"), F.lit(0)).alias("char_count"), F.when(chars.isNotNull(), F.col("ends") + 1).otherwise(0).alias("line_count"), error.cast("string").alias("decode_error"))


def traces(spark: SparkSession, folder: str, lines: bool = False) -> DataFrame:
    """Files with one JSON trace or an array of them, or, in large files that many tasks read, a trace a line; what is broken is a row with _corrupt_record."""
    return spark.read.schema(TRACE).option("multiLine", not lines).option("mode", "PERMISSIVE").json(folder)


def save_traces(rows: DataFrame, folder: str) -> None:
    """S7"""
    rows.drop("_corrupt_record").withColumn("dt", F.to_date("created_at")).write.mode("append").partitionBy("dt").parquet(folder)


def feedback(spark: SparkSession, folder: str, lines: bool = False) -> DataFrame:
    """Arrays in files, or a feedback a line."""
    return spark.read.schema(FEEDBACK).option("multiLine", not lines).json(folder)


def rules(spark: SparkSession, folder: str) -> DataFrame:
    """S8"""
    return spark.read.schema(RULE).option("multiLine", "true").json(folder)


def log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Level, time, module and message of each line; null where a line has another shape."""
    part = lambda i: F.regexp_extract("value", r"^(\d{4}-\d\d-\d\d[ T][\d:.,]+)\s+[-|]?\s*\[?(DEBUG|INFO|WARNING|ERROR|CRITICAL)\]?\s+[-|]?\s*([\w.]+)\s*[-:|]\s*(.*)$", i)
    empty = lambda c: F.when(c != "", c)
    return spark.read.text(folder).select(F.col("value").alias("line"), F.try_to_timestamp(F.regexp_replace(part(1), ",", ".")).alias("ts"), empty(part(2)).alias("level"), empty(part(3)).alias("module"), empty(part(4)).alias("message"))


def log_summary(lines: DataFrame) -> dict[str, DataFrame]:
    """Rule outcomes, contradictions by kind and severity, queries by mode and success; both shapes of each line are read."""
    m = F.col("message")
    rule = lines.select(F.regexp_extract(m, r"rule[ _]?(?:id)?[=: ]+([\w-]+)", 1).alias("rule_id"), F.regexp_extract(m, r"effective[=: ]+(\w+)", 1).alias("e")).where("rule_id <> '' AND e <> ''")
    rate = F.round(F.avg(F.lower("e").isin("true", "yes", "1").cast("int")), 4)
    rules_ = rule.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), rate.alias("rate")).withColumn("status", F.when(F.col("rate") >= 0.7, "effective").when(F.col("rate") >= 0.4, "partial").otherwise("ineffective"))
    c = lines.select(F.regexp_extract(m, r"contradiction.*?(?:type|kind)[=: ]+([\w:]+)", 1).alias("kind"), F.regexp_extract(m, r"severity[=: ]+(\w+)", 1).alias("severity")).where("kind <> ''")
    total = c.agg(F.count(F.lit(1)).alias("total"))
    kinds = c.groupBy("kind", "severity").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total)).withColumn("share", F.round(F.col("n") / F.col("total"), 4)).drop("total")
    q = lines.select(F.regexp_extract(m, r"mode[=: ]+(\w+)", 1).alias("mode"), F.regexp_extract(m, r"(?:results|hits|count)[=: ]+(\d+)", 1).alias("hits")).where("mode <> '' AND hits <> ''")
    modes = q.groupBy("mode").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("hits").cast("int") > 0).cast("int")), 4).alias("success_rate"))
    return {"rules": rules_, "contradictions": kinds, "modes": modes}


def save_report(rows: DataFrame, folder: str, report_id: str, created_at) -> None:
    """S12"""
    rows.withColumns({"report_id": F.lit(report_id), "created_at": F.lit(created_at)}).write.mode("append").partitionBy("report_id").parquet(folder)


def reports(spark: SparkSession, folder: str) -> DataFrame:
    """Newest first."""
    return spark.read.parquet(folder).groupBy("report_id").agg(F.max("created_at").alias("created_at"), F.count(F.lit(1)).alias("rows")).orderBy(F.desc("created_at"), "report_id")


def save_optimised(rows: DataFrame, folder: str) -> None:
    """(doc_id, variant, content) of P18."""
    rows.write.mode("overwrite").partitionBy("variant").parquet(folder)
