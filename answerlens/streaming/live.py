"""Streams: sentence assembly, running verdicts, ingestion, feedback thresholds, service health, request metrics."""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Callable, Iterator
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from answerlens.functions.text import clean_text
from answerlens.functions.text_udf import chunks as chunk_column
from answerlens.functions.text_udf import sentence_spans
from answerlens.operators.index import Store, stored
from answerlens.operators.ordered import lower_before

SENTENCE = "trace_id long, idx int, sentence string, start int, end int, closed boolean"


def closed_sentences(buffer: str, base: int, idx: int, ended: bool) -> tuple[list[tuple], str, int, int]:
    """The closed sentences of a buffer that begins at base, and the open rest; at the end of the answer everything."""
    spans = sentence_spans(buffer, final=True)
    done = spans if ended else [s for s in spans if s[3]]
    out = [(idx + i, text, base + a, base + b, closed) for i, (text, a, b, closed) in enumerate(done)]
    cut = len(buffer) if ended else (done[-1][2] if done else 0)
    return out, buffer[cut:], base + cut, idx + len(done)


def assemble(deltas: DataFrame) -> DataFrame:
    """A stream of (trace_id, seq, delta, is_end, ts) -> sentences with offsets in the whole answer, equal to the batch's.

    Pieces that come before their turn wait in the state; an answer whose end does
    not come is flushed when the watermark has passed its last piece.
    """

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        buffer, base, idx, turn, waiting_seq, waiting, end_at = state.get if state.exists else ("", 0, 0, 0, [], [], -1)
        held = dict(zip(waiting_seq, waiting, strict=True))
        if state.hasTimedOut:
            rows, *_ = closed_sentences(buffer + "".join(held[s] for s in sorted(held)), base, idx, True)
            state.remove()
        else:
            for pdf in pdfs:
                for s, d, e in zip(pdf["seq"], pdf["delta"], pdf["is_end"], strict=True):
                    held[int(s)] = d or ""
                    end_at = int(s) if e else end_at
            while turn in held:
                buffer += held.pop(turn)
                turn += 1
            ended = end_at >= 0 and turn > end_at
            rows, buffer, base, idx = closed_sentences(buffer, base, idx, ended)
            if ended:
                state.remove()
            else:
                state.update((buffer, base, idx, turn, list(held), list(held.values()), end_at))
                state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 600_000, 1))
        yield pd.DataFrame([(key[0], *r) for r in rows], columns=["trace_id", "idx", "sentence", "start", "end", "closed"])

    kept = "buffer string, base int, idx int, turn int, waiting_seq array<int>, waiting array<string>, end_at int"
    return deltas.withWatermark("ts", "10 minutes").groupBy("trace_id").applyInPandasWithState(run, SENTENCE, kept, "append", GroupStateTimeout.EventTimeTimeout)


def absolute(score: float | None, ratio: float, n: int) -> str:
    """The grade of a sentence from its score and its place among the scores so far."""
    if score is None or pd.isna(score):
        return "no_source"
    if score < 0.35:
        return "drift"
    if score >= 0.75 and (n < 3 or ratio >= 0.90):
        return "direct_quote"
    return "summary" if score >= 0.55 and (n < 3 or ratio >= 0.75) else "low_confidence"


#: A trace without new sentences, and a feedback key without feedback, leave the state after so many milliseconds of the rows' own time.
TRACE_IDLE = 24 * 3_600_000
KEY_IDLE = 90 * 24 * 3_600_000


def _timed(rows: DataFrame, ts: str | None) -> tuple[DataFrame, str]:
    """rows with a watermark on their time, and what ends a state: that time, or nothing where rows have none."""
    if ts is None:
        return rows, GroupStateTimeout.NoTimeout
    return rows.withWatermark(ts, "10 minutes"), GroupStateTimeout.EventTimeTimeout


def _expire(state: GroupState, pdfs: list[pd.DataFrame], ts: str | None, idle: int) -> None:
    """The state goes when the watermark is past its newest row by idle."""
    if ts is not None and pdfs:
        newest = max(int(p[ts].max().timestamp() * 1000) for p in pdfs)
        state.setTimeoutTimestamp(max(newest + idle, state.getCurrentWatermarkMs() + 1))


def running_verdicts(scored: DataFrame, ts: str | None = None, idle: int = TRACE_IDLE) -> DataFrame:
    """A stream of (trace_id, idx, score) -> the grade with the scores seen so far; a later batch verdict may differ.

    The state counts scores by their first four digits, so it holds no more than their
    distinct values (20,001 for cosines), however long an answer is.  With a time column
    ts, the state goes when the trace has been idle.
    """

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        none = pd.DataFrame({"trace_id": [], "idx": [], "level": []})
        if state.hasTimedOut:
            state.remove()
            yield none
            return
        pdfs = list(pdfs)
        values, counts = (list(x) for x in state.get) if state.exists else ([], [])
        out = []
        for idx, score in sorted((int(i), s) for pdf in pdfs for i, s in zip(pdf["idx"], pdf["score"], strict=True)):
            ratio = 0.0
            if score is not None and not pd.isna(score):
                value = round(float(score) * 10_000)
                place = bisect_left(values, value)
                if place == len(values) or values[place] != value:
                    values.insert(place, value)
                    counts.insert(place, 0)
                counts[place] += 1
                ratio = (sum(counts[:place]) + 1) / sum(counts)
            out.append((key[0], idx, absolute(score, ratio, sum(counts))))
        state.update((values, counts))
        _expire(state, pdfs, ts, idle)
        yield pd.DataFrame(out, columns=none.columns)

    scored, timeout = _timed(scored, ts)
    return scored.groupBy("trace_id").applyInPandasWithState(run, "trace_id long, idx int, level string", "scores array<int>, counts array<int>", "append", timeout)


def running_ratio(rows: DataFrame) -> DataFrame:
    """W5, in batch: each sentence's place among the scores up to it, counted by merging."""
    counted = lower_before(rows, "trace_id", "idx", "score")
    return counted.withColumn("running_ratio", F.when(F.col("score").isNotNull(), (F.col("lower") + 1) / F.col("seen"))).drop("lower", "seen")


def ingest(files: DataFrame, chunk_path: str, index_path: str, checkpoint: str, size: int = 512, overlap: int = 128):
    """A stream of (kb_id, doc_id, text) -> its chunks, and the index of all chunks so far, with A1's statistics.

    A batch adds its chunks and one segment of the index, so its work does not grow with
    what is stored; a batch that is run again takes its own place in both.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        df = df.repartition(spark.sparkContext.defaultParallelism)  # a file may have fewer parts than there are cores
        each = df.select("kb_id", "doc_id", F.inline(chunk_column(clean_text(F.col("text")), size, overlap)))
        key = F.sha2(F.concat_ws("\x1f", F.to_json(F.struct("kb_id", "doc_id", "chunk_index")), "text"), 256)
        rows = each.withColumn("batch", F.lit(number)).withColumn("chunk_id", key)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(chunk_path)
        if stored(spark, f"{chunk_path}/batch={number}"):
            Store(spark, index_path).append(spark.read.parquet(f"{chunk_path}/batch={number}"), number)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Keys of feedback share the states of so many buckets.
BUCKETS = 1024


def feedback_threshold(feedback: DataFrame, least: int = 3, ts: str | None = None, idle: int = KEY_IDLE) -> DataFrame:
    """A stream of (feedback_type, key) -> a suggestion each time a key's count reaches the threshold, which starts it anew; with a time column ts, a key that was idle starts anew as well.

    Most keys have a few rows, and a call for each would cost more than its rows do: the
    keys of a bucket share a call and a state, which counts each of them by itself and
    forgets those that are idle.
    """

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {(t, k): [n, made, newest] for t, k, n, made, newest in zip(*state.get, strict=True)} if state.exists else {}
        seen = set()
        for pdf in () if state.hasTimedOut else pdfs:
            times = pdf[ts].to_numpy().astype("datetime64[ms]").astype("int64") if ts is not None else [0] * len(pdf)
            out = []
            for t, k, at in zip(pdf["feedback_type"], pdf["key"], times, strict=True):
                own = held.setdefault((t, k), [0, 0, 0])
                own[0] += 1
                own[2] = max(own[2], int(at))
                if own[0] == least:
                    own[0], own[1] = 0, own[1] + 1
                    out.append((t, k, own[1]))
                seen.add((t, k))
            if out:
                yield pd.DataFrame(out, columns=["feedback_type", "key", "number"])
        if ts is not None:
            held = {x: own for x, own in held.items() if x in seen or own[2] + idle >= state.getCurrentWatermarkMs()}
        if held:
            rows = [(t, k, *own) for (t, k), own in held.items()]
            state.update(tuple(map(list, zip(*rows, strict=True))))
            if ts is not None:
                state.setTimeoutTimestamp(max(min(own[2] for own in held.values()) + idle, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()

    feedback, timeout = _timed(feedback, ts)
    bucket = F.pmod(F.xxhash64("feedback_type", "key"), F.lit(BUCKETS)).cast("int").alias("bucket")
    each = feedback.select(bucket, "feedback_type", "key", *([ts] if ts is not None else []))
    kept = "types array<string>, keys array<string>, n array<int>, made array<int>, newest array<long>"
    return each.groupBy("bucket").applyInPandasWithState(run, "feedback_type string, key string, number int", kept, "append", timeout)


class Breaker:
    """The health of one service, call by call."""

    def __init__(self, calls: int = 10, share: float = 0.5, slow: float = 30.0, rest: float = 60.0, good: int = 5, window: int = 100):
        self.calls, self.share, self.slow, self.rest, self.good = calls, share, slow, rest, good
        self.state, self.since, self.ok, self.last = "closed", 0.0, 0, deque(maxlen=window)

    def call(self, at: float, seconds: float, error: bool) -> str:
        """closed, open (rejected) or half_open: the state in which the call was taken; then the call counts."""
        if self.state == "open" and at - self.since >= self.rest:
            self.state, self.ok = "half_open", 0
        taken = self.state
        if taken == "open":
            return taken
        bad = error or seconds > self.slow
        if taken == "half_open":
            self.ok = 0 if bad else self.ok + 1
            if bad:
                self.state, self.since = "open", at
            elif self.ok >= self.good:
                self.state = "closed"
                self.last.clear()
        else:
            self.last.append(bad)
            if len(self.last) >= self.calls and sum(self.last) / len(self.last) >= self.share:
                self.state, self.since = "open", at
                self.last.clear()
        return taken


def health(calls: DataFrame, make: Callable[[], Breaker] = Breaker) -> DataFrame:
    """X5 replayed: calls(service, call_id, ts, duration, error) -> the state in which each was taken.

    A service's calls are read in order of time, batch by batch with the state
    carried along, so no service is held in memory.
    """
    ordered = calls.select("service", "call_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "duration", "error").repartition("service").sortWithinPartitions("service", "at", "call_id")

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, breaker = None, None
        for pdf in pdfs:
            out = []
            for service, call_id, at, seconds, error in zip(pdf["service"], pdf["call_id"], pdf["at"], pdf["duration"], pdf["error"], strict=True):
                if service != now:
                    now, breaker = service, make()
                out.append((service, call_id, breaker.call(at / 1e6, seconds, bool(error))))
            yield pd.DataFrame(out, columns=["service", "call_id", "state"])

    return ordered.mapInPandas(run, "service string, call_id long, state string")


def shares(calls: DataFrame, width: str = "1 minute", slow: float = 30.0, least: int = 10, share: float = 0.5, late: str = "10 minutes") -> DataFrame:
    """X5 by time window: calls(service, ts, duration, error) -> how many calls failed or were slow, and whether so many that the service counts as down.

    Counts are added up before the shuffle, so a service with most of the calls is no hot group.
    """
    calls = calls.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    g = calls.groupBy(F.window("ts", width).alias("w"), "service").agg(F.count(F.lit(1)).alias("n"), F.count_if("error").alias("failed"), F.count_if(F.col("duration") > slow).alias("slow"), F.count_if(F.col("error") | (F.col("duration") > slow)).alias("bad"))
    down = (F.col("n") >= least) & (F.col("bad") >= F.col("n") * share)
    return g.select(F.col("w.start").alias("start"), "service", "n", "failed", "slow", F.round(F.col("bad") / F.col("n"), 6).alias("bad_share"), down.alias("down"))


def metrics(calls: DataFrame, width: str = "1 minute", step: str | None = None, late: str = "10 minutes") -> DataFrame:
    """calls(ts, endpoint, duration, error) by window, tumbling or sliding; the watermark bounds the state."""
    w = F.window("ts", width, step) if step else F.window("ts", width)
    g = calls.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(w.alias("w"), "endpoint")
    return g.agg(F.count(F.lit(1)).alias("n"), F.count_if("error").alias("errors"), F.round(F.sum("duration"), 6).alias("total"), F.max("duration").alias("longest")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "endpoint", "n", "errors", "total", "longest")


def sessions(calls: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a user."""
    g = calls.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return g.agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


def run_once(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Process what there is and return what was written; for reports and tests."""
    spark: SparkSession = stream.sparkSession
    path = f"{folder}/stream-{uuid4().hex}"
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").outputMode("append").trigger(availableNow=True).start()
    else:
        q = stream.writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(path)).option("checkpointLocation", f"{path}-state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
