"""The job queue: states of jobs from events, retries and dead letters, analysis of new documents."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.config import EngineConfig

# The stages' names and order, and a job's states.
STAGES = ("plagiarism", "paraphrase", "grammar", "style", "spam", "aiDetector", "externalSearch")
PROCESSING, DONE, FAILED = "PROCESSING", "DONE", "FAILED"
_SALTS = 32


def job_states(events: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """job_id, status, retry_count, failed_stage from events (job_id, ts, event_id, kind: error or
    done, stage: where an error happened).

    Each error counts; the last allowed one makes the job FAILED, a `done` before it DONE; what
    follows a terminal state changes nothing. Only the first errors of a job matter, and these are
    picked in salted groups first, so a job with very many events isn't one task's work.
    """
    most = config.max_retries
    at = F.struct("ts", "event_id")
    known = F.struct("ts", "event_id", "stage")
    errors = events.filter("kind = 'error'").select("job_id", known.alias("at"), F.pmod(F.xxhash64("event_id"), F.lit(_SALTS)).alias("salt"))
    few = errors.withColumn("n", F.row_number().over(W.partitionBy("job_id", "salt").orderBy("at"))).filter(F.col("n") <= most)
    first = few.withColumn("n", F.row_number().over(W.partitionBy("job_id").orderBy("at"))).filter(F.col("n") <= most)
    ended = events.groupBy("job_id").agg(F.min(F.when(F.col("kind") == "done", at)).alias("done"))
    before = F.col("at").isNotNull() & (F.col("done").isNull() | (F.struct("at.ts", "at.event_id") < F.col("done")))
    counted = ended.join(first, "job_id", "left").groupBy("job_id").agg(
        F.first("done").alias("done"), F.count(F.when(before, 1)).alias("retry_count"), F.max(F.when(before, F.col("at"))).alias("last"))
    status = F.when(F.col("retry_count") >= most, FAILED).when(F.col("done").isNotNull(), DONE).otherwise(PROCESSING)
    failed = F.when((status != DONE) & (F.col("retry_count") > 0), F.col("last.stage"))
    return counted.select("job_id", status.alias("status"), "retry_count", failed.alias("failed_stage"))


def dead_letters(states: DataFrame) -> DataFrame:
    return states.filter(F.col("status") == FAILED).select("job_id", "retry_count", "failed_stage")


def publish(ids: DataFrame, queue: str) -> None:
    """Appends job ids to a queue, a folder of files that `queued` reads as a stream."""
    ids.select(F.col("job_id").cast("long").alias("job_id"), F.current_timestamp().alias("published")).write.mode("append").parquet(queue)


def queued(spark: SparkSession, queue: str) -> DataFrame:
    """The queue as a stream. Its checkpoint says what was taken; a batch that broke off comes again."""
    return spark.readStream.schema("job_id long, published timestamp").parquet(queue)


def known_jobs(jobs: DataFrame, documents: DataFrame) -> DataFrame:
    """Jobs whose document exists; others are dropped."""
    return jobs.join(documents.select(F.col("doc_id").alias("job_id")), "job_id", "left_semi")


def dead_letter_sink(states: DataFrame, folder: str, checkpoint: str):
    """Writes the jobs of a state stream that failed for good to `folder`, once each by batch."""

    def handle(batch: DataFrame, number: int) -> None:
        dead_letters(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return states.writeStream.outputMode("update").foreachBatch(handle).option("checkpointLocation", checkpoint)


def status_until_terminal(events: DataFrame) -> DataFrame:
    """Each job's events up to and including its first terminal one. events: job_id, ts, event_id, kind."""
    end = events.filter("kind in ('done', 'failed')").groupBy("job_id").agg(F.min(F.struct("ts", "event_id")).alias("end"))
    return events.join(end, "job_id", "left").filter(F.col("end").isNull() | (F.struct("ts", "event_id") <= F.col("end"))).drop("end")


def stream_job_states(events: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """The same machine over a stream: emits a job's state whenever it changes."""
    most = config.max_retries

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        status, retries, failed = state.get if state.exists else (PROCESSING, 0, None)
        before = (status, retries, failed)
        for e in pd.concat(list(frames)).sort_values(["ts", "event_id"]).itertuples():
            if status != PROCESSING:
                break
            if e.kind == "error":
                retries, failed = retries + 1, e.stage
                status = FAILED if retries >= most else PROCESSING
            elif e.kind == "done":
                status, failed = DONE, None
        state.update((status, retries, failed))
        if (status, retries, failed) != before or before == (PROCESSING, 0, None):
            yield pd.DataFrame({"job_id": [key[0]], "status": [status], "retry_count": [retries], "failed_stage": [failed]})

    out = "job_id long, status string, retry_count long, failed_stage string"
    return events.groupBy("job_id").applyInPandasWithState(step, out, "status string, retries long, failed string", "update", "NoTimeout")


def _at_least(when: int, state) -> int:
    """A time that a timer may be set to."""
    return max(when, state.getCurrentWatermarkMs() + 1)


def status_stream(events: DataFrame, late: str = "1 hour", expiry: int = 86_400) -> DataFrame:
    """job_id, ts, event_id, kind: each event of a stream as it comes, up to and including its job's
    first terminal one; `status_until_terminal` gives the same rows, if no event comes after later ones.

    events: job_id, ts (a timestamp), event_id, kind. What is later than `late` is left out. A job is
    forgotten `expiry` seconds after its last event; until then nothing more of a closed one gets by.
    """
    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        closed = state.exists and state.get[0]
        e = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        if not closed:
            ends = e["kind"].isin(["done", "failed"]).to_numpy()
            closed = bool(ends.any())
            yield e.iloc[: ends.argmax() + 1 if closed else len(e)][["job_id", "ts", "event_id", "kind"]]
        state.update((closed,))
        state.setTimeoutTimestamp(_at_least(int(e["ms"].max()) + expiry * 1000, state))

    each = events.select("job_id", "ts", "event_id", "kind", F.unix_millis("ts").alias("ms")).withWatermark("ts", late)
    return each.groupBy("job_id").applyInPandasWithState(step, "job_id long, ts timestamp, event_id long, kind string", "closed boolean", "append", "EventTimeTimeout")


def deliveries(events: DataFrame, config: EngineConfig = EngineConfig(), delay: int = 60, visibility: int = 600, late: str = "0 seconds", expiry: int = 86_400) -> DataFrame:
    """job_id, ms, attempt, what: what a queue does with each job of a stream of events, in event time.

    events: job_id, ts (a timestamp), event_id, kind. `published` delivers a job for the first time.
    After an `error` it is delivered again `delay` seconds later, and so it is `visibility` seconds
    after a delivery that nobody answered; only errors count as failures, and the last allowed one makes
    it `dead`, a `done` before it `done`. Nothing happens to jobs that were never published. Closed jobs
    are remembered for `expiry` seconds. The stream's checkpoint holds all of this over restarts.
    """
    out = ["job_id", "ms", "attempt", "what"]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        attempt, failed, due, closed = state.get if state.exists else (0, 0, 0, False)
        done: list[tuple] = []

        def deliver_until(ms: int) -> None:
            nonlocal attempt, due
            while attempt and not closed and due <= ms:
                attempt += 1
                done.append((key[0], due, attempt, "delivered"))
                due += visibility * 1000

        if state.hasTimedOut:
            if closed:
                state.remove()
                return
            deliver_until(state.getCurrentWatermarkMs())
        else:
            for e in pd.concat(list(frames)).sort_values(["ms", "event_id"]).itertuples():
                deliver_until(e.ms)  # whichever batches events come in
                if closed or not attempt and e.kind != "published":
                    continue
                if e.kind == "published" and not attempt:
                    attempt, due = 1, e.ms + visibility * 1000
                    done.append((key[0], e.ms, 1, "delivered"))
                elif e.kind == "error":
                    failed, due = failed + 1, e.ms + delay * 1000
                    closed = failed >= config.max_retries
                elif e.kind == "done":
                    closed = True
                if closed:
                    due = e.ms + expiry * 1000
                    done.append((key[0], e.ms, attempt, "done" if e.kind == "done" else "dead"))
        if attempt:
            state.update((attempt, failed, int(due), closed))
            state.setTimeoutTimestamp(_at_least(int(due), state))
        if done:
            yield pd.DataFrame(done, columns=out)

    each = events.select("job_id", "ts", "event_id", "kind", F.unix_millis("ts").alias("ms")).withWatermark("ts", late)
    return each.groupBy("job_id").applyInPandasWithState(step, "job_id long, ms long, attempt int, what string", "attempt int, failed int, due long, closed boolean", "append", "EventTimeTimeout")


def analyze_stream(documents: DataFrame, analyze, folder: str, checkpoint: str):
    """Runs `analyze(batch) -> {table: DataFrame}` on each micro-batch of new documents.

    Documents whose content came before are skipped: the stream's state keeps the digests seen, so a
    batch's work doesn't grow with what came before it (on a cluster, with RocksDB as the state store).
    Tables are overwritten batch by batch under batch=<id>, so a batch that runs again replaces its own
    rows; the state, too, is that before the batch.
    """
    fresh = documents.withColumn("content_hash", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))).dropDuplicates(["content_hash"]).drop("content_hash")

    def handle(batch: DataFrame, number: int) -> None:
        for name, df in analyze(batch).items():
            df.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")

    return fresh.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
