"""Streams of agent events and requests: evaluation, deduplication, counts, delivery and liveness.

Every function takes streaming or batch frames alike, unless it says so.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from aiscope.functions import columns as C
from aiscope.functions import text
from aiscope.operators import export, policy
from aiscope.sources import files

EVENT_SCHEMA = "id string, type string, name string, payload string, metadata string, timestamp timestamp"
# Kinds of agent events.
EVENT_TYPES = ["tool_call", "llm_invoke", "data_access", "api_call", "file_write", "decision", "policy_violation", "error"]
LATENESS = "10 minutes"
# Files that are watched, by extension.
WATCHED = [".py", ".js", ".ts", ".jsx", ".tsx", ".java", ".go", ".rs", ".yml", ".yaml", ".json", ".toml", ".tf", ".ipynb"]
#: Rules older than this are stale, and everything is allowed.
STALE_SECONDS = 300


def events(spark: SparkSession, path: str, stream: bool = True) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    return reader.schema(EVENT_SCHEMA).json(path)


def valid_event() -> Column:
    """Rows to keep; others belong into quarantine."""
    return F.col("id").isNotNull() & (F.col("id") != "") & F.coalesce(F.col("type").isin(EVENT_TYPES), F.lit(False)) & F.col("name").isNotNull() & F.col("timestamp").isNotNull()


def middleware(rows: DataFrame, steps: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Apply frame-to-frame steps in order; a step drops rows by filtering them."""
    return functools.reduce(lambda frame, step: frame.transform(step), steps, rows)


def deduplicated(rows: DataFrame, key: str = "id", time: str = "timestamp", lateness: str = LATENESS) -> DataFrame:
    """Each key once, as long as repeats come within the lateness; state is dropped beyond it."""
    if rows.isStreaming:
        return rows.withWatermark(time, lateness).dropDuplicatesWithinWatermark([key])
    return rows.dropDuplicates([key])


def decisions_per_window(decided: DataFrame, time: str = "ts", width: str = "1 minute", lateness: str = LATENESS) -> DataFrame:
    """Counts and slowest request per tumbling window and outcome."""
    rows = decided.withWatermark(time, lateness) if decided.isStreaming else decided
    grouped = rows.groupBy(F.window(time, width).alias("w"), "outcome").agg(F.count(F.lit(1)).alias("n"), F.max("duration_ms").alias("max_ms"))
    return grouped.select(F.col("w.start").alias("minute"), "outcome", "n", "max_ms")


def call_statistics(calls: DataFrame) -> DataFrame:
    """Per name: calls, share of errors, mean and high quantile of the duration."""
    return calls.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("success"), 0.0).otherwise(1.0)).alias("error_rate"), F.avg("duration_ms").alias("mean_ms"), F.percentile_approx("duration_ms", 0.95).alias("p95_ms"))


def last_seen(heartbeats: DataFrame, agent: str = "agent_id", time: str = "ts") -> DataFrame:
    return heartbeats.groupBy(agent).agg(F.max(time).alias("last_seen"))


def liveness(seen: DataFrame, now, missed_after: str = "interval 3 minutes") -> DataFrame:  # noqa: ANN001
    """``alive`` of each agent at a moment."""
    return seen.withColumn("alive", F.col("last_seen") >= (now if isinstance(now, Column) else F.lit(now)) - F.expr(missed_after))


def redacted(rows: DataFrame, column: str) -> DataFrame:
    return rows.withColumn(column, text.redact(F.col(column)))


def _run(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str, every: str | None) -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def evaluate_stream(requests: DataFrame, load_rules: Callable[[], DataFrame], allowed_path: str, blocked_path: str, checkpoint: str, enforcement: str = "block", every: str | None = None) -> StreamingQuery:
    """Decide logged requests batch by batch, with the rules read anew for each, into two sinks.

    ``load_rules`` returns rules with ``loaded_at``; when the newest is older
    than ``STALE_SECONDS``, or there are none, all is allowed and the reason says so.
    Each batch has a folder of its own in both sinks, so that a replay replaces it.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        rules = load_rules()
        fresh = rules.where(F.col("loaded_at") >= F.current_timestamp() - F.expr(f"interval {STALE_SECONDS} seconds"))
        decided = policy.decide(batch, fresh)
        if fresh.isEmpty():
            decided = decided.withColumn("reason", F.lit("Policy rules stale or missing (default allow)"))
        decided = decided.withColumn("outcome", policy.outcome(F.col("decision"), enforcement)).persist()
        decided.where("outcome <> 'blocked'").write.mode("overwrite").json(f"{allowed_path}/batch_id={batch_id}")
        decided.where("outcome = 'blocked'").write.mode("overwrite").json(f"{blocked_path}/batch_id={batch_id}")
        decided.unpersist()

    return _run(requests, each, checkpoint, "append", every)


def deliver(rows: DataFrame, send: Callable[[DataFrame, int], None], checkpoint: str, size: int = 100, every: str | None = "5 seconds") -> StreamingQuery:
    """Hand batches of at most ``size`` events with their idempotency keys to ``send``; a replay has the same keys."""

    def each(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(16)))
        send(export.batches(rows, size, key="id", by=["part"]), batch_id)

    return _run(rows, each, checkpoint, "append", every)


def into_table(rows: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Run a stream over what is there; in complete mode each batch replaces the table, else a replayed batch replaces itself."""
    place = lambda n: path if mode == "complete" else f"{path}/batch_id={n}"
    return _run(rows, lambda batch, n: batch.write.mode("overwrite").parquet(place(n)), checkpoint, mode, None)


def watch(spark: SparkSession, root: str, on_change: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = "2 seconds") -> StreamingQuery:
    """Call ``on_change`` with the new and changed files of each trigger; excluded folders and other extensions are left out, and triggers are ``every`` so far apart."""
    found = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(root)
    kept = found.where(files.kept_path(files.relative(F.col("path"), root)) & F.regexp_extract("path", r"(\.[^./]+)$", 1).isin(WATCHED))
    return _run(kept, lambda batch, n: on_change(batch.dropDuplicates(["path"]), n), checkpoint, "append", every)


def deleted_files(before: DataFrame, now: DataFrame) -> DataFrame:
    """Paths that a listing no longer has; file streams do not tell of deletions."""
    return before.select("path").join(now.select("path"), "path", "left_anti")


def sidecar_events(evaluated: DataFrame, mode: str = "block") -> DataFrame:
    """The event kind of each evaluated tool call, with the number of violations."""
    n = F.size("violations")
    kind = F.when(n == 0, "tool_call_approved").when(F.lit(mode) == "block", "tool_call_denied").otherwise("tool_call_warned")
    return evaluated.withColumn("event_type", kind).withColumn("n_violations", n)


def tool_calls_as_requests(calls: DataFrame) -> DataFrame:
    """Tool calls ``call_id, kind, target`` in the shape of requests, under an action address."""
    return calls.select(F.col("call_id").alias("request_id"), F.lit("CALL").alias("method"), C.action_url(F.col("kind"), F.col("target")).alias("url"))
