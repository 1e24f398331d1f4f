"""Progress messages as streams. Each job has the same result as its batch twin over the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offergrid.operators.offers import WRITE_ORDER
from offergrid.shared import exists
from offergrid.sources.keyed_table import KeyedTable
from offergrid.sources.sinks import IncrementalSink
from offergrid.streaming.live_report import LiveReport

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def progress_messages(events: DataFrame) -> DataFrame:
    """Worker messages from the events table: four workers, errors fail, sign-ups meet a challenge, purchases end."""
    status = F.when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "signup", "CAPTCHA").otherwise("OK")
    kind = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "error").otherwise("progress")
    return events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 4).alias("worker"), kind.alias("type"), status.alias("status"), F.col("props").alias("msg"))


def stream_progress(spark: SparkSession, sf_dir: str, files_each: int = 1) -> DataFrame:
    """The message source: files of events, as they arrive."""
    return progress_messages(spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_each).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events*"))


def status_totals(messages: DataFrame, total: int) -> DataFrame:
    """Running counters; done never passes the total, although challenges are told twice."""
    g = messages.groupBy(F.lit(0).alias("run")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "OK").alias("success"), F.count_if(F.col("status") == "FAILED").alias("failed"))
    return g.select(F.least("n", F.lit(total)).alias("done"), "success", "failed")


def latest_per_worker(messages: DataFrame) -> DataFrame:
    last = F.max_by(F.struct("msg", "status"), F.struct("ts", "event_id"))
    return messages.groupBy("worker").agg(last.alias("l")).select("worker", "l.msg", "l.status")


def completion(messages: DataFrame, workers: int) -> DataFrame:
    ended = messages.groupBy(F.lit(0).alias("run")).agg(F.count_if(F.col("type").isin("done", "error")).alias("ended"))
    return ended.select("ended", (F.col("ended") >= workers).alias("complete"))


def run_complete(stream: DataFrame, root: str) -> DataFrame:
    """Run an aggregated stream over all that is there and return its last state, a table under ``root``.

    Each batch replaces the state as a whole (it is an aggregate); started again without new rows, the last one stands.
    """
    state, spark = f"{root}/state", stream.sparkSession
    query = stream.writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(state)).option("checkpointLocation", f"{root}/cursor").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(state) if exists(spark, state) else spark.createDataFrame([], stream.schema)


def upsert_stream(stream: DataFrame, root: str, checkpoint: str, keys: tuple[str, ...], order: tuple[str, ...], **more) -> KeyedTable:
    """Commit arriving rows to a keyed table, a version a batch; after a restart the checkpoint tells where to go on.

    Started again without new rows it returns the table as it stands. ``more`` goes to the sink: its cadence and layout.
    """
    sink = IncrementalSink(root, keys, order, writer=checkpoint, **more)
    query = stream.writeStream.foreachBatch(sink).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    table = sink.table(stream.sparkSession)
    sink.catch_up(table)
    return table


def report_stream(stream: DataFrame, root: str, checkpoint: str, every: int = 50, of: Callable[[DataFrame], DataFrame] = lambda rows: rows, **more) -> LiveReport:
    """Offers from a stream into a keyed table under ``root``, and the report of them, rebuilt each ``every`` results.

    What the last results left over is in the report when the stream ends, as after a run. ``of`` makes offers of the stream's
    rows where it has narrower ones.
    """
    view = lambda table: LiveReport(stream.sparkSession, table, f"{root}/report", of)
    table = upsert_stream(stream, f"{root}/offers", checkpoint, ("asin", "pincode"), WRITE_ORDER, cadence={every: lambda t: view(t).refresh()}, **more)
    live = view(table)
    live.refresh()
    return live
