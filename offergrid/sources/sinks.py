"""Report and versioned outputs, and incremental flushes of keyed state."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from offergrid.operators.offers import WRITE_ORDER
from offergrid.operators.report import failed_rows, pivot_report, summary
from offergrid.shared import erase
from offergrid.sources.keyed_table import KeyedTable


def run_id(now: dt.datetime) -> str:
    return now.strftime("%d%b%Y_%H%M%S")


def sink_versioned(df: DataFrame, root: str, now: dt.datetime) -> str:
    """Write a new output named by the run's time; an output that exists is never overwritten."""
    path = f"{root}/run_id={run_id(now)}"
    df.write.mode("errorifexists").parquet(path)
    return path


def sink_report(catalog: DataFrame, locations: DataFrame, offers: DataFrame, root: str, now: dt.datetime) -> dict[str, str]:
    """Results, Failed and Summary under one run. The offers are made once and kept beside them until all are written."""
    spark, aside = offers.sparkSession, f"{root}/_offers-{uuid.uuid4().hex}"
    try:
        offers.write.parquet(aside)
        held = spark.read.schema(offers.schema).parquet(aside)
        parts = {"results": pivot_report(catalog, locations, held), "failed": failed_rows(held), "summary": summary(held, ok_only=True)}
        return {name: sink_versioned(df, f"{root}/{name}", now) for name, df in parts.items()}
    finally:
        erase(spark, aside)


class IncrementalSink:
    """foreachBatch writer: every micro-batch becomes a commit of a keyed table.

    ``cadence`` maps a number of results to what is to be done each time that many more have arrived, counted over all
    batches and restarts: {10: flush, 50: rebuild}. The count is part of the table's versions; that something was done is
    noted after it, so a crash in between has it done again.
    """

    def __init__(self, root: str, keys: tuple[str, ...] = ("asin", "pincode"), order: tuple[str, ...] = WRITE_ORDER, writer: str = "", cadence: dict[int, Callable[[KeyedTable], None]] | None = None, **layout):
        self.root, self.keys, self.order, self.writer, self.cadence, self.layout = root, keys, order, writer, cadence or {}, layout

    def table(self, spark: SparkSession) -> KeyedTable:
        return KeyedTable(spark, self.root, self.keys, self.order, **self.layout)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        table = self.table(batch.sparkSession)
        held = batch.persist(StorageLevel.DISK_ONLY)  # a micro-batch is made anew, with all its columns, for each use
        try:
            table.commit(held, self.writer, batch_id)
        finally:
            held.unpersist()
        self.catch_up(table)

    def catch_up(self, table: KeyedTable) -> None:
        """Do what the results so far ask for and is not noted as done."""
        for n, act in sorted(self.cadence.items()):
            at = table.snapshot()
            if at["results"] // n > at["meta"].get(f"done_{n}", 0) // n:
                act(table)
                table.note({f"done_{n}": at["results"]})
