"""A log whose entries are numbered, so that a reader can go on from any entry, and that can be ended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from offergrid.operators.grid import small
from offergrid.shared import saved
from offergrid.sources.keyed_table import KeyedTable


def numbered(rows: DataFrame, order: tuple[str, ...], start: int, name: str = "entry") -> DataFrame:
    """Add ``name``: ``start`` plus the row's place in ``order``. Sorted over many tasks, counted in each and shifted."""
    rows = saved(rows.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()), "numbered")
    task, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    counts = rows.groupBy(task.alias("_task")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = small(counts.select(F.col("_task").alias("_of"), before.alias("_before")))  # a row a task
    placed = rows.join(starts, task == F.col("_of"))
    return placed.withColumn(name, place + F.col("_before") + F.lit(start)).drop("_id", "_of", "_before")


class EntryLog:
    """Entries 0, 1, 2 ... in the order in which batches were appended, and by ``order`` within a batch.

    A batch that comes again (same writer and id) is appended once. Reading from an entry opens what may hold it or later
    ones: Parquet's own ranges of ``entry`` leave out the rest.
    """

    def __init__(self, spark: SparkSession, root: str, order: tuple[str, ...]):
        self.table, self.order = KeyedTable(spark, root, ("entry",), ("entry",)), order

    def append(self, batch: DataFrame, writer: str = "", batch_id: int | None = None) -> int:
        """Add a batch and return how many entries there are now."""
        now = self.table.snapshot()
        if now["meta"].get("ended"):
            raise ValueError("the log has ended")
        if batch_id is None or now["writers"].get(writer, -1) < batch_id:
            rows = numbered(batch, self.order, now["results"])
            self.table.commit(rows, writer, batch_id)
        return self.entries()

    def entries(self) -> int:
        return self.table.snapshot()["results"]

    def end(self) -> None:
        """No entry follows."""
        self.table.note({"ended": True})

    def ended(self) -> bool:
        return bool(self.table.snapshot()["meta"].get("ended"))

    def read(self, start: int = 0, schema: StructType | None = None) -> DataFrame:
        """The entries from ``start`` on; none beyond the last. ``schema`` is that of batches, for a log without any."""
        wide = StructType([*schema.fields, StructField("entry", LongType())]) if schema else None
        return self.table.read(wide).where(F.col("entry") >= start)


def log_stream(stream: DataFrame, root: str, checkpoint: str, order: tuple[str, ...], last: bool = False) -> EntryLog:
    """Append what has arrived since ``checkpoint``; with ``last`` the log ends here."""
    log = EntryLog(stream.sparkSession, root, order)
    query = stream.writeStream.foreachBatch(lambda df, i: log.append(df, checkpoint, i)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if last:
        log.end()
    return log
