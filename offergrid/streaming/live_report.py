"""The report and its totals kept up to date from a keyed table of offers, by what has changed."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from offergrid.operators import report
from offergrid.shared import erase
from offergrid.sources.keyed_table import KeyedTable

_TOTALS = ("ok", "all")
_SUMS = ("price_sum", "rating_sum")
_COUNTS = ("total", "success", "failed", "out_of_stock", "price_count", "rating_count")


class LiveReport:
    """A view of ``offers`` (a KeyedTable by product and location, with ``loc_ord``), itself a keyed table by product.

    ``refresh`` reads which keys were written since the version that the view shows, and of the offers only those of
    their products, once. Cells and first offers of these products are made anew and replace their row, which also holds what
    the product adds to the totals; the totals are changed by what these rows add now, less what they added before. Rows
    and totals are one commit of the view together with the version of the offers that they show, so a refresh that is
    cut off is done again as a whole.

    The table may hold narrower rows that ``of`` makes offers of, one of each: these are then moved and kept instead.
    """

    def __init__(self, spark: SparkSession, offers: KeyedTable, root: str, of: Callable[[DataFrame], DataFrame] = lambda rows: rows):
        self.spark, self.offers, self.of = spark, offers, of
        self.products = KeyedTable(spark, root, ("asin",), ("shows",))

    def shows(self) -> int:
        """The version of the offers that the view shows; 0 before the first refresh."""
        return self.products.snapshot()["meta"].get("shows", 0)

    def refresh(self) -> int:
        """Bring the view up to the offers' newest version; return the version it shows."""
        seen, now = self.shows(), self.offers.snapshot()["version"]
        if not self.offers.added(seen, now):
            return seen
        aside = f"{self.products.root}/touched-{uuid.uuid4().hex}"
        try:
            products = self.offers.changed(seen, now).select("asin").distinct()
            products.write.parquet(aside)
            touched = self.spark.read.schema(products.schema).parquet(aside)
            sums = tuple(F.struct(*[s.alias(c) for c, s in zip(report.SUMS, report.summary_sums(name == "ok"), strict=True)]) for name in _TOTALS)
            rows = report.product_rows(self.of(self.offers.read(version=now, only=touched)), sums).withColumnsRenamed({f"more{i}": name for i, name in enumerate(_TOTALS)})
            self.products.commit(rows.withColumn("shows", F.lit(now)), "refresh", now, lambda written: self._totals(written, touched) | {"shows": now}, touched.count())
        finally:
            erase(self.spark, aside)
        return now

    def _totals(self, rows: DataFrame, touched: DataFrame) -> dict:
        """The totals with ``rows`` in place of those that the view holds of the ``touched`` products."""
        held = self.products.snapshot()["meta"]
        added, gone = _added(rows), _added(self.products.read(rows.schema, only=touched))
        totals = {}
        for name in _TOTALS:
            old, change = held.get(name, {}), {c: (added[f"{name}_{c}"] or 0) - (gone[f"{name}_{c}"] or 0) for c in report.SUMS}
            totals[name] = {c: old.get(c, 0) + change[c] for c in _COUNTS} | {c: str(Decimal(old.get(c, "0")) + change[c]) for c in _SUMS}
        return totals

    def report(self, catalog: DataFrame, locations: DataFrame, pending: str = "Pending") -> DataFrame:
        """``pivot_report`` of the offers as of ``shows``."""
        return report.pivot_of_products(catalog, locations, self.products.read().where(F.size("cells") > 0).drop("shows", *_TOTALS), pending)

    def summary(self, ok_only: bool) -> DataFrame:
        """``summary`` of the offers as of ``shows``."""
        held = self.products.snapshot()["meta"].get("ok" if ok_only else "all", {})
        row = [held.get(c, 0) for c in _COUNTS] + [Decimal(held.get(c, "0")) for c in _SUMS]
        kinds = ", ".join([f"{c} bigint" for c in _COUNTS] + [f"{c} decimal(38,4)" for c in _SUMS])
        return self.spark.createDataFrame([row], kinds).select(*report.summary_columns())


def _added(rows: DataFrame) -> Row:
    """What rows of products add to the totals."""
    return rows.agg(*[F.sum(f"{name}.{c}").alias(f"{name}_{c}") for name in _TOTALS for c in report.SUMS]).first()
