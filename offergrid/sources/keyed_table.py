"""A keyed table that takes small batches: a log of runs, merged on reading, under one manifest for each version."""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from offergrid.operators.grid import small
from offergrid.operators.offers import WRITE_ORDER, upsert_latest
from offergrid.shared import erase, listed, publish, read_text

MOST_BITS = 12
EMPTY = {"version": 0, "runs": [], "added": "", "results": 0, "writers": {}, "meta": {}, "schema": None}


class KeyedTable:
    """The last write of each key, as of any version that is still kept.

    A commit writes the batch as one run (Parquet files that never change) and then publishes a manifest that lists all
    runs: the manifest is one file that appears at once, so a reader sees a version as a whole or not at all, and a crash
    between the two writes leaves the table as it was. Reading unites the runs and keeps each key's last row by ``order``,
    then by the later commit. When ``fanout`` of the newest runs are of one size class they are merged into one, so a
    row is rewritten once for each class, and what is written follows the batches, not the table.

    A batch or merged run of more than ``part_rows`` rows lies in 2^bits folders by a hash of the ``cluster`` columns, each
    about ``part_rows`` rows: a read for some keys opens only their folders. How many folders a run has stands in its manifest.

    A writer that commits a batch again (same ``writer`` and ``batch_id``, or a smaller id) changes nothing. Of writers at
    one time, each publishes its own version, in turn.
    """

    def __init__(self, spark: SparkSession, root: str, keys: tuple[str, ...] = ("asin", "pincode"), order: tuple[str, ...] = WRITE_ORDER, cluster: tuple[str, ...] = (), fanout: int = 8, part_rows: int = 1 << 17):
        self.spark, self.root, self.keys, self.order = spark, root.rstrip("/"), tuple(keys), tuple(order)
        self.cluster, self.fanout, self.part_rows = tuple(cluster) or self.keys[:1], fanout, part_rows

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in listed(self.spark, f"{self.root}/log") if n.endswith(".json") and n[0] != ".")

    def snapshot(self, version: int | None = None) -> dict:
        """The manifest of a version, by default the newest; before the first commit an empty one."""
        if version is None:
            version = max(self.versions(), default=0)
        return json.loads(read_text(self.spark, self._log(version))) if version else dict(EMPTY)

    def _log(self, version: int) -> str:
        return f"{self.root}/log/{version:020d}.json"

    def _part(self, bits: int) -> Column:
        return F.expr(f"cast(shiftrightunsigned(xxhash64({', '.join(f'`{c}`' for c in self.cluster)}), {64 - bits}) as int)")

    def read(self, schema: StructType | None = None, version: int | None = None, only: DataFrame | None = None) -> DataFrame:
        """The rows of a version; with ``only`` (the cluster columns), those of its values. ``schema`` is for a table without commits."""
        at = self.snapshot(version)
        if not at["runs"]:
            return self.spark.createDataFrame([], StructType.fromJson(at["schema"]) if at["schema"] else schema)
        rows = self._runs(at["runs"], StructType.fromJson(at["schema"]), only)
        if len(at["runs"]) > 1:
            # Rows of some cluster values are read to be joined or grouped by these: one shuffle serves that too.
            by = self.cluster if only is not None and set(self.cluster) <= set(self.keys) else ()
            rows = upsert_latest(rows, self.keys, (*self.order, "_run"), by)
        return rows.drop("_run")

    def _runs(self, runs: list[dict], schema: StructType, only: DataFrame | None = None) -> DataFrame:
        """The rows of some runs, with their version as ``_run``."""
        bits = max(r["bits"] for r in runs)
        parts = None
        if only is not None and bits:  # at most 2^bits numbers
            parts = [r[0] for r in only.select(self._part(bits).alias("p")).distinct().collect()]
        out = []
        for r in runs:
            df = self.spark.read.schema(StructType([*schema.fields, StructField("_part", IntegerType())]) if r["bits"] else schema).parquet(r["path"])
            if r["bits"] and parts is not None:
                df = df.where(F.col("_part").isin(sorted({p >> (bits - r["bits"]) for p in parts})))
            out.append(df.select(*schema.names, F.lit(r["version"]).alias("_run")))
        rows = reduce(DataFrame.unionByName, out)
        return rows if only is None else rows.join(small(only.select(*self.cluster).distinct()), list(self.cluster), "left_semi").select(*schema.names, "_run")

    def commit(self, batch: DataFrame, writer: str = "", batch_id: int | None = None, meta: dict | Callable[[DataFrame], dict] | None = None, about: int | None = None) -> int:
        """Add a batch and return the version that holds it. ``meta`` goes into the manifest, as of this version.

        Where ``meta`` depends on the batch it may be a function of the batch as written. A batch of distinct keys of which is
        known ``about`` how many rows it has isn't counted first, so it is made once.
        """
        if self._known(now := self.snapshot(), writer, batch_id):
            return now["version"]
        path, seen = f"{self.root}/data/{uuid.uuid4().hex}", batch.count() if about is None else None
        columns = [f["name"] for f in now["schema"]["fields"]] if now["schema"] else batch.columns
        # Rows of one key meet in one folder if the key names it; else they meet first and are laid out after.
        rows, bits = batch.select(*columns), self._bits(about if seen is None else seen) if set(self.cluster) <= set(self.keys) else 0
        self._write(rows, path, bits, self.order)
        written = self.spark.read.schema(rows.schema).parquet(path)
        run = {"path": path, "rows": written.count(), "bits": bits}
        seen, meta = run["rows"] if seen is None else seen, meta(written) if callable(meta) else meta
        schema = now["schema"] or json.loads(batch.schema.json())
        while True:
            now = self.snapshot()
            if self._known(now, writer, batch_id):
                erase(self.spark, path)
                return now["version"]
            version = now["version"] + 1
            runs = [*now["runs"], run | {"version": version}] if run["rows"] else now["runs"]
            writers = now["writers"] if batch_id is None else now["writers"] | {writer: batch_id}
            if self._publish(now | {"version": version, "runs": runs, "added": path if run["rows"] else "", "results": now["results"] + seen, "writers": writers, "meta": now["meta"] | (meta or {}), "schema": schema}):
                break
        self.compact()
        return version

    def _bits(self, rows: int) -> int:
        return min(MOST_BITS, max(0, math.ceil(math.log2(rows / self.part_rows)))) if rows else 0

    def _write(self, rows: DataFrame, path: str, bits: int, order: tuple[str, ...]) -> None:
        """The last row of each key as a run in 2^bits folders: one shuffle, by folder, serves the merge and the files."""
        by = self.keys
        if bits:
            rows, by = rows.withColumn("_part", self._part(bits)).repartition("_part"), ("_part", *self.keys)
        last = upsert_latest(rows, by, order).drop("_run")
        (last.write.partitionBy("_part") if bits else last.write).parquet(path)

    def note(self, meta: dict) -> int:
        """A version that differs in its ``meta`` alone."""
        while True:
            now = self.snapshot()
            if self._publish(now | {"version": now["version"] + 1, "added": "", "meta": now["meta"] | meta}):
                return now["version"] + 1

    @staticmethod
    def _known(now: dict, writer: str, batch_id: int | None) -> bool:
        return batch_id is not None and now["writers"].get(writer, -1) >= batch_id

    def _publish(self, manifest: dict) -> bool:
        return publish(self.spark, self._log(manifest["version"]), json.dumps(manifest))

    def _due(self, runs: list[dict]) -> int:
        """How many of the newest runs are to be merged: those of no larger class than the last, if they are ``fanout``.

        The last alone, if it is a large batch that isn't in folders yet.
        """
        size = lambda r: int(math.log(max(1, r["rows"]), self.fanout))
        n = 0
        while n < len(runs) and size(runs[-1 - n]) <= size(runs[-1]):
            n += 1
        return n if n >= self.fanout else int(self._unlaid(runs))

    def _unlaid(self, runs: list[dict]) -> bool:
        return bool(runs) and not runs[-1]["bits"] and runs[-1]["rows"] > self.part_rows

    def compact(self, whole: bool = False) -> None:
        """Merge newest runs while they are due; with ``whole``, all runs into one. Rows and results stay the same."""
        while n := (len(self.snapshot()["runs"]) if whole else self._due(self.snapshot()["runs"])):
            now = self.snapshot()
            tail = now["runs"][-n:]
            if whole and n == 1 and not self._unlaid(tail):
                return
            total, path = sum(r["rows"] for r in tail), f"{self.root}/data/{uuid.uuid4().hex}"
            schema, bits = StructType.fromJson(now["schema"]), self._bits(total)
            self._write(self._runs(tail, schema), path, bits, (*self.order, "_run"))
            run = {"path": path, "rows": self.spark.read.schema(schema).parquet(path).count(), "bits": bits, "version": tail[-1]["version"]}
            while True:  # what others commit meanwhile stands after these runs
                now = self.snapshot()
                at = [i for i in range(len(now["runs"])) if now["runs"][i : i + n] == tail]
                if not at:
                    erase(self.spark, path)
                    return
                runs = [*now["runs"][: at[0]], run, *now["runs"][at[0] + n :]]
                if self._publish(now | {"version": now["version"] + 1, "runs": runs, "added": ""}):
                    break

    def added(self, since: int, until: int | None = None) -> list[str]:
        """Where the batches lie that were committed after version ``since``, up to ``until``."""
        until = self.snapshot()["version"] if until is None else until
        return [p for v in self.versions() if since < v <= until and (p := self.snapshot(v)["added"])]

    def changed(self, since: int, until: int | None = None) -> DataFrame:
        """Keys that were written after version ``since``, up to ``until``: read from these batches' own runs."""
        schema, paths = StructType.fromJson(self.snapshot(until)["schema"]), self.added(since, until)
        if not paths:
            return self.spark.createDataFrame([], StructType([schema[k] for k in self.keys]))
        # One by one: some batches lie in folders, others don't.
        return reduce(DataFrame.unionByName, [self.spark.read.schema(schema).parquet(p).select(*self.keys) for p in paths]).distinct()

    def vacuum(self, keep_from: int, older_than_s: float = 3600.0) -> None:
        """Forget versions before ``keep_from`` (the newest stays) and delete files of no kept version, if old enough.

        Files of a commit that is under way are of no version yet, so ``older_than_s`` must be longer than a commit takes.
        """
        kept = [v for v in self.versions() if v >= keep_from] or self.versions()[-1:]
        for v in self.versions():
            if v < kept[0]:
                erase(self.spark, self._log(v))
        used = {p.rpartition("/")[2] for v in kept for at in [self.snapshot(v)] for p in [at["added"], *[r["path"] for r in at["runs"]]]}
        for name, written_ms in listed(self.spark, f"{self.root}/data").items():
            if name not in used and written_ms < (time.time() - older_than_s) * 1000:
                erase(self.spark, f"{self.root}/data/{name}")
