"""Jobs that work through a table page by page, with their place kept beside their results.

What a page gives is written first, into a folder of its own; then one entry of the job's log makes it count, with the cursor
and the counters after it. A run that is lost before that entry leaves a folder that nothing refers to, and the next run takes
the same page: no row is left out and none counts twice. Of two runs at once, the one that commits second fails with
``Conflict`` and its page does not count.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from chartspark.plans.staging import Log


class Job:
    """A job over rows in the order of ``key``, which is unique. ``by``: "key" goes on after the last key, "offset" after as
    many rows as are done (for lists that keep their rows). After the last page it starts over."""

    def __init__(self, spark: SparkSession, folder: str, key: str, size: int, by: str = "key") -> None:
        self.spark, self.folder, self.key, self.size, self.by = spark, folder.rstrip("/"), key, size, by
        self.log = Log(spark, f"{self.folder}/_log")

    def cursor(self) -> object:
        """The last key done, or the number of rows done; None at the start."""
        return (self.log.last() or {}).get("cursor")

    def _after(self, rows: DataFrame, cursor: object) -> DataFrame:
        if cursor is None:
            return rows.orderBy(self.key).limit(self.size)
        if self.by == "offset":
            return rows.orderBy(self.key).offset(cursor).limit(self.size)
        return rows.where(F.col(self.key) > F.lit(cursor).cast(rows.schema[self.key].dataType)).orderBy(self.key).limit(self.size)

    def page(self, rows: DataFrame) -> tuple[DataFrame, object, bool]:
        """The next page, the cursor before it, and whether the job starts over with it."""
        cursor = self.cursor()
        page = self._after(rows, cursor)
        if cursor is not None and page.isEmpty():
            return self._after(rows, None), None, True
        return page, cursor, False

    def run(self, rows: DataFrame, step: Callable[[DataFrame], DataFrame]) -> dict:
        """One page: ``step`` gives its rows, with ``ok`` (boolean; null is a skip) and the key. The committed entry.

        Counters are observed while the page is written, so its input is read once.
        """
        number = len(self.log.entries())
        page, before, again = self.page(rows)
        seen = Observation()
        ok = F.col("ok")
        counts = [F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), F.count_if(ok.isNull()).alias("skipped"), F.max(self.key).cast("string").alias("last")]
        path = f"{self.folder}/page-{uuid.uuid4().hex}"
        step(page).observe(seen, *counts).write.parquet(path)
        got = seen.get
        if got["total"] == 0:
            cursor = None
        else:
            cursor = (before or 0) + got["total"] if self.by == "offset" else got["last"]
        entry = {"page": path, "cursor": cursor, "again": again, **{k: got[k] for k in ("total", "succeeded", "failed", "skipped")}}
        self.log.commit(entry, number)
        return entry

    def reset(self) -> None:
        """Start over with the next run."""
        self.log.commit({"page": None, "cursor": None, "again": True, "total": 0, "succeeded": 0, "failed": 0, "skipped": 0}, len(self.log.entries()))

    def results(self) -> DataFrame | None:
        """The rows of all committed pages."""
        paths = [e["page"] for e in self.log.entries() if e["page"]]
        return self.spark.read.parquet(*paths) if paths else None

    def totals(self) -> dict[str, int]:
        """Counters of all committed pages."""
        entries = self.log.entries()
        return {k: sum(e[k] for e in entries) for k in ("total", "succeeded", "failed", "skipped")}

    def status(self, rows: DataFrame, nothing: int = 100) -> dict:
        """``cursor, totalPending, percentComplete`` (of the rows that are there now) and ``nextBatch``, the places of the
        next page. ``nothing``: the percentage where no rows are there."""
        cursor = self.cursor()
        total = rows.count()
        if self.by == "offset" or cursor is None:
            done = min(cursor or 0, total)
        else:
            done = rows.where(F.col(self.key) <= F.lit(cursor).cast(rows.schema[self.key].dataType)).count()
        start = 0 if done >= total else done
        return {"cursor": cursor, "totalPending": total, "percentComplete": int(100 * done / total + 0.5) if total else nothing, "nextBatch": (start + 1, min(start + self.size, total)) if total else None}
