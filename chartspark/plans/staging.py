"""Tables between the steps of a job, and a log of what a job has finished.

A step that several others read is written once as Parquet in the folder that all executors share, and read back: the plan
of a step stays its own, and a lost executor costs a read. A job that ends in tables keeps a ``Log`` beside them: numbered
files, each made only where it is not there yet, so of two writers of one number one fails and starts over.
"""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_staged: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only in local mode on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='chartspark-')}"
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read back; its files go when the driver exits."""
    path = f"{shared_dir(df.sparkSession)}/staged/{name}-{uuid.uuid4().hex}"
    out = stored(df, path)
    _staged[path] = df.sparkSession
    return out


def stored(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to ``path``, over what a broken run may have left there, and read back."""
    schema = df.schema
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


class Conflict(RuntimeError):
    """Another writer has committed this number."""


class Log:
    """Numbered entries of a job: each a small dictionary, committed once."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def entries(self) -> list[dict]:
        """All committed entries in order; a job has one for each batch or step, not for each row."""
        folder, fs = _path(self.spark, self.folder)
        if not fs.exists(folder):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(folder))
        names = [n for n in names if n.endswith(".json")]
        if not names:
            return []
        read = {r.name: json.loads(r.value) for r in self.spark.read.text(f"{self.folder}/*.json", wholetext=True).selectExpr("element_at(split(_metadata.file_path, '/'), -1) AS name", "value").collect()}
        return [read[n] for n in names if n in read]

    def last(self) -> dict | None:
        found = self.entries()
        return found[-1] if found else None

    def commit(self, entry: dict, number: int) -> None:
        """Write entry ``number`` (from 0), or raise ``Conflict`` where it is there already."""
        target, fs = _path(self.spark, f"{self.folder}/{number:08d}.json")
        part, _ = _path(self.spark, f"{self.folder}/.{uuid.uuid4().hex}")
        out = fs.create(part, False)
        out.write(bytearray(json.dumps(entry, default=str).encode()))
        out.close()
        # The whole entry appears under its number at once; neither step replaces a file that is there.
        if fs.exists(target) or not self._renamed(fs, part, target):
            fs.delete(part, False)
            raise Conflict(f"{self.folder}: entry {number} is there already")

    def _renamed(self, fs, part, target) -> bool:
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark._sc._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(part, target, none)
        except Exception:  # noqa: BLE001  (the file is there: another writer was first)
            return False
        return True


def _clean() -> None:
    for path, spark in _staged.items():
        try:
            p, fs = _path(spark, path)
            fs.delete(p, True)
        except Exception:  # noqa: BLE001  (the session may be gone already; the folder belongs to the cluster)
            return


atexit.register(_clean)
