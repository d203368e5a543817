"""Tables written between jobs, in the folder that all executors share."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only in single-machine local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='chartspark-')}"
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def written(df: DataFrame, name: str, *consumed: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back; then drop the written tables ``consumed``.

    Cuts the lineage (a lost executor costs one read, not the whole job) and gives the planner
    real sizes. Spark frees the shuffle files of a plan when the driver has collected it, so the
    driver collects its garbage here: else they would pile up for as long as its heap has room.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    _written[path] = spark
    del df
    dropped(*consumed)
    gc.collect()
    spark._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for t in tables:
        folders = {file.rsplit("/", 2)[-2] for file in t.inputFiles()}  # their names are unique
        for path in [p for p in _written if p.rsplit("/", 1)[-1] in folders]:
            _delete(path)


def _delete(path: str) -> None:
    spark = _written.pop(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    for path in list(_written):
        try:
            _delete(path)
        except Exception:  # the session may be gone already; the folder belongs to the cluster
            return


atexit.register(_clean)
