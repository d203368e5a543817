import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    import __spark_entry__  # noqa: F401  (registers the package for executors)

    s = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.fixture(scope="session")
def model(spark, tmp_path_factory):
    """A folder with the base tables and the music model, stored once for all queries."""
    from chartspark.plans.fixtures import RECIPES, Tables

    folder, made = str(tmp_path_factory.mktemp("model")), Tables(spark, SMALL)
    for name in os.listdir(SMALL):
        os.symlink(f"{SMALL}/{name}", f"{folder}/{name}")
    for name in RECIPES:
        made[name].coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.fixture(scope="session")
def same(spark, duck):
    """Whether a query's rows are those of its SQL."""

    def check(query, sql, folder=SMALL):
        got = query(spark, folder).toArrow()
        want = duck.execute(sql)
        names = [c[0] for c in want.description]
        assert sorted(names) == sorted(got.column_names)
        order = sorted(names)
        a = sorted(repr(tuple(r[c] for c in order)) for r in got.to_pylist())
        b = sorted(repr(tuple(r[names.index(c)] for c in order)) for r in want.fetchall())
        assert a == b

    return check
