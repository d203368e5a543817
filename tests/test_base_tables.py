"""Queries over the base tables alone, where every table of the model is made from them within the plan."""

import pytest

from chartspark import refresh_queries, store_queries


@pytest.mark.parametrize("name", ["delete_songs", "delete_artists"])
def test_deletes_over_tables_that_are_made_in_the_plan(name, same):
    same(store_queries.QUERIES[name], store_queries.SQL[name])


def test_changes_are_met_in_one_grouping_with_their_copies(spark):
    rows = lambda *x: spark.createDataFrame([(a, None) for a in x], "a string, b int")
    got = refresh_queries._changes(rows("a", "a", "b", "d"), rows("a", "c", "c", "d"))
    assert sorted(tuple(r) for r in got.collect()) == [("a", None, -1), ("b", None, -1), ("c", None, 2)]


def test_certifications_are_made_once_for_before_and_after(spark, monkeypatch):
    from chartspark.plans import incremental
    from conftest import SMALL

    made = []
    for module in (refresh_queries, incremental):
        monkeypatch.setattr(module, "staged", lambda df, name, f=module.staged: made.append(name) or f(df, name))
    refresh_queries.QUERIES["refreshed_certifications"](spark, SMALL)
    assert made == ["certifications", "delta"]
