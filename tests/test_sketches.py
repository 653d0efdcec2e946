"""Sketched distinct counts."""

import pytest
from pyspark.sql import functions as F

from tabwarden.operators import sketches
from tabwarden.operators.values import count_columns, distinct_stats
from tabwarden.sources.tables import Table, catalog
from tabwarden.streaming.incremental import ArrivingTable


def wide(spark):
    return spark.range(60_000).selectExpr(
        "id", "id % 7 as few", "cast(id % 20000 as int) as many", "concat('t', id % 9000) as text", "id / 3.0D as x",
        "cast(null as string) as none", "if(id % 2 = 0, null, date_add(date'2020-01-01', cast(id % 400 as int))) as day", "id % 2 = 0 as flag")


def test_bounds_hold_the_exact_counts(spark):
    table = Table(wide(spark), "t")
    exact = {r.col_id: r.n_unique for r in distinct_stats(count_columns([table], catalog([table]))).collect()}
    got = {r.col_id: r for r in sketches.distinct_estimates(sketches.column_sketches([table, table])).collect()}
    assert len(got) == 16 and got[5].n_unique == got[5].at_most == 0
    for i, r in got.items():
        n = exact.get(i % 8, 0)
        assert r.at_least <= n <= r.at_most and abs(r.n_unique - n) <= 4 * sketches.relative_error() * n
        assert r.at_most - r.at_least <= 0.15 * n + 2


def test_sketches_of_batches_are_those_of_the_table(spark, tmp_path):
    df = wide(spark)
    state = ArrivingTable(spark, str(tmp_path), df.schema, "t", sketches=True)
    for batch in (0, 1, 1, 2):
        state.add_batch(df.filter(F.col("id") % 3 == batch), batch)
        if batch == 1:
            state.compact()
    want = sketches.distinct_estimates(sketches.column_sketches([Table(df, "t")]))
    assert sorted(map(tuple, state.distinct_estimates().collect())) == sorted(map(tuple, want.collect()))
    with pytest.raises(ValueError):
        ArrivingTable(spark, str(tmp_path), df.schema, "t").distinct_estimates()


def test_no_value_is_shuffled(spark):
    plan = sketches.column_sketches([Table(wide(spark), "t")])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and plan.count("Exchange SinglePartition") == 1
