"""Streams must give the batch answer."""

import pytest
from pyspark.sql import functions as F

from tabwarden.operators import reports
from tabwarden.plans.screen import floors_of, screen_columns, tabulate_candidates
from tabwarden.sources.tables import Table
from tabwarden.streaming.incremental import ArrivingTable
from tabwarden.streaming.throughput import throughput_stream


@pytest.fixture
def arriving(spark, tmp_path):
    df = spark.range(900).selectExpr(
        "id + 500 as id", "substr(md5(string(id)), 1, 24) as code", "concat('cat', id % 4) as cat",
        "if(id > 700, concat('rare', id), 'common') as note", "id / 8.0D as x", "timestamp_seconds(id * 20) as ts")
    folder = str(tmp_path / "in")
    df.repartition(6).write.parquet(folder)
    return spark.read.parquet(folder), folder


def test_throughput_stream(spark, arriving, tmp_path):
    df, folder = arriving
    stream = throughput_stream(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(folder), delay="10 hours")
    q = stream.writeStream.format("memory").queryName("tp").outputMode("complete").option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.minute.strftime("%Y-%m-%d %H:%M"), r.columns_processed) for r in spark.table("tp").collect()}
    want = {tuple(r) for r in reports.throughput(df).filter("minute <> 'TOTAL'").collect()}
    assert got == want and len(got) == 300


def test_arriving_table_equals_whole_table(spark, arriving, tmp_path):
    df, folder = arriving
    state = ArrivingTable(spark, str(tmp_path / "state"), df.schema, "t")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    state.start(stream, str(tmp_path / "cp")).awaitTermination()
    columns = ["col_idx", "n_rows", "n_nonnull", "max_abs", "reason_code", "reason", "prolific_n"]

    def rows(screened):
        return sorted(map(tuple, screened.select(*columns).collect()), key=repr)

    whole = screen_columns(spark, [Table(df, "t")])
    want = rows(whole)
    assert rows(state.columns()) == want
    floors = sorted((r.col_id, r.floor_met, r.pii_type) for r in state.floors().collect())
    strings = {r.col_id for r in whole.filter("kind = 'string'").collect()}
    assert floors == sorted((r.col_id, r.floor_met, r.pii_type) for r in floors_of(whole).collect() if r.col_id in strings)

    batches = state._parts("counts")
    assert len(batches) > 1
    replay = spark.read.parquet(folder).limit(0)
    last = batches[-1][1]
    kept = spark.read.parquet(batches[-1][2]).collect()
    state.add_batch(replay, last + 1)                      # an empty batch changes nothing
    assert rows(state.columns()) == want and kept
    state.compact()
    assert len(state._parts("counts")) == 1 and rows(state.columns()) == want
    assert [d.name for d in (tmp_path / "state" / "counts").iterdir()] == [f"base={last + 1}"]
    state.add_batch(df.limit(10), last + 2)
    assert state.columns().first().n_rows == 910
    state.add_batch(df.limit(10), last + 2)                # replayed batch counts once
    assert state.columns().first().n_rows == 910


def people(spark, tmp_path):
    df = spark.range(2400).selectExpr(
        "id", "concat('person ', id % 900) as name", "if(id % 5 = 0, concat('mail', id, '@x.example.com'), concat('word', id % 60)) as note",
        "repeat(concat('long text ', id % 70, ' '), 40 + id % 3) as essay", "id * 3 + 4000 as code", "id % 3 = 0 as flag",
        "40.12345 + id / 1024.0D as lat", "-99.54321 + id / 1024.0D as lon", "id * 1000.5 as amount", "cast(null as string) as none",
        "timestamp_seconds(id * 20) as ts", "1.5 as WorkerId", "array(id % 4) as list")
    folder = str(tmp_path / "in")
    df.repartition(5).write.parquet(folder)
    return spark.read.parquet(folder)


@pytest.mark.parametrize("fold", [False, True])
def test_samples_and_coordinates_of_an_arriving_table(spark, tmp_path, fold):
    df = people(spark, tmp_path)
    land = spark.createDataFrame([(y, 70, 85) for y in range(128, 136)], "lat_idx int, lon_start int, lon_end int")
    whole = Table(df, "t", row_key=("id",))
    state = ArrivingTable(spark, str(tmp_path / "state"), df.schema, "t", row_key=("id",), samples=True, points=True)
    for batch in (0, 1, 1, 2, 3):      # the last batch has no rows at all
        state.add_batch(df.filter(F.col("id") % 3 == batch), batch)
        if fold:
            state.compact()
    if fold:
        assert all(len(state._parts(kind)) == 1 for kind in state.kinds)

    want = screen_columns(spark, [whole], land)
    got = state.columns(land)
    assert sorted(map(tuple, got.select("col_id", "reason_code", "reason").collect())) == sorted(
        map(tuple, want.select("col_id", "reason_code", "reason").collect()))
    assert {r.col_name for r in got.filter("reason_code = 'gps'").collect()} == {"lat", "lon"}

    def shown(df):
        return sorted(map(tuple, df.select("col_id", "grp", "rank", "digest", "value", "cnt", "pct", "n_unique").collect()), key=repr)

    samples = shown(state.tabulation(got))
    assert samples == shown(tabulate_candidates(spark, [whole], want)) and all(r[4] is not None for r in samples)
    assert len({r[0] for r in samples}) == got.filter("is_candidate").count() == 10


def test_state_that_keeps_no_samples(spark, tmp_path):
    df = spark.range(3).selectExpr("id")
    state = ArrivingTable(spark, str(tmp_path / "state"), df.schema, "t")
    state.add_batch(df, 0)
    with pytest.raises(ValueError):
        state.tabulation()
    with pytest.raises(ValueError):
        state.pair_shares(df)
