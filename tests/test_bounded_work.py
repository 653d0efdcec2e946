"""Work that stays bounded or spread as tables grow."""
from pyspark.sql import functions as F

from tabwarden.operators import profile, sketches
from tabwarden.sources.tables import Table, catalog
from tabwarden.streaming.incremental import ArrivingTable


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_long_texts_of_batches_are_kept_once(spark, tmp_path):
    df = spark.range(300).selectExpr("id", "concat('name ', id) as name",
                                     "concat(repeat('long text ', 40), id % 250) as text")
    state = ArrivingTable(spark, str(tmp_path), df.schema, "t", samples=True)
    for batch in (0, 1, 1, 2):
        state.add_batch(df.filter(F.col("id") % 3 == batch), batch)
        if batch == 1:
            state.compact()
    assert not (tmp_path / "texts").exists()
    samples = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "samples"))
    assert samples.agg(F.max(F.char_length("value"))).first()[0] < 20
    screened = state.columns()
    assert {r.col_name: r.n_unique for r in screened.collect()}["text"] in (None, 250)
    shown = state.tabulation(screened.withColumn("is_candidate", F.col("col_name") == "text")).collect()
    assert len(shown) == 50 and {r.n_unique for r in shown} == {250}
    assert all(len(r.value) > 400 and r.value.startswith("long text") for r in shown)


def test_numbers_are_sketched_without_their_text(spark):
    df = spark.range(40_000).selectExpr("if(id % 2 = 0, 0.0D, -0.0D) as zero", "id / 7.0D as x", "double('NaN') as none",
                                        "cast(id as decimal(12,2)) / 4 as price", "date_add(date'2020-01-01', cast(id % 400 as int)) as day",
                                        "timestamp_seconds(id % 900) as at")
    found = sketches.column_sketches([Table(df, "t")])
    assert "as string" not in plan_of(found).replace("AS STRING", "as string").split("LocalTableScan")[0]
    got = {r.col_id: r for r in sketches.distinct_estimates(found).collect()}
    for i, n in enumerate((1, 40_000, 0, 40_000, 400, 900)):
        assert got[i].at_least <= n <= got[i].at_most


def test_a_file_of_one_split_is_profiled_by_all_cores(spark, tmp_path):
    spark.range(400_000).selectExpr("sha2(cast(id as string), 256) as code").coalesce(1).write.parquet(str(tmp_path / "t"))
    table = Table(spark.read.parquet(str(tmp_path / "t")), "t")
    assert "RoundRobinPartitioning" in plan_of(profile.profile_tables([table]))
    assert profile.profile_some(table, [0])[0][0] == 400_000 and len(catalog([table])) == 1
