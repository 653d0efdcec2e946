"""Pattern floors at their thresholds, by both ways of counting."""

import pytest
from pyspark.sql import functions as F

from tabwarden.operators import patterns, values
from tabwarden.operators.profile import profiled_columns
from tabwarden.sources.tables import Table, catalog

PROLIFIC = "0123456789abcdef01234567"
MTURK = "A1B2C3D4E5"


def floors(spark, cells, name="code"):
    df = spark.createDataFrame([(c,) for c in cells], "v string").toDF(name)
    table = Table(df, "t")
    by_profile = patterns.pattern_floors(profiled_columns(spark, [table])).first()
    counts = values.value_counts(values.melt_all([table], catalog([table])))
    named = patterns.pattern_stats(counts).withColumns({"col_name": F.lit(name), "label": F.lit(name)})
    by_counts = patterns.pattern_floors(named).first()
    got = (by_profile.floor_met, by_profile.pii_type, by_profile.note)
    assert got == (by_counts.floor_met, by_counts.pii_type, by_counts.note)
    return got


@pytest.mark.parametrize("matches, others, met", [
    (3, 26, False), (4, 25, True), (3, 27, False), (4, 26, True), (10, 90, False), (11, 89, True)])
def test_volume_floor(spark, matches, others, met):
    assert floors(spark, [PROLIFIC] * matches + ["free text"] * others)[:2] == (met, "prolific" if met else None)


def test_name_path_and_ties(spark):
    assert floors(spark, [PROLIFIC] + ["free text"] * 99, "prolific_pid")[1] == "prolific"
    assert floors(spark, [MTURK] + ["free text"] * 99, "mturk_id")[1] == "mturk"
    assert floors(spark, ["free text"] * 99, "prolific_pid")[0] is False
    assert floors(spark, [PROLIFIC, MTURK] * 10)[1] == "prolific"
    assert floors(spark, [PROLIFIC] * 10 + [MTURK] * 11)[1] == "mturk"
    met, kind, note = floors(spark, [PROLIFIC] * 25 + ["free text"] * 75)
    assert (met, kind) == (True, "prolific") and "25% (25/100)" in note and "name says nothing" in note


def test_ip_floor(spark):
    public, private, invalid = "8.8.8.8", "10.0.0.1", "300.1.1.1"
    assert floors(spark, [private] * 50)[0] is False
    assert floors(spark, [private] * 50 + [public])[1] == "ip"
    assert floors(spark, [public] * 5 + [invalid] * 5)[1] == "ip"
    assert floors(spark, [public] * 5 + [invalid] * 6)[0] is False
    both = floors(spark, [PROLIFIC] * 50 + [public] * 2)
    assert both[1] == "prolific" and "IP addresses" in both[2]


def test_words_that_look_like_ids(spark):
    assert floors(spark, ["AUTOMOBILE"] * 30)[:2] == (True, "mturk")
    assert floors(spark, [None, "abc", "def"])[0] is False
