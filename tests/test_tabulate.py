"""What the groups of a value sample promise, on cells whose kinds are known."""

import random

import pytest
from pyspark.sql import functions as F

from tabwarden.operators import tabulate
from tabwarden.plans.local import local_relation

def shown(spark, cells, counter):
    long = spark.createDataFrame([(7, c) for c in cells], "col_id int, value string").repartition(5)
    n_rows = local_relation(spark, [(7, len(cells))], "col_id int, n_rows bigint")
    out = tabulate.tabulate(counter(long), n_rows)
    if counter is tabulate.digest_counts:
        out = tabulate.fetch_texts(out, long)
    groups = {}
    for r in out.orderBy("grp", "rank").collect():
        groups.setdefault(r.grp, []).append(r.value)
        assert r.pct == pytest.approx(r.cnt / len(cells) * 100)
    return groups


KINDS = {"email": "user{}@mail.org", "web": "see www.x{}.org", "long": "call 555-010-{:04d}"}


def planted_cells(seed):
    """Cells with a known kind each: {value: count}, and {value: kind} of those with one."""
    rnd = random.Random(seed)
    kind_of = {form.format(i): kind for kind, form in KINDS.items() for i in range(rnd.choice([2, 5, 9, 30]))}
    values = list(kind_of) + [f"w{'y' * rnd.randint(0, 40)}{i}" for i in range(rnd.choice([60, 90, 150]))] + ["é" * 45]
    counts = {v: rnd.choice([1, 1, 2, 3, 7, 20]) for v in values}
    cells = [v for v, n in counts.items() for _ in range(n)] + [None] * 30
    rnd.shuffle(cells)
    return cells, counts, kind_of


@pytest.mark.parametrize("counter", [tabulate.clean_counts, tabulate.digest_counts])
@pytest.mark.parametrize("seed", range(4))
def test_samples_hold_what_they_promise(spark, seed, counter):
    cells, counts, kind_of = planted_cells(seed)
    groups = shown(spark, cells, counter)
    picked = [v for own in groups.values() for v in own]
    assert len(picked) == len(set(picked)) and set(picked) <= set(counts)
    for kind in KINDS:                       # the rarest of each kind, five at most
        own = [v for v, k in kind_of.items() if k == kind]
        held = [v for v in groups.get("other", []) if kind_of[v] == kind]
        assert len(held) == min(5, len(own))
        assert not held or max(counts[v] for v in held) <= min((counts[v] for v in set(own) - set(held)), default=99)
    rest = set(counts) - set(groups.get("other", []))
    longest = groups["longest"]
    assert len(longest) == 10 and [len(v) for v in longest] == sorted(map(len, longest), reverse=True)
    rest -= set(longest)
    assert min(map(len, longest)) >= max(map(len, rest))
    rarest = groups["rarest"]
    rest -= set(rarest)
    assert len(rarest) == 20 and max(counts[v] for v in rarest) <= min(counts[v] for v in rest)
    assert len(groups["random"]) == min(20, len(rest)) and set(groups["random"]) <= rest


def test_both_ways_of_counting_and_reruns_agree(spark):
    cells, _, _ = planted_cells(11)
    first = shown(spark, cells, tabulate.clean_counts)
    assert first == shown(spark, cells[::-1], tabulate.digest_counts) == shown(spark, cells, tabulate.clean_counts)


def test_controls_are_not_told_apart(spark):
    assert shown(spark, ["a\x0cb", "ab", "ab", "c"], tabulate.clean_counts) == {"all": ["ab", "c"]}


@pytest.mark.parametrize("n", [50, 51])
def test_send_all_limit(spark, n):
    groups = shown(spark, [f"value {i}" for i in range(n)], tabulate.clean_counts)
    assert set(groups) == ({"all"} if n == 50 else {"longest", "rarest", "random"})
    picked = [v for g in groups.values() for v in g]
    assert len(picked) == len(set(picked)) == 50


def test_a_hot_column_is_trimmed_in_the_tasks(spark):
    """The rank limit has to apply before the shuffle that brings a column together."""
    long = spark.range(1000).select(F.lit(1).alias("col_id"), F.concat(F.lit("v"), "id").alias("value"))
    plan = tabulate.ranked_lists(tabulate.clean_counts(long))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_render(spark):
    cells = ["a"] * 3 + ["b"]
    long = spark.createDataFrame([(1, c) for c in cells], "col_id int, value string")
    out = tabulate.tabulate(tabulate.clean_counts(long), local_relation(spark, [(1, 4)], "col_id int, n_rows bigint"))
    assert tabulate.render(out).first().tabulation == (
        f"[All values]\n  {'a':<50} {3:>6} (75.0%)\n  {'b':<50} {1:>6} (25.0%)")
