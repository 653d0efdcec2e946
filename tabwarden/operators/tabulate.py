"""Value samples per column: reserved pattern matches, longest, rarest, random.

Each value is known by the MD5 digest of its cleaned text. Digests break ties, so
short values (counted as text) and long texts (counted by digest only, and
fetched once chosen) are sampled by the same rules.

All lists of a column come from one ranked pass. Every list is bounded and Spark
trims it inside each task before the shuffle, so a column that holds a third of
all distinct values sends a few rows per task and no more.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from .. import rules
from ..functions import text
from ..plans.durable import durable
from ..sources.tables import ColumnRef, Table
from .values import melt_all, melt_typed, value_counts

# Each list keeps as many values as earlier lists could take away from it, and its own.
RESERVED = len(rules.PATTERN_KINDS) * rules.MAX_PER_PATTERN
KEEP_LONGEST = RESERVED + rules.N_LONGEST
KEEP_RAREST = KEEP_LONGEST + rules.N_RAREST
KEEP_RANDOM = max(KEEP_RAREST + rules.N_RANDOM, rules.SEND_ALL_MAX_DISTINCT)
LISTS = {
    "longest": (1, KEEP_LONGEST), "rarest": (2, KEEP_RAREST), "random": (3, KEEP_RANDOM),
    "email": (4, rules.MAX_PER_PATTERN), "web": (5, 2 * rules.MAX_PER_PATTERN),
    "long_digit": (6, 3 * rules.MAX_PER_PATTERN),
}
GROUP_TITLES = {  # fixed values: headings of the report cell, in display order
    "all": "[All values]", "longest": "[Longest values]", "rarest": "[Least frequent values]",
    "random": "[Random sample]", "other": "[Other values]",
}
MAX_BROADCAST_KEYS = 200_000    # of some 50 bytes each
LONG_TEXT_MEAN = 200    # mean characters from which a column is counted by digest


def _traits(value: Column) -> list[Column]:
    return [F.char_length(value).alias("len"), text.has_email(value).alias("email"),
            text.has_web(value).alias("web"), text.has_long_digits(value).alias("long_digit")]


def clean_counts(long: DataFrame) -> DataFrame:
    """Counts of cleaned values with digest, length and pattern flags, from (col_id, value) rows.

    Cleaning can make values equal, so it comes before counting.
    """
    v = F.col("value")
    return (long.filter(v.isNotNull()).select("col_id", text.strip_controls(v).alias("value"))
            .groupBy("col_id", "value").agg(F.count(F.lit(1)).alias("cnt"))
            .select("col_id", F.md5(v).alias("digest"), *_traits(v), "cnt", "value"))


def with_traits(counts: DataFrame) -> DataFrame:
    """Digest, length and pattern flags of counted values that need no cleaning."""
    v = F.col("value")
    return counts.select("col_id", F.md5(v).alias("digest"), *_traits(v), "cnt", "value")


def count_candidates(tables: list[Table], refs: list[ColumnRef]) -> DataFrame:
    """Counts with traits of the given columns, each counted in its own type."""
    parts = []
    for dtype, long in melt_typed(tables, refs).items():
        if isinstance(dtype, T.StringType):
            parts.append(clean_counts(long))
        else:
            parts.append(with_traits(value_counts(long).select(
                "col_id", text.as_text(F.col("value"), dtype).alias("value"), "cnt")))
    return reduce(DataFrame.unionByName, parts)


def digest_counts(long: DataFrame) -> DataFrame:
    """The same for long texts: only digests, lengths and flags are shuffled."""
    v = F.col("value")
    keyed = (long.filter(v.isNotNull()).select("col_id", text.strip_controls(v).alias("value"))
             .select("col_id", F.md5(v).alias("digest"), *_traits(v)))
    return (keyed.groupBy("col_id", "digest", "len", "email", "web", "long_digit")
            .agg(F.count(F.lit(1)).alias("cnt"))
            .withColumn("value", F.lit(None).cast("string")))


def counts_by_digest(counted: DataFrame, most: int) -> DataFrame:
    """The same from value counts, with values of up to `most` characters; longer ones are not shuffled."""
    v = F.col("value")
    keyed = counted.select("col_id", "cnt", text.strip_controls(v).alias("value")).select(
        "col_id", F.md5(v).alias("digest"), *_traits(v), "cnt", F.when(F.char_length(v) <= most, v).alias("value"))
    keys = [c for c in keyed.columns if c != "cnt"]
    return keyed.groupBy(*keys).agg(F.sum("cnt").alias("cnt"))


def ranked_lists(counts: DataFrame, seed: str = "0") -> DataFrame:
    """(col_id, list_id, rn, digest, cnt, value): the first values of each list."""
    cnt, digest = F.col("cnt").cast("bigint"), F.col("digest")
    zero, none = F.lit(0).cast("bigint"), F.lit(None)

    def entry(name: str, k1: Column, k2: Column, k3: Column) -> Column:
        return F.struct(F.lit(LISTS[name][0]).alias("list_id"), k1.alias("k1"), k2.alias("k2"),
                        k3.alias("k3"))

    entries = [
        entry("longest", -F.col("len").cast("bigint"), -cnt, digest),
        entry("rarest", cnt, zero, digest),
        entry("random", zero, zero, F.md5(F.concat(F.lit(seed), F.lit("|"), digest))),
    ]
    entries += [F.when(F.col(kind), entry(kind, cnt, zero, digest)).otherwise(none)
                for kind in rules.PATTERN_KINDS]
    order = Window.partitionBy("col_id", "list_id").orderBy("k1", "k2", "k3")
    widest = max(keep for _, keep in LISTS.values())
    keep = F.element_at(F.create_map(*[F.lit(x) for pair in LISTS.values() for x in pair]),
                        F.col("list_id"))
    return (counts.select("col_id", "digest", "cnt", "value", F.explode(F.array(*entries)).alias("e"))
            .filter(F.col("e").isNotNull())
            .select("col_id", "digest", "cnt", "value", "e.*")
            .withColumn("rn", F.row_number().over(order))
            .filter(F.col("rn") <= widest).filter(F.col("rn") <= keep)
            .select("col_id", "list_id", "rn", "digest", "cnt", "value"))


def _resolved(ranked: DataFrame) -> DataFrame:
    """Per column, the lists with earlier picks taken out of later ones."""
    item = F.struct("list_id", "rn", F.struct("digest", "cnt", "value").alias("item"))
    cols = ranked.groupBy("col_id").agg(F.array_sort(F.collect_list(item)).alias("ranked"))
    def items_of(list_id: int) -> Column:
        return F.transform(F.filter("ranked", lambda e: e["list_id"] == list_id), lambda e: e["item"])

    cols = cols.select("col_id", *[items_of(list_id).alias(name) for name, (list_id, _) in LISTS.items()])

    def pick(name: str, taken: list[str], size: int) -> Column:
        rest = F.array_except(F.col(name), F.concat(*taken)) if taken else F.col(name)
        return F.slice(rest, 1, size)

    cols = cols.withColumn("everything", F.col("random"))
    taken: list[str] = []
    for kind in rules.PATTERN_KINDS:
        cols = cols.withColumn(kind, pick(kind, taken, rules.MAX_PER_PATTERN))
        taken.append(kind)
    for name, size in (("longest", rules.N_LONGEST), ("rarest", rules.N_RAREST),
                       ("random", rules.N_RANDOM)):
        cols = cols.withColumn(name, pick(name, taken, size))
        taken.append(name)
    return cols.withColumn("other", F.concat(*rules.PATTERN_KINDS))


def reserved_values(counts: DataFrame, seed: str = "0") -> DataFrame:
    """(col_id, pattern, value, cnt): up to five rare matches of each pattern.

    A value counts for the first pattern it matches that still has room.
    """
    picked = _resolved(ranked_lists(counts, seed))
    kinds = F.array(*[F.struct(F.lit(k).alias("pattern"), F.col(k).alias("items"))
                      for k in rules.PATTERN_KINDS])
    return (picked.select("col_id", F.inline(kinds))
            .select("col_id", "pattern", F.inline("items"))
            .select("col_id", "pattern", "digest", "value", "cnt"))


def tabulate(counts: DataFrame, n_rows: DataFrame, seed: str = "0") -> DataFrame:
    """(col_id, grp, rank, digest, value, cnt, pct, n_unique): the values shown per column.

    n_rows: (col_id, n_rows); shares are of all rows, missing cells included.
    """
    picked = _resolved(ranked_lists(counts, seed))
    # reading cnt keeps this branch's shuffle equal to the one above, which is then run only once
    sizes = (counts.groupBy("col_id").agg(F.count(F.lit(1)).alias("n_unique"), F.sum("cnt").alias("n_values"))
             .filter("n_values > 0").drop("n_values"))
    common_first = lambda name: F.array_sort(F.col(name), lambda l, r: (
        F.when(l.cnt > r.cnt, -1).when(l.cnt < r.cnt, 1)
        .when(l.digest < r.digest, -1).when(l.digest > r.digest, 1).otherwise(0)))

    def group(name: str, items: Column) -> Column:
        return F.struct(F.lit(name).alias("grp"), items.alias("items"))

    sampled = F.array(group("longest", F.col("longest")), group("rarest", common_first("rarest")),
                      group("random", F.col("random")), group("other", F.col("other")))
    shown = (
        picked.join(sizes, "col_id").join(n_rows, "col_id")
        .withColumn("groups", F.when(F.col("n_unique") <= rules.SEND_ALL_MAX_DISTINCT,
                                     F.array(group("all", common_first("everything"))))
                    .otherwise(sampled))
        .select("col_id", "n_unique", "n_rows", F.inline("groups"))
        .select("col_id", "n_unique", "n_rows", "grp", F.posexplode("items").alias("pos", "item"))
    )
    return shown.select(
        "col_id", "grp", (F.col("pos") + 1).alias("rank"), "item.digest", "item.value",
        F.col("item.cnt").cast("bigint").alias("cnt"),
        (F.col("item.cnt") / F.col("n_rows") * 100).alias("pct"), "n_unique")


def fetch_texts(shown: DataFrame, long: DataFrame) -> DataFrame:
    """Fill in the texts of digest-counted samples, by a second scan.

    A sample holds at most 65 keys per column, so the keys go to the texts and the
    texts stay where they are; copies of a chosen text fold before the shuffle.
    """
    v = F.col("value")
    texts = (long.filter(v.isNotNull()).select("col_id", text.strip_controls(v).alias("text"))
             .withColumn("digest", F.md5("text")))
    return fill_texts(shown, texts)


def fill_texts(shown: DataFrame, texts: DataFrame) -> DataFrame:
    """The same from texts: (col_id, text, digest) rows."""
    shown = durable(shown)
    wanted = shown.select("col_id", "digest")
    if wanted.count() <= MAX_BROADCAST_KEYS:
        wanted = F.broadcast(wanted)
    found = texts.join(wanted, ["col_id", "digest"], "left_semi").distinct()
    return (shown.join(found, ["col_id", "digest"], "left")
            .withColumn("value", F.coalesce("value", "text")).select(*shown.columns))


def tabulate_columns(tables: list[Table], refs: list[ColumnRef], n_rows: DataFrame,
                     mean_len: dict[int, float], seed: str = "0") -> DataFrame:
    """Samples of the given columns: short values by text, long texts by digest."""
    long_refs = [r for r in refs if r.kind == "other" or mean_len.get(r.col_id, 0) > LONG_TEXT_MEAN]
    short_refs = [r for r in refs if r not in long_refs]
    shown = None
    if short_refs:
        shown = tabulate(count_candidates(tables, short_refs), n_rows, seed)
    if long_refs:
        cells = melt_all(tables, long_refs)
        fetched = fetch_texts(tabulate(digest_counts(cells), n_rows, seed), cells)
        shown = fetched if shown is None else shown.unionByName(fetched)
    return shown


def render(shown: DataFrame) -> DataFrame:
    """(col_id, tabulation): the samples as one text cell per column (at most 65 lines each)."""
    order = {name: i for i, name in enumerate(GROUP_TITLES)}
    rank_of = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    title_of = F.create_map(*[F.lit(x) for pair in GROUP_TITLES.items() for x in pair])
    line = text.padded_row(F.col("value"), F.col("cnt"), F.col("pct"))
    groups = (shown.groupBy("col_id", "grp").agg(
        F.max("n_unique").alias("n_unique"),
        F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("lines")))
    block = F.concat_ws("\n", title_of[F.col("grp")], F.array_join(F.col("lines.line"), "\n"))
    cells = (groups.select("col_id", "n_unique", rank_of[F.col("grp")].alias("o"), block.alias("block"))
             .groupBy("col_id").agg(
                 F.max("n_unique").alias("n_unique"),
                 F.array_sort(F.collect_list(F.struct("o", "block"))).alias("blocks")))
    body = F.array_join(F.col("blocks.block"), "\n\n")
    footer = F.concat(F.lit("\n\n  (chosen from "), F.col("n_unique").cast("string"),
                      F.lit(" different values)"))
    return cells.select("col_id", F.when(
        F.col("n_unique") > rules.SEND_ALL_MAX_DISTINCT, F.concat(body, footer)).otherwise(body)
        .alias("tabulation"))
