"""Relations that Spark and the oracle derive from the driver tables by the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# STR stands for the engine's text type.
SURVEY = """
SELECT c_custkey AS respondent_id,
  c_name AS full_name,
  CASE WHEN c_custkey % 7 = 0 THEN NULL
       ELSE concat('user', cast(c_custkey AS STR), '@mail', cast(c_custkey % 5 AS STR), '.example.com') END AS email,
  substr(md5(cast(c_custkey AS STR)), 1, 24) AS prolific_pid,
  CASE WHEN c_custkey % 4 = 0 THEN concat('A', upper(substr(md5(cast(c_custkey AS STR)), 1, 13)))
       ELSE concat('x-', cast(c_custkey AS STR)) END AS panel_code,
  CASE WHEN c_custkey % 50 = 0 THEN concat('52.', cast(c_custkey % 200 AS STR), '.3.4')
       WHEN c_custkey % 50 = 1 THEN '300.1.1.1'
       ELSE concat('10.0.', cast(c_custkey % 256 AS STR), '.7') END AS ip_addr,
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 5550000000 + c_custkey END AS phone,
  cast(18 + c_custkey % 60 AS int) AS age,
  cast(1 + c_custkey % 5 AS int) AS likert,
  c_custkey % 2 = 0 AS consent_flag,
  CASE WHEN c_custkey % 40 = 0 THEN cast(0 AS double) WHEN c_custkey % 41 = 0 THEN cast(-99 AS double)
       ELSE 40 + (c_custkey % 1000) / cast(1024 AS double) END AS q_a,
  CASE WHEN c_custkey % 40 = 0 THEN cast(0 AS double) WHEN c_custkey % 41 = 0 THEN cast(-99 AS double)
       WHEN c_custkey % 53 = 0 THEN NULL
       ELSE -100 + (c_custkey % 777) / cast(1024 AS double) END AS q_b,
  ((c_custkey * 37) % 5000 - 2500) / cast(1024 AS double) AS zscore,
  c_acctbal AS score,
  c_mktsegment AS segment,
  substr(c_mktsegment, 1, 3) AS seg3,
  CASE WHEN c_custkey % 100 = 0 THEN concat('see http://ex.org/', cast(c_custkey AS STR))
       WHEN c_custkey % 101 = 0 THEN concat('call 555-010-', cast(1000 + c_custkey AS STR))
       ELSE concat('free text ', cast(c_custkey % 90 AS STR)) END AS note,
  cast(NULL AS STR) AS empty_col
FROM customer
"""

# Stops of a delivery log: more rows than one coordinate sample holds, some at sea.
STOPS = """
SELECT o_orderkey AS stop_id,
  CASE WHEN o_orderkey % 29 = 0 THEN cast(-99 AS double)
       ELSE 40 + (o_orderkey % 1999) / cast(2048 AS double) END AS gps_y,
  CASE WHEN o_orderkey % 29 = 0 THEN cast(-99 AS double) WHEN o_orderkey % 31 = 0 THEN NULL
       ELSE -101.03125 + (o_orderkey % 2017) / cast(1024 AS double) END AS gps_x,
  (o_custkey % 3000) / cast(1024 AS double) AS detour,
  o_orderpriority AS priority
FROM orders
"""

# Positions at the poles, the date line, around the southern limit of land, and at run ends.
EDGES = """
SELECT o_orderkey AS edge_id,
  CASE o_orderkey % 6 WHEN 0 THEN cast(90 AS double) WHEN 1 THEN cast(-90 AS double)
    WHEN 2 THEN -60 - (o_custkey % 7) / cast(1024 AS double) WHEN 3 THEN -60 + (o_custkey % 900) / cast(1024 AS double)
    WHEN 4 THEN (o_custkey % 3 - 1) / cast(128 AS double) ELSE 40 + (o_custkey % 1200) / cast(1024 AS double) END AS pos_y,
  CASE o_orderkey % 5 WHEN 0 THEN cast(180 AS double) WHEN 1 THEN cast(-180 AS double)
    WHEN 2 THEN -80 + (o_custkey % 1024) / cast(1024 AS double) ELSE -101 + (o_custkey % 3000) / cast(1024 AS double) END AS pos_x
FROM orders
"""

#: (latitude row, first and last longitude column) in whole degrees from the south pole and the date line.
LAND_RUNS = ((130, 79, 81), (130, 200, 260), (131, 79, 79), (179, 0, 179), (0, 0, 359), (30, 90, 140), (29, 90, 140),
             (90, 0, 0), (90, 359, 359))
LAND = " UNION ALL ".join(
    f"SELECT cast({y} AS int) AS lat_idx, cast({a} AS int) AS lon_start, cast({b} AS int) AS lon_end" for y, a, b in LAND_RUNS)


def spark_text(sql: str) -> str:
    return sql.replace("STR", "string")


def duck_text(sql: str) -> str:
    return sql.replace("STR", "varchar")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, sql: str, names: tuple[str, ...]) -> DataFrame:
    """A planted relation: the SQL text over the named driver tables."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(spark_text(sql))


def survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, SURVEY, ("customer",))


def stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, STOPS, ("orders",))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, EDGES, ("orders",))


def land(spark: SparkSession) -> DataFrame:
    return spark.sql(LAND)


# --- relations for answers, attempts, verdicts, ledgers and text files ---------

ANSWERS = """
SELECT conv_id, turn, CASE (conv_id * 3 + turn) % 7
  WHEN 0 THEN concat('{"reasoning": "', md5(text), '", "evaluation": "not_pii"}')
  WHEN 1 THEN concat('First thoughts.', chr(10), '```json', chr(10), '{"reasoning": "', md5(text),
                     '", "evaluation": "direct_pii"}', chr(10), '```', chr(10), 'Done.')
  WHEN 2 THEN concat('```json', chr(10), '{"evaluation": "consent"}', chr(10), '```', chr(10), 'Rather:', chr(10),
                     '```', chr(10), '{"evaluation": "internal_id", "reasoning": "', md5(text), '"}', chr(10), '```')
  WHEN 3 THEN concat('```json', chr(10), '{"evaluation": "consent", "reasoning": "', role, '"}', chr(10), '```',
                     chr(10), '```json', chr(10), '{"evaluation": broken', chr(10), '```')
  WHEN 4 THEN concat('no JSON here: ', md5(text))
  WHEN 5 THEN concat('```json', chr(10), '{"evaluation": "not_pii"}', chr(10), '```', chr(10),
                     '```json', chr(10), '{"reasoning": "', md5(text), '"}', chr(10), '```')
  ELSE concat('{"reasoning": "', role, '", "looks_like_coordinate": " No, ', md5(text), '"}') END AS raw
FROM conversations
"""

ATTEMPTS = """
SELECT event_type AS dataset_id, user_id AS col_key, event_id AS attempt, event_id % 3 <> 0 AS valid,
  event_id % 1000 AS prompt_tokens, user_id % 100 AS completion_tokens, value AS seconds
FROM events
"""

VERDICT_INPUTS = """
SELECT event_id, event_id % 4 = 0 AS is_gps,
  CASE WHEN event_id % 4 = 0 THEN
    CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'yes' WHEN 2 THEN 'No.' WHEN 3 THEN ' Yes! it is' ELSE 'unclear' END
  ELSE CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'direct_pii' WHEN 2 THEN 'internal_id'
       WHEN 3 THEN 'not_pii' ELSE 'consent' END END AS value,
  event_type AS answer_reasoning, event_id % 3 = 0 AS floor_met,
  CASE WHEN event_id % 3 = 0 THEN concat('[Pattern: ', cast(user_id AS STR), ']') ELSE '' END AS note
FROM events
"""

LEDGER = """
SELECT concat('pkg/', cast(c_custkey AS STR)) AS package_path,
  CASE c_custkey % 7 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'done' WHEN 3 THEN 'skip'
    WHEN 4 THEN 'error' WHEN 5 THEN 'error — no files found'
    ELSE '.rar archive present — extract manually or change archive format' END AS status,
  CASE WHEN c_custkey % 7 = 3 THEN c_name END AS notes, c_custkey % 13 AS n_files_total,
  c_mktsegment AS priority
FROM customer
"""

DISCOVERED = "SELECT DISTINCT concat('pkg/', cast(o_custkey + 100 AS STR)) AS package_path FROM orders"

SUMMARIES = """
SELECT concat('pkg/', cast(o_custkey AS STR)) AS package_path, o_custkey % 11 = 0 AS failed,
  CASE WHEN o_custkey % 5 = 0 THEN 0 ELSE count(*) END AS n_files_total,
  CASE WHEN o_custkey % 6 = 0 THEN 'a.zip; b.RAR' WHEN o_custkey % 6 = 1 THEN 'rar.zip' ELSE '' END AS archive_files
FROM orders GROUP BY o_custkey
"""

# Every customer as a small text file in one of five dialects, every document as prose.
_CUSTOMER_LINE = """
SELECT concat('cust/', cast(c_custkey AS STR)) AS path, {n} AS line_no,
  CASE WHEN {n} = 2 THEN '   ' WHEN c_custkey % 5 = 4 AND {n} = 3 THEN c_name
  ELSE concat(cast(c_custkey AS STR), d, c_name, d, c_mktsegment,
              CASE WHEN c_custkey % 5 = 2 THEN ', x' ELSE '' END) END AS line
FROM (SELECT *, CASE c_custkey % 5 WHEN 0 THEN ',' WHEN 1 THEN chr(9) WHEN 2 THEN ';' WHEN 3 THEN '|' ELSE ',' END AS d
      FROM customer) c
UNION ALL"""
TEXT_LINES = "".join(_CUSTOMER_LINE.format(n=n) for n in (1, 2, 3, 4)) + """
SELECT concat('doc/', cast(doc_id AS STR)) AS path, 1 AS line_no, text AS line FROM documents
"""

MARKED_CELLS = """
SELECT CASE o_orderkey % 8 WHEN 0 THEN 'NA' WHEN 1 THEN 'n/a' WHEN 2 THEN '' WHEN 3 THEN 'Na' WHEN 4 THEN '-1.#IND'
    WHEN 5 THEN ' NA' WHEN 6 THEN 'None' ELSE o_orderpriority END AS v,
  CASE WHEN o_orderkey % 9 = 0 THEN '#N/A N/A' WHEN o_orderkey % 9 = 1 THEN 'NULLs' ELSE o_orderstatus END AS w
FROM orders
"""

FILE_PATHS = """
SELECT concat(CASE c_custkey % 4 WHEN 0 THEN 'pkg/' WHEN 1 THEN 'pkg/.git/' WHEN 2 THEN '__MACOSX/' ELSE 'a/b/' END,
  CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'v1.' ELSE 'x' END, cast(c_custkey AS STR),
  CASE c_custkey % 11 WHEN 0 THEN '.csv' WHEN 1 THEN '.TAR.GZ' WHEN 2 THEN '.gz' WHEN 3 THEN '.Zip' WHEN 4 THEN '.tgz'
    WHEN 5 THEN '.txt' WHEN 6 THEN '' WHEN 7 THEN '.parquet' WHEN 8 THEN '.rar' WHEN 9 THEN '.7z'
    ELSE '/Thumbs.db' END) AS path
FROM customer
"""
