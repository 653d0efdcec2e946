"""The registered queries of the operators in this subpackage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, chat, dac, decontaminate, jaccard, language, lines, maxent, negatives, pii, quality, spelling, suffixes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = bpe.round_trip(docs, vocab)
    return done.select("doc_id", F.floor(F.length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 1
    return maxent.score_texts(table(spark, sf_dir, "documents").select("doc_id", "text", held_out.alias("held_out")))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    model = language.learn(docs.filter(~held_out))
    found = language.identify(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", F.size("lang_spans").cast("long").alias("n_spans"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("row_id")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_personal_data(docs).withColumn("base", F.filter("spans", lambda s: s["base"]))

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in ("email", "ip", "card", "phone")]
    return found.select("doc_id", *counts, F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"),
                        pii.joined(F.col("spans")).alias("spans"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op7_dac(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = dac.new_folder(spark)
    files = dac.write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder, added_tokens=True)
    return dac.read_ids(files, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "lines_in", "lines_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.col("label").cast("long")
    whole = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("double"))
    rows = rows.select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
                       F.when(negatives.finite(F.col("embedding")), whole).alias("vector"))
    return negatives.hard_negatives(rows, F.col("id") % 50 == 0)


def op13_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffixes.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return done.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                       F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_maxent": op2_maxent,
    "op3_language": op3_language,
    "op4_decontaminate": op4_decontaminate,
    "op5_pii": op5_pii,
    "op6_chat": op6_chat,
    "op7_dac": op7_dac,
    "op8_quality": op8_quality,
    "op9_jaccard": op9_jaccard,
    "op10_lines": op10_lines,
    "op11_spelling": op11_spelling,
    "op12_negatives": op12_negatives,
    "op13_suffixes": op13_suffixes,
}

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"

#: DuckDB's SQL for the same rows, where SQL can express them on whole tables.
ORACLE: dict[str, str] = {
    "op6_chat": f"""
WITH turns AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
placed AS (SELECT conv_id, row_number() OVER w AS k,
    string_agg(concat('{chat.START}', coalesce(role, 'unknown'), chr(10), coalesce(text, ''), '{chat.END}', chr(10)), '') OVER w AS said
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST ROWS UNBOUNDED PRECEDING)),
whole AS (SELECT conv_id, max(k) AS n_turns, arg_max(said, k) AS rendered FROM placed GROUP BY 1),
starts AS (SELECT DISTINCT p.k, p.said FROM placed p JOIN whole w USING (conv_id) WHERE p.k < w.n_turns)
SELECT min(conv_id) AS conv_id, n_turns, count(*) AS n_copies, rendered FROM whole w
WHERE NOT EXISTS (SELECT 1 FROM starts s WHERE s.k = w.n_turns AND s.said = w.rendered) GROUP BY n_turns, rendered""",
    "op8_quality": f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, source FROM documents),
listed AS (SELECT r, {WORDS.format('t')} AS ws FROM docs),
word AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM listed),
windows AS (SELECT r, i, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM word WINDOW o AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i, w3 IS NOT NULL AND count(*) OVER (PARTITION BY r, w, w2, w3) > 1 AS hit FROM windows),
marked AS (SELECT r, hit OR coalesce(lag(hit) OVER o, false) OR coalesce(lag(hit, 2) OVER o, false) AS inside
  FROM twice WINDOW o AS (PARTITION BY r ORDER BY i)),
repeats AS (SELECT r, count(*) FILTER (inside) AS n_repeat_words FROM marked GROUP BY 1),
lines AS (SELECT r, source, unnest(string_split(t, chr(10))) AS line FROM docs),
full_lines AS (SELECT r, source, line, {WORDS.format('line')} AS ws FROM lines),
kept_lines AS (SELECT r, source, line, len(ws) AS n, array_to_string(list_transform(
    ws, lambda w: regexp_replace({LOWER.format('w')}, '[0-9]+', '0', 'g')), ' ') AS norm FROM full_lines WHERE len(ws) > 0),
dups AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM kept_lines GROUP BY 1),
hot AS (SELECT source, norm FROM kept_lines GROUP BY ALL HAVING count(DISTINCT r) > 100),
gone AS (SELECT r, sum(n) AS gone FROM kept_lines k SEMI JOIN hot h ON k.norm = h.norm AND k.source IS NOT DISTINCT FROM h.source GROUP BY 1),
figures AS (SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(gone, 0)::BIGINT AS removed_words
  FROM docs JOIN listed USING (r) LEFT JOIN dups USING (r) LEFT JOIN repeats USING (r) LEFT JOIN gone USING (r)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM figures)
SELECT *, NOT base_failed AND n_words - removed_words >= 0.3 * n_words AS kept FROM judged""",
    "op9_jaccard": f"""
WITH RECURSIVE listed AS (SELECT doc_id, {WORDS.format(LOWER.format("coalesce(text, '')"))} AS ws FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS s FROM listed),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM shingles a JOIN shingles b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared s JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * s.n >= 85 * (a.n + b.n - s.n)),
reach(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.c),
named AS (SELECT doc_id, min(c) AS component_id, count(*) AS n_rows FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, n_rows FROM named LEFT JOIN sizes USING (doc_id)""",
    "op12_negatives": """
WITH r AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.id % 50 = 0 AND a.id <> b.id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""",
}
