"""The named queries of this subpackage, one for each operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairmill.llm import bpe, infill, interpolated_lm, langid, licences, neardup, pii, quality, runs, templates, toxicity
from pairmill.llm import weighted_sampling, winnowing
from pairmill.operators.once import compute_once
from pairmill.storage import staged


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rank_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", langid.crc_part("doc_id", 4) == 2)
    model = langid.fit(docs.filter(~F.col("held_out")))
    return langid.predict(docs, model, ["doc_id", "held_out"])


def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.send_ranks(spark, _rank_path())
    both = bpe.encode(_table(spark, sf_dir, "documents"), ranks, ["doc_id"], columns=("ids", "decoded"))
    return both.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(_table(spark, sf_dir, "documents"), ["doc_id"]), ["doc_id"])


def licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(_table(spark, sf_dir, "documents"), ["doc_id"])


def lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolated_lm.score_texts(_table(spark, sf_dir, "documents"), parts=10)


def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_sampling.compare_with_edits(_table(spark, sf_dir, "documents"))


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", langid.crc_part("doc_id", 3) == 1)
    teaching = _table(spark, sf_dir, "labels").filter(langid.crc_part("doc_id", 3) != 1)
    model = toxicity.fit(docs, teaching)
    return toxicity.score(docs, model, ["doc_id", "held_out"])


def main_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.extract(_table(spark, sf_dir, "pages"))


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), width=3, percent=85)


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnowing.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", langid.crc_part("doc_id", 5) == 0)
    keep = ["doc_id", "held_out"]
    stats = staged(quality.take_statistics(docs, keep), "statistics")
    model = quality.fit(stats, _table(spark, sf_dir, "labels").filter(langid.crc_part("doc_id", 5) != 0))
    return quality.score(stats, model, keep)


def _with_periodic_tails(docs: DataFrame) -> DataFrame:
    """One document in ten repeats its own words from some place on, as its id says; its text is rewritten."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    drawn = compute_once(docs.select("doc_id", "text"), {"g": F.floor(h / 10), "words": F.when(h % 10 == 0, words)})
    n = F.size("words")
    a = F.when(n > 0, F.col("g") % n)
    drawn = compute_once(drawn, {"a": a, "p": F.lit(1) + F.floor((n - a) / (F.lit(3) + F.col("g") % 8))})
    tail = F.expr("array_join(transform(words, (w, i) -> if(i < a, w, get(words, cast(a + (i - a) % p as int)))), ' ')")
    return drawn.select("doc_id", F.when(F.col("a").isNotNull(), tail).otherwise(F.col("text")).alias("text"))


def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(_with_periodic_tails(_table(spark, sf_dir, "documents")), ["doc_id"])
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("strongest.start").alias("start"),
        F.col("strongest.length").alias("length"),
        F.col("strongest.period").alias("period"),
        F.expr("(1000 * strongest.length) div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.fill_in_middle(_table(spark, sf_dir, "documents"), ["doc_id"])
    return made.select(
        "doc_id",
        "n",
        "form",
        F.col("prefix_units").alias("prefix_chars"),
        F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"),
    )


FILL_IN_MIDDLE_SQL = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d
  FROM documents
), numbers AS (
  SELECT doc_id, t, n,
    CAST('0x' || substr(d, 1, 8) AS BIGINT) % (n + 1) AS c1,
    CAST('0x' || substr(d, 9, 8) AS BIGINT) % (n + 1) AS c2,
    CAST('0x' || substr(d, 17, 8) AS BIGINT) % 100 AS h3,
    CAST('0x' || substr(d, 25, 8) AS BIGINT) % 100 AS h4
  FROM drawn
), formed AS (
  SELECT doc_id, t, n, least(c1, c2) AS a, greatest(c1, c2) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain'
      WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers
), parted AS (
  SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM formed
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t
    WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parted
"""

NEAR_DUPLICATES_SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM worded
), shingles AS MATERIALIZED (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS gram FROM sets),
links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b
    ON a.gram = b.gram AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), ways AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
reached AS (SELECT a AS node, a AS other FROM ways UNION SELECT r.node, w.b FROM reached r JOIN ways w ON r.other = w.a),
least_of AS (SELECT node, min(other) AS label FROM reached GROUP BY node)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(label, doc_id) AS component_id, coalesce(label, doc_id) = doc_id AS kept
FROM sets LEFT JOIN least_of ON node = doc_id
"""

DECONTAMINATION_SQL = r"""
WITH worded AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), item_windows AS MATERIALIZED (
  SELECT DISTINCT item_id, size, array_to_string(w[i : i + size - 1], ' ') AS words
  FROM (SELECT item_id, w, least(len(w), 10) AS size, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0)
), places AS (
  SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS words
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM worded, (SELECT DISTINCT size FROM item_windows))
), found AS MATERIALIZED (SELECT doc_id, i, size, item_id FROM places JOIN item_windows USING (size, words)),
hit AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM (SELECT DISTINCT doc_id, i, size FROM found)) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM worded LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

QUERIES = {
    "op1_language_id": language_id,
    "op2_byte_bpe": byte_bpe,
    "op3_personal_data": personal_data,
    "op4_licence_scan": licence_scan,
    "op5_lm_scores": lm_scores,
    "op6_fingerprints": document_fingerprints,
    "op7_toxicity": toxicity_scores,
    "op8_near_duplicates": near_duplicates,
    "op9_decontamination": decontamination,
    "op10_main_text": main_texts,
    "op11_quality": quality_scores,
    "op12_periodic_runs": periodic_runs,
    "op13_fill_in_middle": fill_in_middle,
}
ORACLES: dict[str, str] = {
    "op8_near_duplicates": NEAR_DUPLICATES_SQL,
    "op9_decontamination": DECONTAMINATION_SQL,
    "op13_fill_in_middle": FILL_IN_MIDDLE_SQL,
}
