"""Catalog, readers, numbering, shard tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pairmill.functions.arrays import joined
from pairmill.functions.text import shard_name
from pairmill.operators import numbering
from pairmill.operators.feed import (
    curriculum_order,
    sample_head,
    shard_order,
    shard_shuffle,
)
from pairmill.operators.metrics import shard_manifest, source_totals
from pairmill.operators.normalize import drop_empty_pairs
from pairmill.operators.rows import JsonRow
from pairmill.registry.base import (
    SQL_CUT_DOCS,
    SQL_LENGTHS,
    docs_as_rows,
    query,
    sql_tokens,
    table,
    token_lengths,
)
from pairmill.sources import catalog, reader, scans, shards, trace
from pairmill.storage import staged, work_path

CHUNK = 10

# ------------------------------------------------------------------ catalog


def doc_catalog(spark, sf_dir):
    """Languages as domains, their sources as datasets."""
    docs = table(spark, sf_dir, "documents")
    domains = docs.groupBy(F.col("lang").alias("domain")).agg(
        F.array_sort(F.collect_set("source")).alias("datasets")
    )
    place = (F.row_number().over(Window.orderBy("domain")) - 1).cast("int")
    return domains.select("domain", place.alias("domain_pos"), "datasets")


def doc_configs(spark, sf_dir):
    """Two configs for sources with a long name, one for `src1`, and one nobody asks for."""
    sources = table(spark, sf_dir, "documents").select(F.col("source").alias("dataset")).distinct()
    two = sources.where(F.length("dataset") == 5).select(
        "dataset", F.posexplode(F.array(F.lit("en"), F.lit("zh"))).alias("config_pos", "name")
    )
    two = two.select(
        "dataset", "config_pos", F.lit(None).cast("string").alias("path"), "name",
        F.when(F.col("name") == "zh", "test").alias("split"),
    )
    one = sources.where(F.col("dataset") == "src1").select(
        "dataset", F.lit(0).alias("config_pos"), F.lit("elsewhere").alias("path"),
        F.lit(None).cast("string").alias("name"), F.lit("eval").alias("split"),
    )
    dead = one.withColumn("dataset", F.lit("unlisted"))
    none = F.lit(None).cast("string")
    return two.unionByName(one).unionByName(dead).withColumns({"data_files": none, "data_dir": none})


_CATALOG = """
ranked AS (SELECT lang, dense_rank() OVER (ORDER BY lang) - 1 AS domain_pos FROM (SELECT DISTINCT lang FROM documents)),
listed AS (SELECT lang AS domain, cast(domain_pos AS INT) AS domain_pos,
  cast(row_number() OVER (PARTITION BY lang ORDER BY source) - 1 AS INT) AS dataset_pos, source AS dataset
  FROM (SELECT DISTINCT lang, source FROM documents) JOIN ranked USING (lang))"""
_CONFIGS = """
configs AS (SELECT DISTINCT source AS dataset, c.pos AS config_pos, NULL AS path, c.name AS name,
    CASE WHEN c.name = 'zh' THEN 'test' END AS split
    FROM documents, (VALUES (0, 'en'), (1, 'zh')) c(pos, name) WHERE length(source) = 5
  UNION ALL SELECT DISTINCT source, 0, 'elsewhere', NULL, 'eval' FROM documents WHERE source = 'src1'),
expanded AS (SELECT l.domain, l.dataset, cast(coalesce(config_pos, 0) AS INT) AS config_pos,
  coalesce(path, l.dataset) AS path, coalesce(name, 'default') AS name, coalesce(split, 'train') AS split,
  regexp_replace(l.dataset || '_' || coalesce(name, 'default') || '_' || coalesce(split, 'train'),
    '[^a-zA-Z0-9_]', '_', 'g') AS source
  FROM listed l LEFT JOIN configs c ON l.dataset = c.dataset)"""


@query("catalog_explode", f"WITH {_CATALOG} SELECT domain, domain_pos, dataset_pos, dataset FROM listed")
def catalog_explode(spark, sf_dir):
    return catalog.catalog_explode(doc_catalog(spark, sf_dir))


def _expanded(spark, sf_dir):
    made = catalog.config_expand(
        catalog.catalog_explode(doc_catalog(spark, sf_dir)), doc_configs(spark, sf_dir)
    )
    return made.select("domain", "dataset", "config_pos", "path", "name", "split", "source")


@query("config_expand", f"WITH {_CATALOG}, {_CONFIGS} SELECT * FROM expanded")
def config_expand(spark, sf_dir):
    return _expanded(spark, sf_dir)


@query(
    "pending_sources",
    f"""WITH {_CATALOG}, {_CONFIGS} SELECT * FROM expanded
    WHERE source NOT IN (SELECT DISTINCT source || '_default_train' FROM documents WHERE lang = 'de')
      AND source NOT IN (SELECT DISTINCT source || '_zh_test' FROM documents)""",
)
def pending_sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    claims = docs.where("lang = 'de'").select(F.concat("source", F.lit("_default_train")).alias("source"))
    claims = claims.union(docs.select(F.concat("source", F.lit("_zh_test")))).distinct()
    return catalog.pending_sources(_expanded(spark, sf_dir), claims)


# ------------------------------------------------------------------ readers

_DOCS = "SELECT doc_id, text, lang, source, n_chars FROM documents"


@query("scan_structured", _DOCS)
def scan_structured(spark, sf_dir):
    """Each language is a split in a folder of its own; the splits together are the table."""
    docs = table(spark, sf_dir, "documents")
    path = work_path(spark, "by-split")
    docs.withColumn("split", F.col("lang")).write.partitionBy("split").parquet(path)
    splits = [r.lang for r in docs.select("lang").distinct().collect()]
    parts = [scans.scan_structured(spark, path, "parquet", split=s) for s in splits]
    return catalog.union_configs(parts).drop("split")


@query("scan_json_glob", _DOCS)
def scan_json_glob(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    path = work_path(spark, "json-glob")
    docs.write.option("compression", "gzip").json(f"{path}/deep/er")
    docs.limit(3).write.json(f"{path}/deep/plain")
    return scans.scan_json_glob(spark, path, "*.json.gz", docs.schema)


_CATALOG_CONFIGS = [  # dataset, config_pos, path, name, split, data_files, data_dir
    ("tables", 0, "parquet", "default", "test", None, None),
    ("tables", 1, "parquet", "default", None, None, None),
    ("lines", 0, "json", None, None, "**/*.json.gz", None),
    ("lines", 1, "json", "plain", None, "*.json", "deep"),
    ("prose", 0, "text", None, None, "*.txt", None),
    ("mislabelled", 0, "json/deep", None, None, None, None),
    ("missing", 0, "nowhere", None, None, None, None),
]


def _in_files(df, least):
    """A file for each split of the input, ``least`` for a small one: no file, hence no task that reads one, grows with the input."""
    return df.repartition(max(least, df.rdd.getNumPartitions()))


def written_catalog(spark, sf_dir):
    """The documents as Parquet by split, gzip and plain JSON lines, and text, as a catalog names them."""
    docs, root = table(spark, sf_dir, "documents"), work_path(spark, "catalog")
    split = F.when(F.col("doc_id") % 3 == 0, "test").otherwise("train")
    lines = docs.select("doc_id", "text")
    _in_files(docs.withColumn("split", split), 4).write.partitionBy("split").parquet(f"{root}/parquet")
    _in_files(lines, 3).write.option("compression", "gzip").json(f"{root}/json/gz")
    _in_files(lines.where("doc_id % 5 = 0"), 2).write.json(f"{root}/json/deep")
    _in_files(docs.select(F.concat_ws(" ", "doc_id", "source").alias("value")), 2).write.text(f"{root}/text")
    return root


def catalog_scan(spark, sf_dir):
    domains = {"general": ["tables", "lines"], "other": ["prose", "mislabelled", "missing"]}
    datasets = catalog.catalog_explode(catalog.catalog_of(spark, domains))
    expanded = catalog.config_expand(datasets, spark.createDataFrame(_CATALOG_CONFIGS, catalog.CONFIG_SCHEMA))
    return reader.scan_catalog(spark, written_catalog(spark, sf_dir), expanded)


@query(
    "scan_catalog",
    """WITH found AS (
      SELECT 'general' AS domain, 'tables_default_test' AS source, doc_id FROM documents WHERE doc_id % 3 = 0
      UNION ALL SELECT 'general', 'tables_default_train', doc_id FROM documents WHERE doc_id % 3 <> 0
      UNION ALL SELECT 'general', 'lines_default_train', doc_id FROM documents
      UNION ALL SELECT 'general', 'lines_plain_train', doc_id FROM documents WHERE doc_id % 5 = 0
      UNION ALL SELECT 'other', 'prose_default_train', doc_id FROM documents
      UNION ALL SELECT 'other', 'mislabelled_default_train', doc_id FROM documents WHERE doc_id % 5 = 0)
    SELECT domain, source, count(*) AS n_rows, cast(sum(doc_id) AS BIGINT) AS ids, 0 AS least_pos,
      count(*) - 1 AS greatest_pos, count(*) AS distinct_pos FROM found GROUP BY ALL""",
)
def scan_catalog(spark, sf_dir):
    """Every row of every config once, at dense places from 0."""
    rows, _ = catalog_scan(spark, sf_dir)
    doc_id = F.coalesce(F.get_json_object("raw", "$.doc_id"), F.regexp_extract("raw", r'"text":"(\d+) ', 1)).cast("bigint")
    return rows.groupBy("domain", "source").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(doc_id).alias("ids"),
        F.min("row_pos").cast("int").alias("least_pos"),
        F.max("row_pos").alias("greatest_pos"),
        F.count_distinct("row_pos").alias("distinct_pos"),
    )


@query("scan_text_fallback", "SELECT doc_id, text, lang FROM documents")
def scan_text_fallback(spark, sf_dir):
    """JSON lines announced as Parquet: the reader falls back to lines, the row rules unpack them."""
    path = work_path(spark, "not-parquet")
    table(spark, sf_dir, "documents").write.json(path)
    lines = scans.scan_or_text(spark, path, "parquet")
    opened = JsonRow.attach(lines.select(F.to_json(F.struct("text")).alias("raw")), "raw", unpack=True)
    row = JsonRow()
    return opened.select(
        row.text("doc_id").cast("bigint").alias("doc_id"),
        row.text("text").alias("text"),
        row.text("lang").alias("lang"),
    )


@query(
    "source_probe",
    """SELECT * FROM (VALUES ('documents', true, NULL), ('conversations', true, NULL), ('events', true, NULL),
      ('missing', false, 'PATH_NOT_FOUND'), ('wrong_format', false, 'unreadable')) v(source, ok, detail)""",
)
def source_probe(spark, sf_dir):
    sources = [(t, f"{sf_dir}/{t}.parquet", "parquet") for t in ("documents", "conversations", "events")]
    sources.append(("missing", f"{sf_dir}/no_such_table.parquet", "parquet"))
    sources.append(("wrong_format", f"{sf_dir}/documents.parquet", "orc"))
    found = scans.source_probe(spark, sources)
    # a reader names the broken file differently in each release
    detail = F.when((F.col("detail") != "PATH_NOT_FOUND") & ~F.col("ok"), "unreadable").otherwise(F.col("detail"))
    return found.withColumn("detail", detail)


@query("scan_skip_corrupt", _DOCS)
def scan_skip_corrupt(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    path = work_path(spark, "half-broken")
    docs.write.parquet(path)
    docs.select("text").write.mode("append").text(path)
    return scans.scan_skip_corrupt(spark, path, docs.schema)


# ------------------------------------------------------------------ numbering and shards

_CHUNKED = f"""
numbered_docs AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) - 1 AS seq FROM documents),
chunked AS (SELECT lang AS domain, source, doc_id AS row_pos, text, cast(seq // {CHUNK} AS INT) AS chunk_id,
  cast(seq % {CHUNK} AS INT) AS pos_in_chunk FROM numbered_docs)"""


def chunked_docs(spark, sf_dir, span=100):
    return numbering.chunk_assign(docs_as_rows(spark, sf_dir), chunk_size=CHUNK, span=span)


@query("chunk_assign", f"WITH {_CHUNKED} SELECT domain, source, row_pos, chunk_id, pos_in_chunk FROM chunked")
def chunk_assign(spark, sf_dir):
    return chunked_docs(spark, sf_dir).drop("text")


# positions that are hashes for a third of the rows, missing for another, and repeat in the last
_ANY_POSITION = """CASE doc_id % 3 WHEN 0 THEN cast('0x' || substring(md5(cast(doc_id AS VARCHAR)), 1, 15) AS BIGINT)
  WHEN 1 THEN doc_id // 40 END"""


@query(
    "number_any_positions",
    f"""WITH d AS (SELECT nullif(lang, 'fr') AS domain, CASE WHEN source <> 'src1' THEN source END AS source, doc_id,
      {_ANY_POSITION} AS row_pos FROM documents),
    n AS (SELECT *, row_number() OVER (PARTITION BY domain, source ORDER BY row_pos NULLS FIRST, doc_id) - 1 AS seq FROM d)
    SELECT domain, source, doc_id, row_pos, cast(seq // {CHUNK} AS INT) AS chunk_id, cast(seq % {CHUNK} AS INT) AS pos_in_chunk FROM n""",
)
def number_any_positions(spark, sf_dir):
    """Chunks over hashed, repeated and missing positions; a place holds at most four rows here."""
    hashed = F.conv(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 15), 16, 10).cast("bigint")
    rows = table(spark, sf_dir, "documents").select(
        F.expr("nullif(lang, 'fr')").alias("domain"),
        F.expr("if(source <> 'src1', source, null)").alias("source"),
        "doc_id",
        F.when(F.col("doc_id") % 3 == 0, hashed).when(F.col("doc_id") % 3 == 1, F.floor(F.col("doc_id") / 40)).alias("row_pos"),
    )
    return numbering.chunk_assign(rows, chunk_size=CHUNK, span=4, tie="doc_id")


_CAP = """CASE WHEN lang = 'en' THEN 12 WHEN source = 'src3' THEN 2 WHEN lang = 'de' THEN 4 ELSE 5 END"""
CAPS = (("en", None, 12), (None, "src3", 2), ("de", None, 4), (None, None, 5))


@query(
    "row_cap",
    f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS rn FROM documents)
    SELECT lang AS domain, source, doc_id AS row_pos, text FROM n WHERE rn <= {_CAP}""",
)
def row_cap(spark, sf_dir):
    rows = docs_as_rows(spark, sf_dir)
    return numbering.row_cap(rows, dataset="source", rules=CAPS, span=100)


_MANIFEST = f"""WITH {SQL_CUT_DOCS},
pairs AS (SELECT lang AS domain, source, doc_id, len({sql_tokens('sp')}) AS a, len({sql_tokens('sr')}) AS b
  FROM cut_docs WHERE length(sp) > 0 AND length(sr) > 0),
placed_pairs AS (SELECT *, cast((row_number() OVER (PARTITION BY domain, source ORDER BY doc_id) - 1) // {CHUNK} AS INT)
  AS chunk_id FROM pairs)
SELECT domain, source, chunk_id, count(*) AS n_rows, cast(sum(least(a, 2048)) AS BIGINT) AS n_prompt_tokens,
  cast(sum(least(b, 2048)) AS BIGINT) AS n_response_tokens FROM placed_pairs GROUP BY ALL"""


@query("shard_manifest", _MANIFEST)
def shard_manifest_query(spark, sf_dir):
    from pairmill.functions.arrays import truncate
    from pairmill.plans.featurize import accept_pairs

    rows = docs_as_rows(spark, sf_dir, heavy=True).withColumn("raw", F.to_json(F.struct("text"))).drop("text")
    pairs = drop_empty_pairs(accept_pairs(rows))
    samples = pairs.select(
        "domain", "source", "row_pos",
        truncate(token_lengths("prompt")).alias("input_tokens"),
        truncate(token_lengths("response")).alias("response_tokens"),
    )
    # numbering looks at its input twice; what is costly to make is written once
    samples = staged(samples, "samples")
    return shard_manifest(numbering.chunk_assign(samples, chunk_size=CHUNK, span=100))


@query("source_totals", "SELECT lang AS domain, source, count(*) AS n_rows FROM documents GROUP BY ALL")
def source_totals_query(spark, sf_dir):
    return source_totals(docs_as_rows(spark, sf_dir))


def written_shards(spark, sf_dir, **layout):
    path = work_path(spark, "shards")
    phase = F.when(F.col("domain") == "en", "general_knowledge").when(
        F.col("domain") == "de", "frontier_traces"
    )
    rows = chunked_docs(spark, sf_dir).withColumn("domain", F.coalesce(phase, F.lit("code_mechanics")))
    rows = numbering.chunk_assign(
        rows.drop("chunk_id", "pos_in_chunk"), chunk_size=CHUNK, span=100
    )
    shards.write_shards(rows, path, **layout)
    return path


_PHASE = """CASE lang WHEN 'en' THEN 'general_knowledge' WHEN 'de' THEN 'frontier_traces' ELSE 'code_mechanics' END"""
_SHARDS = f"""
phased AS (SELECT {_PHASE} AS domain, source, doc_id AS row_pos, text FROM documents),
counted AS (SELECT *, row_number() OVER (PARTITION BY domain, source ORDER BY row_pos) - 1 AS seq FROM phased),
shards AS (SELECT domain, source, row_pos, text, cast(seq // {CHUNK} AS INT) AS chunk_id,
  cast(seq % {CHUNK} AS INT) AS pos_in_chunk FROM counted)"""
_SHARD_COLUMNS = ["domain", "source", "chunk_id", "pos_in_chunk", "row_pos", "text"]
_SHARD_SELECT = "SELECT domain, source, chunk_id, pos_in_chunk, row_pos, text FROM shards"


@query("shard_write", f"WITH {_SHARDS} {_SHARD_SELECT}")
def shard_write(spark, sf_dir):
    path = written_shards(spark, sf_dir, chunk_dirs=True)
    return shards.open_shards(spark, path).select(*_SHARD_COLUMNS)


@query("shard_scan_all", f"WITH {_SHARDS} {_SHARD_SELECT}")
def shard_scan_all(spark, sf_dir):
    return shards.scan_shards(spark, written_shards(spark, sf_dir)).select(*_SHARD_COLUMNS)


@query(
    "shard_scan_phase",
    f"""WITH {_SHARDS} SELECT domain AS phase, domain, source, chunk_id, pos_in_chunk, row_pos, text FROM shards
    UNION ALL SELECT 'src1_1.pt', domain, source, chunk_id, pos_in_chunk, row_pos, text FROM shards
    WHERE contains(domain || '_' || source || '_' || chunk_id || '.pt', 'src1_1.pt')""",
)
def shard_scan_phase(spark, sf_dir):
    """Each phase by its partition, and one selection by a part of the shard name."""
    path = written_shards(spark, sf_dir)
    phases = ("general_knowledge", "frontier_traces", "code_mechanics")
    parts = [shards.scan_shards(spark, path, p).withColumn("phase", F.lit(p)) for p in phases]
    parts.append(shards.scan_shards_named(spark, path, "src1_1.pt").withColumn("phase", F.lit("src1_1.pt")))
    return catalog.union_configs(parts).select("phase", *_SHARD_COLUMNS)


@query("shard_flatten", "SELECT conv_id, turn, role, text FROM conversations")
def shard_flatten(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    listed = turns.groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", "text")).alias("samples"))
    empty = listed.withColumn("samples", F.filter("samples", lambda s: F.lit(False)))
    return shards.flatten_shards(listed.unionByName(empty), "samples")


@query(
    "shard_sync_missing",
    f"""WITH {_CHUNKED}, names AS (SELECT DISTINCT domain || '_' || source || '_' || chunk_id || '.pt' AS shard_name,
      chunk_id, domain FROM chunked),
    local AS (SELECT shard_name, 'local' AS place FROM names WHERE chunk_id % 2 = 0)
    SELECT * FROM local UNION ALL SELECT shard_name, 'remote' FROM names
    WHERE domain <> 'fr' AND shard_name NOT IN (SELECT shard_name FROM local)""",
)
def shard_sync_missing(spark, sf_dir):
    made = chunked_docs(spark, sf_dir)
    name = shard_name(F.col("domain"), F.col("source"), F.col("chunk_id")).alias("shard_name")
    names = made.select(name, "chunk_id", "domain").distinct()
    local = names.where("chunk_id % 2 = 0").select("shard_name", F.lit("local").alias("place"))
    remote = names.where("domain <> 'fr'").select("shard_name", F.lit("remote").alias("place"))
    return shards.sync_missing(local, remote)


@query(
    "trace_append_csv",
    """SELECT cast(user_id AS INT) AS epoch, cast(user_id % 7 AS INT) AS chunk_idx, event_id AS mb, value AS ce_loss,
       value / 2 AS jepa_loss, cast(0 AS DOUBLE) AS route_loss, value * 2 AS total_loss FROM events
       UNION ALL SELECT cast(user_id AS INT), cast(user_id % 7 AS INT), event_id + 1000000000, value,
       value / 2, cast(0 AS DOUBLE), value * 2 FROM events""",
)
def trace_append_csv(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    rows = events.select(
        F.col("user_id").cast("int").alias("epoch"),
        (F.col("user_id") % 7).cast("int").alias("chunk_idx"),
        F.col("event_id").alias("mb"),
        F.col("value").alias("ce_loss"),
        (F.col("value") / 2).alias("jepa_loss"),
        F.lit(0.0).alias("route_loss"),
        (F.col("value") * 2).alias("total_loss"),
    )
    path = work_path(spark, "trace")
    trace.append_trace(rows, path)
    trace.append_trace(rows.withColumn("mb", F.col("mb") + 1_000_000_000), path)
    return trace.read_trace(spark, path, trace.TRACE_SCHEMA)


# ------------------------------------------------------------------ orders


def _shard_list(spark, sf_dir):
    return chunked_docs(spark, sf_dir).groupBy("domain", "source", "chunk_id").agg(
        F.count(F.lit(1)).alias("n_rows")
    )


_LIST = f"{_CHUNKED}, shard_list AS (SELECT domain, source, chunk_id, count(*) AS n_rows FROM chunked GROUP BY ALL)"
_PHASES = ("es", "en", "de", "fr")


@query(
    "curriculum_order",
    f"""WITH {_LIST}, p AS (SELECT *, CASE domain WHEN 'es' THEN 0 WHEN 'en' THEN 1 WHEN 'de' THEN 2 ELSE 3 END AS phase
      FROM shard_list), e AS (SELECT *, unnest(range(2)) AS ep FROM p)
    SELECT domain, source, chunk_id, n_rows, cast(phase AS INT) AS phase, cast(ep AS INT) AS epoch FROM e
    ORDER BY phase, epoch, source, chunk_id""",
)
def curriculum_order_query(spark, sf_dir):
    return curriculum_order(_shard_list(spark, sf_dir), _PHASES)


@query("shard_order", f"WITH {_LIST} SELECT domain, source, chunk_id, n_rows FROM shard_list ORDER BY source, chunk_id")
def shard_order_query(spark, sf_dir):
    return shard_order(_shard_list(spark, sf_dir))


@query(
    "shard_shuffle",
    f"""WITH {_LIST}, e AS (SELECT *, cast(unnest(range(3)) AS INT) AS epoch FROM shard_list)
    SELECT *, md5(source || '/' || chunk_id || '/' || epoch) AS shuffle_key FROM e ORDER BY epoch, shuffle_key""",
)
def shard_shuffle_query(spark, sf_dir):
    return shard_shuffle(_shard_list(spark, sf_dir), 3)


@query(
    "epoch_replicate",
    "SELECT doc_id, lang, source, text, cast(unnest(range(3)) AS INT) AS epoch FROM documents",
)
def epoch_replicate_query(spark, sf_dir):
    from pairmill.operators.feed import epoch_replicate

    return epoch_replicate(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"), 3)


@query(
    "sample_head",
    f"""SELECT doc_id, text, array_to_string({SQL_LENGTHS}, ',') AS ids FROM documents
    ORDER BY lang, doc_id LIMIT 3""",
)
def sample_head_query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    head = sample_head(docs, ["lang", "doc_id"])
    return head.select("doc_id", "text", joined(token_lengths()).alias("ids"))
