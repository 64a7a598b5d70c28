"""Vocabulary, tokens, vectors and the whole featurization."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from pairmill.functions.arrays import joined
from pairmill.operators import tokens as tok
from pairmill.operators.normalize import drop_empty_pairs
from pairmill.operators.numbering import chunk_assign
from pairmill.operators.vectors import concept_vector, hash_encoder, score_batches
from pairmill.plans.featurize import accept_pairs, build_shards, featurize_pairs
from pairmill.plans.training_feed import decoder_feed, latent_feed
from pairmill.registry.base import SQL_CUT_DOCS, SQL_TOKENS, documents, query, sql_tokens
from pairmill.sources.shards import scan_shards
from pairmill.storage import staged_mapped, work_path

DIM = 64

SQL_VOCAB = f"""
vocab_counts AS (SELECT token, count(*) AS n FROM (SELECT unnest({SQL_TOKENS}) AS token FROM documents) GROUP BY token),
vocab AS (SELECT token, n, cast(row_number() OVER (ORDER BY n DESC, token) + 1 AS INT) AS id FROM vocab_counts
  ORDER BY n DESC, token LIMIT {tok.VOCAB_SIZE - tok.FIRST_ID})"""


def doc_vocab(spark, sf_dir):
    return tok.build_vocab(documents(spark, sf_dir).select("text"), "text")


def sql_ids(source: str, column: str, out: str, limit: int = 2048) -> str:
    """CTE ``out``: doc_id and the joined ids of ``column`` of CTE ``source``."""
    return f"""{out}_words AS (SELECT doc_id, unnest(({sql_tokens(column)})[:{limit}]) AS token,
      unnest(range(least({limit}, len({sql_tokens(column)})))) AS pos FROM {source}),
    {out} AS (SELECT doc_id, string_agg(cast(coalesce(id, 1) AS VARCHAR), ',' ORDER BY pos) AS ids,
      count(*) AS n FROM {out}_words LEFT JOIN vocab USING (token) GROUP BY doc_id)"""


def sql_vectors(source: str, column: str, out: str, dim: int = DIM, limit: int = 512) -> str:
    """CTE ``out``: doc_id and the packed hashed vector of ``column``."""
    return f"""{out}_words AS (SELECT doc_id, unnest(({sql_tokens(column)})[:{limit}]) AS token FROM {source}),
    {out}_hits AS (SELECT doc_id, cast(('0x' || substring(md5(token), 1, 8)) AS BIGINT) % {dim} AS bucket,
      count(*) AS n FROM {out}_words GROUP BY ALL),
    {out}_norms AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM {out}_hits GROUP BY doc_id),
    {out} AS (SELECT doc_id, string_agg(cast(bucket AS VARCHAR) || ':' ||
        cast(cast(round(cast(cast(n / norm AS FLOAT) AS DOUBLE) * 1000000) AS BIGINT) AS VARCHAR), ',' ORDER BY bucket) AS vector
      FROM {out}_hits JOIN {out}_norms USING (doc_id) GROUP BY doc_id)"""


def packed_vector(vector):
    """Filled places of a vector as text."""
    entries = F.transform(
        vector,
        lambda x, i: F.when(
            x != 0,
            F.concat_ws(":", i.cast("string"), F.round(x.cast("double") * 1000000).cast("bigint").cast("string")),
        ),
    )
    return F.array_join(entries, ",")


@query("build_vocab", f"WITH {SQL_VOCAB} SELECT token, n, id FROM vocab")
def build_vocab(spark, sf_dir):
    return doc_vocab(spark, sf_dir)


@query("tokenize_corpus", f"WITH {SQL_VOCAB}, {sql_ids('documents', 'text', 'coded')} SELECT doc_id, ids, n FROM coded")
def tokenize_corpus(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    made = tok.tokenize_corpus(docs, doc_vocab(spark, sf_dir), {"text": "ids"})
    return made.select("doc_id", joined(F.col("ids")).alias("ids"), F.size("ids").cast("bigint").alias("n"))


@query(
    "decode_tokens",
    f"""WITH {SQL_VOCAB}, w AS (SELECT doc_id, unnest({SQL_TOKENS}) AS token,
      unnest(range(len({SQL_TOKENS}))) AS pos FROM documents)
    SELECT doc_id, string_agg(token, ' ' ORDER BY pos) AS decoded FROM w JOIN vocab USING (token) GROUP BY doc_id""",
)
def decode_tokens(spark, sf_dir):
    vocab = doc_vocab(spark, sf_dir)
    docs = documents(spark, sf_dir).select("doc_id", "text")
    coded = docs.select("doc_id", tok.id_lookup(vocab)(tok.split_tokens(F.col("text"))).alias("ids"))
    return tok.decode_tokens(coded, vocab, "ids", "decoded").drop("ids")


@query(
    "drop_empty_tokens",
    f"""WITH {SQL_CUT_DOCS}, p AS (SELECT doc_id, {sql_tokens('sp')} AS a, {sql_tokens('sr')} AS b FROM cut_docs)
    SELECT doc_id, len(a) AS prompt_tokens, len(b) AS response_tokens FROM p WHERE len(a) > 0 AND len(b) > 0""",
)
def drop_empty_tokens(spark, sf_dir):
    from pairmill.functions.text import split_break

    docs = documents(spark, sf_dir).select("doc_id", split_break(F.col("text")).alias("pair"))
    made = docs.select(
        "doc_id",
        tok.split_tokens(F.col("pair.prompt")).alias("a"),
        tok.split_tokens(F.col("pair.response")).alias("b"),
    )
    kept = tok.drop_empty_tokens(made, "a", "b")
    return kept.select(
        "doc_id", *[F.size(c).cast("bigint").alias(n) for c, n in (("a", "prompt_tokens"), ("b", "response_tokens"))]
    )


_VECTORS = f"WITH {sql_vectors('documents', 'text', 'made')} SELECT doc_id, vector FROM made"


@query("concept_vector", _VECTORS)
def concept_vector_query(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return docs.select("doc_id", packed_vector(concept_vector(tok.split_tokens(F.col("text")), DIM)).alias("vector"))


@query("microbatch_score", _VECTORS)
def microbatch_score(spark, sf_dir):
    """A caller's encoder: the token lists of a micro-batch scored in one call."""
    encode = hash_encoder(DIM)

    def encoder(texts: list[str]) -> np.ndarray:
        import pyarrow as pa
        import regex

        lists = [regex.findall(tok.TOKEN_PATTERN, t)[:512] for t in texts]
        return encode(pa.array(lists, type=pa.list_(pa.string())))

    docs = documents(spark, sf_dir).select("doc_id", "text")
    made = score_batches(docs, encoder, "text")
    return made.select("doc_id", packed_vector(F.col("target_concept")).alias("vector"))


def document_rows(spark, sf_dir):
    return documents(spark, sf_dir).select(
        F.col("lang").alias("domain"),
        "source",
        F.col("source").alias("dataset"),
        F.col("doc_id").alias("row_pos"),
        F.to_json(F.struct("text")).alias("raw"),
    )


_SAMPLES = f"""WITH {SQL_CUT_DOCS}, {SQL_VOCAB},
    pairs AS (SELECT doc_id, lang, source, sp, sr FROM cut_docs WHERE length(sp) > 0 AND length(sr) > 0),
    {sql_ids('pairs', 'sp', 'left_side')}, {sql_ids('pairs', 'sr', 'right_side')}, {sql_vectors('pairs', 'sr', 'concepts')}
    SELECT p.lang AS domain, p.source, p.doc_id AS row_pos, l.ids AS input_tokens, r.ids AS response_tokens,
      c.vector AS target_concept FROM pairs p JOIN left_side l USING (doc_id) JOIN right_side r USING (doc_id)
      JOIN concepts c USING (doc_id)"""


def document_samples(spark, sf_dir):
    pairs = accept_pairs(document_rows(spark, sf_dir))
    return staged_mapped(featurize_pairs(pairs, doc_vocab(spark, sf_dir), DIM), "samples")


def _sample_text(samples):
    return samples.select(
        "domain",
        "source",
        "row_pos",
        joined(F.col("input_tokens")).alias("input_tokens"),
        joined(F.col("response_tokens")).alias("response_tokens"),
        packed_vector(F.col("target_concept")).alias("target_concept"),
    )


@query("featurize", _SAMPLES)
def featurize(spark, sf_dir):
    return _sample_text(document_samples(spark, sf_dir))


_HOLES = f"""{_SAMPLES.replace("WITH ", "WITH samples AS (WITH ", 1)}),
    keyed AS (SELECT nullif(domain, 'fr') AS domain, CASE WHEN source <> 'src1' THEN source END AS source, row_pos AS id,
      CASE WHEN row_pos % 10 <> 0 THEN row_pos END AS row_pos, input_tokens, response_tokens, target_concept FROM samples),
    counted AS (SELECT *, row_number() OVER (PARTITION BY domain, source ORDER BY {{first}} row_pos NULLS FIRST) - 1 AS seq FROM keyed)
    SELECT domain, source, row_pos, input_tokens, response_tokens, target_concept,
      CASE WHEN row_pos IS NOT NULL THEN cast(seq // 10 AS INT) END AS chunk_id,
      CASE WHEN row_pos IS NOT NULL THEN cast(seq % 10 AS INT) END AS pos_in_chunk FROM counted"""


def _rows_with_holes(spark, sf_dir):
    """The documents with some NULL domains, sources and positions."""
    return document_rows(spark, sf_dir).withColumns(
        {
            "domain": F.expr("nullif(domain, 'fr')"),
            "source": F.expr("if(source <> 'src1', source, null)"),
            "row_pos": F.expr("if(row_pos % 10 <> 0, row_pos, null)"),
        }
    )


def _shard_rows(spark, path):
    """All samples; rows without a position come first in their source in no given order, so their places are left out."""
    made = scan_shards(spark, path)
    place = lambda c: F.when(F.col("row_pos").isNotNull(), F.col(c)).alias(c)
    return made.select(
        "domain", "source", "row_pos",
        joined(F.col("input_tokens")).alias("input_tokens"),
        joined(F.col("response_tokens")).alias("response_tokens"),
        packed_vector(F.col("target_concept")).alias("target_concept"),
        place("chunk_id"), place("pos_in_chunk"),
    )


@query("build_shards", _HOLES.replace("{first}", ""))
def build_shards_query(spark, sf_dir):
    path = work_path(spark, "built")
    build_shards(_rows_with_holes(spark, sf_dir), doc_vocab(spark, sf_dir), path, chunk_size=10, dimension=DIM, span=100)
    return _shard_rows(spark, path)


@query("build_shards_resume", _HOLES.replace("{first}", "id % 2,"))
def build_shards_resume(spark, sf_dir):
    """Even ids first, then all rows again under ``resume``: only the odd ones are added, behind what is there."""
    path, vocab = work_path(spark, "built"), doc_vocab(spark, sf_dir)
    rows = _rows_with_holes(spark, sf_dir)
    early = F.col("row_pos").isNull() | (F.col("row_pos") % 2 == 0)
    build_shards(rows.where(early), vocab, path, chunk_size=10, dimension=DIM, span=100)
    build_shards(rows, vocab, path, chunk_size=10, dimension=DIM, span=100, resume=True)
    return _shard_rows(spark, path)


_FEED = f"""{_SAMPLES.replace("WITH ", "WITH samples AS (WITH ", 1)}),
    ids AS (SELECT domain, source, row_pos, cast(string_split(input_tokens, ',') AS INT[]) AS a,
      cast(string_split(response_tokens, ',') AS INT[]) AS b,
      row_number() OVER (PARTITION BY domain, source ORDER BY row_pos) - 1 AS seq FROM samples),
    placed_ids AS (SELECT *, cast(seq // 10 AS INT) AS chunk_id, cast(seq % 10 AS INT) AS pos_in_chunk,
      cast((seq % 10) // 4 AS INT) AS mini_batch FROM ids)"""
_ZEROS = "list_transform(range({n}), lambda x: 0)"
_SHIFTED = """array_to_string(CASE WHEN len({t}) > 1 THEN ({t})[:len({t}) - 1] ELSE {t} END, ',') AS decoder_input,
      array_to_string(CASE WHEN len({t}) > 1 THEN ({t})[2:] ELSE {t} END, ',') AS decoder_target"""


def _numbered_samples(spark, sf_dir):
    return chunk_assign(document_samples(spark, sf_dir), chunk_size=10, span=100)


def _feed_text(feed, *columns):
    sides = [joined(F.col(c)).alias(c) for c in ("decoder_input", "decoder_target")]
    return feed.select("domain", "source", "row_pos", "chunk_id", "pos_in_chunk", "mini_batch", "epoch", *columns, *sides)


@query(
    "latent_feed",
    f"""{_FEED}, wide AS (SELECT *, max(len(a)) OVER w AS wa, max(len(b)) OVER w AS wb FROM placed_ids
      WINDOW w AS (PARTITION BY domain, source, chunk_id, mini_batch)),
    padded AS (SELECT * EXCLUDE (a, b), list_concat(a, {_ZEROS.format(n='wa - len(a)')}) AS a,
      list_concat(b, {_ZEROS.format(n='wb - len(b)')}) AS b FROM wide),
    cut AS (SELECT *, unnest(range(0, len(a), 64)) AS start FROM padded),
    windows AS (SELECT *, a[start + 1:start + 64] AS wina, CASE WHEN len(b) > 1 THEN b[start + 1:start + 64] ELSE b END AS winb FROM cut)
    SELECT domain, source, row_pos, chunk_id, pos_in_chunk, mini_batch, cast(unnest(range(2)) AS INT) AS epoch,
      cast(start // 64 AS INT) AS window_id, array_to_string(wina, ',') AS input_tokens, {_SHIFTED.format(t='winb')} FROM windows""",
)
def latent_feed_query(spark, sf_dir):
    """Real ids, padded by batches of four, cut into windows of 64, shifted, for two epochs."""
    feed = latent_feed(_numbered_samples(spark, sf_dir), epochs=2, batch_size=4, width=64)
    return _feed_text(feed, "window_id", joined(F.col("input_tokens")).alias("input_tokens"))


@query(
    "decoder_feed",
    f"""{_FEED}, fixed AS (SELECT *, list_concat(b[:257], {_ZEROS.format(n='257 - least(len(b), 257)')}) AS f FROM placed_ids)
    SELECT domain, source, row_pos, chunk_id, pos_in_chunk, mini_batch, cast(unnest(range(2)) AS INT) AS epoch,
      {_SHIFTED.format(t='f')} FROM fixed""",
)
def decoder_feed_query(spark, sf_dir):
    return _feed_text(decoder_feed(_numbered_samples(spark, sf_dir), epochs=2))


@query(
    "project_sample",
    f"""WITH {SQL_CUT_DOCS}, p AS (SELECT lang AS domain, source, doc_id AS row_pos,
      {sql_tokens('sp')} AS a, {sql_tokens('sr')} AS b FROM cut_docs WHERE length(sp) > 0 AND length(sr) > 0)
    SELECT domain, source, row_pos, array_to_string(list_transform(a, lambda t: length(t)), ',') AS input_tokens,
      array_to_string(list_transform(b, lambda t: length(t)), ',') AS response_tokens, len(b) AS concept_size FROM p""",
)
def project_sample(spark, sf_dir):
    from pairmill.operators.feed import project_sample as project
    from pairmill.registry.base import token_lengths

    pairs = drop_empty_pairs(accept_pairs(document_rows(spark, sf_dir)))
    made = pairs.withColumns(
        {
            "input_tokens": token_lengths("prompt"),
            "response_tokens": token_lengths("response"),
            "target_concept": token_lengths("response").cast("array<float>"),
        }
    )
    return project(made).select(
        "domain",
        "source",
        "row_pos",
        joined(F.col("input_tokens")).alias("input_tokens"),
        joined(F.col("response_tokens")).alias("response_tokens"),
        F.size("target_concept").cast("bigint").alias("concept_size"),
    )
