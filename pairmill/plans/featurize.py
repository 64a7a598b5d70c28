"""The whole corpus job: raw rows to numbered, capped shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairmill.functions.arrays import TOKEN_LIMIT, truncate
from pairmill.operators.keyed import join_small, key_of
from pairmill.operators.metrics import source_totals
from pairmill.operators.normalize import drop_empty_pairs, normalize_pairs, pair_columns
from pairmill.operators.numbering import CHUNK_SIZE, SPAN, chunk_assign, row_cap
from pairmill.operators.tokens import has_token, id_lookup, split_tokens
from pairmill.operators.vectors import DIMENSION, concept_vector
from pairmill.sources.shards import commit_shards, has_shards, scan_shards
from pairmill.storage import staged, staged_mapped

SAMPLE_COLUMNS = (
    "domain", "source", "dataset", "row_pos", "row_hash", "rule",
    "input_tokens", "response_tokens", "target_concept",
)


def accept_pairs(raw: DataFrame, version: str = "v2") -> DataFrame:
    """(domain, source, dataset, row_pos, raw) to rows with both sides of a pair."""
    return drop_empty_pairs(pair_columns(normalize_pairs(raw, "raw", version)))


def featurize_pairs(
    pairs: DataFrame, vocab: DataFrame, dimension: int = DIMENSION, limit: int = TOKEN_LIMIT
) -> DataFrame:
    """Tokens and vector per pair.

    Sides without a token go before any Python runs, told by their first visible character: a
    filter on the result of a Python function would run that function a second time.
    """
    filled = pairs.where(has_token(F.col("prompt")) & has_token(F.col("response")))
    to_ids = id_lookup(vocab)
    prompt = truncate(split_tokens(F.col("prompt")), limit)
    response = truncate(split_tokens(F.col("response")), limit)
    made = filled.withColumns(
        {
            "input_tokens": to_ids(prompt),
            "response_tokens": to_ids(response),
            "target_concept": concept_vector(response, dimension),
        }
    )
    return made.select(*[c for c in SAMPLE_COLUMNS if c in made.columns])


def _identity(df: DataFrame) -> Column:
    """What a row is known by in another run: its place, or its content where it has none."""
    content = F.when(F.col("row_pos").isNull(), F.col("row_hash"))
    return key_of("domain", "source", "row_pos", content)


def resume_rows(raw: DataFrame, shards: DataFrame) -> DataFrame:
    """Rows no shard holds yet. NULL keys are keys; the identity is fine-grained, so no source makes the join uneven."""
    known = shards.select(_identity(shards).alias("_on")).distinct()
    hashed = raw.withColumn("row_hash", F.xxhash64("raw"))
    return hashed.withColumn("_on", _identity(hashed)).join(known, "_on", "left_anti").drop("_on", "row_hash")


def build_shards(
    raw: DataFrame,
    vocab: DataFrame,
    path: str,
    chunk_size: int = CHUNK_SIZE,
    rules=None,
    dimension: int = DIMENSION,
    version: str = "v2",
    resume: bool = False,
    span: int = SPAN,
) -> None:
    """Write shards of every source in one job.

    Accepted samples are written once, each with a row number of its own in that table; the cap and the numbers
    then come from their keys and that number alone, so neither tokenizing nor scoring runs a second time, and
    neither a NULL key nor a missing, hashed or repeated position loses a row or makes a task large. Without
    ``rules`` no row is capped. With ``resume`` the shards in ``path`` count towards cap and numbers and their
    rows are not read again; without it a path that holds shards is refused.
    """
    done = already = None
    spark = raw.sparkSession
    if resume and has_shards(spark, path):
        shards = scan_shards(spark, path)
        raw = resume_rows(raw, shards)
        already = staged(source_totals(shards), "rows-before")
    elif has_shards(spark, path):
        raise FileExistsError(f"{path} holds shards; name another path or resume")
    pairs = accept_pairs(raw.withColumn("row_hash", F.xxhash64("raw")), version)
    samples = featurize_pairs(pairs, vocab, dimension)
    accepted = staged_mapped(samples.withColumn("_row", F.monotonically_increasing_id()), "accepted-samples")
    keys = ["domain", "source"]
    thin = accepted.select(*keys, "row_pos", "_row", "dataset")
    if already is not None:
        thin = join_small(thin, already.select(*keys, F.col("n_rows").alias("_before_run")), keys, "left")
        done = F.coalesce("_before_run", F.lit(0))
    capped = row_cap(thin, rules=rules, done=done, span=span, tie="_row")
    numbered = chunk_assign(
        capped.select(*keys, "row_pos", "_row"), chunk_size=chunk_size, already=already, span=span, tie="_row"
    )
    numbered = numbered.select("_row", "chunk_id", "pos_in_chunk")
    commit_shards(accepted.join(numbered, "_row").drop("dataset", "_row"), path)
