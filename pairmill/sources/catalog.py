"""Which sources to read, and which of them are still open. The catalog is the user's table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairmill.functions.text import safe_source
from pairmill.storage import broadcast_if_bounded

CATALOG_SCHEMA = "domain string, domain_pos int, datasets array<string>"
CONFIG_SCHEMA = (
    "dataset string, config_pos int, path string, name string, split string, "
    "data_files string, data_dir string"
)
# What a config that names neither part stands for.
DEFAULT_NAME = "default"
DEFAULT_SPLIT = "train"


def catalog_of(spark: SparkSession, domains: Mapping[str, Sequence[str]]) -> DataFrame:
    rows = [(d, i, list(ids)) for i, (d, ids) in enumerate(domains.items())]
    return spark.createDataFrame(rows, CATALOG_SCHEMA)


def catalog_explode(catalog: DataFrame) -> DataFrame:
    """One row per dataset, with its place in the processing order."""
    return catalog.select("domain", "domain_pos", F.posexplode("datasets").alias("dataset_pos", "dataset"))


def config_expand(datasets: DataFrame, configs: DataFrame) -> DataFrame:
    """Every dataset with each of its configs, or with one default config."""
    made = datasets.join(broadcast_if_bounded(configs), "dataset", "left")
    made = made.withColumns(
        {
            "config_pos": F.coalesce("config_pos", F.lit(0)),
            "path": F.coalesce("path", "dataset"),
            "name": F.coalesce("name", F.lit(DEFAULT_NAME)),
            "split": F.coalesce("split", F.lit(DEFAULT_SPLIT)),
        }
    )
    return made.withColumn("source", safe_source(F.col("dataset"), F.col("name"), F.col("split")))


def pending_sources(expanded: DataFrame, claims: DataFrame) -> DataFrame:
    """Configs nobody has claimed."""
    return expanded.join(claims, "source", "left_anti")


def union_configs(parts: Sequence[DataFrame]) -> DataFrame:
    """All configs as one corpus, repeated rows kept, missing columns filled with NULL."""
    made = parts[0]
    for part in parts[1:]:
        made = made.unionByName(part, allowMissingColumns=True)
    return made
