"""The catalog reader: dense places in file order, under any split size, and reports of what cannot be read."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from pairmill.registry.shards import catalog_scan, written_catalog
from pairmill.sources import catalog, reader, scans
from pairmill.storage import work_path

SPLITS = "spark.sql.files.maxPartitionBytes"


@pytest.fixture(scope="module")
def lines(spark):
    """Three files of lines, with blank ones among them, whose names do not follow the order of writing."""
    path = work_path(spark, "t-lines")
    for name, begin in (("b", 1000), ("a", 0), ("c", 2000)):
        rows = spark.range(begin, begin + 500, 1, 1).select(F.format_string('{"id":%d,"t":"é %d"}', "id", "id").alias("value"))
        rows.union(spark.sql("SELECT '  '")).coalesce(1).write.text(f"{path}/{name}")
    return path


def test_places_follow_files_and_rows_under_any_split_size(spark, lines):
    before = spark.conf.get(SPLITS)
    try:
        for size in ("128m", "4000b", "900b"):
            spark.conf.set(SPLITS, size)
            scan = spark.read.option("recursiveFileLookup", "true").text(lines)
            assert size == "128m" or scan.rdd.getNumPartitions() > 3
            found = reader.place_lines(scan, F.col("value")).orderBy("row_pos").collect()
            assert [r.row_pos for r in found] == list(range(1500))
            ids = [int(r.raw[6 : r.raw.index(",")]) for r in found]
            assert ids == [*range(500), *range(1000, 1500), *range(2000, 2500)]
    finally:
        spark.conf.set(SPLITS, before)


def test_parquet_places(spark):
    path, before = work_path(spark, "t-parquet"), spark.conf.get(SPLITS)
    spark.range(0, 900, 1, 3).withColumn("é.x", F.col("id") * 2).write.option("parquet.block.size", 1024).parquet(path)
    try:
        for size in ("128m", "2000b"):
            spark.conf.set(SPLITS, size)
            found = reader.place_parquet(spark.read.parquet(path)).orderBy("row_pos").collect()
            assert [(r.row_pos, r.raw) for r in found] == [(k, f'{{"id":{k},"é.x":{2 * k}}}') for k in range(900)]
    finally:
        spark.conf.set(SPLITS, before)


def test_configs_that_cannot_be_read_are_reported(spark, sf_dir):
    rows, status = catalog_scan(spark, sf_dir)
    assert {r.source: r.detail for r in status.collect() if not r.ok} == {"missing_default_train": "PATH_NOT_FOUND"}
    assert rows.schema.simpleString() == "struct<domain:string,source:string,dataset:string,row_pos:bigint,raw:string>"


def test_empty_catalog(spark):
    expanded = catalog.config_expand(
        catalog.catalog_explode(catalog.catalog_of(spark, {})), spark.createDataFrame([], catalog.CONFIG_SCHEMA)
    )
    rows, status = reader.scan_catalog(spark, "/nowhere", expanded)
    assert rows.count() == status.count() == 0


def test_only_a_wrong_format_makes_the_reader_fall_back(spark, lines):
    with pytest.raises(AnalysisException):
        scans.scan_or_text(spark, f"{lines}/none")
    assert not scans.is_wrong_format(RuntimeError("connection reset")) and scans.is_wrong_format(RuntimeError("x is not a Parquet file. y"))


def test_the_written_catalog_has_more_files_for_more_splits(spark, tmp_path):
    before, sf_dir = spark.conf.get(SPLITS), str(tmp_path)
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 512).alias("text"), F.lit("s").alias("source"))
    rows.coalesce(1).write.parquet(f"{sf_dir}/documents.parquet")
    try:
        spark.conf.set(SPLITS, "20000b")
        splits = spark.read.parquet(f"{sf_dir}/documents.parquet").rdd.getNumPartitions()
        assert splits > 4
        root = written_catalog(spark, sf_dir)
        for folder in ("parquet", "json/gz", "json/deep", "text"):
            files = spark.read.option("recursiveFileLookup", "true").text(f"{root}/{folder}").inputFiles()
            assert len(files) >= splits
    finally:
        spark.conf.set(SPLITS, before)
