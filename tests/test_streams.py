"""Streams over tables that are folders of files."""

import hashlib

import pytest

from plumbline.plans import registry

registry.load()


@pytest.fixture(scope="module")
def parts(spark, data_dir, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("parts"))
    for name in ("documents", "events"):
        spark.read.parquet(f"{data_dir}/{name}.parquet").repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return folder


def test_upsert_reads_every_file(spark, data_dir, parts):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet").collect()
    want = [(d["doc_id"], d["source"]) for d in docs] + [(d["doc_id"] + 1_000_000_000, d["lang"]) for d in docs if d["doc_id"] % 2 == 0]
    for folder in (data_dir, parts):
        assert sorted(map(tuple, registry.QUERIES["stream_upsert"](spark, folder).collect())) == sorted(want)


def test_index_refresh_reads_every_file(spark, data_dir, parts):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet").collect()
    want = sorted((d["doc_id"], hashlib.sha1(d["text"].encode()).hexdigest()) for d in docs)
    for folder in (data_dir, parts):
        assert sorted(map(tuple, registry.QUERIES["stream_index_refresh"](spark, folder).collect())) == want


def test_metrics_read_every_file(spark, data_dir, parts):
    one, many = (sorted(map(tuple, registry.QUERIES["stream_tumbling_metrics"](spark, folder).collect())) for folder in (data_dir, parts))
    assert one and one == many
