"""The shared folder: refused where executors can't see it, dealt tables, and what is removed; stored postings."""

import pytest
from pyspark.sql import functions as F

from lodestone import storage
from lodestone.operators import signals


class Elsewhere:
    """A session whose executors are on other machines, with no shared folder set."""

    class conf:
        get = staticmethod(lambda key, default=None: default)

    class sparkContext:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)


def test_no_local_folder_on_a_cluster():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_dir(Elsewhere)


def test_small_tables_are_dealt_and_large_ones_left(spark, sf, monkeypatch):
    docs = storage.table(spark, sf, "documents")
    dealt = storage.spread(docs)
    assert dealt.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and dealt.count() == docs.count()
    monkeypatch.setattr(storage, "SMALL", 1)
    assert storage.spread(docs) is docs


def test_stored_postings_answer_from_their_shelves(spark, sf):
    docs = storage.table(spark, sf, "documents")
    index = signals.postings(docs, "doc_id")
    path = storage.new_path(spark, "postings")
    signals.write_postings(index, path, shelves=16)
    read = signals.read_postings(spark, path, "The of", shelves=16)
    assert {r.token for r in read.select("token").distinct().collect()} == {"the", "of"}
    want = {r.doc_id for r in signals.fts_match(index, "the of", "doc_id").collect()}
    assert {r.doc_id for r in signals.fts_match(read, "the of", "doc_id").collect()} == want != set()
    read_from = {r.f.split("/shelf=")[1].split("/")[0] for r in read.select(F.input_file_name().alias("f")).distinct().collect()}
    assert 1 <= len(read_from) <= 2
