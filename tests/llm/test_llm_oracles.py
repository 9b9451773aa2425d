"""Every registered llm query against its oracle, or at least whole and stable, on the smallest tables."""

from __future__ import annotations

import pytest

from scripts.verify import compare
from tests.conftest import SF
from tidemark.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    query, sql = QUERIES[name]
    same, n, _, _, diff = compare(spark, duck, name, query, sql, str(SF))
    assert same is not False, diff


def test_ids_cover_every_document(spark, duck):
    got = QUERIES["p7_ids"][0](spark, str(SF))
    assert got.count() == duck.sql("SELECT count(DISTINCT doc_id) FROM documents").fetchall()[0][0]


def test_clean_corpus_and_found_make_up_the_whole(spark):
    found = QUERIES["p8_found"][0](spark, str(SF)).select("doc_id").distinct()
    clean = QUERIES["p8_clean"][0](spark, str(SF)).select("doc_id").distinct()
    assert found.join(clean, "doc_id").count() == 0
    assert found.union(clean).count() == spark.read.parquet(str(SF / "documents.parquet")).select("doc_id").distinct().count()
