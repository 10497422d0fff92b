"""Every registered query against its SQL, and those without SQL for their shape."""

import pytest
from compare import compare

from millrace.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_agrees_with_sql(spark, name):
    assert compare(catalog.QUERIES[name](spark, SF), catalog.ORACLES[name], SF) is None


#: Queries without SQL, and where their results are held against expected ones; the pages of the tables link to no platform.
HELD = {
    "account_addresses": "test_web", "accounts_of_entities": "test_map", "alike_people": "test_alike", "chunk_documents": "test_web", "corroborated_people": "test_alike", "cited_answers": "test_web", "clean_record_notes": "test_cleaning", "detected_entities": "test_headers",
    "hashing_embedding": "test_web", "header_proposals": "test_headers", "hybrid_search": "test_web", "identity_links": "test_map", "ingested_documents": "test_tables", "name_redaction": "test_web",
    "name_redaction_cases": "test_web", "page_integrity": "test_web", "page_links": "test_web", "page_text": "test_web", "probable_people": "test_map", "retrieved_passages": "test_web", "search_queries": "test_map",
}


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_is_held_elsewhere(spark, name):
    assert name in HELD
    once, again = (catalog.QUERIES[name](spark, SF).collect() for _ in range(2))
    assert sorted(map(repr, once)) == sorted(map(repr, again)) and (once or name == "identity_links")


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
