"""The registered queries: their columns, whole tables, and SQL where there is some."""

import duckdb
import pytest
from netloom.llm import queries

COLUMNS = {
    "op1_chat_formatting": {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string", "formatted_chars": "bigint"},
    "op2_best_fit_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op5_fingerprints": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
    "op6_html_extraction": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op7_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op9_quality_classifier": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op10_url_filters": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
}
TABLE = {"op1_chat_formatting": None, "op2_best_fit_packing": None, "op6_html_extraction": "pages", "op10_url_filters": "pages"}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, sf, name):
    out = queries.queries()[name](spark, sf)
    assert dict(out.dtypes) == COLUMNS[name]
    table = TABLE.get(name, "documents")
    if table:
        assert out.count() == spark.read.parquet(f"{sf}/{table}.parquet").count()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("conversations", "pages"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    out = queries.queries()[name](spark, sf)
    want = con.execute(queries.oracle_sql()[name])
    order = [c[0] for c in want.description]
    assert sorted(map(repr, map(tuple, out.select(order).collect()))) == sorted(map(repr, want.fetchall()))
