"""The registered queries op1_ to op10_: names, columns, whole tables, and SQL where there is some."""

import os
import re

import duckdb
import pytest

from densika.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables aren't here")

#: The columns that were agreed on, and the table that each query reads.
AGREED = {
    1: ("documents", "doc_id held_out n_tokens n_known train_tokens base_score score"),
    2: ("documents", "doc_id held_out score predicted"),
    3: ("documents", "doc_id n_tokens ids_sha256 decoded_sha256"),
    4: ("documents", "doc_id n_shingles component_id kept"),
    5: ("documents", "doc_id held_out lang_pred score"),
    6: ("embeddings", "query_id rank vec_id score"),
    7: ("documents", "doc_id n_bytes n_removed n_spans kept_sha256"),
    8: ("documents", "doc_id start length ids_crc32 doc_tokens sequence_id offset"),
    9: ("pages", "page_id payload_bytes payload_digest record_type refers_to"),
    10: ("documents", "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept"),
}


def table(name):
    path = f"{DATA}/{name}.parquet"
    return path + "/*.parquet" if os.path.isdir(path) else path


def test_one_query_for_each_operator():
    numbers = [int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES]
    assert sorted(numbers) == list(range(1, 11))
    assert set(queries.SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", queries.QUERIES)
def test_columns_and_rows(spark, name):
    source, columns = AGREED[int(re.match(r"op(\d+)_", name)[1])]
    found = queries.QUERIES[name](spark, DATA)
    assert set(columns.split()) <= set(found.columns)
    key = columns.split()[0]
    ids = {r[0] for r in duckdb.sql(f"SELECT {'vec_id' if source == 'embeddings' else key} FROM '{table(source)}'").fetchall()}
    if source == "embeddings":
        ids = {i for i in ids if i % 50 == 0}
    rows = found.collect()
    assert {r[key] for r in rows} == ids
    if source != "embeddings" and not name.startswith("op8_"):
        assert len(rows) == len(ids)


@pytest.mark.parametrize("name", queries.SQL)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{table(t)}'")
    theirs = con.execute(queries.SQL[name])
    columns = [d[0] for d in theirs.description]
    ours = queries.QUERIES[name](spark, DATA)
    assert sorted(columns) == sorted(ours.columns)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in ours.select(*columns).collect()), key=key) == sorted(theirs.fetchall(), key=key)
