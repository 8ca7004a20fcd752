"""The registered queries: those with SQL agree with it; the others give a row per row of their table."""

import os

import duckdb
import pytest

from tidewatch.llm import queries


def rounded(rows, columns):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in (r[c] for c in columns)) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_with_sql(spark, data, name):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{data}/{f}')")
    want = con.sql(queries.ORACLE[name]).to_arrow_table().to_pylist()
    got = [r.asDict() for r in queries.QUERIES[name](spark, data).collect()]
    columns = sorted(want[0])
    key = [c for c in columns if c.endswith("_id") and c != "component_id"] + columns
    assert sorted(got[0]) == columns
    plain = lambda rows: sorted(map(str, rounded([{c: "" if r[c] is None else r[c] for c in columns} for r in rows], key)))
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", ["op1_toxicity", "op4_tokenfile", "op5_quality", "op7_sharding", "op8_syncmers"])
def test_query_of_documents(spark, data, name):
    ids = sorted(r["doc_id"] for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id").collect())
    assert sorted(r["doc_id"] for r in queries.QUERIES[name](spark, data).collect()) == ids
