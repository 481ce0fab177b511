"""Every query with an oracle gives the rows that DuckDB gives on the smallest tables."""

from __future__ import annotations

import os

import pytest

from quillstrata import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{DATA}/{name}'")
    return con


def rows(values, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(repr([round(v[k], 9) if isinstance(v[k], float) else v[k] for k in order]) for v in values)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_oracle(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    expected = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(df.columns) == sorted(expected.columns)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(expected.fetchall(), expected.columns)


def test_bundles_never_exceed_the_bound(spark):
    placed = catalogue.queries()["activation_bundle_bound"](spark, DATA)
    most = placed.groupBy("turn_id").sum("added").agg({"sum(added)": "max"}).first()[0]
    assert 0 < most <= 8


def test_schema_documents_are_strict(spark):
    import json

    def strict(schema):
        if schema.get("type") == "object":
            assert schema["additionalProperties"] is False
        for part in (*schema.get("properties", {}).values(), *schema.get("oneOf", ()), *([schema["items"]] if "items" in schema else ())):
            strict(part)

    rows = catalogue.queries()["schema_export"](spark, DATA).collect()
    assert len({r.name for r in rows}) == 25
    for row in rows:
        document = json.loads(row.document)
        assert row.document.endswith("\n") and ("oneOf" in document or document["type"] == "object")
        strict(document)
