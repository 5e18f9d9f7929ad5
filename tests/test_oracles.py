"""Every query with SQL gives DuckDB's rows."""

import datetime

import duckdb
import pytest

from quillveil import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else repr(v) if isinstance(v, float) else str(v)


@pytest.fixture(scope="session")
def con(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracle(spark, small, con, name):
    df = catalog.queries()[name](spark, small)
    columns = sorted(df.columns)
    found = con.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted(tuple(plain(r[i]) for i in order) for r in found.fetchall())
    assert sorted(tuple(plain(v) for v in r) for r in df.select(*columns).collect()) == want


def test_user_patterns(spark, small):
    """The rows without SQL are those of the patterns' own engine, text by text."""
    import regex

    from quillveil.catalog.texts import USER_PATTERNS

    want = {}
    for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect():
        for i, p in enumerate(USER_PATTERNS):
            if n := sum(1 for _ in regex.finditer(p, r.text or "", flags=regex.V0 | regex.IGNORECASE)):
                want[r.doc_id, f"regex:{i}"] = n
    got = {(r.doc_id, r.rule_id): r.n_hits for r in catalog.queries()["regex_user_rule"](spark, small).collect()}
    assert got == want and len({k for _, k in want}) == len(USER_PATTERNS)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["doc_id", "status", "coverage", "total_matches", "failed"]
