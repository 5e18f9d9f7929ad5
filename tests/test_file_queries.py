"""The file queries over odd texts give the rows of their SQL."""

import duckdb
import pytest

from quillveil import catalog
from tests.test_oracles import plain

_ODD = [None, "", " ", "\n\n", "\t\n \r\n", "\xa0", " \u2003\n\u3000", "Jean Dupont\nwrite a.b@mail.org now", "\n".join(map(str, range(51)))]
_ODD += [t for c in "\x0b\x1c\x85\xa0\u2003\u2028\u3000" for t in (f"ab{c}cd\n  {c} x{c}", f"{c}ab \nx.y@mail.org{c}{c}y", f"é{c}ł z")]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(list(enumerate(_ODD)), "doc_id bigint, text string").write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.mark.parametrize("name", ["pdf_page_sizes", "pdf_page_texts", "pdf_redacted_emails", "pdf_request"])
def test_odd_texts(spark, odd, name):
    """Texts without lines have no page; white space that the SQL does not take for blanks stays."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{odd}/documents.parquet/*.parquet'")
    found = con.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    want = sorted(tuple(map(plain, r)) for r in found.fetchall())
    got = catalog.queries()[name](spark, odd).select(*columns).collect()
    assert sorted(tuple(map(plain, r)) for r in got) == want and len(want) == 24
