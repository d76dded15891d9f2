"""Every query of the engine against its SQL at the smallest scale."""

import duckdb
import pytest

from sheaf.queries import oracle_sql, queries

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(value):
    if isinstance(value, float):
        return f"{value:.7g}"
    return str(value)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    got = queries()[name](spark, DIR)
    want = db.execute(oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    rows = sorted(tuple(shown(r[c]) for c in columns) for r in got.collect())
    assert rows == sorted(tuple(shown(v) for v in r) for r in want.fetchall())


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_first_candidate_settles_ties_by_place_in_the_table(spark, tmp_path):
    """Equal line numbers: the row that stands first in the files, by name and then inside, as one thread of SQL reads them."""
    import pyarrow.parquet as pq

    lines = pq.read_table(f"{DIR}/lineitem.parquet")
    (tmp_path / "lineitem.parquet").mkdir()
    for i, (at, n) in enumerate(((0, 50), (50, 1950), (2000, 4000))):  # a reader may begin with the largest file
        pq.write_table(lines.slice(at, n), tmp_path / f"lineitem.parquet/part-{i}.parquet")
    db = duckdb.connect()
    db.execute("set threads = 1")
    db.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    want = sorted(tuple(r) for r in db.execute(oracle_sql()["first_candidate"]).fetchall())
    got = queries()["first_candidate"](spark, str(tmp_path)).select("doc_id", "field", "value", "ord")
    assert sorted(tuple(r) for r in got.collect()) == want
