"""Every registered query with SQL gives the same rows as that SQL, on the smallest data."""

import duckdb
import pytest

from spanwise import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def canonical(rows, columns):
    def plain(v):
        if hasattr(v, "isoformat"):
            return v.isoformat()[:10]
        return round(v, 6) if isinstance(v, float) else v

    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, duck, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    found = duck.execute(registry.ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(found.fetchall(), columns)


def test_soundex_keys(spark, sf_dir):
    rows = registry.QUERIES["bk_soundex"](spark, sf_dir).limit(5).collect()
    assert all(r["fine"].endswith(r["medium"]) and r["medium"].endswith(r["coarse"]) for r in rows)


def test_entry_without_the_text_operators():
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(registry.ORACLES) <= set(entry.oracle_sql())
