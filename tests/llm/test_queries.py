"""Operator queries with SQL give the same rows as that SQL; the entry point adds all eleven."""

import duckdb
import pytest

import __spark_entry__ as entry
from spanwise.llm import queries
from tests.test_queries import TABLES, canonical


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    found = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(found.fetchall(), columns)


def test_registered():
    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 11)} == {x.split("_")[0] for x in names if x.startswith("op")} and "pipeline" in names


def test_quality_sql_at_all_white_space(spark):
    texts = [" a\vb\fc\rd\te\nf ", "\x0b\x0c\r", None, "", "x\x1cy\x85z \u00a0", "one two three four five six seven eight nine ten\rten\v"]
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", documents.toPandas())
    found = con.execute(queries.ORACLES["op8_quality"])
    columns = [d[0] for d in found.description]
    df = queries.quality.judge(documents)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(found.fetchall(), columns)


def test_texts_of_several_megabytes(spark, tmp_path):
    """Every operator on documents takes texts of millions of characters whole: words, one word, digits, lines, white space."""
    import random

    rng = random.Random(3)
    words = " ".join(f"wort{rng.randrange(50_000)}" for _ in range(300_000))
    texts = [words, "x" * 3_000_000, "7 " * 1_000_000, "a line of text\n" * 150_000, " \n" * 1_000_000, "short text of a few plain words that stays as it is here"]
    spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    for name, f in queries.QUERIES.items():
        if name in ("op2_extraction", "op6_urls"):
            continue
        rows = {r["doc_id"]: r for r in f(spark, str(tmp_path)).collect()}
        assert set(rows) == set(range(len(texts))), name
        if name == "op8_quality":
            assert [rows[k]["n_words"] for k in range(6)] == [len(t.split()) for t in texts] and rows[3]["n_repeat_words"] == 600_000
        if name == "op5_lm":
            assert [rows[k]["n_tokens"] for k in range(6)] == [len(t.split()) + 1 for t in texts]
        if name == "op3_media":
            assert [rows[k]["n_bytes"] for k in range(6)] == [len(t) for t in texts]
    page = "<p>" + words + "</p>" + "<div>" * 50_000 + "<a href=1>" * 1000
    spark.createDataFrame([(1, "x://h/" + "p/" * 500_000, page)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    (row,) = queries.op2_extraction(spark, str(tmp_path)).collect()
    assert row["text"] == words
    assert len(queries.op6_urls(spark, str(tmp_path)).first()["path"]) == 1_000_001
