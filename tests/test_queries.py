"""Every query with SQL against DuckDB on the smallest tables."""

import pytest

from quillspark import queries as q

from conftest import SMALL, rows_of


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_against_sql(name, spark, duck):
    assert rows_of(q.QUERIES[name](spark, SMALL).toPandas()) == rows_of(duck.execute(q.SQL[name]).df())


def test_shuffle_is_numpys_permutation(spark):
    import numpy as np

    rows = q.QUERIES["view_shuffle_numpy"](spark, SMALL).orderBy("_pos").collect()
    assert [r["doc_id"] for r in rows] == np.random.default_rng(7).permutation(len(rows)).tolist()


def test_shuffle_by_hash_is_a_permutation(spark):
    rows = q.QUERIES["view_shuffle"](spark, SMALL).collect()
    assert sorted(r["_pos"] for r in rows) == list(range(len(rows))) and len({r["doc_id"] for r in rows}) == len(rows)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def _documents(spark, path, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "cast(length(text) as bigint) as n_chars").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_merge_reads_whole_texts(spark, tmp_path):
    merged = [q.QUERIES["merge_parts_whole"](spark, _documents(spark, tmp_path / end, ["a long text " + end, "b"])).first().merged for end in ("x", "y")]
    assert merged[0] != merged[1]


def test_content_reads_whole_texts(spark, tmp_path):
    long = "twenty characters and more "
    got = [{r.doc_id: r.content_md5 for r in q.QUERIES["content_text_whole"](spark, _documents(spark, tmp_path / end, [long + end, "line\n" + end])).collect()} for end in ("x", "y")]
    assert got[0][0] != got[1][0] and got[0][1] != got[1][1]
