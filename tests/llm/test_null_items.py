"""Benchmark items without an id."""

from millrace.llm import decontaminate
from tests import oracle


def test_items_without_an_id_count_as_in_the_sql(spark, tmp_path):
    import duckdb

    docs = [(1, "say tiny item now"), (2, "other words here"), (3, "a tiny item and w1 w2"), (4, None)]
    items = [(None, "tiny item"), (None, "w1 w2"), (7, "w1 w2")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = decontaminate.op2_decontaminate(spark, str(tmp_path)).toPandas()
    assert dict(zip(got.doc_id, got.n_hit)) == {1: 2, 2: 0, 3: 4, 4: 0}
    assert oracle.rows(got) == oracle.rows(con.sql(decontaminate.OP2_SQL).df())
