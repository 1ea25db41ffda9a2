from pyspark.sql import functions as F

from millrace.operators import index, search
from millrace.sources import fixtures as fx


def test_a_search_fetches_only_what_it_gives_out(spark, sf_dir, tmp_path):
    e = fx.read(spark, sf_dir, "embeddings").select(F.concat(F.lit("narrative:"), F.col("vec_id").cast("string")).alias("document_id"), "embedding")
    docs = fx.narratives(spark, sf_dir)
    path = str(tmp_path / "index")
    index.build_index(docs, fx.tables(spark, sf_dir), e, path, analyzer="english")
    built = index.load_index(spark, path, "english")
    every = fx.retrieval_documents(spark, sf_dir)
    one = docs.first()
    for filters in ({}, {"ticker": one.ticker}, {"ticker": one.ticker, "report_year": one.report_year}, {"ticker": "none"}):
        got = index.search_index(built, "er or tiones", 5, **filters)
        want = search.keyword_search(every, "er or tiones", 5, **filters)
        assert sorted((r["rank"], r.document_id, r.score) for r in got.collect()) == sorted((r["rank"], r.document_id, r.score) for r in want.collect())
    found = index.search_index(built, "er", 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan parquet" in line)
    assert "In(document_id" in scan and "ticker" in scan.split("PartitionFilters: [")[1].split("]")[0] and "report_year" in scan.split("PartitionFilters: [")[1].split("]")[0]
    assert found.count() == 3
    # a folder has one file or two, as its rows come dealt by range
    assert len(built.documents.inputFiles()) <= len({f.rsplit("/", 1)[0] for f in built.documents.inputFiles()}) + int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert index.search_index(built, "qqqq", 3).count() == 0
