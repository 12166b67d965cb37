"""Queries against their SQL, and tables that are awkward in other ways than their texts."""

import duckdb
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tessera.llm")
from tessera.llm import kneser_ney, near_dedup, quality_cnn, queries, secrets_crf, substring  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_give_the_rows_of_their_sql(spark, data, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{data}/documents.parquet')")
    got, want = queries.QUERIES[name](spark, data).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted(map(repr, df[columns].astype(object).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_columns_of_any_name(spark, data):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(60)
    odd = docs.withColumns({"a.b": F.lit(1), "tick`s": F.lit("x"), "_kept": F.lit(None).cast("string"), "salt": F.lit(2.0), "bucket": F.lit("z")})
    for table in (odd, odd.unionByName(odd.limit(3))):
        for name, stage in pipeline.STAGES[:-1]:
            out = stage(spark, table, data)
            assert out.columns == odd.columns and out.filter("`a.b` = 1 and `tick``s` = 'x' and salt = 2.0 and bucket = 'z' and _kept is null").count() == out.count() > 0, name


def test_models_meet_empty_tables(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    empty = docs.filter("false")
    assert kneser_ney.score(empty, kneser_ney.train(docs.limit(20))).count() == 0
    assert secrets_crf.scan(empty, secrets_crf.learn(docs)).count() == 0
    assert secrets_crf.scan(docs.limit(5), secrets_crf.learn(empty)).count() == 5
    net = quality_cnn.learn(docs, spark.read.parquet(f"{data}/labels.parquet"), F.lit(True))
    assert quality_cnn.score(empty, net).count() == 0 and quality_cnn.keep(empty, net).count() == 0
    assert near_dedup.drop_near_duplicates(empty).count() == 0 and substring.remove_repeated(empty).count() == 0
