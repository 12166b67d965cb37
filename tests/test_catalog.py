import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.plans import catalog, fields  # noqa: F401


def _plain(v):
    return round(v, 9) if isinstance(v, float) and not math.isnan(v) else v


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{data}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows_as_sql(spark, data, duck, name):
    df = catalog.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    result = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    want = sorted(repr([_plain(r[names.index(c)]) for c in cols]) for r in result.fetchall())
    assert sorted(repr([_plain(r[c]) for c in cols]) for r in df.collect()) == want


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_crawl_levels_over_every_line_item(spark, data):
    rows = spark.read.parquet(f"{data}/lineitem.parquet").select("l_orderkey", "l_partkey").collect()
    links = {}
    for r in rows:
        links.setdefault(r.l_orderkey, set()).add(r.l_partkey)
    seen = level = {min(links)}
    want = dict.fromkeys(level, 0)
    for depth in (1, 2):
        level = set().union(*(links.get(x, set()) for x in level)) - seen
        seen = seen | level
        want |= dict.fromkeys(level, depth)
    got = catalog.QUERIES["crawl_levels_whole"](spark, data).collect()
    assert len(got) == len(want) and {r.node: r.depth for r in got} == want and max(want.values()) == 2


@pytest.mark.parametrize("name", ["markup_fields", "title_windows"])
def test_customers_in_one_file_are_dealt_out(spark, tmp_path, name):
    rows = 8 * catalog.TASK_ROWS
    spark.range(1, rows + 1, 1, 1).withColumnRenamed("id", "c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    got = catalog.QUERIES[name](spark, str(tmp_path))
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == (rows if name == "title_windows" else rows - rows // 3 - (rows % 3 == 2)) and len(sizes) == 8 and max(sizes) <= catalog.TASK_ROWS + 8
