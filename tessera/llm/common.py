"""What several operators share: joins with common keys, row splits, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.textvec import lean
from tessera.scratch import discard, shared_dir, stored  # noqa: F401

#: Keys with at least this part of all rows are common; there can't be more than ``COMMON`` of them.
COMMON = 4096

def texts_of(docs: DataFrame) -> DataFrame:
    """Only ``doc_id`` and ``text``, so that other columns can have any name."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def columns(docs: DataFrame) -> list[Column]:
    """Every column by its name, whatever characters that has."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def mapped(docs: DataFrame, run, *more: T.StructField) -> DataFrame:
    """``mapInArrow`` over all columns, whatever their names; ``run`` gives them back in their order, and ``more`` behind them."""
    places = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)]
    out = docs.toDF(*[f.name for f in places]).mapInArrow(lean(run), T.StructType([*places, *more]))
    return out.toDF(*docs.columns, *[f.name for f in more])


def split_join(rows: DataFrame, table: DataFrame, key: str, weight: str) -> DataFrame:
    """Inner join of many rows a key with a stored ``table`` of one row a key.

    ``weight`` counts the rows of each key.  Rows of common keys (see
    ``COMMON``) stay where they are and meet these few keys by broadcast, so that no
    task gets all rows of one key; the others are joined as usual.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    is_common = F.col(weight) * COMMON >= total
    common = F.broadcast(table.filter(is_common))  # at most COMMON rows
    others = rows.join(common.select(key), key, "left_anti").join(table.filter(~is_common), key)
    return rows.join(common, key).unionByName(others)


def unused(name: str, docs: DataFrame) -> str:
    """A column name that ``docs`` doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def remainder(column: Column, n: int) -> Column:
    """crc32 of the value's text modulo ``n``; null stays null."""
    return F.crc32(column.cast("string").cast("binary")) % n


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)``: ``node, component`` (the smallest node reachable).

    Large-star and small-star rounds (Kiveris et al., 2014): every round
    rewires each node to its smallest neighbour, and the number of rounds grows
    with the logarithm of a component's size.  Nodes without an edge to another
    node are not returned.  No round collects nodes or edges.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct())
    state = None
    for _ in range(most):
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state or not seen[0]:
            break
        state = seen
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(low, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(linked.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
    else:
        raise RuntimeError("connected components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
