"""Best-fit decreasing packing of token sequences into windows of fixed size.

Documents are encoded, end with one separator id, and are cut: full windows
first, then one remainder each.  Best-fit decreasing depends on the remainders
only through how many there are of each length, so the driver packs the counts
(at most ``window - 1`` of them, whatever the corpus) and Spark places the
documents: a piece's rank among those of its length tells its window and offset.

A segment tree over remaining capacities finds the tightest open window; runs
of windows in the same state move together, so the work on the driver depends
on the number of lengths, not of documents.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import bpe
from tessera.llm import textvec as V
from tessera.llm.common import stored, texts_of

WINDOW = 1024
SEPARATOR = 0
BLOCK_BYTES = 1 << 19  # of text encoded at once; larger blocks only take more memory


class _Tightest:
    """A segment tree over remaining capacities: the smallest one of at least ``n`` with open windows."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.open = [0] * (2 * self.size)

    def add(self, capacity: int, n: int) -> None:
        i = capacity + self.size
        while i:
            self.open[i] += n
            i //= 2

    def find(self, least: int) -> int:
        i = least + self.size
        if self.open[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return 0


def best_fit_decreasing(counts: dict[int, int], window: int = WINDOW) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Pack ``counts[length]`` pieces; returns the placements and the number of windows.

    A placement ``(length, rank, n, first, offset, each)`` says: pieces ``rank``
    to ``rank + n - 1`` of that length go to the windows from ``first`` on,
    ``each`` to a window, one after another from ``offset``.
    """
    tree, states, placed, used = _Tightest(window), {}, [], 0  # states: capacity -> runs (first, n) of equal windows
    for length in sorted((x for x in counts if counts[x]), reverse=True):
        rank, left = 0, counts[length]
        while left:
            capacity = tree.find(length)
            if capacity:
                first, n = states[capacity].pop()
                tree.add(capacity, -n)
            else:
                capacity = window
                first, n = used, -(-left // (window // length))
                used += n
            each = capacity // length
            full = min(n, left // each)
            if full:
                placed.append((length, rank, full * each, first, window - capacity, each))
                rank, left = rank + full * each, left - full * each
                if rest := capacity - each * length:
                    states.setdefault(rest, []).append((first, full))
                    tree.add(rest, full)
            if full < n:
                if left:  # the last pieces of this length, in one window
                    placed.append((length, rank, left, first + full, window - capacity, each))
                    rest, rank, left = capacity - left * length, rank + left, 0
                    states.setdefault(rest, []).append((first + full, 1))
                    tree.add(rest, 1)
                    full += 1
                if full < n:
                    states.setdefault(capacity, []).append((first + full, n - full))
                    tree.add(capacity, n - full)
    return placed, used


_codec: dict[str, bpe.Codec] = {}


def _encoder(path: str) -> bpe.Codec:
    if path not in _codec:
        c = bpe.Codec(path)
        ranks = dict(zip(c.tokens, c.to_id, strict=True))
        merge = tiktoken.Encoding("own", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        c.pieces = bpe._Pieces(merge)
        _codec[path] = c
    return _codec[path]


def _pieces(path: str, window: int):
    def run(batches):
        c = _encoder(path)
        for batch in batches:
            length, crc = [], []
            for block in V.blocks(batch.column(1), BLOCK_BYTES):
                ids, off = c.encode_block(block)
                raw, end = ids.tobytes(), SEPARATOR.to_bytes(4, "little")
                for a, z in itertools.pairwise(off.tolist()):
                    n = z - a + 1
                    data = raw[4 * a : 4 * z] + end
                    length.append(n)
                    crc.append([zlib.crc32(data[4 * at : 4 * (at + window)]) for at in range(0, n, window)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(length, pa.int64()), pa.array(crc, pa.list_(pa.int64()))], names=["doc_id", "doc_tokens", "crc"])

    return run


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    ``sequence_id`` counts the windows that hold whole pieces of overlong
    documents after those that best-fit decreasing made.  Null and empty texts
    are the separator alone.  Rows with equal ids are separate documents.
    """
    rows = texts_of(docs).mapInArrow(V.lean(_pieces(path or bpe.vocabulary_path(), window)), "doc_id long, doc_tokens long, crc array<long>")
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    rows = stored(rows.withColumn("part", F.spark_partition_id()))
    rest = rows.withColumn("length", F.col("doc_tokens") % window)
    counted = stored(rest.groupBy("part", "length").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("doc_tokens") / window)).alias("whole")))
    totals = {r.length: r.n for r in counted.groupBy("length").agg(F.sum("n").alias("n")).filter("length > 0").collect()}  # under `window` rows
    placed, used = best_fit_decreasing(totals, window)

    spark = docs.sparkSession
    plan = spark.createDataFrame(placed or [(0, 0, 0, 0, 0, 1)], "length long, rank0 long, n long, first long, offset0 long, each long")
    before = counted.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n"))
    wholes = counted.groupBy("part").agg(F.sum("whole").alias("whole"))
    wholes = wholes.withColumn("wholes_before", F.sum("whole").over(Window.orderBy("part")) - F.col("whole")).select("part", "wholes_before")
    # part x length groups are as small as an input split
    ranked = rest.select("doc_id", "doc_tokens", "crc", "row", "part", "length").withColumn("in_part", F.row_number().over(Window.partitionBy("part", "length").orderBy("row")) - 1)
    ranked = ranked.join(before.select("part", "length", "before"), ["part", "length"]).withColumn("rank", F.col("in_part") + F.col("before"))
    # a rank falls in the last placement of its length that begins at or before it
    by_length = plan.filter("n > 0").groupBy("length").agg(F.array_sort(F.collect_list(F.struct("rank0", "first", "offset0", "each"))).alias("runs"))
    at = F.broadcast(by_length)  # bounded by the window size: a few runs for each of its lengths
    tail = ranked.filter("length > 0").join(at, "length")
    tail = tail.withColumn("run", F.element_at(F.filter("runs", lambda r: r["rank0"] <= F.col("rank")), -1))
    step = F.col("rank") - F.col("run.rank0")
    tail = tail.select(
        "doc_id",
        (F.col("doc_tokens") - F.col("length")).alias("start"),
        "length",
        F.element_at("crc", -1).alias("ids_crc32"),
        "doc_tokens",
        (F.col("run.first") + F.floor(step / F.col("run.each"))).cast("long").alias("sequence_id"),
        (F.col("run.offset0") + step % F.col("run.each") * F.col("length")).cast("long").alias("offset"),
    )
    long = rows.filter(f"doc_tokens >= {window}").withColumn("k", F.floor(F.col("doc_tokens") / window))
    order = Window.partitionBy("part").orderBy("row")
    long = long.withColumn("base", F.sum("k").over(order) - F.col("k")).join(wholes, "part")
    long = long.select("doc_id", "doc_tokens", (F.col("base") + F.col("wholes_before") + used).alias("base"), F.posexplode(F.slice("crc", 1, F.col("k").cast("int"))).alias("i", "ids_crc32"))
    whole = long.select(
        "doc_id", (F.col("i") * F.lit(window)).cast("long").alias("start"), F.lit(window).cast("long").alias("length"), "ids_crc32", "doc_tokens", (F.col("base") + F.col("i")).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return whole.unionByName(tail)
