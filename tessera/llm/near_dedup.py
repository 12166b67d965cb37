"""Near-duplicate documents by b-bit MinHash, confirmed on full shingle sets.

1. Every text becomes its set of word-shingle hashes and ``PERMUTATIONS``
   minima.  The low ``BITS`` bits of the minima are packed into a signature;
   bands of whole minima give bucket keys.
2. Texts with equal sets are one class from here on (pre-aggregated), so exact
   copies never meet each other in a bucket.
3. In each bucket every member is compared with two hubs, not with every other
   member.  Bit counts of signatures give a collision-corrected estimate;
   pairs more than six standard deviations under the threshold go, the rest
   is confirmed on full sets.
4. Buckets that still hold more than one component get more hubs, and are then
   finished exactly: the members outside a bucket's largest component meet all
   members in blocks, and only pairs of different components that pass the
   estimate are confirmed, on their full sets, where they stand; only links
   leave the task.

Rows of buckets and pairs of hubs that hold a large share of all are not brought
together by key: common buckets are joined by broadcast, and the sets of common
hubs are dealt out in several copies.

Empty and null texts have an empty set and are linked with nothing, as are rows
without a ``doc_id`` (their component is null and they are kept).  Equal texts
are one class, whatever their ids; of equal ids with equal texts one row stays.  A
text of any length is one row of a task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import textvec as V
from tessera.llm.common import columns, components, discard, split_join, stored

PERMUTATIONS = 128
BITS = 2
MISS = 1e-6
SIGMAS = 6
BLOCK = 400  # members and
BLOCK_SHINGLES = 1 << 19  # shingles of a block, on average
HUBS = 6

_r = np.random.Generator(np.random.PCG64(77))
_A = _r.integers(0, 2**31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _r.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32)
_LANES = np.int64(0x5555555555555555)


def band_rows(similarity: float) -> int:
    """Most minima per band with which a pair at the threshold is missed less often than ``MISS``."""
    return max(r for r in range(1, 9) if r == 1 or (1 - similarity**r) ** (PERMUTATIONS // r) < MISS)


def least_estimate(similarity: float) -> float:
    """The estimate that a pair at the threshold falls under with a chance of about 1e-9."""
    c = 0.5**BITS
    p = similarity + (1 - similarity) * c
    return similarity - SIGMAS * math.sqrt(p * (1 - p) / PERMUTATIONS) / (1 - c)


def _sets(block: V.Block, k: int):
    """The sorted distinct shingle hashes of each row."""
    w = V.words(block, lower=True)
    h = V.windows(w.hash, k)
    for i in range(block.hi - block.lo):
        a, z = w.off[i], w.off[i + 1]
        if z - a >= k:
            yield np.unique(h[a : z - k + 1])
        elif z > a:  # the whole sequence is the only shingle
            yield V.windows(w.hash[a:z], int(z - a)) ^ np.uint64(z - a)
        else:
            yield np.zeros(0, np.uint64)


def minima(s: np.ndarray) -> np.ndarray:
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(PERMUTATIONS, 2**32 - 1, np.uint32)
    for at in range(0, len(x), 4096):
        out = np.minimum(out, (_A[:, None] * x[None, at : at + 4096] + _B[:, None]).min(axis=1))
    return out


def _signatures(k: int, rows: int):
    per = PERMUTATIONS // rows
    lane = (np.arange(32, dtype=np.uint64) * np.uint64(BITS))[None, :]

    def run(batches):
        for batch in batches:
            n, ids, sigs, bands = [], [], [], []
            for block in V.blocks(batch.column(1)):
                for s in _sets(block, k):
                    n.append(len(s))
                    if not len(s):
                        ids.append(None), sigs.append(None), bands.append(None)
                        continue
                    m = minima(s)
                    ids.append(xxhash.xxh3_128_digest(s.tobytes()))
                    sigs.append(np.bitwise_or.reduce((m & np.uint32(3)).astype(np.uint64).reshape(-1, 32) << lane, axis=1).view(np.int64))
                    whole = m[: per * rows].astype(np.uint64).reshape(per, rows)
                    key = np.arange(per, dtype=np.uint64)
                    for j in range(rows):
                        key = V.join(key, whole[:, j])
                    bands.append(key.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(sigs, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "set_id", "sig", "bands"],
            )

    return run


def _full_sets(k: int):
    def run(batches):
        for batch in batches:
            s = [x.view(np.int64) for block in V.blocks(batch.column(1)) for x in _sets(block, k)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.list_(pa.int64()))], names=["doc_id", "s"])

    return run


def estimate(x: Column, y: Column) -> Column:
    """Collision-corrected similarity of two packed signatures, from bit counts."""
    diff = F.zip_with(x, y, lambda a, b: a.bitwiseXOR(b))
    lanes = F.transform(diff, lambda d: F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(F.lit(int(_LANES)))))
    differing = F.aggregate(lanes, F.lit(0), lambda a, b: a + b.cast("int"))
    c = 0.5**BITS
    return (1 - differing / F.lit(float(PERMUTATIONS)) - c) / (1 - c)


def _blockwise(percent: int, least: float):
    """Links between different components in one block of a bucket, confirmed on full sets.

    Rows of ``side`` 0 are outside the bucket's largest component and meet those of
    ``side`` 1, which are of any.  Members of several common buckets meet in the
    first of them only.
    """

    def matrix(table: pa.Table, name: str) -> np.ndarray:
        return table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)

    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        sig, bands = matrix(table, "sig").view(np.uint64), matrix(table, "bands")
        rep, comp, n, largest = (table.column(x).to_numpy() for x in ("rep", "c", "n", "largest"))
        key = table.column("key")[0].as_py()
        sets = table.column("s").combine_chunks()
        value, off = sets.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(pa.compute.list_value_length(sets).to_numpy(zero_copy_only=False))])
        found = []
        for x in left.tolist():
            d = sig[right] ^ sig[x]
            d = np.bitwise_count((d | (d >> np.uint64(1))) & np.uint64(_LANES)).sum(axis=1, dtype=np.int64)
            est = (1 - d / PERMUTATIONS - 0.5**BITS) / (1 - 0.5**BITS)
            once = (comp[right] == largest[right]) | (rep[right] > rep[x])  # two outside the largest meet twice
            y = right[(est >= least) & once & (comp[right] != comp[x]) & (100 * np.minimum(n[right], n[x]) >= percent * np.maximum(n[right], n[x]))]
            if len(y):
                shared = bands[y] == bands[x]
                y = y[bands[x][shared.argmax(axis=1)] == key]
            for at in range(0, len(y), 64):
                part = y[at : at + 64]
                own = value[off[x] : off[x + 1]]
                each = np.concatenate([value[off[j] : off[j + 1]] for j in part.tolist()])
                hit = own[np.minimum(np.searchsorted(own, each), len(own) - 1)] == each
                both = np.add.reduceat(hit, np.concatenate([[0], np.cumsum(off[part + 1] - off[part])[:-1]]), dtype=np.int64)
                part = part[100 * both >= percent * (n[part] + n[x] - both)]
                if len(part):
                    found.append(np.stack([np.minimum(rep[part], rep[x]), np.maximum(rep[part], rep[x])], axis=1))
        out = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        return pa.table({"a": out[:, 0], "b": out[:, 1]})

    return run


def _in_blocks(left: DataFrame) -> DataFrame:
    """Deal members of mixed buckets into cells ``key, i, j``: block ``i`` of all members, ``j`` of those outside the largest component."""
    each = left.groupBy("key", "c").agg(F.count("*").alias("k"), F.sum("n").alias("s"))
    bucket = each.groupBy("key").agg(F.max(F.struct("k", "c", "s")).alias("top"), F.sum("k").alias("members"), F.sum("s").alias("shingles"))
    parts = lambda k, s: F.greatest(F.ceil(k / BLOCK), F.ceil(s / BLOCK_SHINGLES), F.lit(1)).cast("int")
    bucket = bucket.select("key", "members", F.col("top.c").alias("largest"), parts(F.col("members"), F.col("shingles")).alias("all"), parts(F.col("members") - F.col("top.k"), F.col("shingles") - F.col("top.s")).alias("rest"))
    rows = split_join(left, stored(bucket), "key", "members")
    block = lambda seed, n: F.pmod(F.xxhash64("rep", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    right = rows.withColumn("side", F.lit(1)).withColumn("i", block(1, "all")).withColumn("j", every("rest"))
    outside = rows.filter("c != largest").withColumn("side", F.lit(0)).withColumn("j", block(2, "rest")).withColumn("i", every("all"))
    return right.unionByName(outside).select("key", "rep", "n", "c", "largest", "side", "i", "j")


def _joined(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links between nodes."""
    if not links.take(1):
        return comps
    of = comps.toDF("n", "c")
    ends = links.join(of.toDF("a", "ca"), "a", "left").join(of.toDF("b", "cb"), "b", "left")
    again = components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))).toDF("c", "c2")
    linked = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    comps = comps.join(linked, "node", "full_outer").select("node", F.coalesce("component", "node").alias("c"))
    return stored(comps.join(again, "c", "left").select("node", F.coalesce("c2", "c").alias("component")))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, set_id``: one row per input row.

    Two texts are linked when ``100 * |A & B| >= percent * |A | B|`` over sets
    of ``shingle``-word shingles.  ``component_id`` is the smallest id
    reachable over links; ``kept`` marks the row that stays.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows, least = band_rows(percent / 100), least_estimate(percent / 100)
    sig = stored(docs.mapInArrow(V.lean(_signatures(shingle, rows)), "doc_id long, n_shingles long, set_id binary, sig array<long>, bands array<long>"))
    sets_of = sig.filter("set_id is not null and doc_id is not null")
    reps = sets_of.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    reps = stored(reps)

    band = reps.select("rep", "n", F.explode("bands").alias("key"))
    order = F.struct(F.xxhash64("rep").alias("h"), "rep", "n")
    hubs = stored(band.groupBy("key").agg(F.count("*").alias("m"), F.min(order).alias("h1"), F.max(order).alias("h2")).filter("m > 1"))
    members = stored(split_join(band, hubs, "key", "m"))

    sizes = f"100 * least(na, nb) >= {percent} * greatest(na, nb)"
    near = members.select("rep", "n", F.explode(F.array("h1", "h2")).alias("hub")).filter("rep != hub.rep")
    near = near.select(F.least("rep", "hub.rep").alias("a"), F.greatest("rep", "hub.rep").alias("b"), F.col("n").alias("na"), F.col("hub.n").alias("nb"))
    near = near.filter(sizes).select("a", "b").distinct()
    sigs = reps.select(F.col("rep").alias("doc_id"), "sig")

    involved = members.select(F.col("rep").alias("doc_id")).distinct()
    full = stored(docs.join(involved, "doc_id", "left_semi").mapInArrow(V.lean(_full_sets(shingle)), "doc_id long, s array<long>"))
    deal = max(256, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Pairs that the signatures let pass and the full sets confirm."""
        pairs = stored(pairs)
        ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("pairs"))
        share = max(1, 2 * pairs.count() // deal)
        hot = F.broadcast(stored(ends.filter(F.col("pairs") > share).select("id", F.ceil(F.col("pairs") / share).cast("int").alias("slots"))))  # at most `deal` rows

        def with_own(pairs: DataFrame, side: str, table: DataFrame, name: str) -> DataFrame:
            salted = pairs.join(hot.withColumnRenamed("id", side), side, "left").withColumn("salt", F.pmod(F.xxhash64("a", "b"), F.coalesce("slots", F.lit(1))).cast("int")).drop("slots")
            own = table.toDF(side, name).join(hot.withColumnRenamed("id", side), side, "left")
            own = own.select(side, name, F.explode(F.sequence(F.lit(0), F.coalesce("slots", F.lit(1)) - 1)).alias("salt"))
            return salted.join(own, [side, "salt"]).drop("salt")

        both = with_own(with_own(pairs, "a", sigs, "sa"), "b", sigs, "sb")
        both = both.filter(estimate(F.col("sa"), F.col("sb")) >= least).select("a", "b")
        both = with_own(with_own(both, "a", full, "xa"), "b", full, "xb")
        both = both.select("a", "b", F.size("xa").alias("na"), F.size("xb").alias("nb"), F.size(F.array_intersect("xa", "xb")).alias("both"))
        return both.filter(f"100 * both >= {percent} * (na + nb - both)").select("a", "b").distinct()

    comps = stored(components(confirmed(near)))

    def opened(comps: DataFrame) -> DataFrame:
        """Members of buckets that hold several components; those of up to three members have been compared in full."""
        rows = stored(members.filter("m > 3").select("key", "rep", "n", "m").join(comps.toDF("rep", "c"), "rep", "left").withColumn("c", F.coalesce("c", "rep")))
        mixed = stored(rows.groupBy("key").agg(F.min("c").alias("c1"), F.max("c").alias("c2"), F.count("*").alias("members")).filter("c1 != c2").select("key", "members"))
        out = stored(split_join(rows, mixed, "key", "members").drop("members"))
        discard(rows, mixed)
        return out

    left = opened(comps)
    if left.take(1):  # more hubs for the buckets that are still mixed: a member meets only hubs of other components
        hubs = stored(left.groupBy("key").agg(F.count("*").alias("members"), *[F.min(F.struct(F.xxhash64("rep", F.lit(j)).alias("h"), "rep", "n", "c")).alias(f"h{j}") for j in range(HUBS)]))
        met = split_join(left, hubs, "key", "members").select("rep", "n", F.explode(F.filter(F.array(*[f"h{j}" for j in range(HUBS)]), lambda h: h["c"] != F.col("c"))).alias("hub"))
        met = met.select(F.least("rep", "hub.rep").alias("a"), F.greatest("rep", "hub.rep").alias("b"), F.col("n").alias("na"), F.col("hub.n").alias("nb"))
        comps = _joined(comps, stored(confirmed(met.filter(sizes).select("a", "b").distinct())))
        left = opened(comps)
    if left.take(1):
        cells = _in_blocks(left.select("key", "rep", "n", "c")).join(reps.select("rep", "sig", "bands"), "rep").join(full.select(F.col("doc_id").alias("rep"), F.array_sort("s").alias("s")), "rep").filter(F.size("s") == F.col("n"))
        comps = _joined(comps, stored(cells.groupBy("key", "i", "j").applyInArrow(_blockwise(percent, least), "a long, b long").distinct()))

    discard(full, members)
    out = sig.select("doc_id", "n_shingles", "set_id").join(reps.select("set_id", "rep"), "set_id", "left")
    out = out.join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "rep", "doc_id"))
    return out.select("doc_id", "n_shingles", component.cast("long").alias("component_id"), "set_id").select(
        "doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "set_id"
    )


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The input's rows and columns with one document of each group of near copies.

    Of repeated rows with an equal id and text one stays; rows without an id all stay.
    """
    found = stored(near_duplicates(docs, shingle, percent).select("doc_id", "kept"))
    gone = found.filter("not kept").select("doc_id").distinct()
    n, distinct = found.filter("doc_id is not null").agg(F.count("*"), F.count_distinct("doc_id")).first()
    out = docs.join(gone, "doc_id", "left_anti").select(*columns(docs))
    if n == distinct:
        return out
    named = out.filter("doc_id is not null").dropDuplicates(["doc_id", "text"])
    return named.unionByName(out.filter("doc_id is null"))
