"""Threshold-scaled document fingerprints, in DataFrame functions only.

A fingerprint keeps every word-shingle hash below a fixed fraction of the hash
range, so that sketches of any two texts can be merged, intersected and
compared, however unequal their lengths.  The fraction is ``1 / SCALE`` for sets of
more than ``WHOLE`` distinct shingles and 1 for others, which a thinned sketch would
say too little about.  It is part of the sketch; two sketches are compared at
the smaller of their fractions, and ``merge`` gives the sketch of the united sets.

Null texts read as empty; texts without a word have an empty sketch.  Rows without
an id come after all others; equal ids are ordered by a hash of the text and then by
the text.  A text of any length is one row, as is its sketch.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import texts_of

SHINGLE = 5
SCALE = 4
WHOLE = 4096
BUCKET = 1 << 23  # bytes of text in a bucket of neighbouring rows, more where there would be over
BUCKETS = 1 << 16
_MOST = 2**63 - 1


def sketch(text: Column, k: int = SHINGLE, scale: int = SCALE, whole: int = WHOLE) -> Column:
    """``[denominator, hashes...]``: the sorted distinct kept hashes of a text's ``k``-word shingles.

    The denominator is 1 for texts of up to ``whole`` distinct shingles, which keep
    all, and ``scale`` for others.  A text of fewer than ``k`` words is one shingle;
    one without words has none.  Null reads as empty.
    """
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        count = F.size(h)
        every = F.transform(F.sequence(F.lit(0), F.greatest(count - k, F.lit(0))), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]).bitwiseAND(F.lit(_MOST)))
        return F.when(count == 0, F.array().cast("array<bigint>")).otherwise(F.array_distinct(every))

    def build(every: Column) -> Column:
        few = F.size(every) <= whole
        kept = F.when(few, every).otherwise(F.filter(every, lambda x: x < F.lit(_MOST // scale)))
        return F.concat(F.array(F.when(few, F.lit(1)).otherwise(F.lit(scale)).cast("bigint")), F.sort_array(kept))

    # transform over a one-element array binds the hashes, so that they are worked out once
    bound = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))
    return bound(bound(hashed, shingles), build)


def _as_text(packed: Column) -> Column:
    return F.concat(F.get(packed, F.lit(0)).cast("string"), F.lit(":"), F.array_join(F.transform(F.slice(packed, 2, F.size(packed)), lambda x: F.hex(x)), ","))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two packed sketches, 0 to 1.

    Null where neither keeps a hash at their common fraction: such sketches say
    nothing about their texts.
    """
    x, y = _common(a, b)
    both = F.size(F.array_intersect(x, y))
    union = F.size(x) + F.size(y) - both
    return F.when(union > 0, both / union)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` has too; null where ``a`` keeps none."""
    x, y = _common(a, b)
    return F.when(F.size(x) > 0, F.size(F.array_intersect(x, y)) / F.size(x))


def merge(a: Column, b: Column, scale: int = SCALE, whole: int = WHOLE) -> Column:
    """The sketch of both texts' shingles together."""
    x, y = _common(a, b)
    of = F.greatest(F.get(a, F.lit(0)), F.get(b, F.lit(0)))
    both = F.array_sort(F.array_union(x, y))
    many = (of == 1) & (F.size(both) > whole)
    kept = F.when(many, F.filter(both, lambda h: h < F.lit(_MOST // scale))).otherwise(both)
    return F.concat(F.array(F.when(many, F.lit(scale)).otherwise(of).cast("bigint")), kept)


def _common(a: Column, b: Column) -> tuple[Column, Column]:
    da, db = F.get(a, F.lit(0)), F.get(b, F.lit(0))
    limit = F.call_function("div", F.lit(_MOST), F.greatest(da, db))
    cut = lambda x: F.when(da == db, F.slice(x, 2, F.size(x))).otherwise(F.filter(F.slice(x, 2, F.size(x)), lambda h: h < limit))
    return cut(a), cut(b)


def fingerprints(docs: DataFrame, k: int = SHINGLE, scale: int = SCALE, whole: int = WHOLE) -> DataFrame:
    """``doc_id, fingerprint, sketch`` of every document."""
    packed = texts_of(docs).select("doc_id", sketch(F.col("text"), k, scale, whole).alias("sketch"))
    return packed.select("doc_id", _as_text(F.col("sketch")).alias("fingerprint"), "sketch")


_PLACE = "struct<none boolean, back bigint, tie bigint>"


def _bucket(place: Column, bounds: list) -> Column:
    """How many of the sorted ``bounds`` are at or before ``place``; looked up in two steps."""
    step = max(1, int(len(bounds) ** 0.5))
    known = lambda rows: F.from_json(F.lit(json.dumps([r.asDict() for r in rows])), f"array<{_PLACE}>")
    below = lambda rows: F.size(F.filter(rows, lambda b: b <= place))
    if not bounds:
        return F.lit(0)
    group = F.greatest(below(known(bounds[::step])) - 1, F.lit(0))
    return group * step + below(F.slice(known(bounds), group * step + 1, step))


def with_next(docs: DataFrame) -> DataFrame:
    """Each document with ``next_text`` and ``next_sketch`` of the next one, by descending id.

    The first follows the last.  Rows are dealt into buckets of neighbours in this
    order.  A hash picks the rows that begin a bucket, a row the likelier the longer
    its text is, so that buckets hold about ``BUCKET`` bytes each, whatever the ids and
    lengths are like; the driver gets the places of these few rows, not their texts.  Each bucket has a copy of the
    first row of the next bucket, and a window inside the buckets does the rest, so
    texts move once.  Sketches are made after the texts have moved.
    """
    docs = texts_of(docs)
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 16
    step = max(BUCKET, -(-(docs.agg(F.sum(size)).first()[0] or 0) // BUCKETS))
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.bitwise_not("doc_id").alias("back"), F.xxhash64("text").alias("tie"))
    docs = docs.withColumn("place", place).withColumn("begins", F.pmod(F.xxhash64("doc_id", "place.tie", F.lit(8)), F.lit(step)) < size)
    found = docs.agg(F.min("place").alias("first"), F.collect_set(F.when(F.col("begins"), F.col("place"))).alias("bounds")).first()  # about BUCKETS places at most
    first = found["first"]
    bounds = sorted((b for b in found["bounds"] if b != first), key=lambda b: (b.none, b.back if b.back is not None else 0, b.tie))
    n = len(bounds) + 1
    rows = docs.withColumn("bucket", _bucket(F.col("place"), bounds).cast("int"))
    heads = rows.filter(F.col("begins") | (F.col("place") == F.from_json(F.lit(json.dumps(first.asDict() if first else None)), _PLACE)))
    heads = heads.groupBy(F.pmod(F.col("bucket") - 1, F.lit(n)).cast("int").alias("bucket")).agg(F.min(F.struct("place", "text")).alias("head"))
    heads = heads.select("bucket", F.col("head.place").alias("place"), F.col("head.text").alias("text"), F.lit(None).cast("long").alias("doc_id"), F.lit(1).alias("copy"))
    order = ["copy", "place", "text"]
    rows = rows.select("bucket", "place", "text", "doc_id", F.lit(0).alias("copy")).unionByName(heads).repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", *order)
    rows = rows.withColumn("sketch", sketch(F.col("text")))
    w = Window.partitionBy("bucket").orderBy(*order)
    rows = rows.withColumn("next_text", F.lead("text").over(w)).withColumn("next_sketch", F.lead("sketch").over(w))
    return rows.filter("copy = 0").select("doc_id", "text", "sketch", "next_text", "next_sketch")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, and of it with its second half replaced by the next document's beginning.

    Of texts whose sketches say nothing, equal ones count as alike (1) and others as unlike (0).
    """
    rows = with_next(docs).withColumn("text", F.coalesce("text", F.lit("")))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    rows = rows.select("doc_id", "text", F.coalesce("next_text", F.lit("")).alias("next_text"), n.cast("long").alias("n_chars"), edited.alias("edited"), "sketch", "next_sketch")
    rows = rows.select("*", sketch(F.col("edited")).alias("edited_sketch"))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        _as_text(F.col("sketch")).alias("fingerprint"),
        _as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        F.coalesce(likeness(F.col("sketch"), F.col("edited_sketch")), (F.col("text") == F.col("edited")).cast("double")).alias("near_edited"),
        F.coalesce(likeness(F.col("sketch"), F.col("next_sketch")), (F.col("text") == F.col("next_text")).cast("double")).alias("near_next"),
    )
