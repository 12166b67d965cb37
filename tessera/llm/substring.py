"""Repeated word passages by De Bruijn compaction.

An edge of the graph is a window of ``k`` consecutive words, a node the
``k - 1`` words that two edges share.

1. Texts with the same word sequence form one class.  Each class lists the
   smallest hash of ``MINIMIZER`` words in every window; a window that occurs
   twice shares that hash, so only windows whose hash occurs in two classes, or
   twice in one, can repeat.  Nothing repeated is lost, and the edges that Spark
   has to move are close to the repeated ones alone.
2. Edges are counted in Spark, with bit-and and bit-or over the edges seen
   before and after them: where the two differ, the node there branches.
3. A Spark join brings branches back to the edges' places, and each text
   compacts its runs of repeated edges between branching nodes into paths.
4. Every path is checked at its source coordinates: its words' own 128-bit
   digest has to occur twice as well.  The windows of a path that fails (a hash
   collision in it, or one that hid a branch) are checked one by one instead,
   and its text is done again without those that occur only once.

Rows of minimizers or edges that hold a large share of all rows are joined by
broadcast (``common.split_join``).

Null texts read as empty; texts with fewer than ``k`` words lose nothing; a
class of several equal texts with ``k`` words or more loses every word.
Repeated rows, also with an equal id, count as separate occurrences.  A text of
any length is one row of a task, which needs some 60 bytes of memory a byte of it.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import textvec as V
from tessera.llm.common import columns, discard, mapped, split_join, stored, texts_of, unused

MINIMIZER = 8
WORDS = 35
_LOW = np.uint64(0xFFFFFFFF)


def _window_minima(h: np.ndarray, k: int) -> np.ndarray:
    """For every window of ``k`` words the smallest hash of its runs of ``MINIMIZER`` words."""
    m = min(MINIMIZER, k)
    x, size, span = V.windows(h, m), 1, k - m + 1
    while size * 2 <= span:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (span - size)], x[span - size :]) if len(x) > span - size else x[:0]


def _digest(words: bytes) -> bytes:
    """128 bits for a text's words, joined by one blank."""
    return xxhash.xxh3_128_digest(words)


def _joined(text: bytes) -> bytes:
    return b" ".join(text.split())


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _profile(k: int):
    """Per text: digest, number of words, hash of all its words, minimizers and how often each counts."""

    m = min(MINIMIZER, k)

    def run(batches):
        for batch in batches:
            ids, n, sha, mins, weight = [], [], [], [], []
            for block in V.blocks(batch.column(1)):
                w = V.words(block)
                low, grams = _window_minima(w.hash, k), V.windows(w.hash, m)
                raw = block.data.tobytes()
                for i in range(block.hi - block.lo):
                    a, z = w.off[i], w.off[i + 1]
                    plain = _joined(raw[block.off[i] : block.off[i + 1]])
                    ids.append(_digest(plain))
                    n.append(int(z - a))
                    sha.append(_sha(plain))
                    own = low[a : max(a, z - k + 1)]
                    value = np.unique(own[np.flatnonzero(np.diff(own, prepend=~own[:1]))]) if len(own) else own
                    count = np.zeros(len(value), np.int64)
                    if len(own):  # at how many places of this text each of them occurs
                        gram = grams[a : z - m + 1]
                        to = np.minimum(np.searchsorted(value, gram), len(value) - 1)
                        count = np.bincount(to[value[to] == gram], minlength=len(value))
                    mins.append(value.view(np.int64))
                    weight.append(np.minimum(count, 2).astype(np.int8))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.binary()), pa.array(n, pa.int64()), pa.array(sha), pa.array(mins, pa.list_(pa.int64())), pa.array(weight, pa.list_(pa.int8()))],
                names=["doc_id", "digest", "n_words", "sha", "mins", "weight"],
            )

    return run


def _edges(k: int, bits: int):
    """Per class: its windows with a repeated minimizer, and the windows before and after each."""
    used = np.uint64((1 << bits) - 1)

    def run(batches):
        for batch in batches:
            keep, pos, edge, near = [], [], [], []
            want, lists = batch.column(1), batch.column(2)
            for block in V.blocks(batch.column(0)):
                w = V.words(block)
                low, win = _window_minima(w.hash, k), V.windows(w.hash, k) & used
                raw = block.data.tobytes()
                for i in range(block.hi - block.lo):
                    row = block.lo + i
                    if _digest(_joined(raw[block.off[i] : block.off[i + 1]])) != want[row].as_py():  # another text under the same id
                        continue
                    a, z = w.off[i], w.off[i + 1] - k + 1
                    at = np.flatnonzero(np.isin(low[a:z], lists[row].values.to_numpy(zero_copy_only=False).view(np.uint64)))
                    own = win[a:z]
                    after = np.append(own[1:], np.uint64(0))[at] & _LOW
                    before = np.append(np.uint64(0), own[:-1])[at] & _LOW
                    keep.append(row)
                    pos.append(at.astype(np.int32))
                    edge.append(own[at].view(np.int64))
                    near.append((after | before << np.uint64(32)).view(np.int64))
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [want.take(take), batch.column(3).take(take), batch.column(0).take(take).cast(pa.string()), pa.array(pos, pa.list_(pa.int32())), pa.array(edge, pa.list_(pa.int64())), pa.array(near, pa.list_(pa.int64()))],
                names=["digest", "copies", "text", "pos", "edge", "near"],
            )

    return run


_PATHS = "cid long, digest binary, copies long, n_removed long, kept string, sha string, start array<int>, size array<int>, path array<binary>"


def _compact(k: int):
    """Per class: paths of repeated edges between branching nodes, and the text without them.

    ``drop`` lists places of edges that didn't hold up against the sources.
    """

    def run(batches):
        for batch in batches:
            out = {x: [] for x in ("n", "kept", "sha", "start", "size", "path")}
            places, flags, drop = (batch.column(i) for i in (4, 5, 6))
            for row in range(batch.num_rows):
                words = (batch.column(3)[row].as_py() or "").encode().split()
                pos = places[row].values.to_numpy(zero_copy_only=False)
                order = np.argsort(pos, kind="stable")
                pos, flag = pos[order].astype(np.int64), flags[row].values.to_numpy(zero_copy_only=False)[order]
                if drop[row].is_valid:
                    good = ~np.isin(pos, drop[row].values.to_numpy(zero_copy_only=False))
                    pos, flag = pos[good], flag[good]
                cut = np.ones(len(pos), bool)  # a path starts: a gap, or the node before branches
                cut[1:] = (np.diff(pos) > 1) | (flag[1:] & 1 > 0) | (flag[:-1] & 2 > 0)
                first = np.flatnonzero(cut)
                start, size = pos[first], np.diff(first, append=len(pos)) + k - 1
                step = np.zeros(len(words) + 1, np.int32)
                np.add.at(step, start, 1)
                np.add.at(step, start + size, -1)
                gone = np.cumsum(step[:-1]) > 0
                kept = b" ".join([x for x, g in zip(words, gone.tolist(), strict=True) if not g])
                out["n"].append(int(gone.sum()))
                out["kept"].append(kept.decode())
                out["sha"].append(_sha(kept))
                out["start"].append(start.astype(np.int32))
                out["size"].append(size.astype(np.int32))
                out["path"].append([xxhash.xxh3_128_digest(b" ".join(words[a : a + n])) for a, n in zip(start.tolist(), size.tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(out["n"], pa.int64()), pa.array(out["kept"], pa.string()), pa.array(out["sha"], pa.string()), pa.array(out["start"], pa.list_(pa.int32())), pa.array(out["size"], pa.list_(pa.int32())), pa.array(out["path"], pa.list_(pa.binary()))],
                names=["cid", "digest", "copies", "n_removed", "kept", "sha", "start", "size", "path"],
            )

    return run


def _windows_at(k: int):
    """The words' own digests of some windows of each class."""

    def run(batches):
        for batch in batches:
            cid, pos, path = [], [], []
            for row in range(batch.num_rows):
                words = (batch.column(1)[row].as_py() or "").encode().split()
                for at in batch.column(2)[row].as_py():
                    cid.append(row)
                    pos.append(at)
                    path.append(_digest(b" ".join(words[at : at + k])))
            take = pa.array(cid, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(3).take(take), pa.array(pos, pa.int32()), pa.array(path, pa.binary())], names=["cid", "copies", "pos", "path"])

    return run


def _single(bad: DataFrame, each: DataFrame, edges: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """``cid, drop``: of the edges of paths that failed, the places whose own words occur only once."""
    inside = each.join(bad, "cid").filter(f"pos >= start and pos <= start + size - {k}").select("cid", "pos", "edge")
    inside = stored(inside.join(edges.select("edge"), "edge", "left_semi"))
    places = each.join(inside.select("edge").distinct(), "edge", "left_semi").groupBy("cid").agg(F.collect_list("pos").alias("at"))
    windows = found.select("cid", "text", "copies").join(places, "cid").select("cid", "text", "at", "copies")
    windows = stored(windows.mapInArrow(V.lean(_windows_at(k)), "cid long, copies long, pos int, path binary"))
    twice = windows.groupBy("path").agg(F.sum("copies").alias("n")).filter("n > 1").select("path")
    good = windows.join(twice, "path", "left_semi").select("cid", "pos")
    return inside.join(good, ["cid", "pos"], "left_anti").groupBy("cid").agg(F.collect_list("pos").alias("drop"))


def _classes(docs: DataFrame, k: int, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """``(profile, cleaned)``: a row per text, and a row per class that loses words."""
    profile = stored(texts_of(docs).mapInArrow(V.lean(_profile(k)), "doc_id long, digest binary, n_words long, sha string, mins array<long>, weight array<byte>"))
    classes = profile.filter(F.col("n_words") >= k).groupBy("digest").agg(F.count("*").alias("copies"), F.min("doc_id").alias("rep"), F.first("mins").alias("mins"), F.first("weight").alias("weight"))
    classes = stored(classes)
    listed = classes.select("digest", F.explode(F.arrays_zip("mins", "weight")).alias("x")).select("digest", F.col("x.mins").alias("h"), F.col("x.weight").alias("weight"))
    twice = stored(listed.groupBy("h").agg(F.sum("weight").alias("n"), F.count("*").alias("rows")).filter("n > 1").select("h", "rows"))
    flagged = split_join(listed.select("digest", "h"), twice, "h", "rows").groupBy("digest").agg(F.collect_list("h").alias("hs"))
    flagged = flagged.join(classes.select("digest", "copies", "rep"), "digest")

    sources = texts_of(docs).join(flagged, F.col("doc_id").eqNullSafe(F.col("rep"))).select("text", "digest", "hs", "copies")
    found = sources.mapInArrow(V.lean(_edges(k, bits)), "digest binary, copies long, text string, pos array<int>, edge array<long>, near array<long>")
    found = stored(found.withColumn("cid", F.monotonically_increasing_id()))
    discard(twice)
    table = found
    n, distinct = found.agg(F.count("*"), F.count_distinct("digest")).first()
    if n != distinct:  # equal rows under an equal id: one of them stands for the class
        found = found.join(found.groupBy("digest").agg(F.min("cid").alias("cid")).select("cid"), "cid", "left_semi")

    each = found.select("cid", "copies", F.explode(F.arrays_zip("pos", "edge", "near")).alias("x")).select("cid", "copies", F.col("x.pos").alias("pos"), F.col("x.edge").alias("edge"), F.col("x.near").alias("near"))
    edges = each.groupBy("edge").agg(F.sum(F.least("copies", F.lit(2))).alias("n"), F.bit_and("near").alias("all"), F.bit_or("near").alias("any")).filter("n > 1")
    differ = F.col("all").bitwiseXOR(F.col("any"))
    flag = F.when(F.shiftrightunsigned(differ, 32) != 0, 1).otherwise(0) + F.when(differ.bitwiseAND(F.lit(0xFFFFFFFF)) != 0, 2).otherwise(0)
    edges = stored(edges.select("edge", "n", flag.cast("byte").alias("flag")))
    placed = split_join(each.select("cid", "pos", "edge"), edges, "edge", "n").groupBy("cid").agg(F.collect_list("pos").alias("pos"), F.collect_list("flag").alias("flag"))
    rows = found.select("cid", "digest", "copies", "text").join(placed, "cid")
    done = stored(rows.withColumn("drop", F.lit(None).cast("array<int>")).mapInArrow(V.lean(_compact(k)), _PATHS))

    paths = done.select("cid", "copies", F.explode(F.arrays_zip("start", "size", "path")).alias("x")).select("cid", "copies", F.col("x.start").alias("start"), F.col("x.size").alias("size"), F.col("x.path").alias("path"))
    alone = paths.groupBy("path").agg(F.sum("copies").alias("n"), F.min("cid").alias("cid"), F.min("start").alias("start"), F.min("size").alias("size")).filter("n < 2")  # one place: its own
    bad = stored(alone.select("cid", "start", "size"))
    if bad.take(1):
        drop = stored(_single(bad, each, edges, found, k))
        again = rows.join(drop, "cid").mapInArrow(V.lean(_compact(k)), _PATHS)
        done = stored(done.join(drop.select("cid"), "cid", "left_anti").unionByName(again))
    discard(edges, table)
    whole = classes.filter("copies > 1").select("digest", F.lit(True).alias("whole"))
    cleaned = done.select("digest", "n_removed", "kept", "sha", "start", "size", "path").join(whole, "digest", "full_outer")
    return profile, cleaned


def repeated_passages(docs: DataFrame, k: int = WORDS, bits: int = 64) -> DataFrame:
    """One row per text: ``doc_id, n_words, n_removed, kept_sha256, spans``.

    A word goes if a window of ``k`` words that covers it occurs at another
    place of the input.  ``spans`` lists the paths (first word, number of
    words, digest); it is null where the whole text has a copy or nothing repeats.
    ``bits`` of a window's hash name its edge; the rows don't depend on it.
    """
    profile, cleaned = _classes(docs, k, bits)
    hit = cleaned.select("digest", "whole", "n_removed", F.col("sha").alias("new_sha"), F.arrays_zip("start", "size", "path").alias("spans"))
    out = profile.select("doc_id", "digest", "n_words", "sha").join(hit, "digest", "left")
    return out.select(
        "doc_id",
        "n_words",
        F.when(F.col("whole"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("whole"), F.lit(_sha(b""))).otherwise(F.coalesce("new_sha", "sha")).alias("kept_sha256"),
        F.when(F.col("whole"), F.lit(None)).otherwise(F.col("spans")).alias("spans"),
    )


def _with_digest(name: str, place: int):
    def run(batches):
        for batch in batches:
            ids = []
            for block in V.blocks(batch.column(place)):
                raw = block.data.tobytes()
                ids += [_digest(_joined(raw[a:z])) for a, z in itertools.pairwise(block.off.tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary())], names=[*batch.schema.names, name])

    return run


def remove_repeated(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """The input's rows and columns, their ``text`` without repeated passages.

    Texts that lose nothing stay as they are; others keep their remaining words
    joined by one space (an empty text if none remain).
    """
    _, cleaned = _classes(texts_of(docs), k)
    digest, whole, kept = (unused(x, docs) for x in ("_digest", "_whole", "_kept"))
    rows = mapped(docs, _with_digest(digest, docs.columns.index("text")), T.StructField(digest, T.BinaryType()))
    rows = rows.join(cleaned.select(F.col("digest").alias(digest), F.col("whole").alias(whole), F.col("kept").alias(kept)), digest, "left")
    text = F.when(F.col(whole), F.lit("")).otherwise(F.coalesce(kept, "text"))
    return rows.select(*[text.alias("text") if c == "text" else x for c, x in zip(docs.columns, columns(docs), strict=True)])
