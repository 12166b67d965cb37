"""Interpolated modified Kneser-Ney bigram model, counted in Spark and read through memory maps.

1. Words are counted by a 64-bit hash; the sorted hashes are the vocabulary, and
   a word's place in it is its number.
2. Bigrams are counted as ``(number before, number)``.  Map tasks add up what
   they have and send one sorted array per shard; a shard holds the contexts
   that hash to it, and the bigrams of very frequent contexts are dealt out by a
   hash of the pair, so no shard grows with one word.
3. Shards are written as sorted arrays to the shared folder, with the sums that
   modified Kneser-Ney needs: for each context its tokens and how many
   continuations it has once, twice and more often, and for each word in how
   many contexts it occurs.
4. Workers map the arrays into memory and look up each block's sorted distinct
   bigrams, so resident memory doesn't follow the model's size; at most ``OPEN``
   arrays are mapped at a time.

Everything is counted over all learning documents, without cut-offs.  Every text
starts in a context of its own and ends with an end token; null texts read as
empty ones, and rows with an equal id or text count each for itself.  The model lists
how many entries each file has to have; one that is missing or of another length
is an error.  More than ``2**32`` different words are refused with an error.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass, field
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textvec as V
from tessera.llm.common import shared_dir, texts_of

END = np.uint64(0x5EED0E4D)
FLUSH = 1_000_000  # keys that a task remembers before it sends their counts
SHARD_TOKENS = 1 << 21
WORD_SHARDS = 1 << 16  # at most
OPEN = 8192


def _local(uri: str) -> str:
    """The shared folder as a path that can be mapped into memory."""
    parsed = urlparse(uri)
    if parsed.scheme not in ("", "file"):
        raise ValueError(f"spark.checkpoint.dir has to be a mounted folder for memory-mapped models, not {uri}")
    return unquote(parsed.path)


def _write(folder: str, name: str, data: np.ndarray) -> None:
    """Put an array there under its name at once, so that repeated tasks do no harm."""
    os.makedirs(folder, exist_ok=True)
    part = f"{folder}/.{name}-{uuid.uuid4().hex}"
    data.tofile(part)
    os.replace(part, f"{folder}/{name}")


def _summed(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(key):
        return key, count
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(count, first)


def _tokens(block: V.Block) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's words, then its end token; and each text's offsets."""
    w = V.words(block, lower=True)
    off = w.off + np.arange(len(w.off))
    out = np.full(off[-1], END, np.uint64)
    mask = np.ones(off[-1], bool)
    mask[off[1:] - 1] = False
    out[mask] = w.hash
    return out, off


class _Sums:
    """Counts by key, added up until there are many and then sent, one sorted array per shard."""

    def __init__(self, shard_of):
        self.shard_of, self.parts, self.size = shard_of, [], 0

    def add(self, key: np.ndarray, count: np.ndarray):
        self.parts.append((key, count))
        self.size += len(key)
        if self.size >= FLUSH:
            key, count = _summed(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))
            self.parts, self.size = [(key, count)], len(key)
            if self.size >= FLUSH // 2:
                yield self.flush()

    def flush(self) -> pa.RecordBatch:
        key, count = _summed(*(np.concatenate(x) for x in zip(*self.parts, strict=True))) if self.parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.parts, self.size = [], 0
        shard = self.shard_of(key)
        rows = {"shard": [], "key": [], "count": []}
        order = np.argsort(shard, kind="stable")
        for s, a, z in _runs(shard[order]):
            pick = order[a:z]
            rows["shard"].append(s)
            rows["key"].append(_pack(key[pick]))
            rows["count"].append(_small(count[pick]))
        return pa.RecordBatch.from_arrays([pa.array(rows["shard"], pa.int32()), pa.array(rows["key"], pa.binary()), pa.array(rows["count"], pa.binary())], names=["shard", "key", "count"])


def _pack(key: np.ndarray) -> bytes:
    """Sorted 64-bit keys as the upper halves' steps, then the lower halves (upper halves repeat or step little)."""
    high = (key >> np.uint64(32)).astype(np.uint32)
    return np.diff(high, prepend=np.uint32(0)).astype(np.uint32).tobytes() + (key & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    x = np.frombuffer(data, np.uint32)
    n = len(x) // 2
    return np.cumsum(x[:n], dtype=np.uint64) << np.uint64(32) | x[n:].astype(np.uint64)


def _small(count: np.ndarray) -> bytes:
    """Counts as bytes where they fit, with the others listed after a length."""
    big = np.flatnonzero(count > 254)
    out = count.astype(np.uint8)
    out[big] = 255
    return len(count).to_bytes(8, "little") + out.tobytes() + count[big].astype(np.int64).tobytes()


def _counts(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    out = np.frombuffer(data, np.uint8, n, 8).astype(np.int64)
    out[out == 255] = np.frombuffer(data, np.int64, offset=8 + n)
    return out


def _merged(table: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
    """A shard's key arrays as one, two at a time so that equal keys meet early."""
    keys, counts = table.column("key"), table.column("count")
    parts = [(_unpack(keys[i].as_py()), _counts(counts[i].as_py())) for i in range(table.num_rows)]
    while len(parts) > 1:
        parts = [_summed(np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])) for a, b in zip(parts[::2], parts[1::2], strict=False)] + parts[len(parts) // 2 * 2 :]
    return int(table.column("shard")[0].as_py()), *parts[0]


@dataclass
class Model:
    """Where the arrays lie and the few numbers that go with them."""

    folder: str
    word_shards: int
    base: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # number of the first word of each shard
    entries: dict[str, np.ndarray] = field(default_factory=dict)  # the length of each shard's arrays
    tokens: int = 0
    types: int = 0
    texts: int = 0
    shards: int = 1
    discount: list[float] = field(default_factory=lambda: [0.5, 1.0, 1.5])
    lower_discount: list[float] = field(default_factory=lambda: [0.5, 1.0, 1.5])
    continuations: int = 0
    kinds: list[int] = field(default_factory=lambda: [0, 0, 0])  # words by in how many contexts they occur: 1, 2, more

    def word_shard(self, h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(32)) * np.uint64(self.word_shards) >> np.uint64(32)).astype(np.int64)

    def shard_of(self, number: np.ndarray) -> np.ndarray:
        """The word shard of word numbers; ``types``, the start of a text, is with the last one's."""
        return np.searchsorted(self.base, number, "right") - 1

    def pair_shard(self, key: np.ndarray, before_count: np.ndarray) -> np.ndarray:
        """Pairs go by their context, those of frequent contexts by the whole pair."""
        frequent = before_count * (4 * self.shards) > self.tokens
        x = V.mix(np.where(frequent, key, key >> np.uint64(32)) + np.uint64(9))
        return ((x >> np.uint64(32)) * np.uint64(self.shards) >> np.uint64(32)).astype(np.int64)


def _runs(shard: np.ndarray):
    """``(shard, first, end)`` of each run in sorted shard numbers."""
    if len(shard):
        first = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
        yield from zip(shard[first].tolist(), first.tolist(), [*first[1:].tolist(), len(shard)], strict=True)


class Reader:
    """A worker's view of a model; arrays are mapped on first use, and the oldest one makes room."""

    def __init__(self, model: Model):
        self.m, self.open = model, {}

    def array(self, name: str, shard: int, kind: str | None, width: int = 1) -> np.ndarray:
        """A shard's array; ``kind`` None stands for counts in four or eight bytes."""
        key = name, shard
        if key not in self.open:
            n = int(self.m.entries["pair" if name in ("pair", "times") else "stats" if name == "stats" else "word"][shard]) * width
            path = f"{self.m.folder}/{name}-{shard}"
            size = os.path.getsize(path) if os.path.exists(path) else 0 if n == 0 else -1
            kind = kind or ("<u8" if size == 8 * n else "<u4")
            if size != n * np.dtype(kind).itemsize:
                raise RuntimeError(f"the language model's file {path} is {'missing' if size < 0 else 'not whole'}")
            if len(self.open) >= OPEN:
                del self.open[next(iter(self.open))]
            self.open[key] = np.memmap(path, kind, "r") if n else np.zeros(0, kind)
        return self.open[key]

    def words(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(number or -1, count)`` of sorted distinct hashes."""
        number, count = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        for s, a, z in _runs(self.m.word_shard(h)):
            keys = self.array("word", s, "<u8")
            if not len(keys):
                continue
            at = np.minimum(np.searchsorted(keys, h[a:z]), len(keys) - 1)
            hit = keys[at] == h[a:z]
            number[a:z] = np.where(hit, at + self.m.base[s], -1)
            count[a:z] = np.where(hit, self.array("count", s, "<i8")[at], 0)
        return number, count

    def pairs(self, key: np.ndarray, before_count: np.ndarray) -> np.ndarray:
        """Counts of sorted distinct pairs."""
        out = np.zeros(len(key), np.int64)
        shard = self.m.pair_shard(key, before_count)
        order = np.argsort(shard, kind="stable")
        for s, a, z in _runs(shard[order]):
            pick = order[a:z]
            keys = self.array("pair", s, "<u8")
            if not len(keys):
                continue
            at = np.minimum(np.searchsorted(keys, key[pick]), len(keys) - 1)
            hit = keys[at] == key[pick]
            out[pick[hit]] = self.array("times", s, None)[at[hit]]
        return out

    def stats(self, number: np.ndarray) -> np.ndarray:
        """Of sorted distinct word numbers: tokens after it, continuations once, twice, more; contexts before it."""
        out = np.zeros((len(number), 5), np.int64)
        for s, a, z in _runs(self.m.shard_of(number)):
            if len(x := self.array("stats", s, "<i8", 5)):  # none: the words there have no pairs
                out[a:z] = x.reshape(-1, 5)[number[a:z] - self.m.base[s]]
        return out

    def count_of(self, number: np.ndarray) -> np.ndarray:
        """Counts of sorted word numbers; ``types``, the start of a text, counts the texts."""
        out = np.full(len(number), self.m.texts, np.int64)
        for s, a, z in _runs(self.m.shard_of(number[: np.searchsorted(number, self.m.types)])):
            out[a:z] = self.array("count", s, "<i8")[number[a:z] - self.m.base[s]]
        return out

    def numbers(self, block: V.Block):
        """Tokens of a block as numbers (-1: unknown), their counts, and each text's offsets."""
        h, off = _tokens(block)
        unique, inverse = np.unique(h, return_inverse=True)
        number, count = self.words(unique)
        return number[inverse], count[inverse], off

    def before(self, number: np.ndarray, count: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The context of each token: the number before it (``types`` at a text's start) and its count."""
        b, c = np.empty_like(number), np.empty_like(count)
        b[1:], c[1:] = number[:-1], count[:-1]
        first = off[:-1]
        b[first], c[first] = self.m.types, self.m.texts
        return b, c


def _word_counts(model: Model):
    def run(batches):
        sums = _Sums(model.word_shard)
        for batch in batches:
            for block in V.blocks(batch.column(0)):
                h, _ = _tokens(block)
                yield from sums.add(*np.unique(h, return_counts=True))
        yield sums.flush()

    return run


def _pair_counts(model: Model):
    def run(batches):
        reader = Reader(model)

        def shard_of(key: np.ndarray) -> np.ndarray:
            return model.pair_shard(key, reader.count_of((key >> np.uint64(32)).astype(np.int64)))

        sums = _Sums(shard_of)
        for batch in batches:
            for block in V.blocks(batch.column(0)):
                number, count, off = reader.numbers(block)
                before, _ = reader.before(number, count, off)
                yield from sums.add(*np.unique(before.astype(np.uint64) << np.uint64(32) | number.astype(np.uint64), return_counts=True))
        yield sums.flush()

    return run


def _split_stats(model: Model, number: np.ndarray, columns: list[np.ndarray]):
    """Rows ``(shard of the word, numbers, columns)`` of partial sums."""
    for s, a, z in _runs(model.shard_of(number)):
        yield s, np.diff(number[a:z], prepend=0).astype(np.uint32).tobytes(), [_small(c[a:z]) for c in columns]


_STATS = "shard int, number binary, tokens binary, once binary, twice binary, more binary, contexts binary, k1 long, k2 long, k3 long, k4 long, pair_shard long, pairs long"


def _discounts(n: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and more, from how many have counts 1 to 4."""
    n1, n2, n3, n4 = n
    if not n1 or not n2:
        return [0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2.0]
    return [min(max(x, 0.05), i + 0.95) for i, x in enumerate(d)]


def train(docs: DataFrame) -> Model:
    """Count the words and pairs of all texts of ``docs`` (null: empty); the model lies in the shared folder."""
    spark = docs.sparkSession
    texts = docs.select("text")
    folder = _local(shared_dir(spark))
    parts = docs.rdd.getNumPartitions()
    model = Model(folder, word_shards=max(1, min(parts, WORD_SHARDS)))

    def words(table: pa.Table) -> pa.Table:
        shard, keys, counts = _merged(table)
        _write(folder, f"word-{shard}", keys)
        _write(folder, f"count-{shard}", counts)
        ends = int(counts[keys == END].sum())
        return pa.table({"shard": pa.array([shard], pa.int32()), "types": [len(keys)], "tokens": [int(counts.sum())], "texts": [ends]})

    rows = texts.mapInArrow(V.lean(_word_counts(model)), "shard int, key binary, count binary")
    found = rows.repartitionById(model.word_shards, F.col("shard")).groupBy("shard").applyInArrow(words, "shard int, types long, tokens long, texts long").collect()  # a row per shard
    types = np.zeros(model.word_shards, np.int64)
    types[[r.shard for r in found]] = [r.types for r in found]
    model.base = np.concatenate([[0], np.cumsum(types)[:-1]])
    model.types, model.tokens, model.texts = int(types.sum()), sum(r.tokens for r in found), sum(r.texts for r in found)
    if model.types >= 1 << 32:
        raise ValueError("more than 2^32 different words")
    model.shards = max(1, -(-model.tokens // SHARD_TOKENS))
    model.entries = {"word": types, "pair": np.zeros(model.shards, np.int64), "stats": np.zeros(model.word_shards, np.int64)}

    def pairs(table: pa.Table) -> pa.Table:
        shard, keys, counts = _merged(table)
        _write(folder, f"pair-{shard}", keys)
        _write(folder, f"times-{shard}", counts.astype(np.uint32 if counts.max(initial=0) < 1 << 32 else np.uint64))
        before, after = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]])) if len(keys) else np.zeros(0, np.int64)
        out = {name: [] for name in (x.split()[0] for x in _STATS.split(", "))}
        of = [(shard, len(keys))]
        kinds = [int((counts == k).sum()) for k in (1, 2, 3, 4)]
        add = lambda x: np.add.reduceat(x.astype(np.int64), first) if len(first) else first
        sums = [add(counts), add(counts == 1), add(counts == 2), add(counts > 2)]
        words_, contexts = np.unique(after, return_counts=True)
        for number, columns in ((before[first], [*sums, np.zeros(len(first), np.int64)]), (words_, [*[np.zeros(len(words_), np.int64)] * 4, contexts])):
            for s, n, c in _split_stats(model, number, columns):
                for name, value in zip(out, (s, n, *c, *kinds, *(of.pop() if of else (-1, 0))), strict=True):
                    out[name].append(value)
                kinds = [0, 0, 0, 0]
        types_ = [pa.int32(), *[pa.binary()] * 6, *[pa.int64()] * 6]
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), types_, strict=True)})

    def stats(table: pa.Table) -> pa.Table:
        shard = int(table.column("shard")[0].as_py())
        first = int(model.base[shard])
        size = (int(model.base[shard + 1]) if shard + 1 < model.word_shards else model.types + 1) - first
        total = np.zeros((size, 5), np.int64)
        for i in range(table.num_rows):
            number = np.cumsum(np.frombuffer(table.column("number")[i].as_py(), np.uint32), dtype=np.int64) - first
            for j, name in enumerate(("tokens", "once", "twice", "more", "contexts")):
                total[number, j] += _counts(table.column(name)[i].as_py())
        _write(folder, f"stats-{shard}", total)
        c = total[:, 4]
        k = [sum(table.column(f"k{j}").to_pylist()) for j in (1, 2, 3, 4)]
        own = [(s, n) for s, n in zip(table.column("pair_shard").to_pylist(), table.column("pairs").to_pylist(), strict=True) if s >= 0]
        return pa.table({"shard": pa.array([shard], pa.int32()), "size": [size], "of": pa.array([[s for s, _ in own]], pa.list_(pa.int64())), "entries": pa.array([[n for _, n in own]], pa.list_(pa.int64())), "pairs": [k], "words": [[int((c == j).sum()) for j in (1, 2, 3, 4)]], "continuations": [int(c.sum())], "more": [int((c > 2).sum())]})

    rows = texts.mapInArrow(V.lean(_pair_counts(model)), "shard int, key binary, count binary")
    rows = rows.repartitionById(model.shards, F.col("shard")).groupBy("shard").applyInArrow(pairs, _STATS)
    rows = rows.groupBy("shard").applyInArrow(stats, "shard int, size long, of array<long>, entries array<long>, pairs array<long>, words array<long>, continuations long, more long").collect()  # a row per shard
    for r in rows:
        model.entries["stats"][r.shard] = r["size"]
        model.entries["pair"][r["of"]] = r["entries"]
    total = lambda name: [sum(x) for x in zip(*(r[name] for r in rows), strict=True)] or [0, 0, 0, 0]
    model.discount, model.lower_discount = _discounts(total("pairs")), _discounts(total("words"))
    model.continuations = sum(r.continuations for r in rows)
    model.kinds = [*total("words")[:2], sum(r.more for r in rows)]
    return model


def log10_probabilities(reader: Reader, number: np.ndarray, count: np.ndarray, off: np.ndarray) -> np.ndarray:
    """log10 of each token's probability after the one before it."""
    m = reader.m
    d, e = m.discount, m.lower_discount
    before, before_count = reader.before(number, count, off)
    unique, inverse = np.unique(np.concatenate([number, before]), return_inverse=True)
    real = unique >= 0
    st = np.zeros((len(unique), 5), np.int64)
    st[real] = reader.stats(unique[real])
    word, ctx = st[inverse[: len(number)]], st[inverse[len(number) :]]

    c = word[:, 4]
    cut = np.where(c == 0, 0, np.where(c == 1, e[0], np.where(c == 2, e[1], e[2])))
    spare = sum(x * k for x, k in zip(e, m.kinds, strict=True))
    p = ((c - cut) + spare / (m.types + 1)) / max(m.continuations, 1) if m.continuations else np.full(len(c), 1 / (m.types + 1))

    known = (number >= 0) & (before >= 0)
    key = before[known].astype(np.uint64) << np.uint64(32) | number[known].astype(np.uint64)
    distinct, first, inv = np.unique(key, return_index=True, return_inverse=True)
    times = np.zeros(len(number), np.int64)
    times[known] = reader.pairs(distinct, before_count[known][first])[inv]
    total = ctx[:, 0]
    cut = np.where(times == 0, 0, np.where(times == 1, d[0], np.where(times == 2, d[1], d[2])))
    spare = d[0] * ctx[:, 1] + d[1] * ctx[:, 2] + d[2] * ctx[:, 3]
    return np.log10(np.where(total > 0, (times - cut + spare * p) / np.maximum(total, 1), p))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity`` of every text (null: empty).

    ``base_score`` is the add-0.1 unigram score, ``score`` the model's log10
    probability of the words and the end.  With nothing to learn from, every
    token has the uniform probability over the unknown word.
    """

    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few numbers a shard

    def run(batches):
        model = shared.value
        reader = Reader(model)
        for batch in batches:
            cols = [[] for _ in range(4)]
            for block in V.blocks(batch.column(1)):
                number, count, off = reader.numbers(block)
                logs = log10_probabilities(reader, number, count, off)
                base = np.log10((count + 0.1) / (model.tokens + 0.1 * (model.types + 1)))
                first = off[:-1]
                for c, x in zip(cols, (np.diff(off), np.add.reduceat(count > 0, first, dtype=np.int64), np.add.reduceat(base, first), np.add.reduceat(logs, first)), strict=True):
                    c.append(x)
            n, known, base, logs = (np.concatenate(c) if c else np.zeros(0) for c in cols)
            out = [pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(np.full(len(n), model.tokens, np.int64)), pa.array(base.astype(float)), pa.array(logs.astype(float)), pa.array(10.0 ** (-logs.astype(float) / np.maximum(n, 1)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *out], names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return texts_of(docs).mapInArrow(V.lean(run), "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
