"""Rules for text quality: repetition counts and divergence from language references.

Each document's histograms of character classes and of common words are
compared with those of every language by Jensen-Shannon distance.  The references
are sums over all documents of a language, however few, and a language's common
words are its ``COMMON`` most frequent ones (A-Z as a-z), counted over all of them.  A
document is judged against the language nearest to it, the first by name of several;
one whose own language has no reference (null or empty ``lang``) passes the divergence
rules, as do texts of fewer than ``MIN_WORDS`` words, which are too short for a
histogram.

Null and empty texts have no words and fail the base rule.  Equal texts have equal
counts and distances.  A text of any length is one row of a task; its bytes are
counted in slices, and 8-byte arrays are kept for its words and lines only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import textvec as V

MIN_WORDS = 50
MAX_CLASS_DISTANCE = 0.29
MAX_WORD_DISTANCE = 0.42
COMMON = 24
LANGUAGES = 10000
FLUSH = 500_000  # words that a task remembers before it sends their counts
BLOCK_BYTES = 1 << 19  # of texts at once; the counts need some 100 bytes for each
_AT_ONCE = 16
_CELLS = 1 << 22  # of a table of documents and common words

# The symbols that are counted.
SYMBOLS = "#*$%&|<>"
# 0 lower, 1 upper, 2 digit, 3 blank, 4 line break, 5 sentence marks, 6 symbols, 7 other ASCII, 8 beyond ASCII; 9 is not counted
_CLASS = np.full(256, 7, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[32, 9]], _CLASS[[10, 11, 12, 13]] = 3, 4
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 5
_CLASS[[ord(c) for c in SYMBOLS]] = 6
_CLASS[128:192], _CLASS[192:] = 9, 8
_CLASSES = 9


def _count(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    if len(off) == 2:
        return np.array([np.count_nonzero(mask)])
    return np.diff(np.concatenate([[0], np.cumsum(mask)])[off])


def classes(block: V.Block) -> np.ndarray:
    """Per text: counts of the character classes."""
    rows = block.hi - block.lo
    if rows == 1:
        slices = range(0, len(block.data), V.BLOCK_BYTES)
        out = sum((np.bincount(_CLASS[block.data[at : at + V.BLOCK_BYTES]], minlength=10) for at in slices), np.zeros(10, np.int64))[None]
    else:
        owner = np.repeat(np.arange(rows), np.diff(block.off))
        out = np.bincount(owner * 10 + _CLASS[block.data], minlength=rows * 10).reshape(rows, 10)
    return out[:, :_CLASSES]


class References:
    """Of each language the shares of the character classes, its common words' hashes and their shares."""

    def __init__(self, rows: list):
        of: dict[str, dict] = {}
        for r in rows:
            of.setdefault(r.lang, {}).setdefault(r.kind, {})[r.key] = r.n
        self.names = sorted(x for x in of if of[x][_TOTAL][0] > 0)
        n = len(self.names)
        self.chars, self.words = np.zeros((n, _CLASSES)), np.zeros((n, COMMON + 1))
        own = np.zeros((n, COMMON), np.uint64)
        for j, x in enumerate(self.names):
            for k, v in of[x].get(_CHARS, {}).items():
                self.chars[j, k] = v
            top = sorted(of[x][_WORD].items(), key=lambda w: (-w[1], w[0]))[:COMMON]
            own[j] = np.resize(np.array([w for w, _ in top], np.int64).view(np.uint64), COMMON)
            self.words[j, : len(top)] = [v for _, v in top]
            self.words[j, COMMON] = of[x][_TOTAL][0] - self.words[j].sum()
        self.chars /= np.maximum(self.chars.sum(axis=1, keepdims=True), 1)
        self.words /= np.maximum(self.words.sum(axis=1, keepdims=True), 1)
        self.hash = np.unique(own)
        self.at = np.searchsorted(self.hash, own)
        for j, x in enumerate(self.names):  # places without a word are never hit
            self.at[j, len(of[x][_WORD]) :] = -1

    def nearest(self, chars: np.ndarray, lower: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text the reference nearest to it, and both distances from it; ``lower`` has its words' hashes."""
        n = len(off) - 1
        out = np.zeros(n, np.int64), np.full(n, np.inf), np.full(n, np.inf)
        at = np.searchsorted(self.hash, lower).astype(np.int32)
        np.minimum(at, len(self.hash) - 1, out=at)
        hit = np.flatnonzero(self.hash[at] == lower)
        at = at[hit]
        owner = np.searchsorted(off, hit, "right").astype(np.int32) - 1
        del hit
        present = np.flatnonzero(np.bincount(at, minlength=len(self.hash)))
        column = np.full(len(self.hash) + 1, len(present), np.int64)  # words that no text has: an empty column
        column[present] = np.arange(len(present))
        place = column[at]
        step = max(1, _CELLS // (len(present) + 1))
        for lo in range(0, n, step):
            hi = min(lo + step, n)
            a, z = np.searchsorted(owner, [lo, hi])
            width = len(present) + 1
            table = np.bincount((owner[a:z] - lo) * width + place[a:z], minlength=(hi - lo) * width).reshape(hi - lo, width)
            self._nearest(chars[lo:hi], table, np.diff(off[lo : hi + 1]), column, *(x[lo:hi] for x in out))
        return out

    def _nearest(self, chars, table, total, column, best, dc, dw) -> None:
        rows = np.arange(len(chars))
        for lo in range(0, len(self.names), _AT_ONCE):  # some references at once bound the memory
            c = jensen_shannon(chars, self.chars[lo : lo + _AT_ONCE])
            w = np.empty_like(c)
            for j in range(c.shape[1]):
                own = table[:, column[self.at[lo + j]]]
                own = np.concatenate([own, (total - own.sum(axis=1))[:, None]], axis=1)
                w[:, j] = jensen_shannon(own, self.words[lo + j : lo + j + 1])[:, 0]
            at = (c + w).argmin(axis=1)
            c, w = c[rows, at], w[rows, at]
            nearer = c + w < dc + dw
            best[nearer], dc[nearer], dw[nearer] = at[nearer] + lo, c[nearer], w[nearer]


def jensen_shannon(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Distance (0 to 1) of each row's distribution from each reference; rows without counts get 0."""
    total = counts.sum(axis=1, keepdims=True)
    p = counts / np.maximum(total, 1)
    out = np.zeros((len(counts), len(reference)))
    for j, q in enumerate(reference):
        m = (p + q) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            kl = lambda x: np.where(x > 0, x * np.log2(x / m), 0).sum(axis=1)
            out[:, j] = np.sqrt(np.clip((kl(p) + kl(np.broadcast_to(q, p.shape))) / 2, 0, 1))
    out[total[:, 0] == 0] = 0
    return out


def repeats(block: V.Block, w: V.Words, span: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Per text: lines equal to an earlier one, and words inside repeated windows of ``span`` words."""
    rows, data = block.hi - block.lo, block.data
    own = lambda h, owner: V.mix(h ^ V.mix(owner.astype(np.uint64)))
    lines = np.unique(np.concatenate([block.off[:-1][np.diff(block.off) > 0], np.flatnonzero(data == 10) + 1]))
    lines = lines[lines < len(data)]
    dup = np.zeros(rows, np.int64)
    if len(lines):
        end = np.append(lines[1:], len(data))
        h = V.segment_hash(data, lines, end - (data[end - 1] == 10))
        with_word = np.diff(np.searchsorted(w.start, np.append(lines, len(data)))) > 0
        owner = np.searchsorted(block.off, lines, "right") - 1
        h, owner = own(h, owner)[with_word], owner[with_word]
        first = np.unique(h, return_index=True)[1]
        dup = np.bincount(owner, minlength=rows) - np.bincount(owner[first], minlength=rows)
    if rows == 1:
        h, index = V.windows(w.hash, span), slice(None)
    else:
        index, to = V.window_starts(w.off, span)
        h = own(V.windows(w.hash, span)[index], np.repeat(np.arange(rows), np.diff(to))) if len(index) else np.zeros(0, np.uint64)
    step = np.zeros(len(w.start) + 1, np.int32)  # windows that are repeated: +1 where they begin, -1 behind their end
    if len(h):
        order = np.argsort(h)
        h = h[order]
        same = h[1:] == h[:-1]
        twice = np.zeros(len(h), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        del order, same, h
        at = np.flatnonzero(twice) if rows == 1 else index[twice]
        step[at] += 1
        step[at + span] -= 1
    return dup, _count(np.cumsum(step[:-1], dtype=np.int32) > 0, w.off)


_CHARS, _WORD, _TOTAL = range(3)


def _counts(batches):
    """Of each language in some texts: characters by class, words by hash, and all words."""
    kept: dict[str, list] = {}

    def sent():
        lang, kind, key, n = [], [], [], []
        for x, parts in kept.items():
            for what in (_CHARS, _WORD, _TOTAL):
                k, c = _added([(k, c) for w, k, c in parts if w == what])
                lang.append(pa.repeat(pa.scalar(x, pa.string()), len(k))), kind.append(pa.repeat(pa.scalar(what, pa.int8()), len(k))), key.append(pa.array(k.view(np.int64))), n.append(pa.array(c))
        kept.clear()
        cat = lambda x, t: pa.concat_arrays(x) if x else pa.array([], t)
        return pa.RecordBatch.from_arrays([cat(lang, pa.string()), cat(kind, pa.int8()), cat(key, pa.int64()), cat(n, pa.int64())], names=["lang", "kind", "key", "n"])

    size = 0
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for block in V.blocks(batch.column(1), BLOCK_BYTES):
            w = V.words(block, lower=True)
            chars = classes(block)
            own = np.array([x or "" for x in langs[block.lo : block.hi]], object)
            row = np.repeat(np.arange(len(own)), np.diff(w.off))
            for x in set(own.tolist()) - {""}:
                mine = own == x
                k, c = np.unique(w.hash[mine[row]], return_counts=True)
                parts = kept.setdefault(x, [])
                parts += [(_CHARS, np.arange(_CLASSES, dtype=np.uint64), chars[mine].sum(axis=0)), (_WORD, k, c), (_TOTAL, np.zeros(1, np.uint64), np.array([c.sum()]))]
                size += len(k)
        if size >= FLUSH:
            for x, parts in kept.items():
                kept[x] = [(what, *_added([(k, c) for w, k, c in parts if w == what])) for what in (_CHARS, _WORD, _TOTAL)]
            size = sum(len(k) for parts in kept.values() for _, k, _ in parts)
            if size >= FLUSH // 2:
                yield sent()
                size = 0
    yield sent()


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    if not len(key):
        return key, n
    order = np.argsort(key)
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(n, first)


def references(docs: DataFrame) -> References:
    """What all documents of each language that has a word add up to.

    More than ``LANGUAGES`` of them are refused with an error, as a few numbers
    of each reach the driver.
    """
    found = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(V.lean(_counts), "lang string, kind byte, key long, n long")
    found = found.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    most = Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "key")  # of each partition only the most frequent words are moved
    rows = found.withColumn("place", F.row_number().over(most)).filter(F.col("place") <= COMMON).drop("place").limit((LANGUAGES + 1) * (COMMON + _CLASSES + 1)).collect()
    if len({r.lang for r in rows}) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} values of lang")
    return References(rows)


_OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double, nearest string"


def _judge(shared, min_words: int, class_limit: float, word_limit: float):
    def run(batches):
        refs = shared.value
        known = set(refs.names)
        for batch in batches:
            own = np.array([x in known for x in batch.column(2).to_pylist()], bool)
            cols = [[] for _ in range(10)]
            for block in V.blocks(batch.column(1), BLOCK_BYTES):
                w = V.words(block)
                n = np.diff(w.off)
                word_chars = _count(~V.IS_SEP[block.data] & (block.data & 0xC0 != 0x80), block.off)
                symbols = _count(_CLASS[block.data] == 6, block.off)
                dup, rep = repeats(block, w)
                failed = (n < 20) | (100 * rep > 30 * n)
                if known:
                    best, dc, dw = refs.nearest(classes(block), V.segment_hash(V.folded(block.data), w.start, w.end), w.off)
                    who = np.array(refs.names, object)[best]
                else:
                    dc = dw = np.zeros(len(n))
                    who = np.full(len(n), None, object)
                kept = ~failed & ((n < min_words) | ~own[block.lo : block.hi] | ((dc <= class_limit) & (dw <= word_limit)))
                for c, x in zip(cols, (n, word_chars, symbols, dup, rep, failed, kept, dc, dw, who), strict=True):
                    c.append(x)
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2 + [pa.string()]
            out = [pa.array(np.concatenate(c) if c else [], k) for c, k in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *out], names=[x.split()[0] for x in _OUT.split(", ")])

    return run


def quality_rules(docs: DataFrame, min_words: int = MIN_WORDS, class_limit: float = MAX_CLASS_DISTANCE, word_limit: float = MAX_WORD_DISTANCE) -> DataFrame:
    """One row per document with its counts, distances and verdict (``_OUT`` lists the columns).

    Without any language to refer to, only the base rule decides.
    """
    shared = docs.sparkSession.sparkContext.broadcast(references(docs))  # a few numbers a language
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return rows.mapInArrow(V.lean(_judge(shared, min_words, class_limit, word_limit)), _OUT)
