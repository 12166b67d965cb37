"""Language identification by interpolated Kneser-Ney character models.

A model of three characters is learned for each language from a bounded
sample of labelled rows (``SAMPLE`` documents a language of up to ``SAMPLE_TEXT``
bytes, whole texts, chosen by a hash of the row, ``SAMPLE_BYTES`` in all).  Counts
lie in sorted arrays of n-gram hashes.  A text goes to the language of the lowest
cross-entropy per character, the first by name of several; letters are folded to
lower case, and anything else counts as one gap between words.

A prediction is rejected where that cross-entropy is above nearly all those of
the language's own calibration texts.  ``lang_pred`` is ``und`` for texts that
are null or have no letter.  Languages are scored one after another, and texts beyond
a block in slices, so memory depends neither on how many languages there are nor
on the longest text.  Equal texts have equal predictions.
"""

from __future__ import annotations

import sys
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import textvec as V
from tessera.llm.common import texts_of

SAMPLE = 400
SAMPLE_TEXT = 1 << 16
SAMPLE_BYTES = 1 << 26
LANGUAGES = 1000
CALIBRATION = 5  # every fifth sampled text calibrates the rejection
TAIL = 0.995


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    every = "".join(chr(c) if not 0xD800 <= c <= 0xDFFF else "!" for c in range(sys.maxunicode + 1))
    out = np.zeros(sys.maxunicode + 1, bool)
    for m in regex.finditer(r"\p{L}+", every):
        out[m.start() : m.end()] = True
    return out


class Alphabet:
    """Code points to symbols: 0 is a gap, ``size - 1`` any letter not met in training."""

    def __init__(self, letters: list[str]):
        self.letters, self.size = letters, len(letters) + 2
        self.code = np.where(_letters(), self.size - 1, 0).astype(np.int64)
        for i, c in enumerate(letters):
            for x in {c, c.upper()}:
                if len(x) == 1:
                    self.code[ord(x)] = i + 1

    def symbols(self, cps: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of texts that begin at ``start``, each led by a gap, runs of gaps as one; and their offsets."""
        own = np.repeat(np.arange(len(start) - 1), np.diff(start))
        s = self.code[cps]
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] > 0) | (s[:-1] > 0)
        at = start[:-1][np.diff(start) > 0]
        keep[at] = s[at] > 0  # the gap in front of the text is there already
        n = np.bincount(own[keep], minlength=len(start) - 1) + 1
        off = np.concatenate([[0], np.cumsum(n)])
        out = np.zeros(off[-1], np.int64)
        mask = np.ones(off[-1], bool)
        mask[off[:-1]] = False
        out[mask] = s[keep]
        return out, off


class _Counts:
    """Sorted n-gram hashes with their values."""

    def __init__(self, key: np.ndarray, value: np.ndarray):
        h = V.mix(key.astype(np.uint64) + np.uint64(1))
        order = np.argsort(h)
        self.hash, self.value = h[order], value[order].astype(float)

    def get(self, key: np.ndarray) -> np.ndarray:
        if not len(self.hash):
            return np.zeros(len(key))
        h = V.mix(key.astype(np.uint64) + np.uint64(1))
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        return np.where(self.hash[at] == h, self.value[at], 0.0)


def _grouped(key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, inverse = np.unique(key, return_inverse=True)
    return u, np.bincount(inverse, weights=weight, minlength=len(u))


class CharModel:
    """Interpolated Kneser-Ney over trigrams of symbols, with one discount per order."""

    def __init__(self, trigrams: np.ndarray, size: int):
        m = self.m = size
        tri, c3 = np.unique(trigrams, return_counts=True)
        bi, c2 = np.unique(tri % (m * m), return_counts=True)  # in how many contexts a bigram occurs
        uni, c1 = np.unique(bi % m, return_counts=True)
        discount = lambda c: (lambda a, b: a / (a + 2 * b) if a and b else 0.5)(np.sum(c == 1), np.sum(c == 2))
        self.d3, self.d2, self.d1 = discount(c3), discount(c2), discount(c1)
        one = np.ones
        self.c3, self.c2, self.c1 = _Counts(tri, c3), _Counts(bi, c2), _Counts(uni, c1)
        self.t3, self.n3 = _Counts(*_grouped(tri // m, c3)), _Counts(*_grouped(tri // m, one(len(tri))))
        self.t2, self.n2 = _Counts(*_grouped(bi // m, c2)), _Counts(*_grouped(bi // m, one(len(bi))))
        self.t1, self.n1 = max(c1.sum(), 1), len(uni)

    def log2(self, key: np.ndarray) -> np.ndarray:
        m = self.m
        ab, bc = key // m, key % (m * m)
        b, c = bc // m, bc % m
        p = (np.maximum(self.c1.get(c) - self.d1, 0) + (self.d1 * self.n1 if self.n1 else self.t1) / m) / self.t1
        t = self.t2.get(b)
        p = np.where(t > 0, (np.maximum(self.c2.get(bc) - self.d2, 0) + self.d2 * self.n2.get(b) * p) / np.maximum(t, 1), p)
        t = self.t3.get(ab)
        p = np.where(t > 0, (np.maximum(self.c3.get(key) - self.d3, 0) + self.d3 * self.n3.get(ab) * p) / np.maximum(t, 1), p)
        return np.log2(p)


def _trigrams(s: np.ndarray, off: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the trigrams that end at each symbol but the first of its text, and their offsets."""
    first = np.zeros(len(s), bool)
    first[off[:-1]] = True
    before = np.concatenate([[0], s[:-1]])
    two = np.concatenate([[0, 0], s[:-2]])[: len(s)]
    second = np.zeros(len(s) + 1, bool)
    second[off[:-1] + 1] = True
    two[second[:-1]] = 0
    key = (two * m + before) * m + s
    return key[~first], off - np.arange(len(off))


class Identifier:
    """All languages' models over one alphabet, and what their own texts' cross-entropies look like."""

    def __init__(self, texts: dict[str, list[str]]):
        self.names = sorted(x for x in texts if any(t for t in texts[x]))
        seen = sorted({c for x in self.names for t in texts[x] for c in set(t.lower()) if _letters()[ord(c)]})
        self.letters = seen
        self.alphabet = Alphabet(seen)
        self.models, self.limit = [], []
        for x in self.names:
            fit = [t for i, t in enumerate(texts[x]) if i % CALIBRATION or len(texts[x]) < 2 * CALIBRATION]
            self.models.append(CharModel(self._keys(fit)[0], self.alphabet.size))
        for j, x in enumerate(self.names):
            held = [t for i, t in enumerate(texts[x]) if i % CALIBRATION == 0 and t]
            key, off = self._keys(held)
            h = -_sums(self.models[j].log2(key), off) / np.maximum(np.diff(off), 1) if held else np.zeros(0)
            self.limit.append(float(np.quantile(h, TAIL)) * 1.05 if len(h) else np.inf)
        self.limit = np.array(self.limit)

    def _keys(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cps = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        return _trigrams(*self.alphabet.symbols(cps, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)), self.alphabet.size)

    def totals(self, key: np.ndarray, off: np.ndarray) -> np.ndarray:
        """log2 probability of each text's trigrams in every language."""
        unique, inverse = _distinct(key, self.alphabet.size**3)
        return np.stack([_sums(m.log2(unique)[inverse], off) for m in self.models], axis=1)

    def _in_slices(self, data: np.ndarray) -> tuple[np.ndarray, int, int]:
        """``(totals, trigrams, letters)`` of one long text."""
        total, n, letters, last, at, m = np.zeros(len(self.models)), 0, 0, (0, 0), 0, self.alphabet.size
        while at < len(data):
            end = min(at + V.BLOCK_BYTES, len(data))
            while end < len(data) and data[end] & 0xC0 == 0x80:
                end += 1
            s = self.alphabet.code[np.frombuffer(data[at:end].tobytes().decode().encode("utf-32-le"), np.uint32)]
            s = s[(s > 0) | (np.concatenate([last[1:], s[:-1]]) > 0)]  # runs of gaps as one
            x = np.concatenate([last, s])
            key = (x[:-2] * m + x[1:-1]) * m + s
            total += self.totals(key, np.array([0, len(key)]))[0]
            n, letters, last, at = n + len(s), letters + int((s > 0).sum()), tuple(x[-2:].tolist()), end
        return total, n, letters

    def predict(self, block: V.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(language index or -1, score, rejected)`` of each text."""
        if block.hi - block.lo == 1 and len(block.data) > V.BLOCK_BYTES:
            total, n, letters = self._in_slices(block.data)
            total, n, known = total[None], np.array([n]), np.array([letters > 0])
        else:
            cps = np.frombuffer(block.data.tobytes().decode().encode("utf-32-le"), np.uint32)
            start = block.off
            if len(cps) != len(block.data):
                start = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)])[block.off]
            s, off = self.alphabet.symbols(cps, start)
            known = np.diff(np.concatenate([[0], np.cumsum(s > 0)])[off]) > 0
            key, to = _trigrams(s, off, self.alphabet.size)
            total, n = self.totals(key, to), np.diff(to)
        h = -total / np.maximum(n, 1)[:, None]
        best = h.argmin(axis=1)
        weight = np.minimum(n, 60)[:, None]
        odds = np.exp2((h.min(axis=1, keepdims=True) - h) * weight)
        score = 1 / odds.sum(axis=1)
        rejected = h[np.arange(len(h)), best] > self.limit[best]
        score = np.where(rejected, score / 2, score)
        return np.where(known, best, -1), np.where(known, score, 0.0), rejected | ~known


def _sums(x: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0.0], np.cumsum(x)])[off])


def _distinct(key: np.ndarray, space: int) -> tuple[np.ndarray, np.ndarray]:
    if space > 1 << 25:
        return np.unique(key, return_inverse=True)
    seen = np.zeros(space, bool)
    seen[key] = True
    unique = np.flatnonzero(seen)
    place = np.zeros(space, np.int32)
    place[unique] = np.arange(len(unique), dtype=np.int32)
    return unique, place[key]


def learn(docs: DataFrame, learnable: Column, sample: int = SAMPLE) -> Identifier:
    """Fit on about ``sample`` documents of each language among the ``learnable`` rows.

    Rows are chosen by a hash of id and text against a share worked out from the
    languages' counts, and taken in the hash's order up to the bounds on rows
    and bytes.  Every language is learned; more than ``LANGUAGES`` are refused
    with an error.
    """
    rows = docs.filter(learnable & F.col("lang").isNotNull() & (F.octet_length("text") <= SAMPLE_TEXT)).select("lang", "doc_id", "text")
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES + 1).collect()
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} values of lang")
    if not counts:
        return Identifier({})
    share = F.broadcast(docs.sparkSession.createDataFrame([(r.lang, sample / r.n) for r in counts], "lang string, share double"))  # a row a language
    u = F.pmod(F.xxhash64("doc_id", "text", F.lit(10)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    some = rows.withColumn("u", u).join(share, "lang").filter("u < share")
    order = Window.partitionBy("lang").orderBy("u", "doc_id", "text")
    some = some.withColumn("place", F.row_number().over(order)).withColumn("before", F.sum(F.octet_length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.octet_length("text"))
    picked = some.filter((F.col("place") <= 2 * sample) & (F.col("before") <= SAMPLE_BYTES // len(counts))).select("lang", "doc_id", "text").collect()
    texts: dict[str, list[str]] = {}
    for r in sorted(picked, key=lambda r: (r.lang, r.doc_id is None, r.doc_id or 0, r.text)):
        texts.setdefault(r.lang, []).append(r.text)
    return Identifier(texts)


def identify(docs: DataFrame, model: Identifier) -> DataFrame:
    """``doc_id, lang_pred, score, rejected``; without any learned language every text is ``und``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches):
        m = shared.value
        names = np.array([*m.names, "und"], object)
        for batch in batches:
            best, score, rejected = [], [], []
            for block in V.blocks(batch.column(1)):
                n = block.hi - block.lo
                b, s, r = m.predict(block) if m.names else (np.full(n, -1), np.zeros(n), np.ones(n, bool))
                best.append(b), score.append(s), rejected.append(r)
            cat = lambda x: np.concatenate(x) if x else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[cat(best)], pa.string()), pa.array(cat(score), pa.float64()), pa.array(cat(rejected).astype(bool), pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    return texts_of(docs).mapInArrow(V.lean(run), "doc_id long, lang_pred string, score double, rejected boolean")
