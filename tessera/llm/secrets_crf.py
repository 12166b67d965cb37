"""Secrets in text: exact patterns, and a linear-chain conditional random field.

The base patterns (``BASE``) always count.  The field adds spans: tokens (runs of
``[A-Za-z0-9+/_.=-]``) are tagged secret-begin, inside or outside from their shape, the
words and marks in front of them and features of the whole file.

The field is fitted by gradient ascent on the exact likelihood (forward and
backward sums) over a bounded sample of ``SAMPLE`` documents; the base patterns
mark its secrets, with the words that give them away masked half the time, so
that shape and neighbours count as well.

Decoding is Viterbi.  Where ``outside`` beats the other tags by more than all
transitions together could win back, the best path goes through it for certain;
so the sequence falls apart into the few runs of tokens in between, each
decoded exactly, and ordinary text costs one table lookup a token; of equally good
paths it takes the one with the lower tags.

Null texts read as empty and have no secrets; equal texts have equal spans.  A text of
any length is one row of a task, which needs some 40 bytes of memory a byte of it.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textvec as V
from tessera.llm.common import mapped, stored, texts_of

SAMPLE = 1500
SAMPLE_TEXT = 1 << 16
CONTEXT = 40

# The base patterns, and words that announce a secret.
ASSIGN = re.compile(r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ANNOUNCE = "password passwd pwd pass secret token apikey api_key key auth bearer authorization credential credentials access_key private_key".split()
KINDS = ("assign", "access", "hex", "crf")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Base matches as ``(start, end, kind)`` in code points; leftmost, not overlapping, per kind."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{z}" for a, z, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


# Parts of a token's cell: name and number of values.
PARTS = (("length", 6), ("digits", 4), ("upper", 4), ("hex", 2), ("marks", 2), ("before", 3), ("announced", 3), ("file", 2))
_SIZES = [n for _, n in PARTS]
CELLS = int(np.prod(_SIZES))
_FIRST = np.concatenate([[0], np.cumsum(_SIZES)[:-1]])
_WIDTH = sum(_SIZES) + 4 * 4 + 6 * 4  # plus digits x upper and length x digits


def _design() -> np.ndarray:
    """The active features of every cell, as a 0/1 matrix."""
    parts = np.stack(np.unravel_index(np.arange(CELLS), _SIZES), axis=1)
    out = np.zeros((CELLS, _WIDTH), np.float32)
    rows = np.arange(CELLS)
    for j, first in enumerate(_FIRST):
        out[rows, first + parts[:, j]] = 1
    at = sum(_SIZES)
    out[rows, at + parts[:, 1] * 4 + parts[:, 2]] = 1
    out[rows, at + 16 + parts[:, 0] * 4 + parts[:, 1]] = 1
    return out


_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *map(ord, "+/_.=-")]] = True
_KIND = np.zeros(256, np.int64)  # counts packed into one number: digits, upper, letters g-z and any mark, 16 bits each
_KIND[48:58] = 1
_KIND[65:91] = 1 << 20
_KIND[[*range(103, 123)]] = 1 << 40
_LINK = np.zeros(256, np.uint8)
_LINK[[ord(":"), ord("=")]] = 2
_LINK[[ord('"'), ord("'"), ord("`")]] = 1
_MARKS = np.zeros(256, bool)
_MARKS[[ord(c) for c in "+/_=-"]] = True


def _announce_table() -> np.ndarray:
    return np.sort(V.words(next(V.blocks(pa.array([" ".join(ANNOUNCE)]))), lower=True).hash)


_ANNOUNCE = _announce_table()


def tokens(block: V.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(start, end, cell, off)``: the tokens' byte spans, feature cells, and each text's offsets into them."""
    data, n = block.data, len(block.data)
    inside = _TOKEN[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    # "=" after a word that announces a secret ends it: key=value is two tokens
    eq = np.flatnonzero(data == 61)
    eq = eq[(eq > 0) & (eq + 1 < n)]
    eq = eq[inside[eq - 1] & inside[eq + 1] & (data[eq + 1] != 61)]
    first[eq + 1] = True
    last[eq] = True
    edge = block.off[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    off = np.searchsorted(start, block.off)
    if not len(start):
        return start, end, np.zeros(0, np.int64), off
    size = end - start
    packed = np.add.reduceat(np.where(inside, _KIND[data], 0), start)
    digits, upper, beyond = packed & 0xFFFFF, (packed >> 20) & 0xFFFFF, packed >> 40
    marks = np.add.reduceat(_MARKS[data] & inside, start, dtype=np.int64) > 0
    length = np.digitize(size, (8, 12, 16, 24, 40))
    d = np.where(digits == 0, 0, np.where(4 * digits < size, 1, np.where(5 * digits < 3 * size, 2, 3)))
    capital = (data[start] >= 65) & (data[start] <= 90)
    u = np.where(upper == 0, 0, np.where((upper == 1) & capital, 1, np.where(upper + digits == size, 3, 2)))
    hexa = (upper == 0) & (beyond == 0) & ~marks
    gap = np.concatenate([[0], np.maximum.reduceat(np.append(np.where(inside, 0, _LINK[data]), 0), np.append(start, n))[:-1]])[: len(start)]
    before = np.where(data[np.maximum(start - 1, 0)] == 61, 2, gap)
    named = np.zeros(len(start), bool)
    short = np.flatnonzero(size <= 17)
    plain = end[short] - (data[end[short] - 1] == 61)
    h = V.segment_hash(V.folded(data), start[short], np.maximum(plain, start[short]))
    at = np.minimum(np.searchsorted(_ANNOUNCE, h), len(_ANNOUNCE) - 1)
    named[short] = _ANNOUNCE[at] == h
    one = np.concatenate([[False], named[:-1]])
    two = np.concatenate([[False, False], named[:-2]])[: len(start)]
    begin = off[:-1][np.diff(off) > 0]
    one[begin] = False
    two[begin] = False
    later = begin + 1
    two[later[later < len(start)]] = False
    before[begin] = np.where(before[begin] == 2, 0, before[begin])
    announced = np.where(one, 2, np.where(two, 1, 0))
    odd = np.diff(np.concatenate([[0], np.cumsum(digits > 0)])[off])
    code = np.repeat(20 * odd > np.diff(off), np.diff(off)).astype(np.int64)
    cell = np.ravel_multi_index((length, d, u, hexa.astype(int), marks.astype(int), before.astype(int), announced, code), _SIZES)
    return start, end, cell, off


class Field:
    """Weights of the field: per feature and tag, and between tags (0 outside, 1 begin, 2 inside)."""

    def __init__(self):
        self.weights = np.zeros((_WIDTH, 3))
        self.weights[:, 0] = 0.2
        self.step = np.zeros((3, 3))
        self._finish()

    def _finish(self) -> None:
        self.table = (_design() @ self.weights).astype(np.float64)
        # what any neighbours can win back when tag y at a token becomes outside
        self.slack = [-((self.step[:, 0] - self.step[:, y]).min() + (self.step[0] - self.step[y]).min()) for y in (1, 2)]
        self.certain = (self.table[:, :1] - self.table[:, 1:] > np.maximum(self.slack, 0)[None, :] + 1e-9).all(axis=1)

    def fit(self, cells: np.ndarray, tags: np.ndarray, length: np.ndarray, rounds: int = 120) -> Field:
        """Gradient ascent on the log-likelihood of padded sequences (``n x t``), with a small quadratic penalty."""
        if not len(cells):
            return self
        design = _design().astype(np.float64)
        n, t = cells.shape
        live = np.arange(t)[None, :] < length[:, None]
        weight = 1.0 / max(live.sum(), 1)
        want = np.zeros((CELLS, 3))
        np.add.at(want, (cells[live], tags[live]), 1)
        pair = np.zeros((3, 3))
        both = live[:, 1:]
        np.add.at(pair, (tags[:, :-1][both], tags[:, 1:][both]), 1)
        m = [np.zeros_like(self.weights), np.zeros_like(self.step)]
        s = [np.zeros_like(self.weights), np.zeros_like(self.step)]
        for k in range(1, rounds + 1):
            e = (design @ self.weights)[cells]
            a = np.zeros((t, n, 3))
            a[0] = e[:, 0] + self.step[0][None]
            for i in range(1, t):
                x = a[i - 1][:, :, None] + self.step[None]
                top = x.max(axis=1)
                nxt = top + np.log(np.exp(x - top[:, None]).sum(axis=1)) + e[:, i]
                a[i] = np.where(live[:, i, None], nxt, a[i - 1])
            b = np.zeros((t, n, 3))
            pairs = np.zeros((3, 3))
            top = a[-1].max(axis=1)
            z = top + np.log(np.exp(a[-1] - top[:, None]).sum(axis=1))
            for i in range(t - 2, -1, -1):
                x = self.step[None] + (e[:, i + 1] + b[i + 1])[:, None, :]
                top = x.max(axis=2)
                b[i] = np.where(live[:, i + 1, None], top + np.log(np.exp(x - top[:, :, None]).sum(axis=2)), b[i + 1])
                p = np.exp(a[i][:, :, None] + x - z[:, None, None])
                pairs += p[live[:, i + 1]].sum(axis=0)
            p = np.exp(a + b - z[None, :, None]).transpose(1, 0, 2)
            got = np.zeros((CELLS, 3))
            for j in range(3):
                got[:, j] = np.bincount(cells[live], weights=p[live][:, j], minlength=CELLS)
            grads = [design.T @ (want - got) * weight * 50 - 1e-3 * self.weights, (pair - pairs) * weight * 50 - 1e-3 * self.step]
            for j, (g, v) in enumerate(zip(grads, (self.weights, self.step), strict=True)):
                m[j] += 0.1 * (g - m[j])
                s[j] += 0.01 * (g * g - s[j])
                v += 0.15 * (m[j] / (1 - 0.9**k)) / (np.sqrt(s[j] / (1 - 0.99**k)) + 1e-8)
        self._finish()
        return self

    def decode(self, cell: np.ndarray, off: np.ndarray) -> list[tuple[int, int]]:
        """Runs ``(first, last + 1)`` of tokens on the best path that are tagged as one secret."""
        doubt = np.flatnonzero(~self.certain[cell])
        if not len(doubt):
            return []
        owner = np.searchsorted(off, doubt, "right")
        new = np.flatnonzero(np.concatenate([[True], (np.diff(doubt) > 1) | (np.diff(owner) > 0)]))
        out = []
        for a, z in zip(new.tolist(), [*new[1:].tolist(), len(doubt)], strict=True):
            i, j = int(doubt[a]), int(doubt[z - 1]) + 1
            out += [(i + x, i + y) for x, y in self._best(self.table[cell[i:j]])]
        return out

    def _best(self, e: np.ndarray) -> list[tuple[int, int]]:
        """Viterbi between two certain outsides (or a text's ends)."""
        step, back = self.step, []
        v = step[0] + e[0]
        for row in e[1:]:
            x = v[:, None] + step
            back.append(x.argmax(axis=0))
            v = x.max(axis=0) + row
        tag = int((v + step[:, 0]).argmax())
        tags = [tag]
        for b in reversed(back):
            tag = int(b[tag])
            tags.append(tag)
        tags.reverse()
        out: list[tuple[int, int]] = []
        for i, x in enumerate(tags):
            if x == 1 or x == 2 and not (i and tags[i - 1]):
                out.append((i, i + 1))
            elif x == 2:
                out[-1] = (out[-1][0], i + 1)
        return out


def _shapes(r: np.random.Generator, n: int = 300) -> np.ndarray:
    """Cells of made-up keys: random characters of several alphabets and lengths."""
    plain = "0123456789abcdefghijklmnopqrstuvwxyz"
    made = []
    for alphabet in (plain, plain + plain[10:].upper(), plain + plain[10:].upper() + "_-", plain[:10] + plain[10:].upper()):
        made += ["".join(r.choice(list(alphabet), int(r.integers(16, 45)))) for _ in range(n // 4)]
    block = next(V.blocks(pa.array(made)))
    _, _, cell, off = tokens(block)
    return cell[off[:-1]]


def _examples(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token sequences round base matches, and as many without any."""
    cells, tags, r = [], [], np.random.default_rng(9)
    shapes = _shapes(r)
    for text in texts:
        start, end, cell, _ = tokens(next(V.blocks(pa.array([text]))))
        if not len(start):
            continue
        tag = np.zeros(len(start), np.int64)
        for a, z, kind in base_spans(text):
            if kind == "assign":  # the value, not the word in front of it
                a = z - len(ASSIGN.match(text[a:z])[2])
            lo, hi = len(text[:a].encode()), len(text[:z].encode())
            hit = np.flatnonzero((start >= lo) & (end <= hi))
            tag[hit] = 2
            tag[hit[:1]] = 1
        at = np.flatnonzero(tag == 1)
        middle = int(r.choice(at)) if len(at) else int(r.integers(len(start)))
        a = max(0, middle - CONTEXT // 2)
        part = slice(a, a + CONTEXT)
        c = cell[part].copy()
        if len(at) and r.random() < 0.5:  # without the word that announces it
            x = np.array(np.unravel_index(c, _SIZES))
            x[6] = 0
            c = np.ravel_multi_index(tuple(x), _SIZES)
        if len(at) and r.random() < 0.6:  # of another shape: what other services hand out
            own = np.array(np.unravel_index(c, _SIZES))
            own[:5, tag[part] > 0] = np.array(np.unravel_index(r.choice(shapes), _SIZES))[:5, None]
            c = np.ravel_multi_index(tuple(own), _SIZES)
        cells.append(c), tags.append(tag[part])
    n = np.array([len(c) for c in cells], np.int64)
    out = np.zeros((2, len(cells), CONTEXT), np.int64)
    for i, (c, t) in enumerate(zip(cells, tags, strict=True)):
        out[0, i, : len(c)], out[1, i, : len(t)] = c, t
    return out[0], out[1], n


def learn(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """Fit on up to ``sample`` documents with a base match (by a hash of the id) and a third as many others.

    Only texts of up to ``SAMPLE_TEXT`` bytes are learned from.  One pass over the texts
    marks the ids; of those, each partition hands on its first ones only.
    """
    rows = docs.filter(F.octet_length("text") <= SAMPLE_TEXT).select("doc_id", "text")
    hit = F.col("text").rlike(r"(?i)(password|passwd|secret|token|api_?key)[\"']? *[:=]") | F.col("text").contains("AKIA") | F.col("text").rlike("[0-9a-f]{16}")
    order = [F.xxhash64("doc_id", F.lit(3)), F.col("doc_id")]
    marked = stored(rows.select("doc_id", hit.alias("hit")))
    first = lambda which, n: marked.filter(which).orderBy(*order).limit(n).select("doc_id")
    ids = first("hit", sample).union(first("not hit", sample // 3)).distinct()
    picked = rows.join(F.broadcast(ids), "doc_id").orderBy(*order, "text").limit(2 * sample).collect()  # `ids` has 4/3 `sample` rows at most
    return Field().fit(*_examples([r.text for r in sorted(picked, key=lambda r: (r.doc_id, r.text))]))


def _scan(data: bytes, low: bytes, off: list[int]) -> set[int]:
    """Rows that may hold a base match of the first two kinds."""
    found = set()
    at = 0
    for word, where in [*((k, low) for k in KEYWORDS), (b"AKIA", data)]:
        at = where.find(word)
        while at >= 0:
            row = int(np.searchsorted(off, at, "right")) - 1
            found.add(row)
            at = where.find(word, off[row + 1])
    return found


_HEX = np.zeros(256, bool)
_HEX[[*range(48, 58), *range(97, 103)]] = True


def _long_hex(block: V.Block) -> set[int]:
    x = _HEX[block.data]
    for shift in (1, 2, 4, 8):  # runs of 2, 4, 8, 16
        x = x[:-shift] & x[shift:] if len(x) > shift else x[:0]
    return set((np.searchsorted(block.off, np.flatnonzero(x), "right") - 1).tolist())


def find(block: V.Block, field: Field) -> list[list[tuple[int, int, str]]]:
    """All spans of each text, in code points; the field's spans come without those inside a base span."""
    raw = block.data.tobytes()
    off = block.off.tolist()
    base = _scan(raw, raw.lower(), block.off) | _long_hex(block)
    start, end, cell, to = tokens(block)
    runs = field.decode(cell, to)
    row = np.searchsorted(to, [a for a, _ in runs], "right") - 1
    out: list[list[tuple[int, int, str]]] = [[] for _ in range(len(off) - 1)]
    for i in base:
        out[i] = base_spans(raw[off[i] : off[i + 1]].decode())
    for i, (a, z) in zip(row.tolist(), runs, strict=True):
        at = off[i]
        lo = len(raw[at : start[a]].decode(errors="ignore"))
        hi = lo + len(raw[start[a] : end[z - 1]].decode(errors="ignore"))
        if not any(x <= lo and hi <= y for x, y, k in out[i] if k != "crf"):
            out[i].append((lo, hi, "crf"))
    return out


def scan(docs: DataFrame, field: Field) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of every text; null reads as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(field)  # of fixed size

    def run(batches):
        model = shared.value
        for batch in batches:
            cols = [[] for _ in range(5)]
            for block in V.blocks(batch.column(1)):
                for spans in find(block, model):
                    own = [s for s in spans if s[2] != "crf"]
                    for c, kind in zip(cols, KINDS[:3], strict=False):
                        c.append(sum(s[2] == kind for s in own))
                    cols[3].append(hashlib.sha256(joined(own).encode()).hexdigest())
                    cols[4].append(joined(spans))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return texts_of(docs).mapInArrow(V.lean(run), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, field: Field, mark: str = "[secret]") -> DataFrame:
    """The input's rows and columns, each secret in ``text`` replaced by ``mark``; null texts stay null."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    place = docs.columns.index("text")

    def run(batches):
        model = shared.value
        for batch in batches:
            column = batch.column(place)
            out = column.to_pylist()
            for block in V.blocks(column):
                for i, spans in enumerate(find(block, model), block.lo):
                    text, merged = out[i], []
                    for a, z, _ in sorted(spans):  # overlapping spans become one
                        if merged and a < merged[-1][1]:
                            merged[-1][1] = max(z, merged[-1][1])
                        else:
                            merged.append([a, z])
                    for a, z in reversed(merged):
                        text = text[:a] + mark + text[z:]
                    out[i] = text
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if j == place else c for j, c in enumerate(batch.columns)], names=batch.schema.names)

    return mapped(docs, run)
