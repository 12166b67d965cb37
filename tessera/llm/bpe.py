"""Byte-level BPE: exact encoding by backtracking, decoding by an offset table.

A piece (what the pre-tokenizer's pattern cuts out) is covered from the left by
its longest token match, found by one Aho-Corasick pass.  A token may follow
another only if BPE, run on their joined bytes, gives back just these two; that
compatibility is worked out from the merges and remembered.  Where no token
fits, the last one is shortened, and a position that led nowhere is not tried
again, so the work is linear in the piece.  Pieces are remembered in a table of
bounded size.

The vocabulary is a tokenizer file of the ``tokenizers`` library with a
byte-level pre-tokenizer; special tokens inside a text are recognised as the
library does.  Null texts read as empty; equal texts have equal ids.  A text of any
length is one row of a task, which needs some 40 bytes of memory a byte of it.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
import sys
import unicodedata
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers.pre_tokenizers import ByteLevel

from tessera.llm import textvec as V
from tessera.llm.common import texts_of

VOCABULARY = "byte_bpe_50k.json"
REMEMBERED = 200_000


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_OTHER, _LETTER, _NUMBER, _SPACE = range(4)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Each code point's class for the pre-tokenizer: other, letter, number or white space."""
    every = "".join(chr(c) if not 0xD800 <= c <= 0xDFFF else "!" for c in range(sys.maxunicode + 1))
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    for kind, what in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(what, every):
            out[m.start() : m.end()] = kind
    # Characters newer than Python's tables: the library says how its own Unicode version sees them.
    split = ByteLevel(add_prefix_space=False).pre_tokenize_str
    for c in np.flatnonzero(out).tolist():
        if unicodedata.category(chr(c)) == "Cn" and len(split(("a" if out[c] == _LETTER else "1") + chr(c))) > 1:
            out[c] = _OTHER
    return out


def piece_starts(cps: np.ndarray, doc_start: np.ndarray) -> np.ndarray:
    """Where the pieces of ``'s|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?other+|space+(?!non-space)|space+`` begin.

    ``cps`` holds the code points of several texts, which begin at ``doc_start``.
    Runs of one class are the pieces, but for three rules: a blank before a run
    joins it, the last character of white space before a run is apart from the
    rest, and an apostrophe takes the letters of a contraction.
    """
    kind = _classes()[cps]
    cut = np.ones(len(cps), bool)
    cut[1:] = kind[1:] != kind[:-1]
    own = np.zeros(len(cps), bool)
    own[doc_start] = True
    cut |= own
    after_space = np.flatnonzero(cut[1:] & ~own[1:] & (kind[:-1] == _SPACE)) + 1
    blank = cps[after_space - 1] == 32
    starts = cut.copy()
    starts[after_space - 1] = True
    starts[after_space[blank]] = False
    quote = np.flatnonzero((cps[:-1] == 39) & starts[:-1] & starts[1:] & ~own[1:] & (kind[1:] == _LETTER))
    if len(quote):
        n = len(cps)
        one, two = cps[quote + 1], cps[np.minimum(quote + 2, n - 1)]
        inside = (quote + 2 < n) & ~own[np.minimum(quote + 2, n - 1)]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = inside & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
        for which, size in ((short, 1), (long, 2)):
            at = quote[which]
            starts[at + 1] = False
            end = at + 1 + size
            starts[end[end < n]] = True
    return np.flatnonzero(starts)


def _byte_names() -> dict[str, int]:
    """The printable stand-in of each byte in the files of byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encodes and decodes with one vocabulary file.  Tokens are numbered by merge rank inside."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        named = _byte_names()
        raw = lambda name: bytes(named[c] for c in name)
        vocab = spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        singles = {named[name]: i for name, i in vocab.items() if len(name) == 1}
        rank = {bytes([b]): b for b in singles}
        tokens = [bytes([b]) for b in range(256)]
        self.split = [(b, b) for b in range(256)]
        self.pair: dict[tuple[int, int], int] = {}
        to_id = [singles.get(b, 0) for b in range(256)]
        for merge in spec["model"]["merges"]:
            left, right = (merge.split(" ") if isinstance(merge, str) else merge)
            a, b = rank[raw(left)], rank[raw(right)]
            joined = tokens[a] + tokens[b]
            self.pair[a, b] = rank[joined] = len(tokens)
            self.split.append((a, b))
            tokens.append(joined)
            to_id.append(vocab[left + right])
        self.length = [len(t) for t in tokens]
        self.shorter = [next((rank[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in rank), -1) for t in tokens]
        self.matcher = ahocorasick.Automaton()
        for t, r in rank.items():
            self.matcher.add_word(t.decode("latin-1"), (r, len(t)))
        self.matcher.make_automaton()
        self.whole = {t: r for t, r in rank.items()}
        self.to_id = to_id
        self.fits: dict[int, bool] = {}
        self.special = special
        self.special_pattern = re.compile(b"|".join(re.escape(x.encode()) for x in sorted(special, key=len, reverse=True)))
        parts = {i: tokens[r] for r, i in enumerate(to_id)} | {i: s.encode() for s, i in special.items()}
        size = max(parts) + 1
        self.offsets = np.zeros(size + 1, np.int64)
        self.offsets[1:] = np.cumsum([len(parts.get(i, b"")) for i in range(size)])
        self.blob = np.frombuffer(b"".join(parts.get(i, b"") for i in range(size)), np.uint8)
        self.tokens = tokens
        self.pieces = _Pieces(lambda piece: [to_id[t] for t in self.encode_piece(piece)])

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE on the bytes of both tokens ends in just these two.

        Undoes merges from the latest on at the seam; if any pair that meets
        there has a merge earlier than the one undone, BPE would have taken it.
        """
        a, b, limit = left, right, 1 << 30
        while True:
            if self.pair.get((a, b), limit) < limit:
                return False
            if a > b and a >= 256:  # the left one was made later: undo it
                limit, a = a, self.split[a][1]
            elif b >= 256:
                limit, b = b + 1, self.split[b][0]
            elif a >= 256:
                limit, a = a, self.split[a][1]
            else:
                return True

    def encode_piece(self, piece: bytes) -> list[int]:
        one = self.whole.get(piece)
        if one is not None:
            return [one]
        length, shorter, fits = self.length, self.shorter, self.fits
        longest = [0] * len(piece)
        best = [0] * len(piece)
        for end, (token, n) in self.matcher.iter(piece.decode("latin-1")):
            start = end - n + 1
            if n > best[start]:
                best[start], longest[start] = n, token
        out: list[int] = []
        at, total = 0, len(piece)
        token, dead = longest[0], set()
        while at < total:
            last = out[-1] if out else -1
            while True:
                end = at + length[token]
                if end not in dead:
                    if last < 0:
                        break
                    key = last << 20 | token
                    ok = fits.get(key)
                    if ok is None:
                        if len(fits) >= 4 * REMEMBERED:
                            fits.clear()
                        ok = fits[key] = self.compatible(last, token)
                    if ok:
                        break
                token = shorter[token]
                if token < 0:
                    break
            if token >= 0:
                out.append(token)
                at = end
                if at < total:
                    token = longest[at]
            else:  # nothing can follow the last token here: shorten that one
                dead.add(at)
                token = out.pop()
                at -= length[token]
        return out

    def encode_block(self, block: V.Block) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, off)``: the ids of the block's texts, and where each text's begin and end."""
        raw = block.data.tobytes()
        if not any(x.encode() in raw for x in self.special):
            return self._plain(raw, block.off)
        cut, kind, first = [], [], []  # plain segments and special tokens take turns; where each text begins among them
        for a, z in zip(block.off[:-1].tolist(), block.off[1:].tolist(), strict=True):
            first.append(len(cut))
            cut.append(a)
            kind.append(0)
            for m in self.special_pattern.finditer(raw[a:z]):
                cut += [a + m.start(), a + m.end()]
                kind += [m[0].decode(), 0]
        ids, off = self._plain(raw, np.array([*cut, len(raw)]))
        parts = [np.array([self.special[x]], np.uint32) if x else ids[a:z] for x, a, z in zip(kind, off[:-1].tolist(), off[1:].tolist(), strict=True)]
        to = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        return np.concatenate(parts), to[[*first, len(parts)]]

    def encode(self, text: str) -> np.ndarray:
        """The ids of one text."""
        return self.encode_block(next(V.blocks(pa.array([text]))))[0]

    def _plain(self, raw: bytes, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cps = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        data = np.frombuffer(raw, np.uint8)
        if not len(cps):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        begin = off[:-1][np.diff(off) > 0]
        if len(cps) == len(raw):
            start = piece_starts(cps, begin)
        else:
            lead = np.flatnonzero((data & 0xC0) != 0x80)  # the byte that each code point begins at
            start = lead[piece_starts(cps, np.searchsorted(lead, begin))]
        return self.pieces.ids(data, start, np.searchsorted(start, off))

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of many ids, by the offset table."""
        start = self.offsets[ids]
        size = self.offsets[ids.astype(np.int64) + 1] - start
        to = np.cumsum(size)
        return self.blob[np.repeat(start - (to - size), size) + np.arange(to[-1] if len(to) else 0)]

    def byte_lengths(self, ids: np.ndarray) -> np.ndarray:
        return self.offsets[ids.astype(np.int64) + 1] - self.offsets[ids]


_SLOTS = 1 << 19


class _Pool:
    """Arrays of any lengths, one after another in one that grows."""

    def __init__(self, kind, size: int):
        self.data, self.start, self.n = np.zeros(size, kind), np.zeros(REMEMBERED + 1, np.int64), 0

    def add(self, values) -> None:
        a = int(self.start[self.n])
        z = a + len(values)
        if z > len(self.data):
            self.data = np.concatenate([self.data, np.zeros(max(len(self.data), len(values)), self.data.dtype)])
        self.data[a:z] = values
        self.n += 1
        self.start[self.n] = z


class _Pieces:
    """The ids of the pieces seen, found by a 64-bit hash; forgets everything when it is full.

    Each hash has a slot in either of two arrays, so that the lookup of a whole
    block is a few array operations; ``row`` keeps what has lost its slot.  The
    bytes of every piece found are compared with those remembered; one that
    only shares the hash is encoded for itself.
    """

    def __init__(self, encode_piece):
        self.encode_piece = encode_piece
        self.forget()

    def forget(self) -> None:
        self.key = np.zeros((2, _SLOTS), np.uint64)
        self.at = np.zeros((2, _SLOTS), np.int32)
        self.row: dict[int, int] = {}
        self.tokens, self.bytes = _Pool(np.uint32, 4 * REMEMBERED), _Pool(np.uint8, 8 * REMEMBERED)

    def find(self, h: np.ndarray) -> np.ndarray:
        slot = (h & np.uint64(_SLOTS - 1)).astype(np.int64)
        out = np.where(self.key[0][slot] == h, self.at[0][slot], -1)
        rest = np.flatnonzero(out < 0)
        slot = slot[rest]
        out[rest] = np.where(self.key[1][slot] == h[rest], self.at[1][slot], -1)
        return out

    def ids(self, data: np.ndarray, start: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces that begin at ``start``, and of each text's first and last."""
        end = np.append(start[1:], len(data))
        h = V.segment_hash(data, start, end)
        row = self.find(h).astype(np.int64)
        lost = np.flatnonzero(row < 0)
        extra: list[list[int]] = []  # ids of pieces that aren't remembered
        if len(lost):
            new, first, inverse = np.unique(h[lost], return_index=True, return_inverse=True)
            if len(self.row) + len(new) > REMEMBERED and self.row:
                self.forget()
                return self.ids(data, start, off)
            rows = np.full(len(new), -1, np.int64)
            known = self.row
            for i, (x, at) in enumerate(zip(new.tolist(), lost[first].tolist(), strict=True)):
                r = known.get(x)
                if r is None and len(known) < REMEMBERED:
                    piece = data[start[at] : end[at]]
                    self.tokens.add(self.encode_piece(piece.tobytes()))
                    self.bytes.add(piece)
                    r = known[x] = len(known)
                if r is not None:  # else one block holds more new pieces than are remembered
                    rows[i] = r
            keep = rows >= 0
            slot = (new & np.uint64(_SLOTS - 1)).astype(np.int64)
            taken = (self.key[0][slot] != 0).astype(np.int64)
            self.key[taken[keep], slot[keep]] = new[keep]
            self.at[taken[keep], slot[keep]] = rows[keep]
            row[lost] = rows[inverse]
        size = end - start
        there = np.flatnonzero(row >= 0)
        begin = self.bytes.start[row[there]]
        same = self.bytes.start[row[there] + 1] - begin == size[there]
        same[same] = V.equal_segments(data, start[there[same]], self.bytes.data[: self.bytes.start[self.bytes.n]], begin[same], size[there[same]])
        row[there[~same]] = -1
        alone = np.flatnonzero(row < 0)
        begin, pool = self.tokens.start[: self.tokens.n + 1], self.tokens.data
        if len(alone):
            extra = [self.encode_piece(data[start[i] : end[i]].tobytes()) for i in alone.tolist()]
            pool = np.concatenate([pool[: begin[-1]], np.array(list(itertools.chain.from_iterable(extra)), np.uint32)])
            row[alone] = self.tokens.n + np.arange(len(extra))
            begin = np.concatenate([begin, begin[-1] + np.cumsum([len(x) for x in extra])])
        a = begin[row]
        n = begin[row + 1] - a
        to = np.concatenate([[0], np.cumsum(n)])
        return pool[np.repeat(a - to[:-1], n) + np.arange(to[-1])], to[off]


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _round_trip(path: str):
    def run(batches):
        c = codec(path)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for block in V.blocks(batch.column(1)):
                ids, off = c.encode_block(block)
                back = c.decode(ids).tobytes()
                to = np.concatenate([[0], np.cumsum(c.byte_lengths(ids))])[off].tolist()
                n += np.diff(off).tolist()
                raw = ids.tobytes()
                ids_sha += [hashlib.sha256(raw[4 * a : 4 * z]).hexdigest() for a, z in itertools.pairwise(off.tolist())]
                text_sha += [hashlib.sha256(_readable(back[a:z])).hexdigest() for a, z in itertools.pairwise(to)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _readable(data: bytes) -> bytes:
    try:
        data.decode()
    except UnicodeDecodeError:
        return data.decode(errors="replace").encode()
    return data


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``; null texts read as empty (no ids)."""
    return texts_of(docs).mapInArrow(V.lean(_round_trip(path or vocabulary_path())), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, ids``: the ids of every text; none for empty and null texts."""
    path = path or vocabulary_path()

    def run(batches):
        c = codec(path)
        for batch in batches:
            ids = [c.encode(x or "").astype(np.int32) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return texts_of(docs).mapInArrow(V.lean(run), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, text`` of ``doc_id, ids``; null ids read as none, broken UTF-8 is replaced."""
    path = path or vocabulary_path()

    def run(batches):
        c = codec(path)
        for batch in batches:
            text = [c.decode(np.array(x or [], np.uint32)).tobytes().decode(errors="replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", F.col("ids").cast("array<int>").alias("ids")).mapInArrow(V.lean(run), "doc_id long, text string")
