"""SentencePiece (merge type) encoding with seeded merge-dropout, and decoding.

The vocabulary is read from a ``.model`` file whose path is a parameter; nothing is
trained. A text becomes spaces turned to U+2581 with one in front; a piece never has
a space mark behind another letter, so the chunks between such places are encoded on
their own. In a chunk the agenda holds every adjacent pair whose join is a piece and
takes the best score first, leftmost on ties. With ``dropout`` p each candidate merge
is skipped for good if the keyed hash of (seed, text key, chunk place, span of the
candidate) falls below p, so a seed gives one varied segmentation and the same one
after any retry. Letters outside the vocabulary become byte pieces; a literal U+2581
of the text is one of them, so decoding is exact.

Chunks of a batch are encoded together as matrices, one merge a chunk and round;
chunks over LONG letters use a heap. Both give the same pieces.

Results by case: null gives a null list, an empty text an empty list; the keyed hash
uses the id, so repeated rows are segmented alike (a null id counts as 0); empty
tables give empty results; very long texts are encoded whole; only the id and text
columns are read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import encode_slices, map_rows

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
LONG = 48
_NO_RANK = np.int32(2**31 - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class MergeTable:
    """Finds the piece that two pieces make: open addressing over pairs. ``size`` is one more than the largest id."""

    size: int

    def _fill(self, left: np.ndarray, right: np.ndarray, made: np.ndarray) -> None:
        """Open addressing with linear probes; the table is a quarter full."""
        bits = max(8, int(len(left) * 4).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys, self.made = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        mask, self.probes = (1 << bits) - 1, 1
        for key, slot, piece in zip((left * self.size + right).tolist(), self._slot(left * self.size + right).tolist(), made.tolist(), strict=True):
            n = 1
            while self.keys[slot] >= 0:
                slot, n = (slot + 1) & mask, n + 1
            self.keys[slot], self.made[slot] = key, piece
            self.probes = max(self.probes, n)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def merge(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that joins two pieces, -1 where there is none."""
        key = left.astype(np.int64) * self.size + right
        key[(left < 0) | (right < 0)] = -2
        slot = self._slot(key)
        found = np.full(key.shape, -1, np.int32)
        mask = len(self.keys) - 1
        open_ = None
        for _ in range(self.probes):
            if open_ is None:
                at = self.keys[slot]
                hit = at == key
                found[hit] = self.made[slot[hit]]
                open_ = np.flatnonzero(~hit & (at >= 0) & (key >= 0))
                flat_key, flat_found = key[open_], found
                slot = slot[open_]
            else:
                slot = (slot + 1) & mask
                at = self.keys[slot]
                hit = at == flat_key
                flat_found[open_[hit]] = self.made[slot[hit]]
                go = ~hit & (at >= 0)
                open_, slot, flat_key = open_[go], slot[go], flat_key[go]
            if not len(open_):
                break
        return found

class Vocabulary(MergeTable):
    """Pieces, their ranks as merges, and the table that finds a merge of two pieces."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        if any(SPACE in pieces[i].lstrip(SPACE) or "\n" in pieces[i] for i in plain):
            raise ValueError("pieces with a space mark inside, or with line breaks, are not supported")
        self.size = size
        self.ids = {pieces[i]: i for i in plain}
        self.byte = np.zeros(256, np.int32)
        self.surface = [b""] * size
        for i in range(size):
            if sp.is_byte(i):
                self.byte[int(pieces[i][3:5], 16)] = i
                self.surface[i] = bytes([int(pieces[i][3:5], 16)])
        for i in plain:
            self.surface[i] = pieces[i].replace(SPACE, " ").encode()
        scores = np.array([sp.get_score(i) for i in range(size)])
        order = np.unique(-scores[plain])  # equal scores get equal ranks
        self.rank = np.full(size, _NO_RANK, np.int32)
        self.rank[plain] = np.searchsorted(order, -scores[plain])
        left, right, made = [], [], []
        for p, i in ((pieces[i], i) for i in plain):
            for k in range(1, len(p)):
                if (a := self.ids.get(p[:k])) is not None and (b := self.ids.get(p[k:])) is not None:
                    left.append(a)
                    right.append(b)
                    made.append(i)
        self._fill(np.array(left, np.int64), np.array(right, np.int64), np.array(made, np.int32))
        self.letter = np.full(0x110000, -1, np.int32)  # code point -> piece, -1: none
        for p, i in self.ids.items():
            if len(p) == 1 and p != SPACE:
                self.letter[ord(p)] = i
        self.letter[32] = self.ids[SPACE]


def _dropped(key: np.ndarray, start: np.ndarray, end: np.ndarray, limit: int) -> np.ndarray:
    span = start.astype(np.uint64) << np.uint64(32) | end.astype(np.uint64)
    return _mix(key ^ span * np.uint64(0x9E3779B97F4A7C15)) < np.uint64(limit)


_ALL = (1 << 64) - 1


def _dropped_one(key: int, start: int, end: int, limit: int) -> bool:
    """``_dropped`` of one span, in plain numbers."""
    x = key ^ ((start << 32 | end) * 0x9E3779B97F4A7C15 & _ALL)
    x = (x ^ x >> 33) * 0xFF51AFD7ED558CCD & _ALL
    x = (x ^ x >> 33) * 0xC4CEB9FE1A85EC53 & _ALL
    return (x ^ x >> 33) < limit


def agenda(v: Vocabulary, letters: list[int], key: int = 0, limit: int = 0) -> list[tuple[int, int, int]]:
    """Encode one chunk with a heap: (piece or -1, start, end) in letters."""
    n = len(letters)
    sym, end, nxt, prv = list(letters), list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, int, int]] = []
    known: dict[tuple[int, int], int] = {}

    def join(a: int, b: int) -> int:
        """The piece that joins two pieces; an unspaced text meets few different pairs."""
        if (a, b) not in known:
            known[a, b] = int(v.merge(np.array([a]), np.array([b]))[0])
        return known[a, b]

    def offer(i: int) -> None:
        j = nxt[i]
        if j >= n or sym[i] < 0 or sym[j] < 0:
            return
        made = join(sym[i], sym[j])
        if made >= 0 and not (limit and _dropped_one(key, i, end[j], limit)):
            heapq.heappush(heap, (int(v.rank[made]), i, end[j], made))

    # the first pairs all at once
    left, right, at = np.array(letters[:-1], np.int64), np.array(letters[1:], np.int64), np.arange(n - 1)
    pairs = v.merge(left, right)
    take = pairs >= 0
    if limit:
        take &= ~_dropped(np.full(n - 1, key, np.uint64), at, at + 2, limit)
    heap = list(zip(v.rank[pairs[take]].tolist(), at[take].tolist(), (at[take] + 2).tolist(), pairs[take].tolist(), strict=True))
    heapq.heapify(heap)
    gone = [False] * n
    while heap:
        _, i, stop, made = heapq.heappop(heap)
        j = nxt[i]
        if gone[i] or j >= n or end[j] != stop or join(sym[i], sym[j]) != made:
            continue
        sym[i], end[i], nxt[i], gone[j] = made, stop, nxt[j], True
        if nxt[i] < n:
            prv[nxt[i]] = i
        if prv[i] >= 0:
            offer(prv[i])
        offer(i)
    out, i = [], 0
    while i < n:
        out.append((sym[i], i, end[i]))
        i = nxt[i]
    return out


def encode_block(v: Vocabulary, sym: np.ndarray, key: np.ndarray, limit: int) -> np.ndarray:
    """Encode chunks of one length together.

    ``sym`` [chunks, length] has the letters' pieces (-1: none). Returns the pieces
    at their first letters, -2 at the letters they swallowed.

    The agenda of a chunk is a column of (rank, place) codes, whose minimum is the
    next merge; symbols are linked lists, so a merge touches a few cells.
    """
    n, width = sym.shape
    out = np.full((n, width), -2, np.int32)
    if width < 2:
        return sym.astype(np.int32)
    none = np.int64(1 << 62)
    s = np.full((width + 1, n), -1, np.int32)  # row ``width`` stands for "no neighbour"
    s[:width] = sym.T
    place = np.arange(width + 1, dtype=np.int32)[:, None]
    after = np.repeat(np.minimum(place + 1, width), n, 1)
    before = np.repeat(np.where(place > 0, place - 1, width).astype(np.int32), n, 1)
    row, key = np.arange(n), key.copy()

    def code(left: np.ndarray, right: np.ndarray, at: np.ndarray, end: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        made = v.merge(left, right)
        rank = np.full(len(made), none)
        hit = np.flatnonzero(made >= 0)
        if limit and len(hit):
            hit = hit[~_dropped(k[hit], at[hit], end[hit], limit)]
        rank[hit] = v.rank[made[hit]].astype(np.int64) << 6 | at[hit]
        return made, rank

    at = np.repeat(np.arange(width - 1), n)
    made = np.full((width + 1, n), -1, np.int32)
    codes = np.full((width + 1, n), none)
    m, c = code(s[: width - 1].ravel(), s[1:width].ravel(), at, at + 2, np.tile(key, width - 1))
    made[: width - 1], codes[: width - 1] = m.reshape(-1, n), c.reshape(-1, n)
    while True:
        best = codes.min(0)
        live = best != none
        r = np.flatnonzero(live)
        if len(r) * 2 < len(row):  # write out what is done, go on with the rest
            done = ~live
            out[row[done]] = s[:width, done].T
            if not len(r):
                return out
            row, key, best = row[r], key[r], best[r]
            s, after, before, made, codes = (np.ascontiguousarray(x[:, r]) for x in (s, after, before, made, codes))
            r = np.arange(len(row))
        i = best[r] & 63
        j = after[i, r]
        k = after[j, r]
        piece = made[i, r]
        h = before[i, r]
        s[i, r], s[j, r] = piece, -2
        after[i, r], before[k, r] = k, i
        codes[j, r] = none
        both = np.concatenate
        m, c = code(both([piece, s[h, r]]), both([s[k, r], piece]), both([i, h]), both([after[k, r], k]), both([key[r], key[r]]))
        made[i, r], codes[i, r] = m[: len(r)], c[: len(r)]
        made[h, r], codes[h, r] = m[len(r) :], c[len(r) :]
        s[width], codes[width] = -1, none


class Encoder:
    """Encode batches of texts; ``dropout`` 0 is the plain segmentation."""

    def __init__(self, path: str = MODEL, dropout: float = 0.0, seed: int = 0):
        self.v, self.seed = Vocabulary(path), seed
        self.limit = int(dropout * 2.0**64) if dropout < 1 else 2**64 - 1

    def keys(self, docs: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Hash keys of chunks, from the ids of their texts and their places there."""
        k = _mix(np.array([self.seed & (2**64 - 1)], np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        return _mix(_mix(k ^ docs) ^ places.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def encode(self, texts: list[str], docs: list[int]) -> list[np.ndarray]:
        """Piece ids of each text."""
        whole = [" " + t if t else "" for t in texts]
        counts = np.array([len(t) for t in whole], np.int64)
        code = np.frombuffer("".join(whole).encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(code):
            return [np.zeros(0, np.int32) for _ in texts]
        first = (np.cumsum(counts) - counts)[counts > 0]
        space, line = code == 32, code == 10
        cut = line.copy()
        cut[1:] |= line[:-1] | (space[1:] & ~space[:-1])
        cut[first] = True
        start = np.flatnonzero(cut)
        if self.limit:
            owner = np.searchsorted(first, start, "right") - 1
            doc = np.array(docs, np.int64)[counts > 0].view(np.uint64)
            key = self.keys(doc[owner], np.arange(len(start)) - np.searchsorted(start, first)[owner])
        else:
            key = np.zeros(len(start), np.uint64)
        size = np.diff(start, append=len(code))
        letters = self.v.letter[code]
        out = np.full(len(code), -2, np.int32)
        for n in np.unique(size[size <= LONG]):
            at = np.flatnonzero(size == n)
            place = start[at][:, None] + np.arange(n)[None, :]
            sym = letters[place]
            if not self.limit:  # equal chunks have equal pieces
                sym, back = np.unique(sym, axis=0, return_inverse=True)
                done = encode_block(self.v, sym, np.zeros(len(sym), np.uint64), 0)
                out[place] = done[back.ravel()]
            else:
                out[place] = encode_block(self.v, sym, key[at], self.limit)
        for i in np.flatnonzero(size > LONG):
            s = start[i]
            for piece, a, _ in agenda(self.v, letters[s : s + size[i]].tolist(), int(key[i]), self.limit):
                out[s + a] = piece
        result, pos = [], 0
        for n in counts.tolist():
            ids, c = out[pos : pos + n], code[pos : pos + n]
            pos += n
            result.append(self._with_bytes(ids, c))
        return result

    def _with_bytes(self, ids: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Leave out swallowed letters; letters without a piece become byte pieces."""
        lone = np.flatnonzero(ids == -1)
        if not len(lone):
            return ids[ids >= 0]
        parts, pos = [], 0
        for i in lone.tolist():
            parts.append(ids[pos:i])
            parts.append(self.v.byte[np.frombuffer(chr(code[i]).encode("utf-8", "surrogatepass"), np.uint8)])
            pos = i + 1
        ids = np.concatenate([*parts, ids[pos:]])
        return ids[ids >= 0]

    def decode(self, ids) -> str:
        surface = self.v.surface
        return b"".join([surface[i] for i in ids])[1:].decode("utf-8", "surrogatepass")


_ENCODERS: dict[tuple, Encoder] = {}


def _encoder(path: str, dropout: float, seed: int) -> Encoder:
    key = (path, dropout, seed)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, dropout, seed)
    return _ENCODERS[key]


def encode_pieces(docs: DataFrame, model_path: str = MODEL, dropout: float = 0.1, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, token_ids, n_tokens, lossless (decoding gives the text again)."""

    def fn(batch: pa.RecordBatch):
        enc = _encoder(model_path, dropout, seed)
        ids_of = [x or 0 for x in batch.column(0).to_pylist()]
        for at, group in encode_slices(batch.column(1).to_pylist()):
            texts = [g.decode("utf-8", "surrogatepass") for g in group]
            ids = enc.encode(texts, ids_of[at : at + len(group)])
            ok = [enc.decode(i.tolist()) == t for i, t in zip(ids, texts, strict=True)]
            part = batch.slice(at, len(group))
            sizes = np.array([len(i) for i in ids], np.int64)
            null = np.asarray(pc.is_null(part.column(1)))
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), mask=np.append(null, False)),
                pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32()),
            )
            yield pa.RecordBatch.from_arrays(
                [part.column(0), lists, pa.array(sizes, mask=null), pa.array(ok, pa.bool_(), mask=null)],
                ["doc_id", "token_ids", "n_tokens", "lossless"],
            )

    return map_rows(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")),
        "doc_id long, token_ids array<int>, n_tokens long, lossless boolean",
        fn,
    )


def decode_pieces(encoded: DataFrame, model_path: str = MODEL, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """One row per input row: doc_id, text. A null list gives a null text."""

    def fn(batch: pa.RecordBatch):
        enc = _encoder(model_path, 0.0, 0)
        texts = [None if i is None else enc.decode(i) for i in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return map_rows(encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")), "doc_id long, text string", fn)
