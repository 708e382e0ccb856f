"""Secret scan: a worklist unwraps nested encodings and rescans every layer.

Results by case: a null or empty text has no findings; a row with a null id is
scanned like any other; repeated rows give repeated results; an empty table gives
an empty result; only the id and text columns are read, so clashing extra
columns do no harm. Very long texts are scanned whole. Equal spans of one kind
are reported once.

Percent codes, Unicode and octal escapes, base64 (binary contents too), UTF-16 and compressed streams (all
members) are opened, one layer at a time and to the bottom, so a text holds as many layers as they
are nested. ``max_layer_bytes`` is a safety bound on one layer, and all layers of a text together may
have ``TEXT_LAYERS`` times that and ``TEXT_TIMES`` times the text (compression bombs); a layer beyond
is not opened. Its span is counted in ``n_refused``, and redaction masks it, as it may hold anything.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import map_rows

KINDS = ("assign", "access", "hex")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 8, 16, 32

_ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_PERCENT = re.compile(rb"%[0-9A-Fa-f]{2}")
_UNICODE = re.compile(rb"\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\[ux]\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2}|\\[0-3][0-7]{2}|&#x[0-9A-Fa-f]{1,6};|&#[0-9]{1,7};")
_PLAIN_BASE64 = re.compile(rb"[A-Za-z0-9+/]{19,}")
#: Base64 letters over several lines, and the breaks between them.
_WRAPPED = re.compile(rb"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++)++")
_BREAK = re.compile(rb"[ \t]*+\r?\n[ \t]*+")
_JOINER = re.compile(rb"[+/]")
#: What ``_is_text`` takes, from a place on.
_TEXT = re.compile(
    rb"(?:[\x09-\x0d\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
    rb"|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})*+"
)
#: The shortest finding has 14 bytes, which is 19 base64 characters.
MIN_BASE64 = 19
MAX_LAYER_BYTES = 1 << 26
TEXT_LAYERS, TEXT_TIMES = 4, 16
#: Runs of a longer layer are found by a pattern, which is slower and takes no memory.
_LONG_LAYER = 1 << 22

_HEX_CLASS = np.zeros(256, bool)
_HEX_CLASS[list(b"0123456789abcdef")] = True
_B64_CLASS = np.zeros(256, bool)
_B64_CLASS[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_")] = True


_RUNS = {MIN_HEX: re.compile(rb"[0-9a-f]{%d,}" % MIN_HEX), MIN_BASE64: re.compile(rb"[A-Za-z0-9+/_-]{%d,}" % MIN_BASE64)}


def _runs(raw: bytes, codes: np.ndarray, cls: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes of a class, at least ``least`` long."""
    if len(raw) < least:
        return []
    if len(raw) > _LONG_LAYER:
        return [m.span() for m in _RUNS[least].finditer(raw)]
    edge = np.flatnonzero(np.diff(cls[codes].view(np.int8), prepend=0, append=0))
    start, end = edge[::2], edge[1::2]
    keep = end - start >= least
    return list(zip(start[keep].tolist(), end[keep].tolist(), strict=True))


def scan_layer(raw: bytes, codes: np.ndarray | None = None) -> list[tuple[int, int, str]]:
    """Findings of one layer as (start, end, kind) byte offsets."""
    found = []
    low = raw.lower()
    at = set()
    for word in _KEYWORDS:
        i = low.find(word)
        while i >= 0:
            at.add(i)
            i = low.find(word, i + 1)
    pos = 0
    for i in sorted(at):
        if i >= pos and (m := _ASSIGN.match(raw, i)):
            pos = m.end()
            if m.end(1) - m.start(1) >= MIN_ASSIGN:
                found.append((i, pos, "assign"))
    found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(raw) if m.end() - m.start() >= MIN_ACCESS]
    codes = np.frombuffer(raw, np.uint8) if codes is None else codes
    return found + [(s, e, "hex") for s, e in _runs(raw, codes, _HEX_CLASS, MIN_HEX)]


def _decompressor(raw: bytes, at: int):
    """A decompressor for the stream that starts at a place; None if none does."""
    if raw[at : at + 2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if len(raw) - at > 5 and raw[at] == 0x78 and (raw[at] * 256 + raw[at + 1]) % 31 == 0:
        return zlib.decompressobj(15)
    if raw[at : at + 3] == b"BZh":
        return bz2.BZ2Decompressor()
    if raw[at : at + 6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    return None


def _inflate(raw: bytes, limit: int, at: int = 0) -> tuple[bytes | None, bool, int]:
    """(content, refused, end) of the compressed members that start at a place; (None, False, at) if there are none.

    Members are fed in steps that grow, so what is left of a step behind a short member is short too.
    """
    members, size, end = [], 0, at
    while (unzip := _decompressor(raw, at)) is not None:
        parts, step = [], 1024
        try:
            while at < len(raw) and not unzip.eof:
                chunk = raw[at : at + step]
                at, step = at + len(chunk), min(2 * step, 1 << 20)
                parts.append(unzip.decompress(chunk, limit + 1 - size))
                size += len(parts[-1])
                if size > limit:
                    return None, True, at
        except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError):
            break
        members += parts
        at -= len(unzip.unused_data)
        end = at
        if not unzip.eof:
            break
        while at < len(raw) and raw[at] == 0:  # padding between members
            at += 1
    return (b"".join(members) if members else None), False, end


def _is_text(raw: bytes) -> bool:
    if not raw or raw.translate(None, b"\x00\x01\x02\x03\x04\x05\x06\x07\x08\x0e\x0f\x10\x11\x12\x13\x14\x15\x16\x17\x18\x19\x1a\x1b\x1c\x1d\x1e\x1f\x7f") != raw:
        return False
    try:
        raw.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


class _Rewrite:
    """Offsets of a layer made by replacing pieces of its parent one by one."""

    def __init__(self, base: int, pieces: list[tuple[int, int, bytes]], raw: bytes):
        parts, self.out, self.src, pos, size = [], [0], [base], 0, 0
        for start, end, new in pieces:
            parts += [raw[pos:start], new]
            size += start - pos
            self.out += [size, size + len(new)]
            self.src += [base + start, base + end]
            size, pos = size + len(new), end
        parts.append(raw[pos:])
        self.data = b"".join(parts)

    def __call__(self, start: int, end: int) -> tuple[int, int]:
        return self._at(start, False), self._at(end, True)

    def _at(self, x: int, is_end: bool) -> int:
        i = bisect_right(self.out, x) - 1 if not is_end else max(0, bisect_right(self.out, x - 1) - 1)
        if i % 2 == 0:  # copied text
            return self.src[i] + x - self.out[i]
        return self.src[i + 1] if is_end else self.src[i]


def _base64_runs(raw: bytes, codes: np.ndarray):
    """Runs of base64 letters; one with - or _ may also be joined words, so its parts are tried too."""
    for start, end in _runs(raw, codes, _B64_CLASS, MIN_BASE64):
        yield start, end
        parts = [m.span() for m in _PLAIN_BASE64.finditer(raw, start, end)]
        if len(parts) > 1 or parts and parts[0] != (start, end):
            yield from parts


def _standard(letters: bytes) -> bytes:
    return letters.replace(b"-", b"+").replace(b"_", b"/")


def _decode(letters: bytes) -> bytes:
    cut = len(letters) - (len(letters) % 4 == 1)
    return base64.b64decode(letters[:cut] + b"=" * (-cut % 4))


def _base64_parts(letters: bytes, joints: list[int], limit: int):
    """Contents of base64 inside joined letters: (content, start, end, is a stream), None as content where refused.

    A part starts at a joint or behind a + or / and ends at a joint or beside a + or /. Each of the
    four phases is decoded once, and a part is a piece of its phase.
    """
    n = len(letters)
    at = [m.start() for m in _JOINER.finditer(letters)]
    starts = sorted({0, *joints, *(i + 1 for i in at)})
    ends = sorted({0, n, *joints, *at, *(i + 1 for i in at)})
    for phase in range(4):
        own = [s for s in starts if s % 4 == phase and n - s >= MIN_BASE64]
        if not own:
            continue
        data, text_to, stream_to, first = _decode(letters[phase:]), 0, 0, own[0]
        for s in own:
            off = (s - phase) // 4 * 3
            if s >= stream_to and _decompressor(data, off) is not None:
                plain, no, off_end = _inflate(data, limit, off)
                if no or plain is not None:
                    stream_to = n if no else min(n, s - (off - off_end) * 4 // 3)
                    first = -1
                    yield plain, s, stream_to, True
            if s >= text_to:
                good = _TEXT.match(data, off).end() - off
                e = ends[bisect_right(ends, s + (4 * good + 3) // 3) - 1]
                if e - s >= MIN_BASE64:
                    text_to, first = e, -1
                    yield data[off : _TEXT.match(data, off, off + (e - s) * 3 // 4).end()], s, e, False
        if first > 0:  # neither text nor a stream: bytes that may hold either
            yield data[(first - phase) // 4 * 3 :], first, n, False


def _utf16(raw: bytes) -> str | None:
    """The codec of a layer that is UTF-16 for the most part of plain letters."""
    half, even, odd = len(raw) // 2, raw[::2].count(0), raw[1::2].count(0)
    if half < 7 or min(even, odd) * 4 > half:
        return None
    return "utf-16-le" if odd * 4 >= half * 3 else "utf-16-be" if even * 4 >= half * 3 else None


def _code(escape: bytes) -> int:
    """The code point that an escape (hex with or without braces, octal, HTML) stands for."""
    if escape[:1] == b"&":
        return int(escape[3:-1], 16) if escape[2:3] == b"x" else int(escape[2:-1])
    return int(escape[1:], 8) if escape[1:].isdigit() else int(escape[2:].strip(b"{}"), 16)


def _whole(start: int, end: int):
    return lambda s, e: (start, end)


def _unwrap(raw: bytes, codes: np.ndarray, room) -> Iterator[tuple[bytes | None, object]]:
    """Layers one step inside ``raw``, one by one: (content, offset map into raw), None as content where
    refused. ``room()`` is how large a layer may be just now."""
    if _PERCENT.search(raw):
        layer = _Rewrite(0, [(x.start(), x.end(), bytes([int(x[0][1:], 16)])) for x in _PERCENT.finditer(raw)], raw)
        yield layer.data, layer
    if b"\\" in raw or b"&#" in raw:
        pieces = []
        for x in _UNICODE.finditer(raw):
            code = _code(x[0])
            if code < 0x110000:
                pieces.append((x.start(), x.end(), chr(code).encode("utf-8", "surrogatepass")))
        if pieces:
            layer = _Rewrite(0, pieces, raw)
            yield layer.data, layer
    if 0 in raw and (codec := _utf16(raw)):
        text = raw.decode(codec, "replace").encode("utf-8")
        units = lambda x: len(text[:x].decode("utf-8", "ignore").encode("utf-16-le"))
        yield text, lambda s, e: (units(s), units(e))
    for start, end in _base64_runs(raw, codes):
        letters = _standard(raw[start:end])
        data = _decode(letters)
        plain, no, _ = _inflate(data, room())
        pad = _padded(raw, end)
        if plain is not None or no:
            yield plain, _whole(start, pad)
            continue
        yield data, lambda s, e, a=start, b=pad: (a + s * 4 // 3, min(b, a + -(-e * 4 // 3)))
        if not _is_text(data) and _JOINER.search(letters):
            yield from _parts(raw, [(start, end)], room)
    for m in _WRAPPED.finditer(raw):
        edges = [m.start(), *(x for b in _BREAK.finditer(raw, m.start(), m.end()) for x in b.span()), m.end()]
        lines = list(zip(edges[::2], edges[1::2], strict=True))
        if sum(e - s for s, e in lines) >= MIN_BASE64:
            yield from _parts(raw, lines, room)
    plain, no, _ = _inflate(raw, room())
    if plain is not None or no:
        yield plain, _whole(0, len(raw))


def _padded(raw: bytes, end: int) -> int:
    return end + min(2, len(raw[end : end + 2]) - len(raw[end : end + 2].lstrip(b"=")))


def _parts(raw: bytes, lines: list[tuple[int, int]], room) -> Iterator[tuple[bytes | None, object]]:
    """The layers of base64 parts in joined lines."""
    first = [0]
    for s, e in lines:
        first.append(first[-1] + e - s)
    size = first[-1]

    def back(x: int) -> int:
        i = bisect_right(first, x) - 1
        return lines[i][0] + x - first[i]

    for data, a, b, stream in _base64_parts(_standard(b"".join(raw[s:e] for s, e in lines)), first[1:-1], room()):
        end = _padded(raw, lines[-1][1]) if b == size else back(b - 1) + 1
        if stream:
            yield data, _whole(back(a), end)
        else:
            yield data, lambda s, e, a=a, b=b, y=end: (back(a + s * 4 // 3), y if a + -(-e * 4 // 3) >= b else back(a + -(-e * 4 // 3) - 1) + 1)


def scan_text(raw: bytes, limit: int = MAX_LAYER_BYTES) -> tuple[list, list, int, list]:
    """(base findings, all findings, layers opened, spans refused), byte offsets of ``raw``.

    The worklist is a stack of layers that are being unwrapped, each with the chain of offset maps
    back to the text. A layer whose content was seen before in this text is not opened again below
    the same place, so the work ends even where decoding goes in a circle.
    """
    codes = np.frombuffer(raw, np.uint8)
    base = scan_layer(raw, codes)
    found, opened, refused = set(base), 0, set()
    left = TEXT_LAYERS * limit + TEXT_TIMES * len(raw)
    room = lambda: min(limit, left)
    todo = [(_unwrap(raw, codes, room), (), frozenset([hashlib.sha256(raw).digest()]))]
    done: set[tuple[bytes, int, int]] = set()
    while todo:
        layers, chain, here = todo[-1]
        data, back = next(layers, (None, None))
        if back is None:
            todo.pop()
            continue
        maps = (back, *chain)

        def outward(s: int, e: int, maps=maps) -> tuple[int, int]:
            for f in maps:
                s, e = f(s, e)
            return s, e

        if data is None or len(data) > left:
            refused.add(outward(0, 0 if data is None else len(data)))
            continue
        key = hashlib.sha256(data).digest()
        place = (key, *outward(0, len(data)))
        if key in here or place in done:
            continue
        done.add(place)
        opened, left = opened + 1, left - len(data)
        data_codes = np.frombuffer(data, np.uint8)
        found.update((*outward(s, e), kind) for s, e, kind in scan_layer(data, data_codes))
        todo.append((_unwrap(data, data_codes, room), maps, here | {key}))
    return base, sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1])), opened, sorted(refused)


def _code_points(raw: bytes, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Byte offsets to code point offsets, counting only between the places asked for."""
    if not spans or raw.isascii():
        return spans
    at, pos, n = {}, 0, 0
    for x in sorted({y for s in spans for y in s[:2]}):
        part = np.frombuffer(raw, np.uint8, x - pos, pos)
        n += int(np.count_nonzero((part & 0xC0) != 0x80))
        at[x], pos = n, x
    return [(at[s], at[e], k) for s, e, k in spans]


_SCHEMA = (
    "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>, n_layers long, n_refused long"
)
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_layer_bytes: int = MAX_LAYER_BYTES) -> DataFrame:
    """One row per input row: doc_id, spans (code points, sorted), n_layers, n_refused."""

    def fn(batch: pa.RecordBatch):
        spans, layers, refusals = [], [], []
        for text in batch.column(1).to_pylist():
            raw = (text or "").encode("utf-8", "surrogatepass")
            base, found, opened, refused = scan_text(raw, max_layer_bytes)
            own = set(base)
            points = _code_points(raw, found)
            spans.append([{"kind": k, "start": s, "end": e, "base": f in own} for (s, e, k), f in zip(points, found, strict=True)])
            layers.append(opened)
            refusals.append(len(refused))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(spans, _SPAN_TYPE), pa.array(layers, pa.int64()), pa.array(refusals, pa.int64())],
            ["doc_id", "spans", "n_layers", "n_refused"],
        )

    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), _SCHEMA, fn)


def redact_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", max_layer_bytes: int = MAX_LAYER_BYTES) -> DataFrame:
    """The same rows and columns, with every found span of the text replaced by ``mark``.

    So is a span that was refused, as nobody has read it. Spans that overlap are replaced as one.
    A null text stays null.
    """
    fields = docs.schema
    at = docs.columns.index(text_col)

    def fn(batch: pa.RecordBatch):
        out = []
        for text in batch.column(at).to_pylist():
            raw = (text or "").encode("utf-8", "surrogatepass")
            _, found, _, refused = scan_text(raw, max_layer_bytes)
            if found or refused:
                parts, pos = [], 0
                for start, end in sorted([*(x[:2] for x in found), *refused]):
                    if start >= pos:
                        parts += [raw[pos:start], mark.encode()]
                    pos = max(pos, end)
                text = b"".join([*parts, raw[pos:]]).decode("utf-8", "surrogatepass")
            out.append(text)
        arrays = list(batch.columns)
        arrays[at] = pa.array(out, batch.schema.field(at).type)
        yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return map_rows(docs, fields, fn)


def digest(found: DataFrame) -> DataFrame:
    """The digest columns of a scan: counts of base findings, their hash, all spans joined."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["base"])
    count = lambda kind: F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in KINDS),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        "n_layers",
        "n_refused",
    )


def redact_documents(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``redact_secrets`` for the documents table: a column ``n_chars`` follows the new text."""
    out = redact_secrets(docs, "text", mark)
    if "n_chars" not in docs.columns:
        return out
    changed = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNull(), F.col("n_chars")).otherwise(changed))
