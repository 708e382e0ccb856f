"""Token counts of a byte-level merge vocabulary, with a shortcut for whole pre-tokens.

The vocabulary is read from a ``tokenizers`` file whose path is a parameter; nothing is trained. Offline,
on the driver, every vocabulary string is merged on its own: those that end as one token make the
shortcut table, so a pre-token in the table is one token without any merge. A string of the vocabulary
that its own merges never reach stays out. In the tasks a text is cut into words at single spaces, which
always begin a pre-token, and repeats are counted once. The pre-tokens of a word that are in the table
are added up directly and only the rest is merged: adjacent pairs, lowest rank first, leftmost on ties.

Strings of special tokens inside a text are one token each and cut it, as the library does by default.
The library's letters and digits are those of its own Unicode version, so its classes are asked from it:
characters that it sees otherwise than the pattern engine here are set aside before the search.

Results by case: a null text has 0 bytes and 0 tokens, as an empty one; every row gives one row, repeated
ids too; an empty table gives an empty one; very long texts are counted whole, in
windows of words; only the
id and the text are read, so extra columns of any name do no harm.
"""

from __future__ import annotations

import json
import operator
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import encode_slices, ensure_importable, map_rows
from maskwright.llm.pieces import _NO_RANK, LONG, MergeTable, agenda, encode_block

#: Fixed value: the pre-token pattern of byte-level vocabularies.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose counts a worker remembers before it starts anew. They save time only.
REMEMBERED = 500_000
#: The words of some so many characters are counted together; a long text is split so many at a time.
WINDOW = 1_000_000
#: A vocabulary file over this many bytes is not sent to the workers.
MAX_FILE = 64_000_000


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a vocabulary file: printable Latin-1 stands for itself, the
    other bytes in their order for the letters from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class Vocabulary(MergeTable):
    """What the tasks need: merges, the table of strings that are one token, specials, odd characters."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            raw = f.read(MAX_FILE + 1)
        if len(raw) > MAX_FILE:
            raise ValueError(f"{path} has over {MAX_FILE} bytes")
        told = json.loads(raw)
        model, pre = told["model"], told["pre_tokenizer"] or {}
        plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        if model["type"] != "BPE" or told["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or not plain:
            raise ValueError(f"{path} is not a plain byte-level merge vocabulary")
        added = told["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("special tokens that take in what is around them are not supported")
        self.specials = sorted((t["content"] for t in added), key=len, reverse=True)
        ids = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"]]
        made = np.array([ids[a + b] for a, b in pairs], np.int32)
        if len(set(made.tolist())) < len(made):
            raise ValueError("a token that two merges make is not supported")
        self.size = max(ids.values()) + 1
        self.rank = np.full(self.size, _NO_RANK, np.int32)
        self.rank[made] = np.arange(len(made))
        self._fill(np.array([ids[a] for a, _ in pairs], np.int64), np.array([ids[b] for _, b in pairs], np.int64), made)
        letters = byte_letters()
        self.byte = np.array([ids[letters[b]] for b in range(256)], np.int32)
        self.odd = self._odd(path)
        byte = {c: b for b, c in letters.items()}
        whole = [text for token in ids if (text := _decoded(token, byte))]
        self.alone = frozenset(text for text, n in self.merged(whole).items() if n == 1)

    @staticmethod
    def _odd(path: str) -> str:
        """Letters and digits of the engine here that the library holds for neither."""
        from tokenizers import Tokenizer

        cut = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        every = "".join(map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x110000)]))
        odd = []
        for kind, mate in ((r"\p{L}", "a"), (r"\p{N}", "1")):
            asked = regex.findall(kind, every)
            starts = {a for _, (a, _) in cut("".join(f"{mate}{c}\n" for c in asked))}
            odd += [c for i, c in enumerate(asked) if 3 * i + 1 in starts]  # it does not join its like
        return "".join(sorted(odd))

    def merged(self, texts: list[str]) -> dict[str, int]:
        """How many tokens the merges of each pre-token leave; pre-tokens of one length are merged together."""
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        size, found = np.array([len(r) for r in raw]), np.zeros(len(raw), np.int64)
        for n in np.unique(size[size <= LONG]):
            at = np.flatnonzero(size == n)
            sym = self.byte[np.frombuffer(b"".join([raw[i] for i in at]), np.uint8)].reshape(-1, n)
            found[at] = (encode_block(self, sym, np.zeros(len(at), np.uint64), 0) >= 0).sum(1)
        for i in np.flatnonzero(size > LONG):
            found[i] = len(agenda(self, self.byte[np.frombuffer(raw[i], np.uint8)].tolist()))
        return dict(zip(texts, found.tolist(), strict=True))


def _decoded(token: str, byte: dict[str, int]) -> str | None:
    try:
        return bytes(byte[c] for c in token).decode()
    except (KeyError, UnicodeDecodeError):
        return None


#: A space in front of anything but white space always begins a pre-token.
_WORD_START = re.compile(r" (?=\S)")
_SPACES = re.compile(r" (?:\s|$)")
#: No word behind a space begins with this mark.
_FIRST = "\n"
#: A word's count: tokens in the lower 40 bits, whole pre-tokens above.
_TOKENS = (1 << 40) - 1


class TokenCounter:
    """Counts the tokens of texts; remembers the counts of words it has met, up to a bound."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.known = vocabulary, {}
        self.pattern = regex.compile(PRE_TOKEN)
        self.special = re.compile("|".join(map(re.escape, vocabulary.specials))) if vocabulary.specials else None
        self.odd = frozenset(vocabulary.odd)
        self.far = re.compile(f"[{min(vocabulary.odd)}-\U0010ffff]") if vocabulary.odd else None  # few texts have any of these
        self.plain = str.maketrans(dict.fromkeys(vocabulary.odd, "§"))  # neither letter, digit nor space

    def count(self, texts: list[str]) -> np.ndarray:
        """[texts, 2]: the tokens, and those of them that are whole pre-tokens of the table."""
        found = np.zeros((len(texts), 2), np.int64)
        held, size = [], 0
        for i, text in enumerate(texts):
            cuts = [m.span() for m in self.special.finditer(text)] if self.special else []
            found[i, 0], pos = len(cuts), 0
            for a, b in [*cuts, (len(text), len(text))]:
                for part in _windows(text[pos:a]):
                    held.append((i, _words(part)))
                    size += len(part)
                    if size > WINDOW:
                        self._add(found, held)
                        held, size = [], 0
                pos = b
        self._add(found, held)
        return found

    def _add(self, found: np.ndarray, held: list[tuple[int, Counter]]) -> None:
        """Learn the new words of all parts together, then add up the words of each."""
        self._learn({w for _, words in held for w in words if w not in self.known})
        for i, words in held:
            packed = sum(map(operator.mul, map(self.known.__getitem__, words), words.values()))
            found[i] += (packed & _TOKENS, packed >> 40)
        if len(self.known) > REMEMBERED:
            self.known.clear()

    def _learn(self, words: set[str]) -> None:
        cut = {w: self._pre_tokens(w[1:] if w[0] == _FIRST else f" {w}") for w in words}
        alone = self.v.alone
        rest = {t for tokens in cut.values() for t in tokens if t not in alone}
        merged = self.v.merged(list(rest))
        direct = 1 | 1 << 40
        for w, tokens in cut.items():
            self.known[w] = sum([merged[t] if t in merged else direct for t in tokens])

    def _pre_tokens(self, text: str) -> list[str]:
        if self.far and self.far.search(text) and not self.odd.isdisjoint(text):
            return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(self.plain))]
        return self.pattern.findall(text)


def _windows(text: str) -> Iterator[str]:
    """A text without special tokens, some WINDOW characters and the rest of a word at a time."""
    at = 0
    while at < len(text):
        cut = _WORD_START.search(text, at + WINDOW)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def _words(text: str) -> Counter:
    """The words behind a space, and the first one with a mark in front."""
    first, *rest = _WORD_START.split(text) if _SPACES.search(text) else text.split(" ")
    words = Counter(rest)
    if first:
        words[_FIRST + first] = 1
    return words


_PROVED: dict[str, Vocabulary] = {}
_COUNTERS: dict[tuple, TokenCounter] = {}


def _counter(key: tuple, vocabulary) -> TokenCounter:
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = TokenCounter(vocabulary.value)
    return _COUNTERS[key]


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, n_direct (pre-tokens counted without a merge)."""
    spark = docs.sparkSession
    ensure_importable(spark)
    if path not in _PROVED:
        _PROVED[path] = Vocabulary(path)
    sent = spark.sparkContext.broadcast(_PROVED[path])
    key = (path, spark.sparkContext.applicationId, id(sent))

    def fn(batch: pa.RecordBatch):
        counter = _counter(key, sent)
        for at, group in encode_slices(batch.column(1).to_pylist()):
            found = counter.count([g.decode("utf-8", "surrogatepass") for g in group])
            size = pa.array([len(g) for g in group], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(group)), size, pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], ["doc_id", "n_bytes", "n_tokens", "n_direct"])

    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "doc_id long, n_bytes long, n_tokens long, n_direct long", fn)


def over_limit(n_tokens: Column, limit: int = 1024) -> Column:
    return n_tokens > limit
