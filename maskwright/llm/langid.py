"""Language identification by prediction by partial matching (PPM).

Every language has byte statistics in a context tree of its own, of variable order up to ``ORDER``.
In a context with total n and q distinct bytes, a byte seen c times costs -log2 c / (n + q), an
unseen one the escape -log2 q / (n + q) plus its cost in the next shorter context with the bytes seen
here excluded; below the empty context all bytes are alike. The statistics are frozen after the fit,
so the cost of a byte in a context is one entry of a table and a text's code length is a sum of
entries. The shortest code length wins, ties go to the first name; the score is the posterior of
that language when all are equally likely beforehand.

The fit reads a bounded sample: ``PER_LANG`` rows of each language, spread by hash, of which the first
``MAX_TRAIN_CHARS`` characters. In a tree, contexts seen fewer than ``MIN_COUNT`` times are left out
and ``MAX_CONTEXTS`` bounds it. These figures hold for every language, however many there are. No language
is left out: over ``MAX_LANGS`` languages, or over ``MAX_TABLE_BYTES`` of tables, which every task holds, the fit
fails and asks for smaller figures. Prediction reads whole texts.

Results by case: a null text, or one without a letter, is ``und`` with score 0; if
nothing could be learnt every row is ``und``; null ids and repeated rows are predicted
like others and null ids never learnt from; an empty table gives an empty result; only
the named columns are read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import bucket_sample, encode_slices, held_out, map_rows

ORDER, MIN_COUNT, MAX_CONTEXTS = 4, 8, 6_000
PER_LANG, MAX_TRAIN_CHARS = 250, 6_000
MAX_LANGS, MAX_TABLE_BYTES = 256, 1 << 30
UND = "und"
_ASCII_LETTER = re.compile(r"[A-Za-z]")


def has_letter(text: str) -> bool:
    """Letters are those of Unicode's letter categories, so no digits or fractions of other scripts."""
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text))


@dataclass
class Trees:
    """Frozen statistics. code: byte -> symbol (0: padding in front of a text, 1: any byte
    not seen in training). For each language child: context and byte before it -> longer context,
    and cost: [context, symbol] in bits."""

    langs: list[str]
    code: np.ndarray
    child: list[np.ndarray]
    cost: list[np.ndarray]


def _symbols(raw: bytes, code: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(ORDER, np.uint8), code[np.frombuffer(raw, np.uint8)]])


def _tree(s: np.ndarray, width: int, max_contexts: int) -> tuple[np.ndarray, np.ndarray]:
    """(child, cost) of the symbols of one language; contexts are written as numbers to the base
    ``width``, in which the last byte before counts first."""
    at = np.flatnonzero(s != 0)
    key, node, orders = np.zeros(len(at), np.int64), {(0, 0): 0}, []
    for order in range(1, ORDER + 1):
        key = key * width + s[at - order]
        u, c = np.unique(key, return_counts=True)
        orders.append([(-n, order, k) for k, n in zip(u.tolist(), c.tolist(), strict=True) if n >= MIN_COUNT])
    for _, order, k in sorted(x for part in orders for x in part):  # a shorter context is seen as often, so it comes first
        if len(node) >= max_contexts:
            break
        node[order, k] = len(node)
    child, parent = np.zeros((len(node), width), np.int16), np.zeros(len(node), np.int64)
    for (order, k), i in node.items():
        if order:
            parent[i] = node[order - 1, k // width]
            child[parent[i], k % width] = i
    counts = np.zeros((len(node), width))
    cur, alive = np.zeros(len(at), np.int64), np.ones(len(at), bool)
    for order in range(ORDER + 1):
        if order:
            step = child[cur, s[at - order]]
            alive &= step > 0
            cur = np.where(alive, step, cur)
        np.add.at(counts, (cur[alive], s[at][alive]), 1)
    return child, _costs(counts, parent)


def _costs(counts: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Bits of each symbol in each context. Symbol 1 stands for each of the bytes that were never seen."""
    n_nodes, width = counts.shape
    unseen = 256 - (width - 2)
    p = np.empty_like(counts)
    base = np.full(width, 1 / 256)
    base[0] = 0
    for i in range(n_nodes):  # a parent comes before its children
        c, lower = counts[i], base if i == 0 else p[parent[i]]
        n, q = c.sum(), np.count_nonzero(c)
        new = np.where(c > 0, 0, lower)
        left = new[2:].sum() + new[1] * unseen
        p[i] = np.where(c > 0, c / max(n + q, 1), q / (n + q) * new / max(left, 1e-12)) if n else lower
    cost = np.minimum(-np.log2(np.maximum(p, 1e-12)), 40.0)
    cost[:, 0] = 0  # the padding itself is never coded
    return cost.astype(np.float32)


def fit(texts: dict[str, list[str]], max_contexts: int | None = None) -> Trees | None:
    """Fit the trees on texts by language, with at most ``max_contexts`` (MAX_CONTEXTS) contexts each."""
    max_contexts = max_contexts or MAX_CONTEXTS
    if max_contexts > np.iinfo(np.int16).max:
        raise ValueError("contexts are numbered in 16 bits")
    langs = sorted(texts)
    raws = {g: [t.lower().encode("utf-8", "surrogatepass") for t in texts[g] if t] for g in langs}
    seen = sorted({b for group in raws.values() for raw in group for b in set(raw)})
    if not seen:
        return None
    code = np.ones(256, np.uint8)
    code[seen] = np.arange(2, len(seen) + 2)
    flat = (np.concatenate([_symbols(r, code) for r in raws[g]] or [np.zeros(0, np.uint8)]).astype(np.int64) for g in langs)
    trees, size = [], 0
    for s in flat:
        trees.append(_tree(s, len(seen) + 2, max_contexts))
        size += trees[-1][0].nbytes + trees[-1][1].nbytes
        if size > MAX_TABLE_BYTES:
            raise ValueError(f"the tables of {len(langs)} languages are over {MAX_TABLE_BYTES} bytes; lower max_contexts")
    return Trees(langs, code, [c for c, _ in trees], [c for _, c in trees])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_contexts: int | None = None) -> Trees | None:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("doc_id is not null and lang is not null and text is not null")
    rows = rows.where(~held_out(F.col("doc_id")))
    n_langs = rows.select("lang").distinct().limit(MAX_LANGS + 1).count()
    if n_langs > MAX_LANGS:
        raise ValueError(f"over {MAX_LANGS} languages; {lang_col} holds something else")
    chosen = bucket_sample(rows, "lang", F.xxhash64("doc_id", "text"), PER_LANG)
    cut = F.substring("text", 1, MAX_TRAIN_CHARS)
    sample = rows.join(F.broadcast(chosen), (rows["lang"] == chosen["label"]) & (F.xxhash64(rows["doc_id"], rows["text"]) == chosen["key"])).select("label", "key", cut.alias("text"))
    texts: dict[str, list[str]] = {}
    for r in sample.dropDuplicates(["label", "key"]).collect():  # at most MAX_LANGS * PER_LANG rows, repeated ones once
        texts.setdefault(r["label"], []).append(r["text"])
    return fit({g: sorted(t) for g, t in texts.items()}, max_contexts)


def code_lengths(trees: Trees, raws: list[bytes]) -> np.ndarray:
    """Bits of each text under each language, [texts, languages]."""
    sizes = np.array([len(r) for r in raws], np.int64)
    s = np.concatenate([_symbols(r, trees.code) for r in raws]).astype(np.int32)
    first = np.cumsum(sizes + ORDER) - sizes - ORDER
    out, full = np.zeros((len(raws), len(trees.langs))), sizes > 0
    if not full.any():
        return out
    before = [np.concatenate([np.zeros(k, np.int32), s[:-k]]) for k in range(1, ORDER + 1)]
    for j, (child, cost) in enumerate(zip(trees.child, trees.cost, strict=True)):
        width, flat = child.shape[1], child.reshape(-1)
        cur, alive = np.zeros(len(s), np.int32), np.ones(len(s), bool)
        for x in before:
            step = flat[cur * width + x]
            alive &= step > 0
            np.copyto(cur, step, where=alive)
        bits = cost.reshape(-1)[cur * width + s]
        out[full, j] = np.add.reduceat(bits, first[full], dtype=np.float64)
    return out


def predict(docs: DataFrame, trees: Trees | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, lang_pred, score, bits_per_byte (of the winner)."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)  # at most MAX_TABLE_BYTES

    def fn(batch: pa.RecordBatch):
        t = shared.value
        for at, group in encode_slices([x.lower() if x else x for x in batch.column(1).to_pylist()]):
            part = batch.slice(at, len(group))
            lettered = np.array([has_letter(g.decode("utf-8", "surrogatepass")) for g in group])
            if t is None:
                name, score, rate = np.full(len(group), UND, object), np.zeros(len(group)), np.zeros(len(group))
            else:
                bits = code_lengths(t, group)
                best = bits.argmin(1)
                least = bits[np.arange(len(group)), best]
                score = 1 / np.exp2(np.minimum(0, least[:, None] - bits)).sum(1)
                name = np.array(t.langs, object)[best]
                rate = least / np.maximum(1, [len(g) for g in group])
                name[~lettered], score[~lettered] = UND, 0.0
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(name.tolist(), pa.string()), pa.array(score), pa.array(np.round(rate, 6))], ["doc_id", "lang_pred", "score", "bits_per_byte"]
            )

    return map_rows(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")),
        "doc_id long, lang_pred string, score double, bits_per_byte double",
        fn,
    )
