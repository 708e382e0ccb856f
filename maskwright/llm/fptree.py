"""Ranked lexical search of a stated set of items by document FP-trees.

The terms of a document are restricted to those of the items and written once as a narrow table of term
vectors. Document frequencies order the terms, most frequent first, and a tree of some TREE_DOCS
documents shares the paths of those vectors: its compressed nodes are runs of documents that have the
same first terms. Each node holds the maxima of its documents' term counts and the minimum of their
length factor m. As a score rises with counts and falls with m, these bound every score below a node, so
a depth-first search for an item leaves out what cannot reach its best ``k`` so far. Bounds are exact
integers, nothing within the best ``k`` is lost, and equal bounds are followed for the sake of ties.

A task builds and searches one tree after another and carries an item's best ``k`` along, so it holds one
tree and ``k`` rows an item; no document leaves it but those. Items are searched in blocks of about
BLOCK_BYTES bytes of text, which bounds the vocabulary that is sent to the tasks.

Results by case: null, empty and termless texts are in no result and not counted in N; items without
terms have no rows; items are rows, so a repeated item is ranked each time; rows that repeat a doc_id are
documents of their own, and a null id comes last among equal scores; an empty table gives an empty one;
very long texts are counted whole; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskwright.llm.common import BATCH_ROWS, encode_slices, map_partitions, written

#: Terms are runs of ASCII letters and digits and of everything beyond ASCII; only A-Z are lower-cased.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
BEST = 20
#: Documents of a tree, cells of its count matrix, and documents of a node that is not divided further.
TREE_DOCS, TREE_CELLS, LEAF = 2_048, 8_000_000, 32
#: Bytes of item texts that are searched together.
BLOCK_BYTES = 1_000_000
#: A text over this many bytes is counted window by window.
WINDOW = 8_000_000
_ID_OF_NULL = (1 << 63) - 1
_BREAK = re.compile(rb"[^0-9A-Za-z\x80-\xff]")


def terms(raw: bytes) -> Counter:
    """How often each term occurs in a text."""
    found, at = Counter(), 0
    while at < len(raw):
        cut = _BREAK.search(raw, at + WINDOW)
        end = cut.start() if cut else len(raw)
        found.update(TERM.findall(raw[at:end].lower()))
        at = end
    return found


def vectors(docs: DataFrame, vocabulary: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, terms, counts) of the documents with a term: all their terms counted, those of the vocabulary listed."""
    number = {t: i for i, t in enumerate(vocabulary)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(first, BATCH_ROWS)
                for at, group in encode_slices(part.column(1).to_pylist()):
                    counted = [terms(g) for g in group]
                    listed = [{number[t]: c[t] for t in c.keys() & number.keys()} for c in counted]
                    ends = np.cumsum([0, *map(len, listed)]).astype(np.int32)
                    flat = pa.array([t for x in listed for t in x], pa.int32()), pa.array([n for x in listed for n in x.values()], pa.int32())
                    columns = [part.column(0).slice(at, len(group)), pa.array([c.total() for c in counted], pa.int64()), *(pa.ListArray.from_arrays(ends, f) for f in flat)]
                    made = pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "counts"])
                    yield made.filter(pa.array([bool(c) for c in counted], pa.bool_()))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_partitions(rows, "doc_id long, n long, terms array<int>, counts array<int>", run)


def corpus_counts(table: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """N, L and the document frequency of each term of the vocabulary; each task sends one row for a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 2, np.int64)
        for batch in batches:
            total[:size] += np.bincount(batch.column(1).flatten().to_numpy(), minlength=size)
            total[size:] += batch.num_rows, int(batch.column(0).to_numpy().sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 2)), pa.array(total)], ["term", "n"])

    total = np.zeros(size + 2, np.int64)
    for r in map_partitions(table.select("n", "terms"), "term long, n long", run).groupBy("term").agg(F.sum("n").alias("n")).collect():
        total[r.term] = r.n
    return int(total[size]), int(total[size + 1]), total[:size]


def impacts(counts: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term weighs in a document by its count there and the document's m; rises with counts, falls with m."""
    counts = counts.astype(np.int64)
    return (1_000_000_000 * counts) // (1_000 * counts + 12 * m[:, None])


@dataclass
class Item:
    item_id: int | None
    columns: np.ndarray  # terms as columns of the trees
    weight: np.ndarray  # w times the repeats in the item


class Tree:
    """Documents in the order of their term paths; nodes are runs of them. Column c is the c-th most frequent term."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, counts: np.ndarray):
        has = np.packbits(counts > 0, axis=1)
        order = np.ascontiguousarray(has).view(np.dtype((np.void, has.shape[1]))).ravel().argsort(kind="stable")[::-1]
        self.ids, self.m, self.counts = ids[order], m[order], counts[order]
        present = self.counts > 0
        length = present.sum(1)
        differ = present[1:] != present[:-1]
        first = np.where(differ.any(1), differ.argmax(1), present.shape[1])
        shared = np.concatenate([[0], (np.cumsum(present[1:], axis=1, dtype=np.int32) - present[1:])[np.arange(len(first)), np.minimum(first, present.shape[1] - 1)]])
        shared[1:][first == present.shape[1]] = length[1:][first == present.shape[1]]  # equal paths
        self.span, self.children = [(0, len(ids))], [[]]
        node = 0
        while node < len(self.span):
            a, b = self.span[node]
            depth = shared[a + 1 : b].min(initial=1 << 30)
            if b - a > LEAF and depth < max(length[a], length[b - 1]):
                for span in _joined([a, *(a + 1 + np.flatnonzero(shared[a + 1 : b] == depth)).tolist(), b]):
                    if span != (a, b):
                        self.children[node].append(len(self.span))
                        self.span.append(span)
                        self.children.append([])
            node += 1
        self.most = np.zeros((len(self.span), counts.shape[1]), counts.dtype)
        self.least = np.zeros(len(self.span), np.int64)
        for node in reversed(range(len(self.span))):  # children come behind their parents
            (a, b), below = self.span[node], self.children[node]
            self.most[node] = self.most[below].max(0) if below else self.counts[a:b].max(0)
            self.least[node] = self.least[below].min() if below else self.m[a:b].min()

    def search(self, item: Item, best: np.ndarray, k: int) -> tuple[np.ndarray, int]:
        """The best (score, id) rows of ``best`` and this tree, best first, and how many documents were scored."""
        use = self.most[0][item.columns] > 0
        columns, weight = item.columns[use], item.weight[use]
        if not len(columns):
            return best, 0
        need, scored = _needed(best, k), 0
        stack = [(int(impacts(self.most[:1, columns], self.least[:1])[0] @ weight), 0)]
        while stack:
            bound, node = stack.pop()
            if bound < need:
                continue
            if below := self.children[node]:
                bounds = impacts(self.most[np.ix_(below, columns)], self.least[below]) @ weight
                order = np.argsort(bounds)  # the highest bound is searched first
                stack += [(int(bounds[i]), below[i]) for i in order if bounds[i] >= need]
                continue
            a, b = self.span[node]
            score = impacts(self.counts[a:b, columns], self.m[a:b]) @ weight
            scored += b - a
            if len(hit := np.flatnonzero(score >= need)):
                best = np.concatenate([best, np.stack([score[hit], self.ids[a:b][hit]], 1)])
                best = best[np.lexsort((best[:, 1], -best[:, 0]))[:k]]
                need = _needed(best, k)
        return best, scored


def _joined(cuts: list[int]) -> Iterator[tuple[int, int]]:
    """The runs between cuts; neighbours of together at most LEAF documents are one run."""
    a = cuts[0]
    for b, c in zip(cuts[1:], [*cuts[2:], None], strict=True):
        if c is None or c - a > LEAF:
            yield a, b
            a = b


def _needed(best: np.ndarray, k: int) -> int:
    """The score that a document needs to matter: above 0, and at least the k-th best."""
    return max(1, int(best[k - 1, 0])) if len(best) >= k else 1


def search(table: DataFrame, items: list[Item], n_docs: int, n_terms: int, column: np.ndarray, k: int) -> DataFrame:
    """Each task's best ``k`` documents of each item: (item, item_id, doc_id, score). ``column`` is the place of a
    term of the vocabulary among the most frequent ones."""
    width = len(column)
    tree_docs = max(LEAF, min(TREE_DOCS, TREE_CELLS // max(1, width)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [np.zeros((0, 2), np.int64)] * len(items)
        for rows in _chunks(batches, tree_docs):
            n, lists = rows.column(1).to_numpy(), rows.column(2)
            size = np.diff(lists.offsets.to_numpy())
            counts = rows.column(3).flatten().to_numpy()
            dense = np.zeros((len(n), width), np.uint16 if counts.max(initial=0) < 65_536 else np.int32)
            dense[np.repeat(np.arange(len(n)), size), column[lists.flatten().to_numpy()]] = counts
            ids = rows.column(0).fill_null(_ID_OF_NULL).to_numpy()
            tree = Tree(ids, 75 + (25 * n * n_docs) // n_terms, dense)
            for i, item in enumerate(items):
                best[i] = tree.search(item, best[i], k)[0]
        for i, item in enumerate(items):
            if n := len(best[i]):
                ids = pa.array(best[i][:, 1].copy(), mask=best[i][:, 1] == _ID_OF_NULL)
                yield pa.RecordBatch.from_arrays([pa.array([i] * n, pa.int32()), pa.array([item.item_id] * n, pa.int64()), ids, pa.array(best[i][:, 0].copy())], ["item", "item_id", "doc_id", "score"])

    return map_partitions(table.where(F.size("terms") > 0), "item int, item_id long, doc_id long, score long", run)


def _chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The rows of a partition, ``rows`` at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, rows - sum(h.num_rows for h in held))
            held.append(part)
            batch = batch.slice(part.num_rows)
            if sum(h.num_rows for h in held) == rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _search_block(docs: DataFrame, items: list, k: int, id_col: str, text_col: str) -> DataFrame:
    counted = [(i.item_id, terms((i.text or "").encode("utf-8", "surrogatepass"))) for i in items]
    vocabulary = sorted({t for _, c in counted for t in c})
    number = {t: i for i, t in enumerate(vocabulary)}
    table = written(vectors(docs, vocabulary, id_col, text_col), "vectors")
    n_docs, n_terms, df = corpus_counts(table, len(vocabulary))
    order = np.lexsort((np.arange(len(df)), -df))
    column = np.empty(len(df), np.int64)
    column[order] = np.arange(len(df))
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    made = []
    for item_id, c in counted:
        at = np.array([number[t] for t in c], np.int64)
        made.append(Item(item_id, column[at], weight[at] * np.array(list(c.values()), np.int64)))
    return search(table, made, n_docs, max(1, n_terms), column, k)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = BEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents with a score above 0 for each row of ``items`` (item_id, text)."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES) or 1
    found = []
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        found.append(_search_block(docs, rows, k, id_col, text_col).withColumn("block", F.lit(block)))
    order = Window.partitionBy("block", "item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def _sql_terms(table: str, key: str) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"select {key}, unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from {table}"


ORACLE_SQL = f"""with d as ({_sql_terms("documents", "doc_id")}), q as ({_sql_terms("benchmark", "item_id")}),
tf as (select doc_id, term, count(*) as tf from d group by all), l as (select doc_id, count(*) as n from d group by all), c as (select count(*) as nn, cast(sum(n) as bigint) as ll from l),
w as (select item_id, term, count(*) as k from q group by all), df as (select term, count(*) as df from tf group by all),
s as (select item_id, doc_id, cast(sum(k * cast(floor(1000 * ln((2 * nn + 2) / (2 * df + 1))) as bigint) * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // ll)))) as bigint) as score
  from w join df using (term) join tf using (term) join l using (doc_id), c group by all)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score from s where score > 0 qualify rank <= {BEST}"""
