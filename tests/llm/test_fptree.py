"""Document FP-trees against brute force."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from compare import rows_of
from test_llm import odd_docs

from maskwright.llm import fptree as T

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def naive_terms(text):
    return Counter(TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)})))


def naive(docs, items, k=20):
    docs = [(i, c) for i, t in docs if (c := naive_terms(t))]
    n_docs, n_terms = len(docs), sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    rows = []
    for item_id, text in items:
        scored = []
        for i, c in docs:
            m, score = 75 + (25 * c.total() * n_docs) // n_terms, 0
            for t, r in naive_terms(text).items():
                if t in c:
                    score += r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                scored.append((-score, math.inf if i is None else i))
        rows += [(item_id, r + 1, None if i == math.inf else i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(rows, key=repr)


@pytest.mark.parametrize(("tree", "leaf", "block"), [(2_048, 32, 1_000_000), (7, 1, 20), (50, 4, 1_000_000)])
def test_odd_rows_ties_and_copies(spark, monkeypatch, tree, leaf, block):
    """Nulls, empty, long, repeated rows, copies over several trees, repeated items, several blocks."""
    monkeypatch.setattr(T, "TREE_DOCS", tree)
    monkeypatch.setattr(T, "LEAF", leaf)
    monkeypatch.setattr(T, "BLOCK_BYTES", block)
    monkeypatch.setattr(T, "WINDOW", 50)
    d = odd_docs(spark).select("doc_id", "text", "n_chars", "score")
    more = [(i % 90 if i % 8 else None, " ".join(f"W{(i * j) % 11}" for j in range(i % 13)) + " é X" * (i % 3), None, 1.0) for i in range(240)]
    more += [(1000 + i, "w1 w2 w3 same", None, None) for i in range(60)]
    d = d.unionByName(spark.createDataFrame(more, d.schema))
    items = [(1, "w1 W2 w2 é"), (2, None), (3, ""), (None, "x w10"), (4, "same, same w3"), (4, "same, same w3"), (5, "nowhere"), (6, "a x")]
    got = T.rank_documents(d, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect()), key=repr) == naive([(r.doc_id, r.text) for r in d.collect()], items)


def test_empty_tables(spark):
    d, items = odd_docs(spark), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert rows_of(T.rank_documents(d.limit(0), items))[1:] == rows_of(T.rank_documents(d, items.limit(0)))[1:]
    assert T.rank_documents(d.limit(0), items).collect() == T.rank_documents(d, items.limit(0)).collect() == []


def test_bounds_hold_and_branches_are_left_out():
    """No document beats the bound of a node above it; a tree scores fewer documents than it has."""
    rng = np.random.default_rng(5)
    counts = (rng.poisson(0.3, (1500, 40)) * (rng.random((1500, 40)) < np.linspace(0.9, 0.05, 40))).astype(np.uint16)
    m = rng.integers(80, 400, 1500)
    tree = T.Tree(np.arange(1500), m, counts)
    weight = rng.integers(1, 3000, 40)
    score = T.impacts(tree.counts, tree.m) @ weight
    bound = T.impacts(tree.most, tree.least) @ weight
    for node, (a, b) in enumerate(tree.span):
        assert score[a:b].max() <= bound[node]
        below = [tree.span[c] for c in tree.children[node]]
        assert not below or (below[0][0], below[-1][1]) == (a, b) and all(x[1] == y[0] for x, y in zip(below, below[1:]))
    item = T.Item(1, np.array([30, 35, 39]), np.array([900, 1500, 2000]))
    best, scored = tree.search(item, np.zeros((0, 2), np.int64), 5)
    every = T.impacts(tree.counts[:, item.columns], tree.m) @ item.weight
    assert best[:, 0].tolist() == np.sort(every)[::-1][:5].tolist() and scored < 1500
