"""Token counts against the library."""

import random

import public_tokenizers
from compare import DATA
from test_llm import odd_docs
from tokenizers import Tokenizer

from maskwright.llm import pieces, token_counts
from maskwright.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")


def library(texts):
    return [len(e.ids) for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_query_equals_the_library(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    got = QUERIES["op12_token_counts"](spark, DATA).collect()
    want = dict(zip(texts, library(texts.values()), strict=True))
    assert {r.doc_id: r.n_tokens for r in got} == want and len(got) == len(texts)
    assert all(r.n_bytes == len((texts[r.doc_id] or "").encode()) and r.over_limit == (r.n_tokens > 1024) for r in got)
    assert sum(r.n_direct for r in got) > 0


def test_odd_and_empty_rows(spark):
    docs = odd_docs(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = token_counts.count_tokens(docs, PATH).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == sorted((i or 0, n) for (i, _), n in zip(rows, library([t for _, t in rows]), strict=True))
    assert token_counts.count_tokens(docs.limit(0), PATH).collect() == []


def test_random_texts_specials_and_spaces(monkeypatch):
    """Special strings, all kinds of white space, letters newer than the library's Unicode; small windows and memory."""
    vocabulary = token_counts.Vocabulary(PATH)
    monkeypatch.setattr(token_counts, "WINDOW", 40)
    monkeypatch.setattr(token_counts, "REMEMBERED", 50)
    odd = vocabulary.odd[0], vocabulary.odd[-1]
    parts = ["a", "b", " ", "  ", "\n", "\t", "'s", "'", "1", "22", "é", "😀", "中文", *odd, "<|endoftext|>", "<|endoftext", "!", "\x85", "\x1c", " ", "Ġ", "²", "٣", "the", " of"]
    rnd = random.Random(1)
    texts = ["".join(rnd.choices(parts, k=rnd.randint(0, 40))) for _ in range(3000)] + ["a" * 3000, " " * 3000 + "x", "\n" * 500, "é" * 900]
    assert token_counts.TokenCounter(vocabulary).count(texts)[:, 0].tolist() == library(texts)


def test_table_is_proved_string_by_string():
    """A string of the table is one token of the library; a vocabulary string outside is not, or is no text."""
    vocabulary = token_counts.Vocabulary(PATH)
    byte = {c: b for b, c in token_counts.byte_letters().items()}
    tokenizer = Tokenizer.from_file(PATH)
    for token in random.Random(2).sample(sorted(tokenizer.get_vocab()), 4000):
        text = token_counts._decoded(token, byte)
        if text and not vocabulary.specials[0] == token:
            assert (text in vocabulary.alone) == ([t for t in tokenizer.model.tokenize(token)][0].value == token), token


def test_long_pre_tokens_take_the_agenda():
    assert pieces.LONG < 3000
    word = "xyzzy" * 700
    assert token_counts.TokenCounter(token_counts.Vocabulary(PATH)).count([word])[0, 0] == library([word])[0]
