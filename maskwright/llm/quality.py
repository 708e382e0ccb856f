"""Quality rules: a ledger of failure bits and measurements, versioned policies, ablations.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit
for each failed rule, and is stored as a table; a policy is a bit mask with a version, so applying
one, or asking what a rule alone removes, reads the stored ledger and never the texts.

Results by case: a null or empty text has no words and fails ``few_words``; repeated rows
give repeated results; null ids are kept; empty tables give empty results; only the id
and text columns are read; very long texts are measured whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import encode_slices, map_rows, written

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """``fails`` is SQL over the measurements; it holds in Spark and in the oracle alike."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 50 * n_words"),
    Rule(3, "repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule(4, "word_length", "word_chars < 2 * n_words or word_chars > 25 * n_words"),
)
#: version -> rules whose failure removes a document. Versions are only ever added.
POLICIES = {
    1: ("few_words", "repeated_words"),
    2: ("few_words", "repeated_words", "symbols", "repeated_lines"),
    3: ("few_words", "repeated_words", "symbols", "repeated_lines", "word_length"),
}
CURRENT = 3


def mask(version: int) -> int:
    bits = {r.name: r.bit for r in RULES}
    return sum(1 << bits[name] for name in POLICIES[version])


def repeated_words(owner: np.ndarray, word: np.ndarray, n_docs: int) -> np.ndarray:
    """Words of each document that lie in a window of five found twice or more in it.

    ``word`` numbers the words, ``owner`` their documents. Windows are sorted by a hash;
    neighbours with one hash are compared word by word, so a collision never counts.
    """
    out = np.zeros(n_docs, np.int64)
    if len(word) < WINDOW:
        return out
    start = np.flatnonzero(owner[: len(owner) - WINDOW + 1] == owner[WINDOW - 1 :])
    h = owner[start].astype(np.uint64)
    for k in range(WINDOW):
        h = (h ^ word[start + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    hs, st = h[order], start[order]
    same = hs[1:] == hs[:-1]
    a, b = st[:-1][same], st[1:][same]
    alike = owner[a] == owner[b]
    for k in range(WINDOW):
        alike &= word[a + k] == word[b + k]
    hit = np.zeros(len(word) + WINDOW, bool)
    if not alike.all():  # a collision: settle its windows exactly
        groups: dict[tuple, list[int]] = {}
        for s in np.unique(np.concatenate([st[:-1][same], st[1:][same]])).tolist():
            groups.setdefault((int(owner[s]), *word[s : s + WINDOW].tolist()), []).append(s)
        found = np.array([s for g in groups.values() if len(g) > 1 for s in g], np.int64)
    else:
        found = np.concatenate([a, b])
    for k in range(WINDOW):
        hit[found + k] = True
    np.add.at(out, owner[np.flatnonzero(hit[: len(word)])], 1)
    return out


def measure(raws: list[bytes]) -> np.ndarray:
    """MEASURES of each text, [texts, measures]. bytes.split and strip know ASCII white space only, as wanted."""
    out = np.zeros((len(raws), len(MEASURES)), np.int64)
    number: dict[bytes, int] = {}
    ids, sizes = [], []
    for i, raw in enumerate(raws):
        words = raw.split()
        ids.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)))
        sizes.append(len(words))
        lines = [x for x in raw.split(b"\n") if x.strip()]
        points = len(raw) if raw.isascii() else len(raw.decode("utf-8", "surrogatepass"))
        spaces = len(raw) - len(raw.translate(None, SPACES))
        out[i, :5] = len(words), points - spaces, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines), len(lines) - len(set(lines))
    out[:, 5] = repeated_words(np.repeat(np.arange(len(raws)), sizes), np.concatenate(ids), len(raws))
    return out


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: doc_id, the measurements, fail_bits."""

    def fn(batch: pa.RecordBatch):
        for at, group in encode_slices(batch.column(1).to_pylist()):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(group)), *(pa.array(c) for c in measure(group).T)], ["doc_id", *MEASURES])

    rows = map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES), fn)
    bits = sum((F.when(F.expr(r.fails), 1 << r.bit).otherwise(0) for r in rules), F.lit(0)).cast("long")
    return rows.withColumn("fail_bits", bits)


def stored_ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger written as a table in the shared folder, a few dozen bytes a document."""
    return written(ledger(docs, id_col, text_col), "ledger")


def passes(version: int = CURRENT, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(mask(version))) == 0


def ablations(rows: DataFrame, version: int = CURRENT, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """What each rule of a policy does, from the ledger alone: rule, n_fail (documents that fail
    it), n_only (documents that only it removes); one pass, one row of counts per task."""
    m = mask(version)
    own = F.col("fail_bits").bitwiseAND(F.lit(m))
    used = [r for r in rules if m >> r.bit & 1]
    sums = [f(r) for r in used for f in (lambda r: F.sum((own.bitwiseAND(F.lit(1 << r.bit)) != 0).cast("long")).alias(f"f{r.bit}"), lambda r: F.sum((own == F.lit(1 << r.bit)).cast("long")).alias(f"o{r.bit}"))]
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_or(own), F.lit(0)).alias("any_bits"), *sums)
    line = lambda r: F.struct(F.lit(r.name).alias("rule"), F.coalesce(F.col(f"f{r.bit}"), F.lit(0)).alias("n_fail"), F.coalesce(F.col(f"o{r.bit}"), F.lit(0)).alias("n_only"))
    return total.select("n", "any_bits", F.explode(F.array(*map(line, used))).alias("x")).select(F.lit(version).alias("version"), "n", "any_bits", "x.*")


LEDGER_SQL = rf"""
with t as (select doc_id, row_number() over () as rid, coalesce(text, '') as text from documents),
w as (select rid, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from t),
g as (select rid, unnest(range(1, len(w) - 3)) as i, w from w where len(w) >= 5),
k as (select rid, i, array_to_string(w[i:i + 4], ' ') as k from g),
r as (select rid, i from k qualify count(*) over (partition by rid, k) > 1),
p as (select rid, count(distinct i + j) as n from r, (select unnest(range(0, 5)) as j) group by rid),
l as (select rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from t),
m as (select t.doc_id, cast(len(w) as bigint) as n_words, cast(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) as bigint) as word_chars,
  cast(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) as bigint) as n_symbols, cast(len(l) as bigint) as n_lines,
  cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines, coalesce(p.n, 0) as n_repeat_words
  from t join w using (rid) join l using (rid) left join p using (rid)),
b as (select *, cast({" + ".join(f"case when {r.fails} then {1 << r.bit} else 0 end" for r in RULES)} as bigint) as fail_bits from m)"""
ORACLE_SQL = f"""{LEDGER_SQL}
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits, cast({CURRENT} as integer) as policy_version,
  (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed,
  (fail_bits & {mask(CURRENT)}) = 0 as kept from b"""
ABLATIONS_SQL = LEDGER_SQL + " union all ".join(
    f"""
select cast({version} as integer) as version, count(*) as n, coalesce(bit_or(fail_bits & {mask(version)}), 0) as any_bits, '{r.name}' as rule,
  count(*) filter (where fail_bits & {1 << r.bit} <> 0) as n_fail, count(*) filter (where fail_bits & {mask(version)} = {1 << r.bit}) as n_only from b"""
    for version in POLICIES
    for r in RULES
    if mask(version) >> r.bit & 1
)
