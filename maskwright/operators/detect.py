"""Detection: pattern spans, model spans, fusion. Everything is a narrow projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions import spans as S
from maskwright.functions.ranges import overlap_join
from maskwright.functions.patterns import PATTERNS, SIMPLE_PATTERNS, SYSTEM_TAG, TOKEN, Pattern


def mask_protected(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``_keep``, the tokens and system tag blocks of a text that detection may not touch, and ``_masked``,
    the text with as many NUL characters in their place. Step by step, as deep nests of lambdas resolve slowly."""
    text = F.col(text_col)
    tokens = docs.select("*", S.find_all(text, TOKEN, r"\[#").alias("_tokens"))
    once = tokens.select("*", S.replace_ranges(text, F.col("_tokens"), S.nul_fill).alias("_once"))
    tags = once.select("*", S.find_all(F.col("_once"), SYSTEM_TAG, "</").alias("_tags"))
    masked = S.replace_ranges(F.col("_once"), F.col("_tags"), S.nul_fill)
    return tags.select(*docs.columns, F.concat("_tokens", "_tags").alias("_keep"), masked.alias("_masked"))


def detect(docs: DataFrame, patterns: tuple[Pattern, ...] = PATTERNS, text_col: str = "text", out: str = "spans") -> DataFrame:
    """Add ``out``: all pattern matches, texts as in the original, protected ranges left alone.

    A null text has an empty array. Matches are found on the folded and masked text, which has
    the original's length.
    """
    kept = [c for c in docs.columns if c != out]
    base = mask_protected(docs.select(*kept, F.coalesce(F.col(text_col), F.lit("")).alias("_text")), "_text")
    folded = base.select(*kept, "_text", "_keep", S.fold_confusables(F.col("_masked")).alias("_folded"))
    found = folded.select(
        *kept,
        "_text",
        "_keep",
        *(S.find_all(F.col("_folded"), p.regex, p.guard).alias(f"_m{i}") for i, p in enumerate(patterns)),
    )

    def as_spans(i: int, p: Pattern) -> Column:
        def span(m: Column, t: Column) -> Column:
            return F.struct(
                m["start"].alias("start"),
                m["end"].alias("end"),
                t.alias("text"),
                F.lit(p.pii_type).alias("pii_type"),
                F.lit("regex").alias("source"),
                F.lit(p.confidence).alias("confidence"),
                F.lit(i).alias("priority"),
            )

        # only a match that holds a masked character can overlap a protected range
        free = F.filter(f"_m{i}", lambda m: ~(F.contains(m["text"], F.lit("\0")) & F.exists("_keep", lambda k: S.overlaps(m, k))))
        return F.when(F.size(f"_m{i}") > 0, S.let(free, lambda v: F.zip_with(v, S.cut(F.col("_text"), v), span))).otherwise(F.array().cast(S.SPANS))

    return found.select(*kept, F.concat(*(as_spans(i, p) for i, p in enumerate(patterns))).alias(out))


def detect_simple(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", patterns: tuple[Pattern, ...] = SIMPLE_PATTERNS) -> DataFrame:
    """Rows (id, pii_type, start, end, text) of the smaller engine; the span is group 1 of a match."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    cols = [S.find_all(text, p.regex).alias(f"_m{i}") for i, p in enumerate(patterns)]
    found = docs.select(F.col(id_col), *cols)

    def as_rows(i: int, p: Pattern) -> Column:
        def one(m: Column) -> Column:
            group = F.regexp_extract(m["text"], p.regex.replace(r"\b", ""), 1)
            return F.struct(F.lit(p.pii_type).alias("pii_type"), (m["start"] + F.instr(m["text"], group) - 1).alias("start"), group.alias("text"))

        return F.transform(f"_m{i}", one)

    parts = [as_rows(i, p) for i, p in enumerate(patterns)]
    rows = found.select(F.col(id_col), F.explode_outer(F.concat(*parts)).alias("s")).where("s is not null")
    return rows.select(id_col, "s.pii_type", "s.start", (F.col("s.start") + F.length("s.text")).alias("end"), "s.text")


def fuse(docs: DataFrame, text_col: str = "text", spans_col: str = "spans", compat: bool = False) -> DataFrame:
    """Overlaps resolved, then neighbours merged (``compat``: see ``merge_adjacent``)."""
    rest = [c for c in docs.columns if c != spans_col]
    resolved = docs.select(*rest, S.resolve_overlaps(F.col(spans_col)).alias(spans_col))
    return resolved.select(*rest, S.merge_adjacent(F.col(spans_col), F.coalesce(F.col(text_col), F.lit("")), compat).alias(spans_col))


def detect_composite(docs: DataFrame, model: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pattern spans and model spans (rows id, spans) together, fused."""
    found = detect(docs, text_col=text_col)
    given = model.select(F.col(id_col), F.col("spans").alias("_model"))
    both = found.join(given, id_col, "left").withColumn("spans", F.concat("spans", F.coalesce(F.col("_model").cast(S.SPANS), F.array().cast(S.SPANS))))
    return fuse(both.drop("_model"), text_col)


def merge_regex_model(regex: DataFrame, model: DataFrame, id_col: str = "doc_id", share: float = 0.5) -> DataFrame:
    """All pattern rows, and model rows of whose characters less than ``share`` are covered by
    patterns. Rows are (id, start, end, pii_type); the result adds source.

    Covered characters are counted once: pattern ranges are first merged into islands, which model
    rows meet by stretches of text.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(id_col).orderBy("start", "end")
    reach = regex.select(id_col, "start", "end").withColumn("reach", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    island = reach.withColumn("island", F.sum((F.col("reach").isNull() | (F.col("start") > F.col("reach"))).cast("int")).over(w))
    cover = island.groupBy(id_col, "island").agg(F.min("start").alias("cs"), F.max("end").alias("ce")).drop("island")
    m = model.select(id_col, "start", "end", "pii_type")
    hit = overlap_join(m, cover, id_col, ("start", "end"), ("cs", "ce"))
    covered = hit.groupBy(id_col, "start", "end", "pii_type").agg(
        F.sum(F.when(F.col("ce").isNull(), 0).otherwise(F.least("end", "ce") - F.greatest("start", "cs"))).alias("n")
    )
    kept = covered.where(F.col("n") < F.lit(share) * (F.col("end") - F.col("start"))).select(id_col, "start", "end", "pii_type", F.lit("slm").alias("source"))
    return regex.select(id_col, "start", "end", "pii_type", F.lit("regex").alias("source")).unionByName(kept)


def detection_profile(spans: DataFrame) -> DataFrame:
    """Counts by type and source, and totals (rows of exploded spans in)."""
    return spans.rollup("pii_type", "source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).alias("chars"))


def document_profile(docs: DataFrame, id_col: str = "doc_id", spans_col: str = "spans") -> DataFrame:
    """(id, n_regex, n_model, n_spans, chars, types (pii_type, n)) of each row's spans, without a shuffle; a null
    array counts as empty."""
    spans = F.coalesce(F.col(spans_col), F.array().cast(S.SPANS))
    by = lambda own: F.size(F.filter("_s", lambda s: (s["source"] == "regex") == own))
    kinds = F.array_sort(F.array_distinct(F.transform("_s", lambda s: s["pii_type"])))  # few
    types = F.transform(kinds, lambda k: F.struct(k.alias("pii_type"), F.size(F.filter("_s", lambda s: s["pii_type"].eqNullSafe(k))).alias("n")))
    chars = F.aggregate("_s", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    return docs.select(F.col(id_col), spans.alias("_s")).select(id_col, by(True).alias("n_regex"), by(False).alias("n_model"), F.size("_s").alias("n_spans"), chars.alias("chars"), types.alias("types"))


def aggregate_logits(tokens: DataFrame, strategy: str = "first") -> DataFrame:
    """Word label from subword logits: rows (doc_id, idx, word_id, logits) -> (doc_id, word_id,
    label, score). Special tokens (null word_id) are left out; ties go to the lower label."""
    from pyspark.sql import Window

    if strategy not in ("first", "average", "max"):
        raise ValueError(f"unknown strategy {strategy!r}")
    real = tokens.where("word_id is not null")
    if strategy == "first":
        w = Window.partitionBy("doc_id", "word_id").orderBy("idx")
        real = real.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    long = real.select("doc_id", "word_id", F.posexplode("logits").alias("label", "x"))
    fold = F.max("x") if strategy == "max" else F.avg("x")
    scored = long.groupBy("doc_id", "word_id", "label").agg(fold.alias("x"))
    best = F.max_by(F.struct("label", "x"), F.struct(F.col("x"), -F.col("label")))
    return scored.groupBy("doc_id", "word_id").agg(best.alias("b")).select("doc_id", "word_id", F.col("b.label").alias("label"), F.col("b.x").alias("score"))


def trim_spans(spans: Column, text: Column, abbreviations: tuple[str, ...] = S.ABBREVIATIONS) -> Column:
    """Trim each (start, end, pii_type) element; those trimmed to nothing are dropped."""

    def trimmed(s: Column, t: Column) -> Column:
        lead = F.least(s["start"], F.lit(1))
        before = F.when(lead > 0, F.substring(t, 1, 1)).otherwise(" ")
        return F.struct(S.trim_string(s["start"], before, F.substring(t, lead + 1, F.length(t)), abbreviations).alias("x"), s["pii_type"].alias("pii_type"))

    def all_of(v: Column) -> Column:
        wide = F.transform(v, lambda s: F.struct(F.greatest(s["start"] - 1, F.lit(0)).alias("start"), s["end"].alias("end")))
        kept = F.filter(F.zip_with(v, S.cut(text, wide), trimmed), lambda s: s["x"]["end"] > s["x"]["start"])
        return F.transform(kept, lambda s: F.struct(s["x"]["start"].alias("start"), s["x"]["end"].alias("end"), s["pii_type"].alias("pii_type")))

    return S.let(spans, all_of)


def model_spans(spans: Column, text: Column, confidence: float = 0.85) -> Column:
    """Decoded model spans as full span elements: trimmed, text cut from the source."""

    def span(s: Column, t: Column) -> Column:
        return F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            t.alias("text"),
            s["pii_type"].alias("pii_type"),
            F.lit("slm").alias("source"),
            F.lit(confidence).alias("confidence"),
            F.lit(1000).alias("priority"),
        )

    cut = trim_spans(spans, text, tuple(a for a in S.ABBREVIATIONS if a != "ecc.."))
    return S.let(cut, lambda v: F.zip_with(v, S.cut(text, v), span))
