"""Annotated corpora: conversion, cleaning, validation, formatting, splitting."""

from __future__ import annotations

import bisect
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions import spans as S
from maskwright.functions.frames import bounded_broadcast
from maskwright.functions.patterns import MODEL_TYPES, REGEX_TYPES
from maskwright.functions.ranges import overlap_join
from maskwright.functions.ranks import hash_rank, join_by

# Source type -> type code, by corpus; a null drops the entity.
MULTINERD = {"PER": "pe", "ORG": "org", "LOC": "loc", "DIS": "med", "INST": "org"}
WIKINEURAL = {"PER": "pe", "ORG": "org", "LOC": "loc"}
HUMADEX = {"DISEASE": "med", "SYMPTOM": "med", "DRUG": "med", "TREATMENT": "med"}
AI4PRIVACY = {
    "FIRSTNAME": "pe",
    "LASTNAME": "pe",
    "GIVENNAME": "pe",
    "SURNAME": "pe",
    "FULLNAME": "pe",
    "USERNAME": "pe",
    "MIDDLENAME": "pe",
    "COMPANYNAME": "org",
    "ORGANIZATIONNAME": "org",
    "CITY": "loc",
    "STATE": "loc",
    "COUNTRY": "loc",
    "COUNTY": "loc",
    "NEARBYGPSCOORDINATE": "loc",
    "STREET": "ind",
    "STREETADDRESS": "ind",
    "BUILDINGNUMBER": "ind",
    "ZIPCODE": "ind",
    "SECONDARYADDRESS": "ind",
    "DISEASE": "med",
    "BLOODTYPE": "med",
    "HEIGHT": "med",
    "WEIGHT": "med",
    "AMOUNT": "fin",
    "ACCOUNTNUMBER": "fin",
    "BITCOINADDRESS": "fin",
    "ETHEREUMADDRESS": "fin",
    "LITECOINADDRESS": "fin",
    "JOBTITLE": "pro",
    "JOBAREA": "pro",
    "JOBTYPE": "pro",
    "DOB": "dt",
    "DATEOFBIRTH": "dt",
}
TYPE_MAP = {
    **{("multinerd", k): v for k, v in MULTINERD.items()},
    **{("wikineural", k): v for k, v in WIKINEURAL.items()},
    **{("humadex", k): v for k, v in HUMADEX.items()},
    **{("ai4privacy", k): v for k, v in AI4PRIVACY.items()},
}
NER_LABELS = ("O", *(f"{p}-{t}" for t in MODEL_TYPES for p in "BI"))
WIKINEURAL_LABELS = ("O", "B-PER", "I-PER", "B-ORG", "I-ORG", "B-LOC", "I-LOC", "B-MISC", "I-MISC")
# Entity texts that patterns find (full match).
REGEX_ENTITY = (
    r"[\w.+-]+@[\w-]+\.[\w.-]+",
    r"\+?\d[\d\s\-./]{7,15}\d",
    r"[A-Z]{2}\d{2}\s?[\dA-Z]{4}\s?[\dA-Z]{4}\s?[\dA-Z]{4}\s?[\dA-Z]{4}\s?[\dA-Z]{0,4}",
    r"[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z]",
)
# Cleaning rules.
MED_FACILITY = r"\b(ospedale|clinica|asl|policlinico|pronto\s+soccorso|istituto\s+ortopedico)\b"
CITIES = (
    "milano", "roma", "napoli", "torino", "firenze", "bologna", "genova",
    "palermo", "bari", "catania", "venezia", "verona", "padova", "trieste",
    "brescia", "bergamo", "modena", "parma", "perugia", "cagliari", "livorno",
    "ravenna", "rimini", "salerno", "pisa", "lecce", "ancona", "pescara",
    "como", "reggio", "messina", "vicenza", "trento", "siena", "treviso",
    "monza", "foggia", "ferrara", "sassari", "latina", "giugliano", "reggio emilia",
)
CITY_LIKE = r"^[A-ZÀÈÉÌÒÙ][a-zàèéìòùA-ZÀÈÉÌÒÙ]{3,}$"
IGNORE = -100

RAW = "array<struct<type:string,start:int,end:int>>"


def map_types(entities: DataFrame, dataset_col: str = "dataset", type_col: str = "type") -> DataFrame:
    """Add ``code`` and ``reject_reason`` (``unmapped:TYPE``) to entity rows; the map is a small literal."""
    table = entities.sparkSession.createDataFrame([(d, k, v) for (d, k), v in TYPE_MAP.items()], "_d string, _t string, code string")
    joined = entities.join(F.broadcast(table), (F.col(dataset_col) == F.col("_d")) & (F.upper(type_col) == F.col("_t")), "left").drop("_d", "_t")
    return joined.withColumn("reject_reason", F.when(F.col("code").isNull(), F.concat(F.lit("unmapped:"), F.upper(type_col))))


def label_names(tags: Column, names: tuple[str, ...]) -> Column:
    """Tag ids to labels; an id out of range is O."""
    table = F.array(*map(F.lit, names))
    return F.transform(tags, lambda i: F.when(i.between(0, len(names) - 1), F.get(table, i)).otherwise("O"))


#: Rows that are folded at once; their tokens are held as numbers.
FOLD_ROWS = 256


def _searched(words: list[str | None], text: str) -> list[int]:
    """Where each word is found in a text, behind the one found before; -1 where it is not."""
    found, pos = [], 0
    for word in words:
        at = -1 if word is None else text.find(word, pos)
        found.append(at)
        if at >= 0:
            pos = at + len(word)
    return found


def _fold(words: pa.Array, tags: pa.Array, texts: pa.Array, stray: str) -> pa.Array:
    """The spans of each row of a batch. All tokens are folded at once: a span is a token that opens
    one and those behind it that go on, and both can be told from the last token that is no I-."""
    n_words, n_tags = (pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False) for x in (words, tags))
    good = (n_words > 0) & (n_words == n_tags)
    keep, size = pa.array(good), n_words[good]
    word, tag, text = words.filter(keep).flatten(), tags.filter(keep).flatten(), texts.filter(keep)
    first, row = np.cumsum(size) - size, np.repeat(np.arange(len(size)), size)
    length = pc.fill_null(pc.utf8_length(word), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.cumsum(length + 1) - length - 1
    start -= start[first][row]
    for r in np.flatnonzero(pc.is_valid(text).to_numpy(zero_copy_only=False)):
        part = slice(first[r], first[r] + size[r])
        start[part] = _searched(word[part].to_pylist(), text[r].as_py())

    coded = pc.dictionary_encode(pc.fill_null(tag, "O"))
    known = coded.dictionary.to_pylist()
    kinds = sorted({k[2:] for k in known})
    index = coded.indices.to_numpy(zero_copy_only=False)
    head = np.array([{"B-": 1, "I-": 2}.get(k[:2], 0) for k in known], np.int8)[index]
    kind = np.array([kinds.index(k[2:]) for k in known], np.int64)[index]
    head[start < 0] = 0

    at, fresh, inner = np.arange(len(head)), np.zeros(len(head), bool), head == 2
    fresh[first] = True
    if stray == "open":
        same = np.zeros(len(head), bool)
        same[1:] = (head[:-1] != 0) & (kind[:-1] == kind[1:])
        goes = inner & same & ~fresh
        opens = (head == 1) | (inner & ~goes)
    else:
        anchor = np.maximum.accumulate(np.where(~inner | fresh, at, 0))
        opens, goes = head == 1, inner & (head[anchor] == 1)
        if stray == "drop":
            goes &= np.maximum.accumulate(np.where(inner & (kind != kind[anchor]), at, -1)) < anchor
    ends = (opens | goes) & ~np.append(goes[1:], False)

    n_spans = np.zeros(len(words), np.int64)
    n_spans[good] = np.bincount(row[opens], minlength=len(size))
    names = pa.array(kinds, pa.string()).take(pa.array(kind[opens]))
    spans = pa.StructArray.from_arrays([names, pa.array(start[opens], pa.int32()), pa.array((start + length)[ends], pa.int32())], ["type", "start", "end"])
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n_spans)), pa.int32()), spans, mask=pa.array(~good))


def fold_labels(tokens: Column, labels: Column, stray: str = "drop", text: Column | None = None) -> Column:
    """Spans (type, start, end) of BIO labels by one ordered fold.

    ``stray`` says what an I- label does that does not go on the open type: ``drop`` closes and
    drops, ``extend`` lets any I- go on whatever is open, ``open`` opens its own type. Offsets are
    those of the tokens joined by single spaces; with ``text`` (not null) each token is searched in it
    from where the last one ended, and one that is not found closes what is open. Null for null, empty
    or unequal arrays; a null label is O, a null token is empty, and found in no text.

    The fold runs on the flat arrays of Arrow batches: Spark's ``aggregate`` copies what it has
    gathered at every element, which is quadratic for texts of thousands of tokens.
    """
    if stray not in ("drop", "extend", "open"):
        raise ValueError(f"unknown mode {stray!r}")

    def run(words: pa.Array, tags: pa.Array, texts: pa.Array) -> pa.Array:
        parts = [_fold(words[i : i + FOLD_ROWS], tags[i : i + FOLD_ROWS], texts[i : i + FOLD_ROWS], stray) for i in range(0, len(words), FOLD_ROWS)]
        return pa.concat_arrays(parts) if parts else _fold(words, tags, texts, stray)

    return F.arrow_udf(run, RAW)(tokens, labels, F.lit(None).cast("string") if text is None else text)


def parse_span_json(text: Column, spans: Column) -> Column:
    """A JSON list of {label|type|entity_type, text|value, start?, end?} as (label, text, start, end);
    missing offsets are those of the first occurrence. Null where it is no JSON list."""
    kind = "array<struct<label:string,type:string,entity_type:string,text:string,value:string,start:int,end:int>>"
    blank = lambda c: F.nullif(c, F.lit(""))
    picked = F.transform(
        F.from_json(spans, kind),
        lambda x: F.struct(
            F.upper(F.coalesce(blank(x["label"]), blank(x["type"]), blank(x["entity_type"]), F.lit(""))).alias("label"),
            F.coalesce(blank(x["text"]), x["value"], F.lit("")).alias("text"),
            x["start"].alias("start"),
            x["end"].alias("end"),
        ),
    )
    both = lambda x: x["start"].isNotNull() & x["end"].isNotNull()
    at = lambda x: F.instr(text, x["text"]) - 1
    return F.transform(
        picked,
        lambda x: F.struct(
            x["label"].alias("label"),
            x["text"].alias("text"),
            F.when(both(x), x["start"]).otherwise(at(x)).alias("start"),
            F.when(both(x), x["end"]).otherwise(at(x) + F.length(x["text"])).alias("end"),
        ),
    )


def parse_label_string(labels: Column) -> Column:
    """``TYPE: text, TYPE: text`` as (label, text); parts of another form are left out."""
    parts = F.transform(F.split(labels, r",\s*"), lambda p: F.trim(p))
    hits = F.filter(parts, lambda p: p.rlike(r"^\w+\s*:\s*.+"))
    return F.transform(hits, lambda p: F.struct(F.upper(F.regexp_extract(p, r"^(\w+)\s*:", 1)).alias("label"), F.trim(F.regexp_extract(p, r"^\w+\s*:\s*(.+)", 1)).alias("text")))


def looks_like_pattern(text: Column) -> Column:
    return F.trim(text).rlike("(?U)^(?:" + "|".join(REGEX_ENTITY) + ")$")


def offsets_hold(text: Column, start: Column, end: Column, own: Column) -> Column:
    inside = (start >= 0) & (end <= F.length(text)) & (start < end)
    return F.coalesce(inside & (F.substring(text, start + 1, end - start) == own), F.lit(False))


def clean_reason(kind: Column, text: Column) -> Column:
    """The rule that removes an entity, null if none does."""
    return (
        F.when((kind == "pe") & text.rlike("^[a-zA-Z0-9]{3,12}$") & text.rlike("[0-9]") & text.rlike("[a-zA-Z]"), "pe_code")
        .when((kind == "ind") & text.rlike("^[0-9]+$") & (F.length(text) < 5), "ind_bare_number")
        .when((kind == "dt") & text.rlike(r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}"), "dt_structured")
        .when((kind == "med") & text.rlike(f"(?i){MED_FACILITY}"), "med_facility")
    )


def org_city(kind: Column, text: Column) -> Column:
    return (kind == "org") & text.rlike(CITY_LIKE) & F.lower(text).isin(*CITIES)


def cleaning_report(entities: DataFrame, source: str = "_source") -> DataFrame:
    """Entities in, out, removed and flagged, by source and in all: rows of (source, type, text) in."""
    marked = entities.withColumn("_why", clean_reason(F.col("type"), F.col("text"))).withColumn("_city", org_city(F.col("type"), F.col("text")))
    return marked.rollup(source).agg(
        F.count(F.lit(1)).alias("n_in"),
        F.sum(F.col("_why").isNull().cast("long")).alias("n_out"),
        *(F.sum((F.col("_why") == r).cast("long")).alias(f"n_{r}") for r in ("pe_code", "ind_bare_number", "dt_structured", "med_facility")),
        F.sum((F.col("_city") & F.col("_why").isNull()).cast("long")).alias("n_org_city"),
    ).na.fill(0)


def validate_spans(examples: DataFrame, types: tuple[str, ...] = MODEL_TYPES) -> DataFrame:
    """Add ``reason``: the first failure of (text, entities) rows, null for valid ones. No shuffle: the
    checks run over the entity array and the first that fails counts."""

    def why(x: Column, last: Column, text: Column) -> Column:
        return (
            F.when(x["text"].isNull() | x["type"].isNull() | x["start"].isNull() | x["end"].isNull(), "entity_missing_keys")
            .when(~x["type"].isin(*types), F.concat(F.lit("invalid_label_"), x["type"]))
            .when((x["start"] < 0) | (x["end"] > F.length(text)) | (x["start"] >= x["end"]), "offset_out_of_bounds")
            .when(F.substring(text, x["start"] + 1, x["end"] - x["start"]) != x["text"], "offset_mismatch")
            .when(x["start"] < last, "overlapping_entities")
        )

    start = F.struct(F.lit(-1).alias("last"), F.lit(None).cast("string").alias("why"), F.col("text").alias("text"))
    fold = F.aggregate(
        "entities",
        start,
        lambda a, x: F.struct(F.coalesce(x["end"], a["last"]).alias("last"), F.coalesce(a["why"], why(x, a["last"], a["text"])).alias("why"), a["text"].alias("text")),
        lambda a: a["why"],
    )
    reason = F.when(F.coalesce(F.col("text"), F.lit("")) == "", "missing_text").when(F.col("entities").isNull(), "missing_entities_key").otherwise(fold)
    return examples.withColumn("reason", reason)


SYSTEM_PROMPT = "Find personal data and answer with a JSON list."


def to_chat(examples: DataFrame, prompt: str = SYSTEM_PROMPT) -> DataFrame:
    """Replace text and entities by ``messages``: system, user, assistant (compact JSON)."""
    rest = [c for c in examples.columns if c not in ("text", "entities")]
    compact = F.transform("entities", lambda x: F.struct(x["text"].alias("t"), x["type"].alias("y"), x["start"].alias("s"), x["end"].alias("e")))
    said = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    answer = F.coalesce(F.to_json(compact), F.lit("[]"))
    return examples.select(*rest, F.array(said("system", F.lit(prompt)), said("user", F.col("text")), said("assistant", answer)).alias("messages"))


def validate_chat(rows: DataFrame, prompt: str = SYSTEM_PROMPT) -> DataFrame:
    """Add ``fatal`` (first failed structural check or null) and ``prompt_differs``."""
    roles = F.transform("messages", lambda m: m["role"])
    content = lambda i: F.get("messages", F.lit(i))["content"]
    answer = F.try_parse_json(content(2))
    fatal = (
        F.when(F.col("messages").isNull(), "has_messages")
        .when(F.size("messages") != 3, "message_count")
        .when(F.array_join(roles, ",", "?") != "system,user,assistant", "message_roles")
        .when(answer.isNull(), "assistant_json")
        .when(~F.ltrim(content(2)).startswith("["), "assistant_is_list")
    )
    return rows.withColumn("fatal", fatal).withColumn("prompt_differs", fatal.isNull() & (content(0) != prompt))


def _meet_earlier(starts: list[int | None], ends: list[int | None]) -> list[bool]:
    """Whether each range overlaps one listed before it. The furthest end of the ranges that start below a
    place is kept in a tree over the starts, so that each range costs steps of the logarithm of their number."""
    known = sorted({s for s in starts if s is not None})
    furthest, found = [-1] * (len(known) + 1), []
    for s, e in zip(starts, ends, strict=True):
        if s is None or e is None:
            found.append(False)
            continue
        i, far = bisect.bisect_left(known, e), -1
        while i:
            far, i = max(far, furthest[i]), i & (i - 1)
        found.append(far > s)
        i = bisect.bisect_left(known, s) + 1
        while i <= len(known):
            furthest[i] = max(furthest[i], e)
            i += i & -i
    return found


def meet_earlier(starts: Column, ends: Column) -> Column:
    """For the ranges of arrays of starts and ends, whether each overlaps an earlier one; null for null arrays."""

    def run(starts: pa.Array, ends: pa.Array) -> pa.Array:
        return pa.array([None if s is None else _meet_earlier(s, e) for s, e in zip(starts.to_pylist(), ends.to_pylist(), strict=True)], pa.list_(pa.bool_()))

    return F.arrow_udf(run, "array<boolean>")(starts, ends)


def validate_entities(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """All failures of chat entities (text, entities with t/y/s/e): rows (id, place, error)."""
    starts, ends = F.transform("entities", lambda x: x["s"]), F.transform("entities", lambda x: x["e"])
    met = rows.select(id_col, F.length("text").alias("n"), "entities", meet_earlier(starts, ends).alias("_met"), S.cut(F.col("text"), F.transform("entities", lambda x: F.struct(F.greatest(x["s"], F.lit(0)).alias("start"), x["e"].alias("end")))).alias("_own"))
    zipped = met.select(id_col, "n", F.posexplode_outer(F.arrays_zip("entities", "_met", "_own")).alias("place", "z")).where("z is not null")
    numbered = zipped.select(id_col, "n", "place", F.col("z.entities").alias("x"), F.col("z._met").alias("met"), F.col("z._own").alias("own"))
    e, n = F.col("x"), F.col("n")
    bounds = (e["s"] < 0) | (e["e"] > n) | (e["s"] >= e["e"])
    missing = e["t"].isNull() | e["y"].isNull() | e["s"].isNull() | e["e"].isNull()
    errors = F.when(missing, F.array(F.lit("entity_keys"))).otherwise(F.array(F.lit(None).cast("string")))
    errors = F.concat(
        errors,
        F.array(
            F.when(~missing & ~e["y"].isin(*MODEL_TYPES), "entity_type_valid"),
            F.when(~missing & e["y"].isin(*REGEX_TYPES), "no_regex_types"),
            F.when(~missing & bounds, "offset_bounds").when(~missing & (F.col("own") != e["t"]), "offset_alignment"),
            F.when(F.col("met"), "no_overlap"),
        ),
    )
    return numbered.select(id_col, "place", F.explode_outer(errors).alias("error")).where("error is not null")


def validation_report(examples: DataFrame, splits: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """Counts by split of examples (split, source, entities with ``type``): rows (kind, name) with a column for each
    split and ``total``. Kinds: ``examples``; ``type``, entities of a type, and examples without any under EMPTY;
    ``source``, examples of a source. One pass, whose partial sums hold a row for each kind and name."""
    row = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.alias("name"))
    types = F.transform(F.when(F.size("entities") > 0, F.transform("entities", lambda x: x["type"])).otherwise(F.array(F.lit("EMPTY"))), lambda y: row("type", y))
    marks = F.concat(F.array(row("examples", F.lit("all"))), types, F.array(row("source", F.col("source"))))
    long = examples.select("split", F.explode_outer(marks).alias("m"))
    sums = [F.sum((F.col("split") == s).cast("long")).alias(s) for s in splits]
    return long.groupBy("m.kind", "m.name").agg(*(F.coalesce(c, F.lit(0)).alias(s) for c, s in zip(sums, splits, strict=True)), F.count(F.lit(1)).alias("total"))


def first_errors(errors: DataFrame, order: list[str], most: int = 50) -> DataFrame:
    """The first ``most`` rows of validation errors, with ``n_errors``, how many there are in all. Each task keeps
    its own first rows, so the one that merges them holds few."""
    n = errors.agg(F.count(F.lit(1)).alias("n_errors"))
    return errors.orderBy(*order).limit(most).join(F.broadcast(n), how="cross")  # one row


def mix_sources(sources: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(examples, counts): the examples (text, entities, ...) of all sources under ``_source``, without empty texts,
    and for each source how many there are, with and without entities. A row's own ``_source`` goes before the
    name it is given; columns that a source lacks are null."""
    named = [(df if "_source" in df.columns else df.withColumn("_source", F.lit(None).cast("string"))).withColumn("_source", F.coalesce("_source", F.lit(name))) for name, df in sources.items()]
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named).where(F.trim("text") != "")
    some = (F.coalesce(F.size("entities"), F.lit(0)) > 0).cast("long")
    return whole, whole.groupBy("_source").agg(F.count(F.lit(1)).alias("n"), F.sum(some).alias("n_with"), F.sum(1 - some).alias("n_without"))


def validate_bio(rows: DataFrame, id_col: str = "doc_id", labels: str = "labels", names: tuple[str, ...] = NER_LABELS) -> DataFrame:
    """(id, bad_range, bad_bio): the first position of a label out of range, and of an I- that does not
    follow its own type (ignored labels left out); null where there is none."""
    text = F.transform(F.col(labels), lambda i: F.when(i.between(0, len(names) - 1), F.get(F.array(*map(F.lit, names)), i)).otherwise("O"))
    base = rows.select(id_col, labels, text.alias("_names"))
    wrong = F.filter(F.transform(labels, lambda x, i: F.when(~x.between(0, len(names) - 1) & (x != IGNORE), i)), lambda i: i.isNotNull())
    kept = F.filter(F.transform("_names", lambda y, i: F.struct(i.alias("i"), y.alias("y"))), lambda x: F.get(F.col(labels), x["i"]) != IGNORE)
    start = F.struct(F.lit("O").alias("last"), F.lit(None).cast("int").alias("bad"))
    step = lambda a, x: F.struct(
        x["y"].alias("last"),
        F.coalesce(a["bad"], F.when(x["y"].startswith("I-") & ((F.substring(x["y"], 3, 9) != F.substring(a["last"], 3, 9)) | (a["last"] == "O")), x["i"])).alias("bad"),
    )
    return base.select(id_col, F.get(wrong, F.lit(0)).alias("bad_range"), F.aggregate(kept, start, step, lambda a: a["bad"]).alias("bad_bio"))


def spans_to_bio(tokens: DataFrame, spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Label ids of tokens (id, idx, word_id, cs, ce) from spans (id, start, end, type): special tokens
    and subwords behind the first are ignored; the first overlapping span by start labels a token,
    B- where the token starts at or before it. Tokens meet the spans of their own stretch of text."""
    key = [id_col, "idx", "word_id", "cs", "ce"]
    hit = overlap_join(tokens.select(*key), spans.select(id_col, "start", "end", "type"), id_col, ("cs", "ce"), ("start", "end"))
    best = hit.groupBy(*key).agg(F.min(F.when(F.col("start").isNotNull(), F.struct("start", "end", "type"))).alias("b"))
    before = F.lag("word_id").over(Window.partitionBy(id_col).orderBy("idx"))
    ids = F.create_map(*(F.lit(x) for i, n in enumerate(NER_LABELS) for x in (n, i)))
    name = F.concat(F.when(F.col("cs") <= F.col("b.start"), "B-").otherwise("I-"), F.col("b.type"))
    label = F.when(F.col("word_id").isNull() | (F.col("word_id") == F.coalesce(before, F.lit(-1))), IGNORE).when(F.col("b.type").isNull(), 0).otherwise(F.coalesce(F.element_at(ids, name), F.lit(0)))
    return best.withColumn("label", label).select(id_col, "idx", "label")


def stratum(types: Column) -> Column:
    return F.when(F.size(types) > 0, F.array_join(F.array_sort(F.array_distinct(types)), "+")).otherwise("EMPTY")


def collapse_rare(df: DataFrame, key: str = "stratum") -> DataFrame:
    """Strata of one row become RARE; if even RARE has one row, all become ALL (no stratification). Rows
    without a stratum are a stratum of their own."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    named = sizes.withColumn("_to", F.when(F.col("_n") < 2, "RARE").otherwise(F.col(key)))
    least = named.groupBy("_to").agg(F.sum("_n").alias("_m")).agg(F.min("_m").alias("_least"))
    table = named.join(F.broadcast(least), how="cross")  # one row
    table = table.select(F.col(key), F.when(F.col("_least") < 2, "ALL").otherwise(F.col("_to")).alias("_to"))
    return join_by(df, bounded_broadcast(table), [key]).withColumn(key, F.col("_to")).drop("_to")


def stratified_split(df: DataFrame, id_col: str, key: str = "stratum", ratios: tuple[float, float] = (0.8, 0.1), seed: int = 42) -> DataFrame:
    """Add ``split``: in each stratum, the one without a name too, the first rows in hash order train, the
    next validate, the rest test."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    ranked = join_by(hash_rank(df, [key], id_col, seed, "_r"), bounded_broadcast(sizes), [key])
    a = F.floor(F.col("_n") * F.lit(ratios[0]) + 1e-9)
    b = a + F.floor(F.col("_n") * F.lit(ratios[1]) + 1e-9)
    return ranked.withColumn("split", F.when(F.col("_r") <= a, "train").when(F.col("_r") <= b, "val").otherwise("test")).drop("_n", "_r")


def split_distribution(df: DataFrame, types: str = "types") -> DataFrame:
    """Entities of each type by split (EMPTY: rows without any), one column a split."""
    long = df.select("split", F.explode_outer(F.when(F.size(types) > 0, F.col(types)).otherwise(F.array(F.lit("EMPTY")))).alias("type"))
    return long.groupBy("type").pivot("split", ["train", "val", "test"]).count().na.fill(0)
