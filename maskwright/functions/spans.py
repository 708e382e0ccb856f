"""Span arrays as column expressions. Offsets count code points, ends are exclusive.

Spark evaluates a lambda's body for every element, so whatever a lambda needs travels
inside the folded array or the accumulator, never as an expression of its own.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.functions.patterns import LOOK_ALIKE

RANGES = "array<struct<start:int,end:int,text:string>>"
SPANS = "array<struct<start:int,end:int,text:string,pii_type:string,source:string,confidence:double,priority:int>>"


#: Long arrays are worked on in blocks of this size. An aggregate copies what it has gathered at every
#: step, and ``substring`` walks a text from its start, so both stay inside a block and its stretch of text.
BLOCK = 128


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _blocks(items: Column) -> Column:
    """An array in slices of BLOCK elements; an empty one has one empty slice. ``items`` is a variable."""
    last = F.floor((F.greatest(F.size(items), F.lit(1)) - 1) / BLOCK).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(items, i * BLOCK + 1, F.lit(BLOCK)))


def cut(text: Column, ranges: Column) -> Column:
    """The text of each (start, end, ...) range, in time linear in text and ranges if they are about in order."""

    def stretch(block: Column) -> Column:
        low, high = F.array_min(F.transform(block, lambda r: r["start"])), F.array_max(F.transform(block, lambda r: r["end"]))
        return F.struct(block.alias("ranges"), low.alias("low"), (high - low).alias("size"))

    def of(t: Column, v: Column) -> Column:
        local = F.transform(F.transform(_blocks(v), stretch), lambda b: F.struct(b["ranges"].alias("ranges"), b["low"].alias("low"), F.substring(t, b["low"] + 1, b["size"]).alias("text")))
        return F.flatten(F.transform(local, lambda b: F.transform(b["ranges"], lambda r: F.substring(b["text"], r["start"] - b["low"] + 1, r["end"] - r["start"]))))

    return let(text, lambda t: let(ranges, lambda v: of(t, v)))


def find_all(text: Column, regex: str, guard: str | None = None) -> Column:
    """Every match of a pattern that never matches the empty string: (start, end, text).

    A text without a match is searched once, one that fails the cheap guard not at all; the gaps are
    cut only where there are matches. Lengths are added up inside blocks, then over the blocks.
    """
    found = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    found = F.when(text.rlike(guard), found) if guard else found
    kind = F.array().cast(RANGES)

    def inside(block: Column, base: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            at = acc["pos"] + x["gap"]
            end = at + F.length(x["m"])
            return F.struct(end.alias("pos"), F.concat(acc["part"], F.array(F.struct(at.alias("start"), end.alias("end"), x["m"].alias("text")))).alias("part"))

        return F.aggregate(block, F.struct(base.alias("pos"), kind.alias("part")), step, lambda acc: acc["part"])

    def add_up(blocks: Column) -> Column:
        sizes = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + x["gap"] + F.length(x["m"])))
        none = F.array().cast("array<int>")
        more = lambda acc, n: F.struct((acc["pos"] + n).alias("pos"), F.concat(acc["bases"], F.array(acc["pos"])).alias("bases"))
        bases = F.aggregate(sizes, F.struct(F.lit(0).alias("pos"), none.alias("bases")), more, lambda acc: acc["bases"])
        return F.flatten(F.zip_with(blocks, bases, inside))

    def place(matches: Column) -> Column:
        gaps = F.slice(F.transform(F.split(text, regex, -1), lambda g: F.length(g)), 1, F.size(matches))
        hits = F.zip_with(gaps, matches, lambda g, m: F.struct(g.alias("gap"), m.alias("m")))
        return F.when(F.size(matches) > 0, let(hits, lambda h: let(_blocks(h), add_up))).otherwise(kind)

    return let(found, place)


@cache
def _fold_table() -> tuple[str, str]:
    """One-to-one letters: compatibility forms, look-alikes, then the plain letter of accented ones."""
    source, target = [], []
    for code in range(0x80, 0x110000):
        if 0xD800 <= code < 0xE000:
            continue
        ch = chr(code)
        new = unicodedata.normalize("NFKC", ch)
        if len(new) != 1:
            continue
        new = LOOK_ALIKE.get(new, new)
        if ord(new) > 127:
            plain = unicodedata.normalize("NFKD", new).encode("ascii", "ignore").decode()
            new = plain if len(plain) == 1 else new
        if new != ch:
            source.append(ch)
            target.append(new)
    return "".join(source), "".join(target)


def fold_confusables(text: Column) -> Column:
    """Look-alikes to plain letters, one for one, so offsets stay; plain ASCII is left as it is."""
    source, target = _fold_table()
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, source, target)).otherwise(text)


def replace_ranges(text: Column, ranges: Column, new) -> Column:
    """Rewrite disjoint sorted ranges; ``new`` maps a range element to its replacement."""

    def rewritten(t: Column, v: Column) -> Column:
        ends = F.concat(F.array(F.lit(0)), F.transform(v, lambda r: r["end"]))
        gaps = F.zip_with(F.slice(ends, 1, F.size(v)), v, lambda e, r: F.struct(e.alias("start"), r["start"].alias("end")))
        parts = F.zip_with(cut(t, gaps), v, lambda g, r: F.concat(g, new(r)))
        return F.concat(F.array_join(parts, ""), F.substring(t, F.element_at(v, -1)["end"] + 1, F.length(t)))

    return F.when(F.size(ranges) > 0, let(text, lambda t: let(ranges, lambda v: rewritten(t, v)))).otherwise(text)


def nul_fill(x: Column) -> Column:
    """As many NUL characters as a match has."""
    return F.repeat(F.lit("\0"), F.length(x["text"]))


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def iou(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Character intersection over union of two ranges, 0 where both are empty."""
    shared = F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))
    union = (a_end - a_start) + (b_end - b_start) - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def by_start_then_longest(spans: Column) -> Column:
    """Sort by start, longer first, then the pattern's priority, then source and type."""
    key = lambda s: F.struct(s["start"], -s["end"], s["priority"], s["source"], s["pii_type"], s["confidence"])
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(key(s).alias("k"), s.alias("s"))))
    return F.transform(keyed, lambda x: x["s"])


def _fold(spans: Column, kind: str, join) -> Column:
    """Each span and the last one kept become one where ``join(last, span)`` gives (whether, joined); else both
    stay. Blocks are folded one after another, with the last span handed on."""
    none, no_last = F.array().cast(kind), F.lit(None).cast(kind[len("array<") : -1])

    def step(acc: Column, s: Column) -> Column:
        last = acc["last"]
        joins, joined = join(last, s)
        keep = last.isNull() | joins
        return F.struct(
            F.when(keep, acc["part"]).otherwise(F.concat(acc["part"], F.array(last))).alias("part"),
            F.when(last.isNotNull() & joins, joined).otherwise(s).alias("last"),
        )

    def block(acc: Column, b: Column) -> Column:
        first = F.struct(none.alias("part"), acc["last"].alias("last"))
        return F.aggregate(b, first, step, lambda r: F.struct(F.concat(acc["done"], F.array(r["part"])).alias("done"), r["last"].alias("last")))

    start = F.struct(F.array().cast(f"array<{kind}>").alias("done"), no_last.alias("last"))
    end = lambda acc: F.flatten(F.concat(acc["done"], F.array(F.when(acc["last"].isNotNull(), F.array(acc["last"])).otherwise(none))))
    return let(spans, lambda v: F.aggregate(_blocks(v), start, block, end))


def resolve_overlaps(spans: Column) -> Column:
    """Disjoint spans: an overlap with the last kept span goes to a pattern over a model, then to
    the longer, else to the one that was there."""

    def join(last: Column, s: Column) -> tuple[Column, Column]:
        longer = (s["end"] - s["start"]) > (last["end"] - last["start"])
        better = F.when((s["source"] == "regex") & (last["source"] != "regex"), True).when((s["source"] != "regex") & (last["source"] == "regex"), False).otherwise(longer)
        return s["start"] < last["end"], F.when(better, s).otherwise(last)

    return _fold(by_start_then_longest(spans), SPANS, join)


def merge_adjacent(spans: Column, text: Column, compat: bool = False) -> Column:
    """Merge neighbours of one type with a gap of at most one character. The pattern source wins,
    confidences are averaged pair by pair from left to right, the text is cut anew; with ``compat``
    it is the texts of the parts, with a space for whatever character lies between them."""

    def join(last: Column, s: Column) -> tuple[Column, Column]:
        gap = s["start"] - last["end"]
        joined = F.struct(
            last["start"].alias("start"),
            s["end"].alias("end"),
            (F.concat(last["text"], F.repeat(F.lit(" "), gap), s["text"]) if compat else F.lit(None).cast("string")).alias("text"),
            last["pii_type"].alias("pii_type"),
            F.when((last["source"] == "regex") | (s["source"] == "regex"), "regex").otherwise(last["source"]).alias("source"),
            ((last["confidence"] + s["confidence"]) / 2).alias("confidence"),
            last["priority"].alias("priority"),
        )
        return F.coalesce((last["pii_type"] == s["pii_type"]) & gap.between(0, 1), F.lit(False)), joined

    merged = _fold(spans, SPANS, join)
    if compat:
        return merged
    rest = ("pii_type", "source", "confidence", "priority")
    anew = lambda s, t: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.coalesce(s["text"], t).alias("text"), *(s[c].alias(c) for c in rest))
    return let(merged, lambda v: F.when(F.exists(v, lambda s: s["text"].isNull()), F.zip_with(v, cut(text, v), anew)).otherwise(v))


# Punctuation that is cut from span ends, and abbreviations that keep their period.
LEADING, TRAILING = "[{<", ",:;]}>?—–!"
ABBREVIATIONS = ("dott.", "ing.", "avv.", "geom.", "prof.", "arch.", "rag.", "sig.", "sigg.", "spett.", "ecc.", "ecc..")
INITIALS = r"[A-Z](?:\.[a-zA-Z])+\.$"
QUOTES = "'’"


def trim_punctuation(start: Column, end: Column, text: Column, abbreviations: tuple[str, ...] = ABBREVIATIONS) -> Column:
    """(start, end) of a span without outer punctuation; end <= start if nothing is left."""
    before = F.when(start > 0, F.substring(text, start, F.lit(1))).otherwise(" ")
    return trim_string(start, before, F.substring(text, start + 1, end - start), abbreviations)


def trim_string(start: Column, before: Column, span: Column, abbreviations: tuple[str, ...] = ABBREVIATIONS) -> Column:
    """``trim_punctuation`` of a span's own text and the character before it.

    One fold over the span's length moves the start, another the end, one step at a time.
    """
    among = lambda ch, chars: (ch != "") & F.contains(F.lit(chars), ch)
    char = lambda t, i: F.substring(t, i + 1, F.lit(1))

    def moves(v: Column) -> Column:
        steps = F.sequence(F.lit(0), F.length(v["t"]))
        lead0 = F.struct(F.lit(0).alias("s"), F.lit(False).alias("done"), F.length(v["t"]).alias("e"), v["t"].alias("t"))

        def lead(a: Column, _: Column) -> Column:
            ch = char(a["t"], a["s"])
            prior = F.when(a["s"] > 0, char(a["t"], a["s"] - 1)).otherwise(v["before"])
            off = among(ch, LEADING) | (among(ch, '"(') & among(prior, " \n\t"))
            go = ~a["done"] & (a["s"] < a["e"]) & off
            return F.struct((a["s"] + go.cast("int")).alias("s"), (~go).alias("done"), a["e"].alias("e"), a["t"].alias("t"))

        def trail(a: Column, _: Column) -> Column:
            ch = char(a["t"], a["e"] - 1)
            prior = F.when(a["e"] - 2 >= a["s"], char(a["t"], a["e"] - 2)).otherwise("")
            third = F.when(a["e"] - 3 >= a["s"], char(a["t"], a["e"] - 3)).otherwise("")
            whole = F.substring(a["t"], a["s"] + 1, a["e"] - a["s"])
            head = F.substring(a["t"], a["s"] + 1, a["e"] - a["s"] - 1)
            short = whole.rlike(INITIALS) | F.lower(F.substring_index(whole, " ", -1)).isin(*abbreviations)
            n = (
                F.when(among(ch, TRAILING), 1)
                .when(ch == ".", F.when(short, 0).otherwise(1))
                .when(ch == ")", F.when(F.contains(head, F.lit("(")), 0).otherwise(1))
                .when((ch == "s") & (a["e"] - a["s"] >= 3) & among(prior, QUOTES) & third.rlike(r"^\p{L}$"), 2)
                .when(among(ch, QUOTES), F.when(prior.rlike(r"^\p{L}$"), 0).otherwise(1))
                .when(ch == '"', 1)
                .otherwise(0)
            )
            n = F.when(a["done"] | (a["e"] <= a["s"]), 0).otherwise(n)
            return F.struct(a["s"].alias("s"), (n == 0).alias("done"), (a["e"] - n).alias("e"), a["t"].alias("t"))

        reset = lambda a: F.struct(a["s"].alias("s"), F.lit(False).alias("done"), a["e"].alias("e"), a["t"].alias("t"))
        led = F.aggregate(steps, lead0, lead, reset)
        return F.aggregate(steps, led, trail, lambda a: F.struct((v["start"] + a["s"]).alias("start"), (v["start"] + a["e"]).alias("end")))

    return let(F.struct(start.alias("start"), before.alias("before"), span.alias("t")), moves)


def merge_adjacent_typed(spans: Column, text: Column) -> Column:
    """Merge neighbours of one type over one space; addresses over one or two of space and comma.
    Elements are (start, end, pii_type); the text is cut anew."""
    kind = "array<struct<start:int,end:int,pii_type:string,before:string>>"

    def join(last: Column, s: Column) -> tuple[Column, Column]:
        size = s["start"] - last["end"]
        gap = F.when(size.between(1, 2), F.right(s["before"], size))
        close = F.when(s["pii_type"] == "ind", gap.rlike("^[ ,]{1,2}$")).otherwise(gap == " ")
        joined = F.struct(last["start"].alias("start"), s["end"].alias("end"), last["pii_type"].alias("pii_type"), last["before"].alias("before"))
        return F.coalesce((last["pii_type"] == s["pii_type"]) & close, F.lit(False)), joined

    def with_before(v: Column) -> Column:
        two = F.transform(v, lambda s: F.struct(F.greatest(s["start"] - 2, F.lit(0)).alias("start"), s["start"].alias("end")))
        return F.zip_with(v, cut(text, two), lambda s, t: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["pii_type"].alias("pii_type"), t.alias("before")))

    merged = _fold(let(spans, with_before).cast(kind), kind, join)
    return F.transform(merged, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["pii_type"].alias("pii_type")))
