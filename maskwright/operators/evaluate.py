"""Scores of detectors from gold and predicted spans: rows (doc_id, type, start, end)."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions.frames import materialise
from maskwright.functions.ranges import overlap_join
from maskwright.functions.ranks import join_by, value_rank
from maskwright.functions.spans import iou
from maskwright.operators.corpus import FOLD_ROWS, IGNORE

#: Targets of a report (metric, target, is a floor).
TARGETS = (
    ("exact_f1", 0.85, True),
    ("partial_f1", 0.90, True),
    ("precision", 0.90, True),
    ("recall", 0.80, True),
    ("hard_negative_fp_rate", 0.05, False),
    ("json_validity", 0.99, True),
    ("latency_mean_ms", 400.0, False),
    ("latency_p99_ms", 800.0, False),
)
KEY = ["doc_id", "type", "start", "end"]
PREDICTION = "array<struct<t:string,y:string,s:int,e:int>>"


def parse_predictions(text: Column) -> Column:
    """The spans of a JSON answer; null if it is not JSON, no list, or any item lacks a key."""
    parsed = F.from_json(text, PREDICTION)
    whole = F.forall(parsed, lambda x: x["t"].isNotNull() & x["y"].isNotNull() & x["s"].isNotNull() & x["e"].isNotNull())
    good = F.ltrim(text).startswith("[") & F.try_parse_json(text).isNotNull() & F.coalesce(whole, F.lit(False)) & (F.size(parsed) == F.json_array_length(text))
    return F.when(good, parsed)


def match_exact(gold: DataFrame, pred: DataFrame, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn of span sets, in all or by columns of KEY."""
    g = gold.select(*KEY).distinct().withColumn("_g", F.lit(True))
    p = pred.select(*KEY).distinct().withColumn("_p", F.lit(True))
    both = g.join(p, KEY, "full_outer")
    counts = [
        F.coalesce(F.sum((F.col("_g").isNotNull() & F.col("_p").isNotNull()).cast("long")), F.lit(0)).alias("tp"),
        F.coalesce(F.sum((F.col("_g").isNull()).cast("long")), F.lit(0)).alias("fp"),
        F.coalesce(F.sum((F.col("_p").isNull()).cast("long")), F.lit(0)).alias("fn"),
    ]
    return both.groupBy(*by).agg(*counts) if by else both.agg(*counts)


def prf(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of tp, fp, fn rows; 0 where a denominator is 0."""
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return counts.withColumn("precision", F.round(p, 6)).withColumn("recall", F.round(r, 6)).withColumn("f1", F.round(ratio(2 * p * r, p + r), 6)).withColumn("support", tp + fn)


def _numbered(df: DataFrame, place: str) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("start", "end", "type")
    return df.select(*KEY).withColumn(place, F.row_number().over(w))


def _pairs(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Overlapping gold and predicted spans of a document: (doc_id, gi, gt, pi, pt, iou), numbered in their orders."""
    g = _numbered(gold, "gi").withColumnsRenamed({"type": "gt", "start": "gs", "end": "ge"})
    p = _numbered(pred, "pi").withColumnsRenamed({"type": "pt", "start": "ps", "end": "pe"})
    met = overlap_join(g, p, "doc_id", ("gs", "ge"), ("ps", "pe")).where("pi is not null")
    return met.select("doc_id", "gi", "gt", "pi", "pt", iou(F.col("ps"), F.col("pe"), F.col("gs"), F.col("ge")).alias("iou"))


def _one_to_one(pairs: pa.Array) -> pa.Array:
    """How many (pi, gi) pairs of each sorted list a greedy choice takes, each side used once."""
    found = []
    for row in pairs.to_pylist():
        ps, gs = set(), set()
        for x in row:
            if x["pi"] not in ps and x["gi"] not in gs:
                ps.add(x["pi"])
                gs.add(x["gi"])
        found.append(len(ps))
    return pa.array(found, pa.int64())


def match_partial(gold: DataFrame, pred: DataFrame, threshold: float = 0.5) -> DataFrame:
    """tp, fp, fn with one-to-one matches of one type and IoU above ``threshold``, the best first
    (ties: prediction, then gold order).

    Pairs come from a join by stretches of text; the greedy choice goes once through a document's
    pairs, which overlap by more than half and so are few.
    """
    pairs = _pairs(gold, pred).where((F.col("pt") == F.col("gt")) & (F.col("iou") > threshold))
    per_doc = pairs.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("iou")).alias("k"), "pi", "gi"))).alias("c"))
    matched = per_doc.select(F.arrow_udf(_one_to_one, "long")("c").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tp"))
    counts = pred.select(F.lit(1).alias("p"), F.lit(0).alias("g")).unionByName(gold.select(F.lit(0).alias("p"), F.lit(1).alias("g"))).agg(F.coalesce(F.sum("p"), F.lit(0)).alias("n_p"), F.coalesce(F.sum("g"), F.lit(0)).alias("n_g"))
    return matched.join(counts, how="cross").select("tp", (F.col("n_p") - F.col("tp")).alias("fp"), (F.col("n_g") - F.col("tp")).alias("fn"))  # one row each


_MATCH = "array<struct<gi:int,pi:int,pt:string>>"


def _best_unused(golds: pa.Array) -> pa.Array:
    """(gi, pi, pt) of the gold spans of each list, in order, that find a prediction nobody has taken."""
    found = []
    for row in golds.to_pylist():
        used, out = set(), []
        for x in row:
            best = next((c for c in x["c"] if c["pi"] not in used), None)
            if best is not None:
                used.add(best["pi"])
                out.append({"gi": x["gi"], "pi": best["pi"], "pt": best["pt"]})
        found.append(out)
    kind = pa.list_(pa.struct([("gi", pa.int32()), ("pi", pa.int32()), ("pt", pa.string())]))
    return pa.array(found, kind)


def confusion_matrix(gold: DataFrame, pred: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(gold_type, pred_type, n): gold spans in order take the best unused prediction of any type with
    IoU of ``threshold`` or more, else MISS; predictions left over are SPURIOUS."""
    p, g = _numbered(pred, "pi"), _numbered(gold, "gi")
    near = _pairs(gold, pred).where(F.col("iou") >= threshold).select("doc_id", "gi", "gt", F.struct((-F.col("iou")).alias("k"), "pi", "pt").alias("c"))
    lists = near.groupBy("doc_id", "gi", "gt").agg(F.array_sort(F.collect_list("c")).alias("c")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("gi", "gt", "c"))).alias("golds"))
    folded = lists.select("doc_id", F.arrow_udf(_best_unused, _MATCH)("golds").alias("m"))
    hits = folded.select("doc_id", F.explode_outer("m").alias("x")).where("x is not null").select("doc_id", "x.gi", "x.pt")
    used = folded.select("doc_id", F.explode_outer("m.pi").alias("pi")).where("pi is not null")
    rows = g.join(hits, ["doc_id", "gi"], "left").select(F.col("type").alias("gold_type"), F.coalesce("pt", F.lit("MISS")).alias("pred_type"))
    spare = p.join(used, ["doc_id", "pi"], "left_anti").select(F.lit("SPURIOUS").alias("gold_type"), F.col("type").alias("pred_type"))
    return rows.unionByName(spare).groupBy("gold_type", "pred_type").agg(F.count(F.lit(1)).alias("n"))


SPANS = "array<struct<type:string,start:int,end:int>>"
_COUNTS = "array<struct<part:string,type:string,other:string,n:bigint>>"
TP, FP, FN, ROWS = "tp", "fp", "fn", "rows"


def _overlaps(gold: list[tuple], pred: list[tuple]) -> list[tuple]:
    """(iou, pi, gi) of overlapping spans (start, end, type), both lists sorted. A prediction sees only gold
    spans that start before its end and behind the last place where all earlier ones have ended."""
    starts, reach, found = [g[0] for g in gold], list(accumulate((g[1] for g in gold), max)), []
    for pi, (ps, pe, _) in enumerate(pred):
        for gi in range(bisect_right(reach, ps), bisect_left(starts, pe)):
            gs, ge, _ = gold[gi]
            shared = min(pe, ge) - max(ps, gs)
            if shared > 0:
                found.append((shared / (pe - ps + ge - gs - shared), pi, gi))
    return found


def _document_counts(gold: list[tuple], pred: list[tuple], threshold: float) -> Counter:
    """Counts of one document by (part, type, other)."""
    out = Counter({(ROWS, None, "gold"): len(gold), (ROWS, None, "pred"): len(pred)})
    gold, pred = sorted(gold), sorted(pred)
    g, p = set(gold), set(pred)
    for side, spans in ((TP, g & p), (FP, p - g), (FN, g - p)):
        out.update(("exact", kind, side) for _, _, kind in spans)
    met = _overlaps(gold, pred)
    used_p, used_g = set(), set()
    for _, pi, gi in sorted((-v, pi, gi) for v, pi, gi in met if v > threshold and pred[pi][2] == gold[gi][2]):
        if pi not in used_p and gi not in used_g:
            used_p.add(pi)
            used_g.add(gi)
    out.update(("partial", pred[pi][2], TP) for pi in used_p)
    out.update(("partial", x[2], FP) for i, x in enumerate(pred) if i not in used_p)
    out.update(("partial", x[2], FN) for i, x in enumerate(gold) if i not in used_g)
    taken, at = set(), 0
    near = sorted((gi, -v, pi) for v, pi, gi in met if v >= threshold)
    for gi, (_, _, kind) in enumerate(gold):
        best = None
        while at < len(near) and near[at][0] == gi:
            if best is None and near[at][2] not in taken:
                best = near[at][2]
            at += 1
        if best is not None:
            taken.add(best)
        out["confusion", kind, "MISS" if best is None else pred[best][2]] += 1
    out.update(("confusion", "SPURIOUS", x[2]) for i, x in enumerate(pred) if i not in taken)
    return out


def report_counts(docs: DataFrame, by: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """Everything a report needs as sums: (by, part, type, other, n) of documents (source, gold, pred).

    ``gold`` and ``pred`` are arrays of (type, start, end); a null ``pred`` is an answer that could not be read and
    counts as no spans. Documents are read once; a task turns each into a few counts, which are summed
    before and behind one small shuffle. No shuffle holds a span.
    """

    def count(gold: pa.Array, pred: pa.Array) -> pa.Array:
        out = []
        for gs, ps in zip(gold.to_pylist(), pred.to_pylist(), strict=True):
            sides = ([(x["start"], x["end"], x["type"]) for x in side or []] for side in (gs, ps))
            out.append([{"part": a, "type": b, "other": c, "n": n} for (a, b, c), n in _document_counts(*sides, threshold).items() if n])
        return pa.array(out, pa.list_(pa.struct([("part", pa.string()), ("type", pa.string()), ("other", pa.string()), ("n", pa.int64())])))

    by = by or []
    negative = F.coalesce(F.col("source") == "hard_negatives", F.coalesce(F.size("gold"), F.lit(0)) <= 0)
    one = lambda other, c: F.when(c, F.struct(F.lit(ROWS).alias("part"), F.lit(None).cast("string").alias("type"), F.lit(other).alias("other"), F.lit(1).cast("bigint").alias("n")))
    flags = F.array_compact(F.array(
        one("docs", F.lit(True)), one("readable", F.col("pred").isNotNull()), one("negatives", negative), one("negatives_hit", negative & (F.coalesce(F.size("pred"), F.lit(0)) > 0)),
    ))
    counted = docs.select(*by, flags.alias("flags"), F.arrow_udf(count, _COUNTS)(F.col("gold").cast(SPANS), F.col("pred").cast(SPANS)).alias("counts"))
    rows = counted.select(*by, F.explode_outer(F.concat("flags", "counts")).alias("x")).select(*by, "x.*")
    return rows.groupBy(*by, "part", "type", "other").agg(F.sum("n").alias("n"))


def report(docs: DataFrame, by: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """The whole evaluation in one frame of (by, section, type, other, n, precision, recall, f1, support, value).

    Sections: ``exact`` and ``partial`` (all types: type null; n is the true positives), ``confusion`` (n gold spans of
    ``type`` answered as ``other``), ``json_validity``, ``hard_negatives`` (value is the rate, support its rows),
    ``predictions``, ``gold`` and ``examples`` (n). Without rows, rates are 0.
    """
    by = by or []
    counts = materialise(report_counts(docs, by, threshold))  # read by each section
    total = lambda part, other: F.coalesce(F.sum(F.when((F.col("part") == part) & (F.col("other") == other), F.col("n"))), F.lit(0))
    sides = [total(part, side).alias(f"{part}_{side}") for part in ("exact", "partial") for side in (TP, FP, FN)]
    sizes = [total(ROWS, name).alias(name) for name in ("docs", "readable", "negatives", "negatives_hit", "gold", "pred")]
    empty = {"type": "string", "other": "string", "n": "bigint", "precision": "double", "recall": "double", "f1": "double", "support": "bigint", "value": "double"}
    row = lambda section, **cols: F.struct(F.lit(section).alias("section"), *(F.coalesce(cols[c], F.lit(None)).cast(k).alias(c) if c in cols else F.lit(None).cast(k).alias(c) for c, k in empty.items()))

    def scored(frame: DataFrame, part: str, kind: Column) -> DataFrame:
        named = frame.select(*by, kind.alias("type"), *(F.col(f"{part}_{x}").alias(x) for x in (TP, FP, FN))).where((F.col(TP) + F.col(FP) + F.col(FN) > 0) | F.col("type").isNull())
        cols = {c: F.col(c) for c in ("type", "precision", "recall", "f1", "support")}
        return prf(named).select(*by, row(part, n=F.col(TP), **cols).alias("x"))

    rate = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6)).otherwise(F.lit(0.0))
    whole = counts.groupBy(*by).agg(*sides, *sizes)
    typed = counts.where("part in ('exact', 'partial')").groupBy(*by, "type").agg(*sides)
    singles = F.array(
        row("json_validity", value=rate("readable", "docs"), support=F.col("docs")), row("hard_negatives", value=rate("negatives_hit", "negatives"), support=F.col("negatives")),
        row("predictions", n=F.col("pred")), row("gold", n=F.col("gold")), row("examples", n=F.col("docs")),
    )
    parts = [scored(whole, part, F.lit(None).cast("string")) for part in ("exact", "partial")] + [scored(typed, part, F.col("type")) for part in ("exact", "partial")]
    parts += [counts.where("part = 'confusion'").select(*by, row("confusion", type=F.col("type"), other=F.col("other"), n=F.col("n")).alias("x")), whole.select(*by, F.explode(singles).alias("x"))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(*by, "x.*")


def compare(docs: DataFrame, config: str, types: tuple[str, ...]) -> DataFrame:
    """One row per configuration: exact precision, recall and F1, partial F1, exact F1 of ``types``, rate of hit
    negatives, share of readable answers, and numbers of predictions, gold spans and documents."""
    r = report(docs, [config])
    at = lambda section, c, kind=None: F.max(F.when((F.col("section") == section) & F.col("type").eqNullSafe(F.lit(kind)), F.col(c)))
    return r.groupBy(config).agg(
        at("exact", "precision").alias("precision"), at("exact", "recall").alias("recall"), at("exact", "f1").alias("exact_f1"), at("partial", "f1").alias("partial_f1"),
        *(F.coalesce(at("exact", "f1", k), F.lit(0.0)).alias(f"exact_f1_{k}") for k in types),
        at("hard_negatives", "value").alias("fp_rate"), at("json_validity", "value").alias("json_validity"), at("predictions", "n").alias("n_pred"), at("gold", "n").alias("n_gold"), at("examples", "n").alias("n_docs"),
    )


def recommendations(report_rows: DataFrame, latency: DataFrame | None = None) -> DataFrame:
    """(advice, type, value, gap) of a report: F1 under its targets, precision against recall, weak types, hit
    negatives, unreadable answers and, with a frame of ``p99``, slow answers; ``all_met`` where there is none."""
    goal = {name: target for name, target, _ in TARGETS}
    none = F.lit(None).cast("double")
    say = lambda when, advice, value, gap=none: F.when(when, F.struct(F.lit(advice).alias("advice"), F.col("type").alias("type"), value.cast("double").alias("value"), F.round(gap, 6).alias("gap")))
    is_ = lambda section: (F.col("section") == section) & F.col("type").isNull()
    ratio = F.when((F.col("precision") > 0) & (F.col("recall") > 0), F.col("precision") / F.col("recall"))
    under = lambda c, name: (F.col(c) < goal[name], F.lit(goal[name]) - F.col(c))
    (low_f1, f1_gap), (low_partial, partial_gap), (low_json, json_gap) = under("f1", "exact_f1"), under("f1", "partial_f1"), under("value", "json_validity")
    found = F.array_compact(F.array(
        say(is_("exact") & low_f1, "exact_f1_low", F.col("f1"), f1_gap), say(is_("partial") & low_partial, "partial_f1_low", F.col("f1"), partial_gap),
        say(is_("exact") & (ratio > 1.3), "low_recall", F.round(ratio, 6)), say(is_("exact") & (ratio < 0.7), "low_precision", F.round(ratio, 6)),
        say((F.col("section") == "exact") & F.col("type").isNotNull() & (F.col("f1") < 0.70) & (F.col("support") >= 5), "weak_type", F.col("f1"), F.lit(0.70) - F.col("f1")),
        say(is_("hard_negatives") & (F.col("value") > goal["hard_negative_fp_rate"]), "negatives_hit", F.col("value"), F.col("value") - goal["hard_negative_fp_rate"]),
        say(is_("json_validity") & low_json, "unreadable", F.col("value"), json_gap),
    ))
    out = report_rows.select(F.explode(found).alias("x")).select("x.*")
    if latency is not None:
        over = F.col("p99") - goal["latency_p99_ms"]
        out = out.unionByName(latency.where(over > 0).select(F.lit("slow").alias("advice"), F.lit(None).cast("string").alias("type"), F.col("p99").cast("double").alias("value"), F.round(over, 6).alias("gap")))
    out = materialise(out)  # a few rows, read twice
    fine = out.agg(F.count(F.lit(1)).alias("_n")).where("_n = 0")
    return out.unionByName(fine.select(F.lit("all_met").alias("advice"), F.lit(None).cast("string").alias("type"), none.alias("value"), none.alias("gap")))


def hard_negative_rate(docs: DataFrame) -> DataFrame:
    """Share of negatives with a prediction: docs (source, n_gold, n_pred); negative is source
    ``hard_negatives``, or no source and no gold."""
    negative = F.coalesce(F.col("source") == "hard_negatives", F.col("n_gold") == 0)
    return docs.where(negative).agg(F.round(F.coalesce(F.avg((F.col("n_pred") > 0).cast("double")), F.lit(0.0)), 6).alias("rate"), F.count(F.lit(1)).alias("n"))


def _sets(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("type", "start", "end"))).alias(name))


def diff_runs(gold: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, hits_before, hits_after, verdict) of documents whose predictions differ."""
    none = F.array().cast("array<struct<type:string,start:int,end:int>>")
    joined = _sets(gold, "g").join(_sets(before, "a"), "doc_id", "full_outer").join(_sets(after, "b"), "doc_id", "full_outer")
    filled = joined.select("doc_id", *(F.coalesce(F.col(c).cast("array<struct<type:string,start:int,end:int>>"), none).alias(c) for c in ("g", "a", "b")))
    n = lambda c: F.size(F.array_intersect("g", c))
    verdict = F.when(n("b") > n("a"), "SUCCESS").when(n("b") < n("a"), "REGRESSION").otherwise("NEUTRAL")
    return filled.where(F.col("a") != F.col("b")).select("doc_id", n("a").alias("hits_before"), n("b").alias("hits_after"), verdict.alias("verdict"))


def equivalence(a: DataFrame, b: DataFrame) -> DataFrame:
    """(n, n_equal, share) of documents whose span sets agree."""
    joined = _sets(a, "a").join(_sets(b, "b"), "doc_id", "full_outer")
    same = (F.col("a") == F.col("b")) & F.col("a").isNotNull() & F.col("b").isNotNull()
    return joined.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.coalesce(same, F.lit(False)).cast("long")), F.lit(0)).alias("n_equal")).withColumn("share", F.round(F.col("n_equal") / F.col("n"), 6))


def latency_stats(rows: DataFrame, by: list[str]) -> DataFrame:
    """Mean, median and percentiles (value at index floor(n * p)), min, max, failures, tokens a second."""
    timed = rows.where("ms is not null")
    sizes = timed.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    good = value_rank(timed, by, F.col("ms"), "ms", out="_r")
    good = join_by(good, sizes, by)
    at = lambda p: F.round(F.max(F.when(F.col("_r") == F.least(F.floor(F.col("_n") * F.lit(p)), F.col("_n") - 1) + 1, F.col("ms"))), 3)
    half = F.round(F.avg(F.when(F.abs(2 * F.col("_r") - F.col("_n") - 1) <= 1, F.col("ms"))), 3)
    stats = good.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("ms"), 3).alias("mean"), half.alias("median"), *(at(p / 100).alias(f"p{p}") for p in (50, 75, 95, 99)),
        F.round(F.min("ms"), 3).alias("low"), F.round(F.max("ms"), 3).alias("high"), F.round(F.sum("tokens") / (F.sum("ms") / 1000), 3).alias("tokens_per_s"),
    )
    failed = rows.groupBy(*by).agg(F.sum(F.col("ms").isNull().cast("long")).alias("n_failed"))
    return join_by(failed, stats, by, "left")


def verdicts(metrics: DataFrame) -> DataFrame:
    """(metric, value, target, verdict) and a row OVERALL; metrics has (metric, value)."""
    table = metrics.sparkSession.createDataFrame(list(TARGETS), "metric string, target double, floor boolean")
    joined = metrics.join(F.broadcast(table), "metric")
    ok = F.when(F.col("floor"), F.col("value") >= F.col("target")).otherwise(F.col("value") <= F.col("target"))
    rows = joined.select("metric", "value", "target", F.when(ok, "PASS").otherwise("FAIL").alias("verdict"))
    overall = rows.agg(F.when(F.coalesce(F.bool_and(F.col("verdict") == "PASS"), F.lit(True)), "PASS").otherwise("FAIL").alias("verdict"))
    return rows.unionByName(overall.select(F.lit("OVERALL").alias("metric"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("target"), "verdict"))


def weak_types(per_type: DataFrame) -> DataFrame:
    """Advice from precision, recall, F1 and support of each type: weak types and imbalances."""
    p, r = F.col("precision"), F.col("recall")
    advice = F.array(
        F.when((F.col("f1") < 0.70) & (F.col("support") >= 5), "weak"),
        F.when((r > 0) & (p / F.nullif(r, F.lit(0.0)) > 1.3), "low_recall").when((r > 0) & (p / F.nullif(r, F.lit(0.0)) < 0.7), "low_precision"),
    )
    return per_type.select("type", F.explode_outer(advice).alias("advice")).where("advice is not null")


def sequence_accuracy(rows: DataFrame, ignore: int = -100) -> DataFrame:
    """Token accuracy of (gold, pred) label arrays, ignored places left out."""
    kept = F.filter(F.arrays_zip(F.col("gold").alias("g"), F.col("pred").alias("p")), lambda x: x["g"] != ignore)
    n = rows.select(F.size(kept).alias("n"), F.size(F.filter(kept, lambda x: x["g"] == x["p"])).alias("ok"))
    return n.agg(F.sum("n").alias("n"), F.sum("ok").alias("n_right"), F.round(F.sum("ok") / F.sum("n"), 6).alias("accuracy"))


_SEQUENCE = "struct<n:bigint,n_right:bigint,tp:bigint,n_pred:bigint,n_gold:bigint>"


def _entities(ids: np.ndarray, first: np.ndarray, names: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, type) of the entities of flat label ids, as places in them; ``first`` marks where a row begins.
    An id out of range is O, an I- that goes on nothing opens an entity, as ``fold_labels`` does with ``open``."""
    kinds = sorted({k[2:] for k in names})
    head_of = np.array([*({"B-": 1, "I-": 2}.get(k[:2], 0) for k in names), 0], np.int8)
    kind_of = np.array([*(kinds.index(k[2:]) for k in names), 0], np.int32)
    ids = np.where((ids >= 0) & (ids < len(names)), ids, len(names))
    head, kind = head_of[ids], kind_of[ids]
    goes = head == 2
    goes[1:] &= (head[:-1] != 0) & (kind[:-1] == kind[1:])
    goes[first] = False
    opens = (head > 0) & ~goes
    return np.flatnonzero(opens), np.flatnonzero((opens | goes) & ~np.append(goes[1:], False)), kind[opens]


def _sequence_counts(gold: pa.Array, pred: pa.Array, names: tuple[str, ...]) -> pa.Array:
    """Counts of each row. The entities of both sides are found and compared as sorted places, in linear time."""
    size, other = (pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (gold, pred))
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(row)) - (np.cumsum(size) - size)[row]
    values = lambda x: (pc.fill_null(x, 0).to_numpy(zero_copy_only=False).astype(np.int64), x.is_valid().to_numpy(zero_copy_only=False))
    (g, has_g), (flat, has) = values(gold.flatten()), values(pred.flatten())
    met = place < other[row]  # places beyond the shorter side are null there
    p, has_p = np.full(len(row), -1, np.int64), np.zeros(len(row), bool)
    at = ((np.cumsum(other) - other)[row] + place)[met]
    p[met], has_p[met] = np.where(has[at], flat[at], -1), has[at]
    kept = has_g & (g != IGNORE) & pred.is_valid().to_numpy(zero_copy_only=False)[row]
    g, p, has_p, row = g[kept], p[kept], has_p[kept], row[kept]
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.empty(0, np.int64)
    (gs, ge, gk), (ps, pe, pk) = _entities(g, first, names), _entities(p, first, names)
    start, i, j = np.intersect1d(gs, ps, assume_unique=True, return_indices=True)
    hits = start[(ge[i] == pe[j]) & (gk[i] == pk[j])]
    count = lambda rows: pa.array(np.bincount(rows, minlength=len(size)), pa.int64())
    return pa.StructArray.from_arrays([count(row), count(row[(g == p) & has_p]), count(row[hits]), count(row[ps]), count(row[gs])], ["n", "n_right", "tp", "n_pred", "n_gold"])


def sequence_scores(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Entity scores and token accuracy of label ids (gold, pred): one row of n, n_right, accuracy, tp, fp, fn,
    precision, recall, f1 and support.

    Positions that gold ignores are left out of both; an id out of range is O; an I- that goes on nothing opens an
    entity. Both sides of a row are decoded and compared on the flat ids of Arrow batches, so nothing is joined
    and a row's cost is in proportion to its length.
    """

    def count(gold: pa.Array, pred: pa.Array) -> pa.Array:
        parts = [_sequence_counts(gold[i : i + FOLD_ROWS], pred[i : i + FOLD_ROWS], names) for i in range(0, len(gold), FOLD_ROWS)]
        return pa.concat_arrays(parts) if parts else _sequence_counts(gold, pred, names)

    counted = rows.select(F.arrow_udf(count, _SEQUENCE)("gold", "pred").alias("x")).select("x.*")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    sums = counted.agg(total("n").alias("n"), total("n_right").alias("n_right"), total("tp").alias("tp"), total(F.col("n_pred") - F.col("tp")).alias("fp"), total(F.col("n_gold") - F.col("tp")).alias("fn"))
    accuracy = F.when(F.col("n") > 0, F.round(F.col("n_right") / F.col("n"), 6)).otherwise(F.lit(0.0))
    return prf(sums).withColumn("accuracy", accuracy)
