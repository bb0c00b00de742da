"""Personal data found by rules and by boosted trees over wide candidates.

Base spans come from four exact rules (e-mail, IP, card, phone). Beside them, generators
with high recall propose further spans, which may overlap: obfuscated mail addresses,
addresses with letters outside ASCII, defanged or spaced IPs, cards with other
separators, phones without country code. Boosted trees of depth two judge a candidate
by its format and its surroundings, and a threshold for each kind decides whether it is
added. A candidate that overlaps a base span or an
earlier added one is not added; base spans always stay.

The trees learn from the base rules themselves: spans that pass are positive, spans that
fail their check are negative, and so are copies of passing spans whose digits are
turned until the check fails. They are fitted by Newton steps on histograms, each
a DataFrame aggregation over the distinct feature rows of all documents, and become column
expressions. Thresholds come from all documents too: trees fitted on either half score the
other one. Every step is DataFrame code, and finding spans is local to a row: nothing but
features is shuffled.

A null text is empty and has no spans. Repeated rows are judged one by one. Positions
are code points, the end exclusive. If a half has no trees, for want of positive or negative spans, nothing is added.
Only id and text are read; ``redact`` hands all other columns on.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cobasket.llm.common import SEED, fresh_name
from cobasket.staging import stage

KINDS = ("email", "ip", "card", "phone")
CONTEXT = 24

# Rules. Repeats are possessive and long runs are entered at their start only (or where the
# last match ended), which changes no match but keeps the search linear.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Generators of further candidates.
WIDE = {
    "email": r"(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]{1,64}+ ?(?:@|[(\[{] ?(?:at|AT) ?[)\]}]) ?[\p{L}0-9-]{1,63}+"
             r"(?: ?(?:\.|[(\[{] ?(?:dot|DOT) ?[)\]}]) ?[\p{L}0-9-]{1,63}+){1,4}+",
    "ip": r"(?<![0-9])[0-9]{1,3}+(?: ?[(\[{]?\.[)\]}]? ?[0-9]{1,3}+){3}+(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4,6}+(?:[ ._/-]{1,2}+[0-9]{3,6}+){2,4}+(?![0-9])",
    "phone": r"(?<![0-9])(?:\([0-9]{2,5}+\)|[0-9]{2,5}+)(?:[ ./-]{1,2}+(?:\([0-9]{2,5}+\)|[0-9]{2,5}+)){1,5}+(?![0-9])",
}
# A text can only hold a match of a kind if it has this.
HINT = {"email": r"(?i)@|\bat\b", "ip": r"[0-9].{0,2}\..{0,2}[0-9]", "card": r"[0-9]{4}|(?:[0-9][ -]?){12}", "phone": r"[0-9]{2}|\+[0-9]"}
CUES = r"(?i)(?:mail|contact|write|phone|tel|call|fax|mobile|card|visa|pay|credit|account|ip|host|server|address|from)\b"

FEATURES = ("kind", "digits", "length", "marks", "luhn", "octets", "variety", "glued", "cue", "plus", "tail", "runs")
# Histogram borders of each feature; a value goes left when it is at most the border.
BORDERS = {
    "kind": (0, 1, 2), "digits": (4, 6, 8, 9, 11, 12, 13, 15, 16, 19), "length": (7, 9, 12, 15, 17, 20, 28), "marks": (0, 1, 2, 3, 4, 5),
    "luhn": (0,), "octets": (0,), "variety": (1, 2, 4, 6), "glued": (0, 1), "cue": (0,), "plus": (0,), "tail": (1, 3, 6), "runs": (1, 2, 3, 4, 5),
}


def _located(text: Column, pattern: str, matches: Column, kind: int) -> Column:
    """``array<struct<start, end, kind, hit>>`` of the matches, from what stands between them."""
    between = F.split(text, pattern, -1)
    none = F.expr("CAST(array() AS array<struct<start:int,end:int,kind:int,hit:string>>)")

    def step(state: Column, i: Column) -> Column:
        hit = F.get(matches, i)
        start = state["at"] + F.length(F.get(between, i))
        end = start + F.length(hit)
        span = F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), hit.alias("hit"))
        return F.struct(F.concat(state["spans"], F.array(span)).alias("spans"), end.alias("at"))

    places = F.sequence(F.lit(0), F.size(matches) - 1)
    begin = F.struct(none.alias("spans"), F.lit(0).alias("at"))
    return F.when(F.size(matches) > 0, F.aggregate(places, begin, step)["spans"]).otherwise(none)


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _octets(hit: Column) -> Column:
    """Whether all numbers of a dotted text are at most 255."""
    parts = F.filter(F.split(hit, r"[^0-9]+"), lambda p: p != "")
    return (F.size(parts) == 4) & F.forall(parts, lambda p: p.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$"))


def _luhn(digits: Column) -> Column:
    return F.coalesce(F.call_function("luhn_check", digits), F.lit(False))


def _passes(span: Column) -> Column:
    digits = _digits(span["hit"])
    n = F.length(digits)
    return (
        F.when(span["kind"] == 0, F.lit(True)).when(span["kind"] == 1, _octets(span["hit"]))
        .when(span["kind"] == 2, (n >= 12) & (n <= 19) & _luhn(digits)).otherwise((n >= 9) & (n <= 15))
    )


def _features(text: Column, span: Column) -> Column:
    hit, digits = span["hit"], _digits(span["hit"])
    before = F.substring(text, span["start"], F.lit(1))
    before = F.when(span["start"] > 0, before).otherwise(F.lit(""))
    after = F.substring(text, span["end"] + 1, F.lit(1))
    left = F.greatest(span["start"] - CONTEXT, F.lit(0))
    word = r"^[\p{L}0-9_]$"

    def flag(c: Column) -> Column:
        return c.cast("int")

    values = {
        "kind": span["kind"], "digits": F.length(digits), "length": F.length(hit),
        "marks": F.length(F.regexp_replace(hit, r"[\p{L}0-9]", "")), "luhn": flag(_luhn(digits)), "octets": flag(_octets(hit)),
        "variety": F.size(F.array_distinct(F.split(digits, ""))), "glued": flag(before.rlike(word)) + flag(after.rlike(word)),
        "cue": flag(F.substring(text, left + 1, span["start"] - left).rlike(CUES)), "plus": flag(hit.startswith("+") | (before == "+")),
        "tail": F.length(F.regexp_extract(hit, r"\p{L}*$", 0)), "runs": F.size(F.filter(F.split(hit, r"[^0-9]+"), lambda p: p != "")),
    }
    return F.struct(*[values[f].cast("int").alias(f) for f in FEATURES])


def spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``_text``, all matches of the rules (``_rules``) and all further candidates (``_wide``)."""
    rows = docs.withColumn("_text", F.coalesce(F.col(text_col), F.lit("")))
    empty = F.array().cast("array<string>")

    def found(kind: str, pattern: str) -> Column:
        return F.when(F.col("_text").rlike(HINT[kind]), F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))).otherwise(empty)

    rows = rows.withColumns(
        {f"_b{k}": found(kind, BASE[kind]) for k, kind in enumerate(KINDS)} | {f"_w{k}": found(kind, WIDE[kind]) for k, kind in enumerate(KINDS)},
    )
    located = {
        name: F.array_sort(F.concat(*[_located(F.col("_text"), table[kind], F.col(f"_{letter}{k}"), k) for k, kind in enumerate(KINDS)]))
        for name, letter, table in (("_rules", "b", BASE), ("_wide", "w", WIDE))
    }
    return rows.withColumns(located).drop(*[f"_{x}{k}" for x in "bw" for k in range(4)])


@dataclass
class Trees:
    """Boosted trees of depth two, as ``(feature, border, (feature, border, leaf, leaf), (...))``, and thresholds by kind."""

    base: float = 0.0
    trees: list = field(default_factory=list)
    thresholds: tuple[float, ...] = (math.inf,) * 4

    def margin(self, value) -> Column:
        """The score of a candidate before the logistic function; ``value(name)`` gives a feature."""
        total = F.lit(self.base)
        for tree in self.trees:
            total = total + self._leaf(tree, value)
        return total

    def _leaf(self, node, value) -> Column:
        if isinstance(node, float):
            return F.lit(node)
        feature, border, low, high = node
        return F.when(value(feature) <= border, self._leaf(low, value)).otherwise(self._leaf(high, value))

    def threshold(self, kind: Column) -> Column:
        limits = F.array(*[F.lit(float(t)) for t in self.thresholds])
        return F.get(limits, kind)


def _split(sums, floor: float = 1.0):
    """The best border by gain, from ``{(feature, border): (g, h)}`` of the left side and the totals."""
    left, (g, h) = sums
    best = (1e-6, None)
    for place, (gl, hl) in sorted(left.items()):
        gr, hr = g - gl, h - hl
        if hl > 1e-9 and hr > 1e-9:
            gain = gl * gl / (hl + floor) + gr * gr / (hr + floor) - g * g / (h + floor)
            best = max(best, (gain, place), key=lambda x: x[0])
    return best[1]


def fit(rows: DataFrame, rounds: int = 8, rate: float = 0.5, floor: float = 1.0) -> Trees:
    """Fit trees on ``(features..., label, n)`` rows: feature values, 0 or 1, and how often they occur.

    Each tree takes two small aggregations, one for its root and one for both children.
    """
    yes, n = rows.agg(F.sum(F.col("n") * F.col("label")), F.sum("n")).first()
    model = Trees()
    if not n or not yes or yes == n:
        return model
    model.base = math.log(yes / (n - yes))

    def sums(side: Column) -> dict[int, tuple[dict, tuple[float, float]]]:
        """By side: what lies left of each border, and the totals."""
        p = 1 / (1 + F.exp(-model.margin(F.col)))
        graded = rows.withColumn("p", p).select(
            side.alias("side"), (F.col("n") * (F.col("p") - F.col("label"))).alias("g"), (F.col("n") * F.col("p") * (1 - F.col("p"))).alias("h"),
            F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f).alias("v")) for i, f in enumerate(FEATURES)])).alias("x"),
        )
        found: dict[int, tuple[dict, tuple[float, float]]] = {}
        for r in sorted(graded.groupBy("side", "x.f", "x.v").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()):
            left, (g, h) = found.setdefault(r.side, ({(f, b): (0.0, 0.0) for f in FEATURES for b in BORDERS[f]}, (0.0, 0.0)))
            name = FEATURES[r.f]
            for border in BORDERS[name]:
                if r.v <= border:
                    gl, hl = left[name, border]
                    left[name, border] = gl + r.g, hl + r.h
            found[r.side] = (left, (g + r.g, h + r.h) if r.f == 0 else (g, h))
        return found

    def leaf(g: float, h: float) -> float:
        return -rate * g / (h + floor)

    for _ in range(rounds):
        root = _split(sums(F.lit(0))[0], floor)
        if root is None:
            break
        children = []
        below = sums((F.col(root[0]) > root[1]).cast("int"))
        for side in (0, 1):
            left, (g, h) = below[side]
            place = _split((left, (g, h)), floor)
            gl, hl = left[place] if place else (0.0, 0.0)
            children.append((*place, leaf(gl, hl), leaf(g - gl, h - hl)) if place else leaf(g, h))
        model.trees.append((*root, *children))
    return model


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = 0.98) -> Trees:
    """Fit on all of ``docs``, and calibrate on the score each gets from trees that have not seen it."""
    key = F.col(id_col).cast("string"), F.col(text_col)
    dealt = docs.select(F.col(text_col).alias("text"), F.pmod(F.xxhash64(F.lit(SEED + 1), *key), F.lit(2)).cast("int").alias("half"))
    # Outer, for of a plain explode Spark makes a filter that searches the text once for each mention of a match.
    found = spans(dealt).select("half", "_text", F.explode_outer("_rules").alias("s")).filter("s IS NOT NULL")

    def turned(span: Column) -> Column:
        """The span with every digit raised: what looks the same but no longer passes."""
        hit = F.when(span["kind"] == 1, F.regexp_replace(span["hit"], r"^[0-9]+", "742")).otherwise(F.translate(span["hit"], "0123456789", "1234567890"))
        hit = F.when(span["kind"] == 0, F.regexp_replace(hit, r"\.[A-Za-z0-9-]+$", ".0")).otherwise(hit)
        hit = F.when(span["kind"] == 3, F.regexp_replace(hit, r"[().-]", "0 0 0 ")).otherwise(hit)
        return F.struct(span["start"].alias("start"), span["end"].alias("end"), span["kind"].alias("kind"), hit.alias("hit"))

    both = F.explode(F.array(F.struct(F.lit(0).alias("copy"), F.col("s").alias("s")), F.struct(F.lit(1).alias("copy"), turned(F.col("s")).alias("s"))))
    judged = found.select("half", "_text", both.alias("x")).select("half", "_text", "x.*")
    mail = F.col("s.kind") == 0
    label = (_passes(F.col("s")) & ~(mail & (F.col("copy") == 1))).cast("int")
    # A turned copy that passes all the same proves nothing.
    judged = judged.withColumn("label", label).filter("copy = 0 OR label = 0")
    rows = judged.select("half", "label", _features(F.col("_text"), F.col("s")).alias("f")).groupBy("half", "label", "f").agg(F.count("*").alias("n"))
    rows = stage(rows.select("half", "label", "f.*", "n"), "pii-features")
    halves = [fit(rows.filter(F.col("half") == half)) for half in (0, 1)]
    if not all(model.trees for model in halves):
        return Trees()
    # Thresholds: the least score from which on enough of the candidates are right.
    score = F.when(F.col("half") == 0, halves[1].margin(F.col)).otherwise(halves[0].margin(F.col))
    counts = rows.groupBy("kind", F.round(score, 2).alias("score")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("label")).alias("yes")).collect()
    model = fit(rows)
    limits = []
    for kind in range(len(KINDS)):
        limit, total, right = math.inf, 0, 0
        for r in sorted((r for r in counts if r.kind == kind), key=lambda r: -r.score):
            total, right = total + r.n, right + r.yes
            if right >= precision * total:
                limit = r.score
        # Never below even odds.
        limits.append(max(limit, 0.0))
    model.thresholds = tuple(limits)
    return model


def find(docs: DataFrame, model: Trees, text_col: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``added`` spans, as ``array<struct<start, end, kind, hit>>`` in order of start and kind."""
    rows = spans(docs, text_col)
    rows = rows.withColumn("base", F.filter("_rules", _passes))
    # Added spans stay clear of all base spans, and of added ones before them.
    free = F.filter("_wide", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    judged = F.transform(free, lambda s: F.struct(s.alias("s"), _features(F.col("_text"), s).alias("f")))
    accepted = F.filter(judged, lambda c: model.margin(lambda name: c["f"][name]) >= model.threshold(c["s"]["kind"]))
    rows = rows.withColumn("_chosen", F.transform(accepted, lambda c: c["s"]))
    none = F.expr("CAST(array() AS array<struct<start:int,end:int,kind:int,hit:string>>)")

    def step(kept: Column, s: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        return F.when(F.coalesce(last["end"], F.lit(0)) <= s["start"], F.concat(kept, F.array(s))).otherwise(kept)

    rows = rows.withColumn("added", F.aggregate("_chosen", none, step))
    return rows.drop("_text", "_rules", "_wide", "_chosen")


def listed(found: Column) -> Column:
    """Spans as ``kind:start:end`` by start, then kind, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    in_order = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.array_join(F.transform(in_order, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_email, n_ip, n_card, n_phone, base, added)`` for every row: counts of base spans, and all spans as text."""
    rows = find(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_body")), model, "_body")
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return rows.select(F.col("_id").alias(id_col), *counts, listed(F.col("base")).alias("base"), listed(F.concat("base", "added")).alias("spans"))


def redact(docs: DataFrame, model: Trees, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans become one.

    ``chars_col``, where ``docs`` has it, is set to the new length of texts that change.
    """
    body = fresh_name(docs, "pii_body")
    rows = find(docs.withColumn(body, F.struct(*[F.col(f"`{c}`") for c in docs.columns])).select(body, F.col(text_col).alias("_body")), model, "_body")
    merged = F.aggregate(
        F.array_sort(F.concat("base", "added")), F.expr("CAST(array() AS array<struct<start:int,end:int,kind:int>>)"),
        lambda kept, s: F.when(
            F.coalesce(F.try_element_at(kept, F.lit(-1))["end"], F.lit(0)) > s["start"],
            F.concat(F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))), F.array(F.struct(
                F.try_element_at(kept, F.lit(-1))["start"].alias("start"),
                F.greatest(F.try_element_at(kept, F.lit(-1))["end"], s["end"]).alias("end"), F.try_element_at(kept, F.lit(-1))["kind"].alias("kind"),
            ))),
        ).otherwise(F.concat(kept, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))),
    )
    rows = rows.withColumn("_merged", merged)
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    text = F.col("_body")

    def piece(s: Column, i: Column) -> Column:
        last = F.coalesce(F.get(F.col("_merged"), i - 1)["end"], F.lit(0))
        return F.concat(F.substring(text, last + 1, s["start"] - last), F.get(names, s["kind"]))

    tail = F.substring(text, F.try_element_at("_merged", F.lit(-1))["end"] + 1, F.length(text))
    rows = rows.withColumn("_new", F.when(F.size("_merged") > 0, F.concat(F.array_join(F.transform("_merged", piece), ""), tail)).otherwise(text))
    columns = []
    for c in docs.columns:
        old = F.col(body)[c]
        if c == text_col:
            old = F.col("_new")
        elif c == chars_col:
            old = F.when(F.size("_merged") > 0, F.length("_new").cast(docs.schema[c].dataType)).otherwise(old)
        columns.append(old.alias(c))
    return rows.select(*columns)
