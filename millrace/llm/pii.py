"""Personal data: high-recall candidates, boosted trees over format and context, calibrated redactions.

Two families of generators propose spans in every whole text.  The *base* generators are exact
patterns with a check (digits, parts, Luhn); what they find always stays.  The *loose* ones also take
written-out addresses, local phone numbers and other separators; they overlap the base spans freely.
Loose cards are all runs of 13 to 19 digits that start and end at the border of a group of digits, so
they overlap each other too, and two cards side by side are proposed one by one.  Every loose candidate gets format features (digits, separators, signs, and whether the check digit of a card or
the parts of an address hold) and context features (words before, neighbours).  Candidates that a base span confirms are positive examples; those with evidence
against them (a wrong check digit, a part over 255, a date) are negative; the rest is unlabelled.

Boosted trees of depth two learn on the counts of distinct feature rows, so what the driver sees is
bounded by the product of the features' values, not by the corpus.  The trees become one SQL
expression.  Per kind the lowest score that keeps ``PRECISION`` among the labelled candidates set
aside is the threshold; an unlabelled candidate above it is added unless it overlaps a base span or a
better candidate that is added.  Everything that touches rows is a column expression.

Offsets count code points, ends are exclusive.  Patterns never cross a line feed.  Patterns use
possessive repeats and start only where a run of their characters starts, so a text costs time in
proportion to its length.

Defined results: NULL and empty texts have no spans; repeated rows have the same ones; without
labelled examples of a kind nothing is added to the base spans.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import ROW, annotate, whole_text, with_row
from millrace.staging import Staging

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.95
ROUNDS = 40
RATE = 0.3
CONTEXT = 24

_LOCAL = "A-Za-z0-9._%+-"
# Fixed patterns of the base spans.
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": rf"(?<![{_LOCAL}])[{_LOCAL}]++(?:@|\x20?[(\[](?:at|AT)[)\]]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[](?:dot|DOT)[)\]]\x20?)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z.])[0-9]++(?:\.[0-9]++){3,}+(?![0-9A-Za-z])",
    # the first digit of a group; looks at the 13 to 20 digits from there, and at a letter after them
    "card": r"(?<![0-9A-Za-z+])(?<!(?<![0-9])\.)(?=([0-9](?:[\x20.-]?[0-9]){12,19}+[A-Za-z]?+))[0-9]",
    "phone": r"(?<![0-9A-Za-z.])(?:\+|\()?[0-9](?:[\x20().-]{0,2}[0-9]){7,14}+(?![0-9A-Za-z])",
}
_GATES = {"email": r"@|[(\[](?:at|AT)[)\]]", "ip": "[0-9]", "card": "[0-9]", "phone": "[0-9]"}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_IP_PARTS = rf"^{_PART}(?:\.{_PART}){{3}}$"
_WORDS = r"(?i)(mail|contact|call|phone|tel|mobile|fax|card|visa|credit|pay|host|server|address)"

_CARD_DIGITS = range(13, 20)

FEATURES = ("kind", "digits", "separators", "plus", "paren", "at", "before", "after", "word", "parts", "check")


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _base_holds(kind: Column, match: Column) -> Column:
    digits = _digits(match)
    n = F.length(digits)
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", match.rlike(_IP_PARTS))
        .when(kind == "card", F.when(n.between(14, 19), _luhn(digits)).otherwise(False))
        .otherwise(n.between(10, 15))
    )


def _found(text: Column, family: str, kind: str, pattern: str) -> Column:
    """The matches of one pattern in order, each with the text before it and the characters it takes.

    A loose card takes the first digit only, and its match is all that may belong to it.
    """
    starts = (family, kind) == ("loose", "card")
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(int(starts)))
    gaps = F.split(text, pattern)
    rows = F.zip_with(matches, gaps, lambda m, g: F.struct(
        F.lit(family).alias("family"), F.lit(kind).alias("kind"), m.alias("match"),
        (F.lit(1) if starts else F.length(m)).alias("width"), F.length(g).alias("gap"), F.right(g, F.lit(CONTEXT)).alias("before")))
    some = F.filter(rows, lambda r: r["match"].isNotNull())
    return F.when(text.rlike(_GATES[kind]), some).otherwise(F.array().cast(
        "array<struct<family:string,kind:string,match:string,width:int,gap:int,before:string>>"))


def _card_runs(match: Column) -> Column:
    """The runs of digits from the start of a match to the end of a group, one per number of digits."""
    runs = F.array(*[F.regexp_extract(match, rf"^(?:[0-9][\x20.-]?){{{n - 1}}}+[0-9](?![0-9A-Za-z])", 0) for n in _CARD_DIGITS])
    return F.filter(runs, lambda r: r != "")


def candidates(docs: DataFrame) -> DataFrame:
    """``(row, family, kind, start, end, match, before)`` of all that the generators propose."""
    # one explode per family and kind, so that a text is held once beside the matches of one pattern
    arrays = [_found(F.col("text"), family, kind, pattern)
              for family, patterns in (("base", BASE), ("loose", LOOSE)) for kind, pattern in patterns.items()]
    each = docs.select(ROW, F.explode(F.array(*arrays)).alias("found")).select(ROW, F.posexplode("found").alias("k", "f"))
    each = each.select(ROW, "k", "f.*")
    before = Window.partitionBy(ROW, "family", "kind").orderBy("k")
    start = F.sum(F.col("gap") + F.col("width")).over(before) - F.col("width")
    starts = (F.col("family") == "loose") & (F.col("kind") == "card")
    runs = F.explode(F.when(starts, _card_runs(F.col("match"))).otherwise(F.array("match"))).alias("match")
    placed = each.withColumn("start", start).select(ROW, "family", "kind", "start", "before", runs)
    placed = placed.withColumn("end", F.col("start") + F.length("match"))
    return placed.select(ROW, "family", "kind", "start", "end", "match", "before")


def _features() -> dict[str, Column]:
    match, before = F.col("match"), F.col("before")
    n = F.length(_digits(match))
    separators = F.length(match) - F.length(F.translate(match, " .-()", ""))
    last = F.right(before, F.lit(1))
    return {
        "kind_no": F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int"),
        "digits": F.when(n < 8, 0).when(n < 10, 1).when(n < 12, 2).when(n < 14, 3).when(n < 16, 4).when(n < 17, 5).otherwise(6),
        "separators": F.least(separators, F.lit(4)),
        "plus": match.startswith("+").cast("int"),
        "paren": F.contains(match, F.lit("(")).cast("int"),
        "at": F.contains(match, F.lit("@")).cast("int"),
        "before": F.when(last == "", 0).when(last.rlike(r"[\x20\t(<\[]"), 1).when(last.rlike("[:=,;]"), 2).otherwise(3),
        "after": F.when(match.rlike(r"[0-9]$"), 1).otherwise(0),
        "word": before.rlike(_WORDS).cast("int"),
        "parts": F.least(F.size(F.split(match, r"[\x20.()-]+")), F.lit(6)),
        "check": (F.col("kind").isin("card", "ip") & ~F.col("against")).cast("int"),
    }


_COLUMNS = ("kind_no", *FEATURES[1:])


def _against() -> Column:
    """Evidence that a loose candidate is none of its kind."""
    kind, match = F.col("kind"), F.col("match")
    digits = _digits(match)
    n = F.length(digits)
    date = match.rlike(r"^\(?(?:19|20)[0-9]{2}[-. ][0-9]{2}[-. ][0-9]{2}|^[0-9]{2}[-. ][0-9]{2}[-. ](?:19|20)[0-9]{2}")
    return (
        F.when(kind == "ip", ~match.rlike(_IP_PARTS))
        .when(kind == "card", F.when(n.between(14, 19), ~_luhn(digits)).otherwise(True))
        .when(kind == "phone", date | (n < 10) | match.rlike(r"^[0-9]+(?:\.[0-9]+)*$"))
        .otherwise(~match.rlike("[A-Za-z]{2,}$"))
    )


class Trees:
    """Boosted trees of depth two over small whole-number features, with a threshold per kind."""

    def __init__(self, rows: list[tuple[tuple[int, ...], int, int, int]]):
        self.trees: list[tuple] = []
        self.thresholds: dict[str, float] = {}
        train, aside = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
        for features, label, fold, n in rows:
            (train if fold else aside)[features][label] += n
        self._fit(train)
        self._calibrate(aside)

    def _fit(self, train) -> None:
        points = sorted(train)
        score = dict.fromkeys(points, 0.0)
        cuts = sorted({(f, p[f]) for p in points for f in range(len(_COLUMNS))})

        def split(part, gradient, weight):
            """The cut of a part with the largest gain, as (gain, feature, value)."""
            g, h = sum(gradient[p] for p in part), sum(weight[p] for p in part)
            best = (1e-6, None, None)
            for f, v in cuts:
                left = [p for p in part if p[f] <= v]
                if 0 < len(left) < len(part):
                    gl, hl = sum(gradient[p] for p in left), sum(weight[p] for p in left)
                    gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                    if gain > best[0] + 1e-9:
                        best = (gain, f, v)
            return best

        for _ in range(ROUNDS if points else 0):
            probability = {p: 1 / (1 + math.exp(-score[p])) for p in points}
            gradient = {p: train[p][1] - sum(train[p]) * probability[p] for p in points}
            weight = {p: sum(train[p]) * probability[p] * (1 - probability[p]) for p in points}

            def leaf(part):
                return RATE * sum(gradient[p] for p in part) / (sum(weight[p] for p in part) + 1)

            _, f, v = split(points, gradient, weight)
            if f is None:
                break
            sides = []
            for part in ([p for p in points if p[f] <= v], [p for p in points if p[f] > v]):
                _, f2, v2 = split(part, gradient, weight)
                if f2 is None:
                    sides.append((None, None, leaf(part), leaf(part)))
                else:
                    sides.append((f2, v2, leaf([p for p in part if p[f2] <= v2]), leaf([p for p in part if p[f2] > v2])))
            self.trees.append((f, v, *sides))
            for p in points:
                score[p] += self._tree(self.trees[-1], p)

    @staticmethod
    def _tree(tree, p) -> float:
        f, v, low, high = tree
        f2, v2, a, b = low if p[f] <= v else high
        return a if f2 is None or p[f2] <= v2 else b

    def raw(self, p) -> float:
        return sum(self._tree(t, p) for t in self.trees)

    def _calibrate(self, aside) -> None:
        for k, kind in enumerate(KINDS, 1):
            ranked = sorted(((self.raw(p), *n) for p, n in aside.items() if p[0] == k), reverse=True)
            good = bad = 0
            for i, (score, negative, positive) in enumerate(ranked):
                good, bad = good + positive, bad + negative
                tied = i + 1 < len(ranked) and ranked[i + 1][0] == score
                if not tied and good and good >= PRECISION * (good + bad) and score > 0:
                    self.thresholds[kind] = score

    def column(self) -> Column:
        """The score as a SQL expression over the feature columns."""
        total = F.lit(0.0)
        for f, v, low, high in self.trees:
            sides = [F.lit(a) if f2 is None else F.when(F.col(_COLUMNS[f2]) <= v2, a).otherwise(b) for f2, v2, a, b in (low, high)]
            total = total + F.when(F.col(_COLUMNS[f]) <= v, sides[0]).otherwise(sides[1])
        return total

    def above(self) -> Column:
        chosen = F.lit(False)
        for kind, least in self.thresholds.items():
            chosen = chosen | ((F.col("kind") == kind) & (F.col("score") >= least - 1e-9))
        return chosen


def _span(base: bool) -> Column:
    return F.struct(
        F.col("start").cast("long").alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).alias("kind_no"),
        F.col("end").cast("long").alias("end"), F.col("kind"), F.lit(base).alias("base"),
        (F.lit(1.0) if base else F.lit(1.0) / (1 + F.exp(-F.col("score")))).alias("score"))


def find_spans(df: DataFrame, text: str = "text", staging: Staging | None = None) -> DataFrame:
    """``(row, base, added)`` of the rows with spans: sorted arrays of
    ``(start, kind_no, end, kind, base, score)``; rows as ``with_row`` numbers them."""
    staging = staging or Staging(df.sparkSession)
    docs = with_row(df).select(ROW, whole_text(F.col(f"`{text}`")).alias("text"))
    found = staging.keep(candidates(docs), "candidates")
    base = found.where((F.col("family") == "base") & _base_holds(F.col("kind"), F.col("match")))
    base = base.groupBy(ROW).agg(F.sort_array(F.collect_list(_span(True))).alias("base"))
    loose = annotate(found.where("family = 'loose'").withColumn("against", _against()), _features())
    met = base.select(F.col(ROW).alias("r"), F.col("base").alias("held"))
    loose = loose.join(met, F.col(ROW) == F.col("r"), "left")

    def crosses(s: Column) -> Column:
        return (s["start"] < F.col("end")) & (F.col("start") < s["end"])

    held = F.coalesce("held", F.array().cast(base.schema["base"].dataType))

    def same(s: Column) -> Column:  # a part of a card is none
        return (s["kind"] == F.col("kind")) & ((F.col("kind") != "card") | ((s["start"] == F.col("start")) & (s["end"] == F.col("end"))))

    loose = loose.withColumn("touches", F.exists(held, crosses)).withColumn(
        "confirmed", F.exists(held, lambda s: crosses(s) & same(s)))
    loose = staging.keep(loose.select(ROW, "kind", "start", "end", "against", "touches", "confirmed", *_COLUMNS), "loose")

    fold = F.pmod(F.xxhash64(ROW, "start"), F.lit(2)).cast("int").alias("fold")
    label = F.when(F.col("confirmed"), 1).when(F.col("against") & ~F.col("touches"), 0).alias("label")
    counts = loose.select(*_COLUMNS, label, fold).where("label is not null").groupBy(*_COLUMNS, "label", "fold").count().collect()
    trees = Trees([(tuple(r[c] for c in _COLUMNS), r["label"], r["fold"], r["count"]) for r in counts])

    new = loose.where(~F.col("touches") & ~F.col("against")).withColumn("score", trees.column()).where(trees.above())
    new = new.groupBy(ROW).agg(F.sort_array(F.collect_list(_span(False))).alias("added")).select(F.col(ROW).alias("a"), "added")
    # best first; what overlaps one that stays goes, what overlaps only those that go may stay
    ranked = F.array_sort(F.transform("added", lambda s: F.struct(
        (-s["score"]).alias("least"), s["start"].alias("at"), s["kind_no"].alias("no"), (-s["end"]).alias("upto"), s.alias("span"))))
    none_yet = F.array().cast(new.schema["added"].dataType)
    better = F.array_sort(F.aggregate(ranked, none_yet, lambda kept, r: F.when(
        F.exists(kept, lambda o: (o["start"] < r["span"]["end"]) & (r["span"]["start"] < o["end"])), kept).otherwise(
        F.concat(kept, F.array(r["span"])))))
    none = F.array().cast(base.schema["base"].dataType)
    both = base.join(new, F.col(ROW) == F.col("a"), "full")
    return staging.keep(both.select(
        F.coalesce(ROW, "a").alias("hit"), F.coalesce("base", none).alias("base"), F.coalesce(better, none).alias("added")), "spans")


def written(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined, by start and then kind."""
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(df: DataFrame, text: str = "text", staging: Staging | None = None) -> DataFrame:
    """The input with ``redacted``: every span (the first of those that overlap) gives way to its kind."""
    spans = find_spans(df, text, staging).select(
        F.col("hit").alias("__llm_hit"), F.sort_array(F.concat("base", "added")).alias("__llm_spans"))
    joined = with_row(df).join(spans, F.col(ROW) == F.col("__llm_hit"), "left")
    t = whole_text(F.col(f"`{text}`"))
    first = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    done = F.aggregate("__llm_spans", first, lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(F.struct(
        F.concat(acc["out"], F.substring(t, acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int")), F.lit("["), s["kind"], F.lit("]")).alias("out"),
        s["end"].alias("at"))), lambda acc: F.concat(acc["out"], F.substring(t, acc["at"].cast("int") + 1, F.length(t))))
    return annotate(joined, {"redacted": F.coalesce(done, t)}).drop(ROW, "__llm_hit", "__llm_spans")
