"""Personal data: patterns propose spans, check sums confirm them, context adjusts the score.

DataFrame functions only.  Spans are found as the text between them: a text
split at a pattern and the list of its matches give every match its place.

The patterns are those of the contract, written so that a failed attempt is never
repeated from inside the same run: a run is entered at its start (or where the last
match ended) and is taken whole (possessive), which leaves the leftmost matches
as they are and the time linear also on very long texts.  For cards only runs of a card's
length are listed; the shorter and longer ones would be dropped by the check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logvigil.functions.text import settle

#: kind -> (pattern, what a text must contain to hold it, base score, words that support it)
KINDS = {
    "email": (
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "@", 0.9, ("mail", "contact", "write")),
    "ip": (
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        r"[0-9]\.[0-9]", 0.6, ("ip", "host", "server", "address")),
    "card": (
        r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
        r"[0-9](?:[\x20-]?[0-9]){13}", 0.7, ("card", "visa", "credit", "payment")),
    "phone": (
        r"\+[0-9][\x20().0-9-]+[0-9]",
        "+", 0.6, ("phone", "call", "tel", "mobile")),
    "iban": (
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        r"[A-Z]{2}[0-9]{2}", 0.8, ("iban", "account", "bank")),
}
BASE = ("email", "ip", "card", "phone")
#: Characters before and after a span, up to the next of its kind, in which context words
#: count, and what one adds.
NEAR, GAIN = 40, 0.2

SPAN = "struct<kind:string,start:int,end:int,score:double>"


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if a string of digits passes the Luhn check."""
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)), F.lit(0),
        lambda s, i: s + F.when(
            (F.length(digits) - i) % 2 == 0, F.substring(digits, i, F.lit(1)).cast("int")
        ).otherwise(_doubled(F.substring(digits, i, F.lit(1)).cast("int"))),
    )
    return total % 10 == 0


def _doubled(digit: Column) -> Column:
    return F.when(digit > 4, 2 * digit - 9).otherwise(2 * digit)


def mod97(iban: Column) -> Column:
    """True if an IBAN (white space allowed) leaves 1 when divided by 97."""
    plain = F.regexp_replace(iban, r"\s", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))
    rest = F.aggregate(
        F.split(turned, ""), F.lit(0),
        lambda rest, c: F.when(c == "", rest)
        .when(c.rlike("[0-9]"), (rest * 10 + c.try_cast("int")) % 97)
        .otherwise((rest * 100 + F.ascii(c) - 55) % 97),
    )
    return F.length(plain).between(15, 34) & (rest == 1)


def valid(kind: str, found: Column) -> Column:
    """The check a match must pass; failing matches are dropped, not tried again shorter."""
    if kind == "ip":
        part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return found.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        digits = _digits(found)
        return F.length(digits).between(14, 19) & luhn(digits)
    if kind == "phone":
        return F.length(_digits(found)).between(10, 15)
    if kind == "iban":
        return mod97(found)
    return F.lit(True)


def _may_hold(kind: str) -> Column:
    needed = KINDS[kind][1]
    return F.contains("text", F.lit(needed)) if len(needed) == 1 else F.col("text").rlike(needed)


def _proposed(kind: str) -> dict[str, Column]:
    """Matches of a kind, and the texts before, between and behind them."""
    pattern = F.lit(KINDS[kind][0])
    return {
        f"_{kind}_matches": F.when(_may_hold(kind), F.regexp_extract_all("text", pattern, F.lit(0))),
        f"_{kind}_gaps": F.when(_may_hold(kind), F.split("text", KINDS[kind][0], -1)),
    }


def _lengths(kind: str) -> Column:
    """Per match: its length and that of the gap before it, in code points."""
    matches, gaps = F.col(f"_{kind}_matches"), F.col(f"_{kind}_gaps")
    return F.transform(matches, lambda m, i: F.struct(
        F.length(F.get(gaps, i)).alias("gap"), F.length(m).alias("size")))


def _blocks(kind: str) -> Column:
    """Places inside runs of about sqrt(n) matches, so that growing arrays stay short."""
    lengths = F.col(f"_{kind}_lengths")
    width = F.ceil(F.sqrt(F.size(lengths))).cast("int")
    state = "struct<at:int,starts:array<int>>"
    return F.transform(
        F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / width).cast("int")),
        lambda b: F.aggregate(
            F.slice(lengths, b * width + 1, width),
            F.struct(F.lit(0).alias("at"), F.array().alias("starts")).cast(state),
            lambda s, x: F.struct(
                (s["at"] + x["gap"] + x["size"]).alias("at"),
                F.concat(s["starts"], F.array(s["at"] + x["gap"])).alias("starts")).cast(state)))


def _offsets(kind: str) -> Column:
    """Where each of those runs begins."""
    return F.aggregate(
        F.col(f"_{kind}_blocks"), F.array(F.lit(0)),
        lambda offsets, b: F.concat(offsets, F.array(F.element_at(offsets, -1) + b["at"])))


def _placed(kind: str) -> Column:
    """Valid matches as (kind, start, end, score); ends are exclusive, in code points."""
    matches, gaps = F.col(f"_{kind}_matches"), F.col(f"_{kind}_gaps")
    offsets = F.col(f"_{kind}_offsets")
    starts = F.flatten(F.transform(
        F.col(f"_{kind}_blocks"), lambda b, j: F.transform(b["starts"], lambda x: x + F.get(offsets, j))))
    _, _, base, words = KINDS[kind]
    found = F.transform(starts, lambda start, i: F.struct(
        start.alias("start"), F.get(matches, i).alias("found"),
        F.concat_ws(" ", F.right(F.get(gaps, i), F.lit(NEAR)), F.left(F.get(gaps, i + 1), F.lit(NEAR))).alias("near")))
    return F.transform(F.filter(found, lambda s: valid(kind, s["found"])), lambda s: F.struct(
        F.lit(kind).alias("kind"), s["start"].alias("start"), (s["start"] + F.length(s["found"])).alias("end"),
        F.least(F.lit(1.0), F.lit(base) + F.when(F.lower(s["near"]).rlike("|".join(words)), GAIN).otherwise(0.0))
        .alias("score")))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, text, found): one row per row of ``docs``.

    ``found`` lists (kind, start, end, score), ordered by start, then kind as in
    ``KINDS``.  Matches of one kind never overlap, matches of different kinds may.
    Null and empty texts have none.  Repeated rows are judged alike; columns other
    than doc_id and text are not read.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # each step is computed once per row, not once per use in the next step
    steps = settle(rows, {n: c for kind in KINDS for n, c in _proposed(kind).items()})
    for name, step in (("lengths", _lengths), ("blocks", _blocks), ("offsets", _offsets)):
        steps = settle(steps, {
            f"_{kind}_{name}": F.when(F.size(f"_{kind}_matches") > 0, step(kind)) for kind in KINDS})
    placed = {kind: F.when(F.size(f"_{kind}_matches") > 0, _placed(kind)) for kind in KINDS}
    steps = settle(steps, {f"_{kind}_found": F.coalesce(c, F.array().cast(f"array<{SPAN}>")) for kind, c in placed.items()})
    order = F.lit(list(KINDS))
    return steps.select("doc_id", "text", F.concat(*[f"_{kind}_found" for kind in KINDS]).alias("found")).select(
        "doc_id", "text",
        F.transform(
            F.array_sort(F.transform("found", lambda s: F.struct(
                s["start"].alias("start"), F.array_position(order, s["kind"]).alias("rank"),
                s.alias("span")))),
            lambda s: s["span"]).alias("found"),
    )


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")


def personal_data_digest(docs: DataFrame) -> DataFrame:
    """Counts per base kind, the digest of the base spans, and all spans as a string."""
    found = find_personal_data(docs).drop("text")
    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    counts = [_count(kind).alias(f"n_{kind}") for kind in BASE]
    return found.select(
        "doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.col("found")).alias("spans"),
        F.transform("found", lambda s: s["score"]).alias("scores"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every valid match replaced by its kind in angle brackets.

    Kinds are replaced one after the other, in the order of ``KINDS``; what an earlier kind
    has replaced is no longer there for a later one.
    """
    out = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for kind in KINDS:
        whole = F.when(F.size(f"_{kind}_matches") > 0, F.array_join(_parts(kind), "")).otherwise(F.col("text"))
        out = settle(out, _proposed(kind)).select("doc_id", whole.alias("text"))
    return out


def _parts(kind: str) -> Column:
    """Gaps, each followed by its match or by the kind in its place."""
    matches, gaps = F.col(f"_{kind}_matches"), F.col(f"_{kind}_gaps")
    match = lambda i: F.get(matches, i)
    return F.transform(gaps, lambda gap, i: F.concat(gap, F.when(match(i).isNull(), "").when(
        valid(kind, match(i)), f"<{kind}>").otherwise(match(i))))
