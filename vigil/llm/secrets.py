"""Secrets: assignments, access keys, hexadecimal runs, and runs of high entropy.

Only Spark's own functions are used.  Positions follow from the pieces between
matches and the matches, which alternate in a text.

The added search: candidates are runs of at least ``WINDOW`` characters of
base64 and its URL form.  For each class of characters (hexadecimal, base64)
a window slides over a candidate; as one character enters and one leaves, two
counts change and with them the sum of count * log2(count), from which the
Shannon entropy follows.  The sum is kept in whole units of 2^-20 bit, so it
does not drift.  Windows at or above the limit of their class are joined to
spans.  Spans that the allow-list explains and spans inside a base span are
left out.  The allow-list judges a span, not the run it lies in: a key that
follows an allowed word or an address in the same run is kept.

Matches are placed in blocks of ``BLOCK``, and a block's spans are moved by
the length of those before it, so time grows with the text, not with the
square of its matches.

Defined cases: a null text counts as empty and has no spans; texts of any
length are read whole; repeated rows get equal results; an empty table gives
an empty table; columns beside those named are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kind, pattern of the whole match, pattern of the part with a least length (group 1), that length.
BASE = (
    (
        "assign",
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
        r"""^[A-Za-z_]+["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$""",
        6,
    ),
    ("access", r"AKIA[A-Z0-9]+", r"^(.*)$", 20),
    # runs below the least length are never a match, and leaving them out moves no other match
    ("hex", r"[0-9a-f]{24,}", None, 24),
)


@dataclass(frozen=True)
class CharacterClass:
    """Characters counted together; letters outside ``alphabet`` end a window; least entropy in bits."""

    kind: str
    alphabet: str
    least: float


_DIGITS, _SMALL = "0123456789", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 20
CLASSES = (
    CharacterClass("entropy_hex", _DIGITS + "abcdefABCDEF", 3.0),
    CharacterClass("entropy_base64", _DIGITS + _SMALL + _SMALL.upper() + "+/_=-", 3.8),
)
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
#: A run that is a UUID is no secret.
UUID = "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
#: Spans of numbers, dates and telephone numbers.
NUMBERS = "^[0-9+/_=-]*$"
#: Words, rules and paths: no digit, and no letters that change case as words never do.
LETTERS, SHUFFLED = "^[^0-9]*$", "[a-z][A-Z]{1,2}[a-z]{1,2}[A-Z]"
#: A span is explained where these words leave no piece as long as a window.
WORDS = "(?i)example|placeholder|changeme|your[_-]|x{4}|0123456789|abcdefghij"
#: Runs that go on with an address after its protocol; there, parts of the path are pieces too.
ADDRESS, PATH = "^//", "|/"
KINDS = (*(b[0] for b in BASE), *(c.kind for c in CLASSES))
#: Matches of one text that are placed one after the other.
BLOCK = 256
_UNIT = 1 << 20
#: count * log2(count) for 0 to WINDOW, in units of 2^-20.
WEIGHTS = [0, *(round(c * math.log2(c) * _UNIT) for c in range(1, WINDOW + 1))]


def most(least: float) -> int:
    """Largest sum of weights with which a full window still has the entropy."""
    return math.floor((math.log2(WINDOW) - least) * WINDOW * _UNIT)


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def found(text: Column, pattern: str) -> Column:
    """Matches of a pattern: array of (start, end, text), code points, end exclusive."""
    parts = F.arrays_zip(
        F.split(text, pattern, -1).alias("before"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found")
    )
    parts = F.filter(parts, lambda x: x["found"].isNotNull())
    matches = "array<struct<start:long,end:long,found:string>>"
    none = F.array().cast(matches)

    def start_of(kind: str) -> Column:
        return F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(kind).alias("out"))

    def place(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["before"])
        end = start + F.length(x["found"])
        one = F.struct(start.alias("start"), end.alias("end"), x["found"].alias("found"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

    def moved(m: Column, by: Column) -> Column:
        return F.struct((m["start"] + by).alias("start"), (m["end"] + by).alias("end"), m["found"].alias("found"))

    def follow(state: Column, block: Column) -> Column:
        placed = F.transform(block["out"], lambda m: moved(m, state["at"]))
        return F.struct((state["at"] + block["at"]).alias("at"), F.concat(state["out"], F.array(placed)).alias("out"))

    def blocks(every: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.size(every), F.lit(BLOCK))
        return F.transform(firsts, lambda i: F.aggregate(F.slice(every, i, F.lit(BLOCK)), start_of(matches), place))

    placed = F.aggregate(_bound(parts, blocks), start_of(f"array<{matches}>"), follow, lambda state: F.flatten(state["out"]))
    return F.when(text.rlike(pattern), placed).otherwise(none)


def hot_spans(letters: Column, kind: CharacterClass) -> Column:
    """Joined windows of high entropy in the letters of one candidate: array of (start, end)."""
    codes = F.transform(letters, lambda c: F.instr(F.lit(kind.alphabet), c))
    return _bound(codes, lambda c: _slide(c, kind))


def _slide(codes: Column, kind: CharacterClass) -> Column:
    leaving = F.concat(F.array_repeat(F.lit(0), WINDOW), codes)
    steps = F.filter(F.arrays_zip(codes.alias("enter"), leaving.alias("leave")), lambda x: x["enter"].isNotNull())
    weights = F.array(*[F.lit(w).cast("long") for w in WEIGHTS])
    zeros = F.array_repeat(F.lit(0), len(kind.alphabet) + 1)
    nowhere = F.lit(None).cast("long")
    begin = F.struct(
        zeros.alias("counts"),
        F.lit(0).cast("long").alias("total"),
        F.lit(0).alias("inside"),
        F.lit(0).cast("long").alias("at"),
        nowhere.alias("start"),
        nowhere.alias("end"),
        F.array().cast("array<struct<start:long,end:long>>").alias("spans"),
    )

    def weight(count: Column) -> Column:
        return F.get(weights, count)

    def judged(state: Column) -> tuple[Column, Column, Column]:
        """The open span and the closed ones, after the window that ends at the state's place is judged."""
        hot = (state["inside"] >= WINDOW) & (state["total"] <= most(kind.least))
        first = state["at"] - WINDOW
        opens = hot & ~F.coalesce(state["end"] >= first, F.lit(False))
        start = F.when(opens, first).otherwise(state["start"])
        end = F.when(hot, state["at"]).otherwise(state["end"])
        closes = opens & state["start"].isNotNull()
        return start, end, F.when(closes, F.concat(state["spans"], F.array(_range(state["start"], state["end"])))).otherwise(state["spans"])

    def step(state: Column, x: Column) -> Column:
        full = state["inside"] >= WINDOW
        enter, leave = F.get(state["counts"], x["enter"]), F.get(state["counts"], x["leave"])
        counts = F.transform(
            state["counts"],
            lambda c, i: c + F.when(i == x["enter"], 1).otherwise(0) - F.when(full & (i == x["leave"]), 1).otherwise(0),
        )
        change = weight(enter + 1) - weight(enter)
        change = change + F.when(full, weight(leave - 1) - weight(leave)).otherwise(F.lit(0).cast("long"))
        change = F.when(full & (x["enter"] == x["leave"]), F.lit(0).cast("long")).otherwise(change)
        inside = x["enter"] > 0
        start, end, spans = judged(state)
        return F.struct(
            F.when(inside, counts).otherwise(zeros).alias("counts"),
            F.when(inside, state["total"] + change).otherwise(F.lit(0).cast("long")).alias("total"),
            F.when(inside, state["inside"] + 1).otherwise(F.lit(0)).alias("inside"),
            (state["at"] + 1).alias("at"),
            start.alias("start"),
            end.alias("end"),
            spans.alias("spans"),
        )

    def closed(state: Column) -> Column:
        start, end, spans = judged(state)
        return F.when(start.isNotNull(), F.concat(spans, F.array(_range(start, end)))).otherwise(spans)

    return F.aggregate(steps, begin, step, closed)


def _range(start: Column, end: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end"))


def allowed(run: Column, span: Column) -> Column:
    """Whether the allow-list explains the text of a span that lies in a run."""

    def pieces(pattern: str) -> Column:
        return F.forall(F.split(span, pattern, -1), lambda piece: F.length(piece) < WINDOW)

    words = pieces(WORDS) | (run.rlike(ADDRESS) & pieces(WORDS + PATH))
    return run.rlike(UUID) | span.rlike(NUMBERS) | (span.rlike(LETTERS) & ~span.rlike(SHUFFLED)) | words


def find(df: DataFrame, kept: list[str], text: str = "text") -> DataFrame:
    """``kept``, ``base`` and ``added``: arrays of (start, kind, end) by start, then kind as in ``KINDS``.

    ``kind`` is the place in ``KINDS``.
    """
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = df.select(*[F.col(f"`{c}`") for c in kept], value.alias("_text"))
    kinds = [_base_spans(F.col("_text"), number) for number in range(len(BASE))]
    rows = rows.withColumn("base", F.array_sort(F.concat(*kinds)))

    rows = rows.withColumn("_runs", found(F.col("_text"), CANDIDATE))
    added = [_added_spans(F.col("_runs"), number) for number in range(len(CLASSES))]

    def inside(s: Column) -> Column:
        return F.exists("base", lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"]))

    rows = rows.withColumn("added", F.array_sort(F.filter(F.concat(*added), lambda s: ~inside(s))))
    return rows.select(*[F.col(f"`{c}`") for c in kept], "base", "added")


def _base_spans(text: Column, number: int) -> Column:
    _, pattern, part, least = BASE[number]
    matches = found(text, pattern)
    if part:
        matches = F.filter(matches, lambda m: F.length(F.regexp_extract(m["found"], part, 1)) >= least)
    return F.transform(matches, lambda m: _span(m["start"], number, m["end"]))


def _added_spans(runs: Column, number: int) -> Column:
    def of_letters(run: Column, letters: Column) -> Column:
        def explained(s: Column) -> Column:
            part = F.array_join(F.slice(letters, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")), "")
            return _bound(part, lambda span: allowed(run["found"], span))

        hot = F.filter(hot_spans(letters, CLASSES[number]), lambda s: ~explained(s))
        return F.transform(hot, lambda s: _span(run["start"] + s["start"], len(BASE) + number, run["start"] + s["end"]))

    return F.flatten(F.transform(runs, lambda run: _bound(F.split(run["found"], ""), lambda c: of_letters(run, c))))


def _span(start: Column, kind: int, end: Column) -> Column:
    return F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))


def written(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined in their order."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
    )
