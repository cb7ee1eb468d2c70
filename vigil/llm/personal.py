"""Personal data: patterns of four kinds, and what the contexts of their matches lead to.

Base matches (email, ip, card, telephone) are seeds.  The words around a seed
form lexical patterns: one word before, two words before, one before and one
after.  Tokens that look like identifiers but are no seeds are candidates, with
patterns of their own; so are runs of digit groups between spaces, dots, dashes
and brackets, as one, with the words around the run.  A run of more digits than
a card can have is several numbers; its tokens are candidates by themselves.
Patterns and instances (the strings met) form a graph.
Each round scores a pattern for a kind by the share of its instances that
belong to the kind, and a candidate by all its patterns together; candidates
above ``ACCEPT`` support their kind in the next round.  In the end every
mention of a candidate in a pattern of at least ``SURE`` becomes a span.

All rounds are joins and grouped sums over the graph, which holds each pair of
pattern and instance once; nothing of it comes to the driver.

Defined cases: a null text counts as empty and has no spans; rows with equal
id and text have equal spans; rows with a null id are told apart by their
text; an empty table gives an empty table; other columns are not read, and in
``redact`` they are kept.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm.common import attach, rewrite_texts, slices
from vigil.session import materialize

#: Kinds by number; added spans have the number of their kind plus 4.
KINDS = ("email", "ip", "card", "phone", "context_email", "context_ip", "context_card", "context_phone")
BASE_KINDS = 4
ROUNDS = 3
#: Seeds (or accepted candidates) a pattern needs, least share to count, to be sure, least score of a candidate.
SUPPORT, COUNTS, SURE, ACCEPT = 3, 0.5, 0.8, 0.8
#: Digits that make a token or a run a candidate if it has no @, and the most a run has.
DIGITS, RUN_DIGITS = 5, 19

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match that starts inside a run of digits fails or succeeds as the whole run does
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# groups and what joins them have no character in common, so a run is found in one pass
_RUN = re.compile(r"(?<![\w@])(?:\+?\(?|\(\+)[0-9]+(?:[ \xa0().-]{1,3}[0-9]+)+(?![\w@])")
_SIGN = re.compile(r"[0-9@]")
_AROUND = ".,;:!?\"'()[]{}<>|*%$#&"
_WORDS = 80  # characters before and after a token in which its neighbours are sought

_FOUND = (
    "spans array<struct<kind:int,start:long,end:long>>, "
    "mentions array<struct<kind:int,start:long,end:long,instance:string,patterns:array<string>>>"
)


def emails(text: str) -> list[tuple[int, int]]:
    """Matches by their @: the local part reaches back to the last match at most."""
    out, last, at = [], 0, text.find("@")
    allowed = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in allowed:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        last = domain.end() if domain else at + 1
        if domain:
            out.append((start, last))
        at = text.find("@", last)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def small(part: str) -> bool:
    value = part.lstrip("0")
    return len(value) <= 3 and int(value or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [(0, a, b) for a, b in emails(text)]
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(map(small, m.group().split(".")))]
    for match in _CARD.finditer(text):
        digits = only_digits(match.group()) if len(match.group()) <= 40 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *match.span()))
    out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(only_digits(m.group())) <= 15]
    return out


def neighbours(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns around a place."""
    before = [w.strip(_AROUND) or w for w in text[max(0, start - _WORDS) : start].lower().split()[-2:]]
    after = [w.strip(_AROUND) or w for w in text[end : end + _WORDS].lower().split()[:2]]
    after = [w for w in after if w.strip(_AROUND)][:1]
    if not before:
        return []
    out = [f"1 {before[-1]}"]
    if len(before) > 1:
        out.append(f"2 {before[-2]} {before[-1]}")
    if after:
        out.append(f"3 {before[-1]} _ {after[0]}")
    return out


def runs(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Digit groups with a space between some of them, outside the places ``taken`` (sorted)."""
    out, last = [], 0
    for begin, stop in [*taken, (len(text), len(text))]:
        for match in _RUN.finditer(text, last, max(last, begin)):
            start, end = match.span()
            found = match.group()
            start += found.startswith("(") and ")" not in found
            if (" " in found or "\xa0" in found) and DIGITS <= len(only_digits(found)) <= RUN_DIGITS:
                out.append((start, end))
        last = max(last, stop)
    return out


def mentions(text: str, spans: list[tuple[int, int, int]]) -> list[tuple]:
    """(kind, start, end, instance, patterns) of the base spans and of candidates (kind -1)."""
    out = [(k, a, b, text[a:b].lower(), neighbours(text, a, b)) for k, a, b in spans]
    taken, last = sorted((a, b) for _, a, b in spans), 0
    spaced = runs(text, taken)
    out += [(-1, a, b, text[a:b].lower(), neighbours(text, a - (text[a - 1 : a] == "("), b)) for a, b in spaced]
    n = r = 0
    for sign in _SIGN.finditer(text):
        start = end = sign.start()
        if start < last:
            continue
        while start > last and not text[start - 1].isspace():
            start -= 1
        while end < len(text) and not text[end].isspace():
            end += 1
        last = end
        token = text[start:end]
        start += len(token) - len(token.lstrip(_AROUND))
        end -= len(token) - len(token.rstrip(_AROUND))
        token = text[start:end]
        while n < len(taken) and taken[n][1] <= start:
            n += 1
        free = n == len(taken) or taken[n][0] >= end
        while r < len(spaced) and spaced[r][1] <= start:
            r += 1
        inside = r < len(spaced) and spaced[r][0] <= start and end <= spaced[r][1]
        if free and not inside and ("@" in token[1:-1] or len(only_digits(token)) >= DIGITS):
            out.append((-1, start, end, token.lower(), neighbours(text, start, end)))
    return out


def scan(df: DataFrame, kept: list[str], text: str = "text") -> DataFrame:
    """``kept``, ``spans`` (base) and ``mentions`` of each whole text."""
    fields = ("kind", "start", "end", "instance", "patterns")
    columns = [F.col(f"`{c}`") for c in kept]
    schema = T.StructType([*df.select(*columns).schema.fields, *T.DataType.fromDDL(_FOUND).fields])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column("_text").to_pylist()]
            spans = [base_spans(t) for t in texts]
            found = [[dict(zip(fields, m)) for m in mentions(t, s)] for t, s in zip(texts, spans)]
            spans = [[dict(zip(fields, s)) for s in some] for some in spans]
            arrays = [batch.column(i) for i in range(len(kept))]
            arrays += [pa.array(spans, arrow.field("spans").type), pa.array(found, arrow.field("mentions").type)]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.select(*columns, F.col(f"`{text}`").alias("_text")).mapInArrow(run, schema)


def sure_patterns(pairs: DataFrame) -> DataFrame:
    """``pattern``, ``kind`` and ``share`` of sure patterns, from pairs (``pattern``, ``instance``, ``kind``).

    ``kind`` is that of a seed, or -1.
    """
    graph = pairs.groupBy("pattern", "instance").agg(F.max("kind").alias("kind"))
    graph = materialize(graph, "graph")
    size = materialize(graph.groupBy("pattern").agg(F.count(F.lit(1)).alias("size")), "pattern_sizes")
    seeds = graph.where("kind >= 0").groupBy("instance").agg(F.max("kind").alias("of"))
    seeds = materialize(seeds.withColumn("belief", F.lit(1.0)), "seeds")
    believed = seeds
    candidates = materialize(graph.where("kind < 0").join(seeds, "instance", "left_anti"), "candidates")
    shares = None
    for _ in range(ROUNDS):
        support = graph.select("pattern", "instance").join(believed, "instance")
        support = support.groupBy("pattern", "of").agg(F.sum("belief").alias("belief"), F.count(F.lit(1)).alias("met"))
        support = materialize(support.where(F.col("met") >= SUPPORT), "support")
        shares = support.join(size, "pattern").withColumn("share", F.col("belief") / F.col("size"))
        shares = materialize(shares.where(F.col("share") >= COUNTS).select("pattern", "of", "share"), "shares")
        doubt = F.sum(F.log1p(-F.least("share", F.lit(0.999))))
        scored = candidates.select("pattern", "instance").join(shares, "pattern").groupBy("instance", "of")
        scored = scored.agg((1 - F.exp(doubt)).alias("belief")).where(F.col("belief") >= ACCEPT)
        top = F.max(F.struct("belief", (-F.col("of")).alias("of"))).alias("top")
        accepted = scored.groupBy("instance").agg(top)
        accepted = accepted.select("instance", (-F.col("top.of")).alias("of"), "top.belief")
        believed = seeds.unionByName(materialize(accepted, "accepted"))
    return shares.where(F.col("share") >= SURE).select("pattern", F.col("of").alias("kind"), "share")


def detect(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``_id``, ``_key`` (hash of the text), ``base`` and ``added`` spans (kind, start, end) of every row.

    ``kind`` is the place in ``KINDS``; both arrays are by kind, then start.
    """
    keyed = df.select(F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_key"), F.col(text).alias("_text"))
    rows = materialize(scan(keyed, ["_id", "_key"], "_text"), "mentions")
    met = rows.select("_id", "_key", F.explode("mentions").alias("m")).select("_id", "_key", "m.*")
    pairs = met.select(F.explode("patterns").alias("pattern"), "instance", "kind")
    sure = materialize(sure_patterns(pairs), "sure_patterns")
    open_ = met.where("kind < 0").select("_id", "_key", "start", "end", F.explode("patterns").alias("pattern"))
    best = F.max(F.struct("share", (-F.col("kind")).alias("kind"))).alias("best")
    added = open_.join(sure, "pattern").groupBy("_id", "_key", "start", "end").agg(best)
    span = F.struct((BASE_KINDS - F.col("best.kind")).cast("int").alias("kind"), "start", "end")
    added = added.groupBy(F.col("_id").alias("_of"), F.col("_key").alias("_in")).agg(F.collect_set(span).alias("added"))
    same = F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_key") == F.col("_in"))
    both = rows.select("_id", "_key", F.array_sort("spans").alias("base")).join(materialize(added, "added"), same, "left")
    none = F.array().cast("array<struct<kind:int,start:long,end:long>>")
    return both.select("_id", "_key", "base", F.coalesce(F.array_sort("added"), none).alias("added"))


def redact(df: DataFrame, doc_id: str = "doc_id", text: str = "text", spans: str = "redacted") -> DataFrame:
    """The rows of ``df`` with every span replaced by its kind in brackets, and ``spans`` (start, end, fill)."""
    every = F.array_distinct(F.concat("base", "added"))
    names = F.array(*[F.lit(f"[{k.removeprefix('context_').upper()}]") for k in KINDS])

    def filled(s):
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.get(names, s["kind"]).alias("fill"))

    found = detect(df, doc_id, text).where(F.size("base") + F.size("added") > 0).withColumn(spans, F.transform(every, filled))
    found = materialize(found.select("_id", "_key", spans).dropDuplicates(["_id", "_key"]), "spans")
    return rewrite_texts(attach(df, doc_id, text, found, [spans]), text, spans)
