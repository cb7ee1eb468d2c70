"""Removal of lines and sentences that occur before, in the same or another document.

A unit is a line of at least ``LINE_WORDS`` words, or a piece of a line up to a
full stop, exclamation or question mark and a space, of at least
``SENTENCE_WORDS`` words.  Units are lower-cased, white space is made one space,
and the MD5 digest of that is what is compared.  Occurrences are ranked by id
(null last), then by the hash of the text, then by place; the first of a digest
stays and all others are removed.  Spans are code points of the original text,
end exclusive; those that touch are not joined, those that overlap are.

Two occurrences that overlap in one document are one.  Rows with equal id and
text are one document: all get the same result.

Defined cases: null and empty texts lose nothing, a null text stays null;
an empty table gives an empty table; rows with null ids are told apart by
their text; columns of the input other than id and text are kept unless they
have the name of an added column, which then replaces them.
"""

from __future__ import annotations

import hashlib
import re
import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import attach, rewrite_texts, slices
from vigil.session import materialize

LINE_WORDS, SENTENCE_WORDS = 6, 8
_SENTENCE = re.compile(r"\n|(?<=[.!?]) ")
_BLANK = re.compile(r"[\x09-\x0d\x20]+")

_UNITS = "_id long, _key long, _high long, _low long, _start long, _end long, _again boolean"


def units(text: str) -> list[tuple[bytes, int, int, bool]]:
    """(digest, start, end, again) of a text's units; ``again``: the digest has an earlier occurrence here."""
    spans, start = [], 0
    for line in text.split("\n"):
        spans.append((start, start + len(line), LINE_WORDS))
        start += len(line) + 1
    start = 0
    for gap in _SENTENCE.finditer(text):
        spans.append((start, gap.start(), SENTENCE_WORDS))
        start = gap.end()
    spans.append((start, len(text), SENTENCE_WORDS))
    found, first = [], {}
    for start, end, least in sorted(spans, key=lambda x: (x[0], -x[1])):
        words = _BLANK.sub(" ", text[start:end]).strip(" ")
        if words.count(" ") + 1 >= least:
            digest = hashlib.md5(words.lower().encode()).digest()
            if digest not in first:
                first[digest] = end
                found.append((digest, start, end, False))
            elif start >= first[digest]:
                found.append((digest, start, end, True))
    return found


def _unit_rows(df: DataFrame) -> DataFrame:
    def run(batches):
        for batch in slices(batches):
            ids, keys = batch.column("_id").to_pylist(), batch.column("_key").to_pylist()
            rows = []
            for doc, key, text in zip(ids, keys, batch.column("_text").to_pylist()):
                rows += [(doc, key, *struct.unpack("<qq", d), a, b, again) for d, a, b, again in units(text or "")]
                if len(rows) > 50_000:
                    yield as_batch(rows)
                    rows = []
            yield as_batch(rows)

    def as_batch(rows):
        kinds = [pa.int64()] * 6 + [pa.bool_()]
        columns = list(zip(*rows)) if rows else [[]] * 7
        names = [c.split()[0] for c in _UNITS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return df.mapInArrow(run, _UNITS)


def removed_spans(docs: DataFrame) -> DataFrame:
    """``_id``, ``_key`` and ``removed`` of documents (``_id``, ``_key``, ``_text``) that lose something.

    Owners of digests are found by partial minima, so a line that a third of
    all documents hold is reduced before it is shuffled; the join back reads
    written tables, where adaptive execution splits such a digest.
    """
    found = materialize(_unit_rows(docs), "units")
    place = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_key").alias("key"))
    digests = found.where(~F.col("_again")).groupBy("_high", "_low")
    owners = digests.agg(F.min(place).alias("_owner"), F.max(place).alias("_last"))
    owners = materialize(owners.where("_owner != _last").select("_high", "_low", "_owner"), "owners")
    later = found.where(~F.col("_again")).withColumn("_place", place).join(owners, ["_high", "_low"])
    span = F.struct(F.col("_start").alias("start"), F.col("_end").alias("end"), F.lit("").alias("fill")).alias("_span")
    later = later.where("_place != _owner").select("_id", "_key", span)
    lost = later.union(found.where("_again").select("_id", "_key", span))
    return lost.groupBy("_id", "_key").agg(F.collect_set("_span").alias("removed"))


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df``, repeats cut from ``text``, and ``removed``: array of (start, end, fill)."""
    docs = df.select(F.col(doc_id).cast("long").alias("_id"), F.xxhash64(text).alias("_key"), F.col(text).alias("_text"))
    lost = materialize(removed_spans(docs), "removed")
    return rewrite_texts(attach(df, doc_id, text, lost, ["removed"]), text, "removed")
