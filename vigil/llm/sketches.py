"""Document fingerprints by threshold-scaled sketches of word shingles.

A shingle is ``WORDS`` consecutive words (fewer words: the whole sequence),
joined by spaces; its hash is the first 64 bits of its MD5, as 16 hexadecimal
digits.  A sketch keeps, in ascending order, every distinct hash that starts
with ``BELOW`` zeros, a fixed share of 1/16, whatever the length of the text.
So sketches of parts merge into that of the whole, and a short text is
estimated against a long one without bias.  Texts with fewer kept hashes keep
their ``LEAST`` smallest ones; the sketch still merges, and comparisons use the
hashes only that both sketches would have kept.

All of it is Spark's own functions: no Python runs in tasks.

Defined cases: null texts count as empty; texts without a word have an empty
sketch, like only to another empty one; long texts are read whole; equal texts
have equal sketches; an empty table stays empty; columns that are not named are
not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.operators.ranges import positions
from vigil.session import materialize

WORDS = 5
#: Leading zeros of the hashes that are always kept, and the least number kept.
BELOW = "0"
LEAST = 16
DIGITS = 16
#: Rows that one row of a group of rows alike stands for.
REPEATS = 1 << 16


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once for a row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def kept_hashes(every: Column) -> Column:
    """Sketch of an array of hashes."""

    def of(hashes: Column) -> Column:
        low = F.array_distinct(F.filter(hashes, lambda x: x.startswith(BELOW)))
        fewest = F.slice(F.array_sort(F.array_distinct(hashes)), 1, LEAST)
        return let(low, lambda some: F.when(F.size(some) >= LEAST, F.array_sort(some)).otherwise(fewest))

    return let(every, of)


def sketch(text: Column) -> Column:
    """Sketch of a text: ascending array of hashes."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")

    def hashes(every: Column) -> Column:
        count = F.greatest(F.size(every) - (WORDS - 1), F.least(F.size(every), F.lit(1)))
        starts = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
        return F.transform(
            starts, lambda i: F.substring(F.md5(F.concat_ws(" ", F.slice(every, i, WORDS))), 1, DIGITS)
        )

    return kept_hashes(let(words, hashes))


def merged(a: Column, b: Column) -> Column:
    """Sketch of the shingles of both."""
    return kept_hashes(F.array_union(a, b))


def packed(hashes: Column) -> Column:
    """The hashes as bytes, eight each."""
    return F.unhex(F.array_join(hashes, ""))


def unpacked(data: Column) -> Column:
    def of(text: Column) -> Column:
        count = (F.length(text) / DIGITS).cast("int")
        starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substring(text, i * DIGITS + 1, F.lit(DIGITS)))

    return let(F.lower(F.hex(data)), of)


def written(hashes: Column) -> Column:
    return F.array_join(hashes, "")


def containment(a: Column, b: Column) -> Column:
    """Share of the shingles of ``a`` that ``b`` has too, estimated from sketches; 1 for equal sketches."""

    def of(mine: Column, other: Column) -> Column:
        # beyond its last hash, a sketch of LEAST hashes and more tells nothing but of hashes that are always kept
        seen = F.filter(mine, lambda x: x.startswith(BELOW) | (x <= F.element_at(other, -1)))
        seen = F.when(F.size(other) < LEAST, mine).otherwise(seen)
        return let(
            seen,
            lambda some: F.when(
                F.size(some) > 0, F.size(F.array_intersect(some, other)) / F.size(some)
            ).otherwise(F.lit(0.0)),
        )

    return F.when(a == b, F.lit(1.0)).otherwise(let(a, lambda x: let(b, lambda y: of(x, y))))


def fingerprints(df: DataFrame, kept: list[str], text: str = "text") -> DataFrame:
    """``kept`` and ``sketch`` of each whole text."""
    return df.select(*[F.col(f"`{c}`") for c in kept], sketch(F.col(f"`{text}`")).alias("sketch"))


def with_next_and_edited(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document with the sketches of its own, its edited and the next document's text.

    Next: by descending id (null last), then digest of id and text; the first
    follows the last.  Edited: the last third of the code points (rounded down)
    replaced by as many of the next text's first ones.  Columns: ``doc_id``,
    ``n_chars``, ``edited_sha256``, ``sketch``, ``edited_sketch``, ``next_sketch``.

    The order is found on ids and digests alone.  Of the next text only the
    part that is needed is shuffled to the document.  Rows alike in id and text
    are one until the end: all but the last of them are followed by their like.
    """
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    keyed = df.select(F.col(f"`{doc_id}`").alias("_id"), value.alias("_text"))
    whole = F.concat(F.coalesce(F.col("_id").cast("string"), F.lit("-")), F.lit(" "), F.col("_text"))
    keyed = keyed.withColumn("_key", F.unhex(F.sha2(whole, 256)))  # never null, so joins reuse one exchange
    alike = keyed.groupBy("_key", "_id", F.length("_text").alias("_n"), packed(sketch(F.col("_text"))).alias("_own"))
    alike = materialize(alike.agg(F.count("*").alias("_copies")), "sketches")
    placed = positions(alike.drop("_own"), [], [F.col("_id").desc_nulls_last(), F.col("_key")], "_pos", "_size")
    after = placed.select(F.col("_pos").alias("_at"), F.col("_key").alias("_next_key"))
    beside = placed.join(after, F.pmod(F.col("_pos") + 1, F.col("_size")) == F.col("_at"))
    # one row asks for the next text, further ones for as many rows alike each as one row may stand for
    more = F.col("_copies") - 1
    following = F.struct("_next_key", F.lit(1).cast("long").alias("_rows"))
    itself = F.transform(
        F.sequence(F.lit(0).cast("long"), F.greatest(more - 1, F.lit(0)), F.lit(REPEATS).cast("long")),
        lambda i: F.struct(F.col("_key").alias("_next_key"), F.least(F.lit(REPEATS).cast("long"), more - i).alias("_rows")),
    )
    every = F.when(more > 0, F.concat(F.array(following), itself)).otherwise(F.array(following))
    third = F.floor(F.col("_n") / 3).cast("int")
    asks = beside.select(
        F.col("_key").alias("_for_key"), "_id", third.alias("_third"), (F.col("_n") - third).alias("_left"),
        F.explode(every).alias("_ask"),
    ).select("_for_key", "_id", "_third", "_left", "_ask.*")
    texts = keyed.groupBy("_key").agg(F.min("_text").alias("_text")).join(alike.select("_key", "_own"), "_key")
    parts = asks.join(texts, F.col("_next_key") == F.col("_key")).select(
        "_for_key", "_id", "_left", "_rows",
        F.col("_own").alias("_next"), F.substring("_text", F.lit(1), F.col("_third")).alias("_part"),
    )
    edited = F.concat(F.substring("_text", F.lit(1), F.col("_left")), "_part").alias("_edited")
    both = texts.join(parts, F.col("_key") == F.col("_for_key"))
    both = both.select("_id", F.length("_text").cast("long").alias("n_chars"), "_own", "_next", "_rows", edited)
    found = both.select(
        F.col("_id").alias("doc_id"),
        "n_chars",
        F.sha2("_edited", 256).alias("edited_sha256"),
        unpacked(F.col("_own")).alias("sketch"),
        sketch(F.col("_edited")).alias("edited_sketch"),
        unpacked(F.col("_next")).alias("next_sketch"),
        "_rows",
    )
    return found.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rows")))).drop("_row", "_rows")
