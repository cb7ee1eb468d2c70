"""What several of the operators share: tables, folds, row keys, work on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of the documents table, in order.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from; a null id counts as not held out."""
    return F.coalesce(fold(doc_id) == 2, F.lit(False))


def may_learn(doc_id: Column) -> Column:
    """Rows a model may learn from; a null id is not one of them."""
    return F.coalesce(fold(doc_id) != 2, F.lit(False))


def row_hash(df: DataFrame) -> Column:
    """Hash of all columns that tells a null in one column from a null in another."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    return F.xxhash64(*columns, *[c.isNull() for c in columns])


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Parts of the batches, so that few texts are Python objects at a time."""
    for batch in batches:
        for start in range(0, len(batch), rows):
            yield batch.slice(start, rows)


def map_texts(
    df: DataFrame,
    kept: list[str],
    make: Callable[[], Callable[[list], list[list]]],
    added: str,
    text: str = "text",
) -> DataFrame:
    """Columns ``kept`` of the input and the columns ``added`` (DDL) computed from ``text``.

    ``make`` runs once in each task and returns a function from the texts of a
    batch (None for null) to one list of values for each added column.
    Nothing but ``kept`` and ``text`` is sent to Python.
    """
    new = T.DataType.fromDDL(added)
    schema = T.StructType([*[T.StructField(c, df.schema[c].dataType, True) for c in kept], *new.fields])

    sent = kept if text in kept else [*kept, text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        work, arrow = make(), to_arrow_schema(schema)
        for batch in slices(batches):
            columns = work(batch.column(sent.index(text)).to_pylist())
            arrays = [batch.column(i) for i in range(len(kept))]
            arrays += [pa.array(x, type=arrow.field(len(kept) + i).type) for i, x in enumerate(columns)]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.select(*[F.col(f"`{c}`") for c in sent]).mapInArrow(run, schema)


def joined_spans(spans: list[tuple]) -> list[tuple]:
    """(start, end, fill) by start; overlapping spans become one, with the fill of the first."""
    out: list[list] = []
    for start, end, fill in sorted(spans, key=lambda x: (x[0], -x[1], x[2])):
        if out and start < out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end, fill])
    return [tuple(x) for x in out]


def rewrite_texts(df: DataFrame, text: str, spans: str) -> DataFrame:
    """``df`` with the spans of ``text`` replaced by their fill.

    ``spans`` is an array of (start, end, fill), code points of the whole text,
    end exclusive, or null; afterwards it holds the joined spans.
    """
    schema, names = df.schema, df.columns
    at, of = names.index(text), names.index(spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            columns = list(batch.columns)
            texts, found = columns[at].to_pylist(), columns[of].to_pylist()
            for i, some in enumerate(found):
                merged = joined_spans([(s["start"], s["end"], s["fill"]) for s in some or []])
                found[i] = [{"start": a, "end": b, "fill": fill} for a, b, fill in merged]
                if merged:
                    pieces, last = [], 0
                    for a, b, fill in merged:
                        pieces += [texts[i][last:a], fill]
                        last = b
                    texts[i] = "".join([*pieces, texts[i][last:]])
            columns[at], columns[of] = pa.array(texts, columns[at].type), pa.array(found, columns[of].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.mapInArrow(run, schema)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until no column of ``df`` has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def attach(df: DataFrame, doc_id: str, text: str, found: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` and ``columns`` of ``found`` (with ``_id``, ``_key``: the id and the hash of the text), null without."""
    kept = [c for c in df.columns if c not in columns]
    own, of, key = unused(df, "_own", "_of", "_key")
    keyed = df.select(*[F.col(f"`{c}`") for c in kept], F.xxhash64(text).alias(own))
    other = found.select(F.col("_id").alias(of), F.col("_key").alias(key), *columns)
    both = keyed.join(other, F.col(doc_id).eqNullSafe(F.col(of)) & (F.col(own) == F.col(key)), "left")
    return both.select(*[F.col(f"`{c}`") for c in kept], *columns)
