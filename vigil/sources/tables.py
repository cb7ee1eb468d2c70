"""Table sinks, file inventories and publishing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil import fixed_values as fv
from vigil.functions import scalars as S
from vigil.operators.contracts import allowlist


def read_many(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One scan over a list of Parquet paths."""
    return spark.read.parquet(*paths)


def read_by_name(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Parquet files whose columns differ, matched by name."""
    return spark.read.option("mergeSchema", True).parquet(*paths)


def union_by_name(parts: list[DataFrame]) -> DataFrame:
    """Concatenation by column name; a column a part lacks becomes NULL."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Parquet with ZSTD; the commit protocol shows a whole table or none."""
    writer = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def overwrite_partitions(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Replace only the partitions present in ``df``; the others stay as they are."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy(*partition_by)
        .parquet(path)
    )


def append_log(df: DataFrame, path: str) -> None:
    """Append-only log of experiments and thresholds."""
    df.write.mode("append").option("compression", "zstd").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def export_rows(predictions: DataFrame) -> DataFrame:
    """Fixed field list with text that a spreadsheet would run as a formula quoted."""
    fields = allowlist(predictions, fv.EXPORT_FIELDS)
    text = [name for name, kind in fields.dtypes if kind == "string"]
    return fields.select(
        *[S.formula_safe(F.col(c)).alias(c) if c in text else F.col(c) for c in fields.columns]
    )


def export_csv(predictions: DataFrame, path: str) -> None:
    """Rows as text files; an ordered table keeps its order from file to file, by their names."""
    rows = export_rows(predictions)
    stamps = {name: S.iso_text(F.col(name)) for name, kind in rows.dtypes if "timestamp" in kind}
    write_report(rows.withColumns(stamps) if stamps else rows, path)


def file_inventory(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Name, bytes and modification time; the content column is pruned, never read."""
    files = spark.read.format("binaryFile").load(paths)
    return files.select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("file"),
        F.col("length").alias("bytes"),
        F.col("modificationTime").alias("modified"),
    )


def file_rows(table: DataFrame) -> DataFrame:
    """Rows per file of a table that was read from files."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1)
    return table.groupBy(name.alias("file")).agg(F.count("*").alias("rows"))


#: Rows of a file that share a digest.
DIGEST_ROWS = 4096


def row_digest(columns: list[str]) -> Column:
    """SHA-256 of a row: each value as text with its length in bytes, ``-`` for NULL."""
    texts = [F.col(f"`{c}`").cast("string") for c in columns]
    each = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*each), 256)


def file_digests(table: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows, columns and a digest in order of each file of a table that was read from Parquet files.

    Rows are digested by their place in the file: those of a block together,
    then the blocks.  A changed value, a row more or another order of the rows
    changes it.  No task holds more than a block of row digests, or the block
    digests of a file.
    """
    columns = columns or table.columns
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1)
    rows = table.select(name.alias("file"), F.col("_metadata.row_index").alias("_at"), row_digest(columns).alias("_row"))

    def together(place: str, digest: str) -> Column:
        listed = F.array_sort(F.collect_list(F.struct(place, digest)))
        return F.sha2(F.array_join(F.transform(listed, lambda x: x[digest]), ""), 256)

    blocks = rows.groupBy("file", F.floor(F.col("_at") / DIGEST_ROWS).alias("_block")).agg(
        F.count("*").alias("_rows"), together("_at", "_row").alias("_digest")
    )
    return blocks.groupBy("file").agg(
        F.sum("_rows").alias("rows"), F.lit(len(columns)).alias("columns"), together("_block", "_digest").alias("digest")
    )


def file_manifest(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Bytes, rows, columns and a digest in order per Parquet file, for files of any size."""
    files = spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("bytes"))
    sizes = files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "bytes")
    # each path may have columns of its own
    rows = union_by_name([file_digests(spark.read.parquet(path)) for path in paths])
    return sizes.join(rows, "file", "left")


def changed_files(inventory: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that are new or differ from the manifest of the last run."""
    key = ["file", "bytes", "modified"]
    return inventory.join(manifest.select(*key), key, "left_anti")


def publish(tables: dict[str, DataFrame], root: str, version: str) -> None:
    """Write a whole set under its version, then add the pointer row that shows it.

    A reader follows the newest pointer, so an unfinished set is never seen.
    """
    for name, table in tables.items():
        write_table(table, f"{root}/versions/{version}/{name}")
    spark = next(iter(tables.values())).sparkSession
    pointer = spark.range(1).select(
        F.lit(version).alias("version"), F.current_timestamp().alias("published_at")
    )
    append_log(pointer, f"{root}/current")


def current_version(spark: SparkSession, root: str) -> str:
    newest = F.max_by("version", F.struct("published_at", "version")).alias("version")
    return spark.read.parquet(f"{root}/current").agg(newest).first()["version"]


def read_published(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/versions/{current_version(spark, root)}/{name}")
