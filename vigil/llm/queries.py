"""One query for each operator: thin, over the whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm import alignment, bpe, graph_index, langid, merkle, mixing, personal, pivots, quality, repeats, secrets, simhash, sketches
from vigil.llm.checks import ORACLE
from vigil.llm.common import held_out, table

VOCABULARY, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
BYTE_BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op1_balanced_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.copies(table(spark, sf_dir, "documents"), ["doc_id"], "source", "text")
    return rows.select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_words").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_size") * F.col("_copies")).alias("taken"),
    )


def op2_graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_index.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.find(table(spark, sf_dir, "documents"), ["doc_id"])
    counts = [
        F.size(F.filter("base", lambda s: s["kind"] == 0)).cast("long").alias("n_assign"),
        F.size(F.filter("base", lambda s: s["kind"] == 1)).cast("long").alias("n_access"),
        F.size(F.filter("base", lambda s: s["kind"] == 2)).cast("long").alias("n_hex"),
    ]
    every = F.array_sort(F.concat("base", "added"))
    base_sha256 = F.sha2(secrets.written(F.col("base")), 256).alias("base_sha256")
    return rows.select("doc_id", *counts, base_sha256, secrets.written(every).alias("spans"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = quality.learn(docs, table(spark, sf_dir, "labels"))
    rows = quality.score(docs, trees, ["doc_id"])
    likely = F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", likely)


def op5_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = personal.detect(table(spark, sf_dir, "documents"))
    names = F.array(*map(F.lit, personal.KINDS))

    def written(spans):
        one = F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"]))
        return F.array_join(one, ",")

    counts = [
        F.size(F.filter("base", lambda s: s["kind"] == 0)).cast("long").alias("n_email"),
        F.size(F.filter("base", lambda s: s["kind"] == 1)).cast("long").alias("n_ip"),
        F.size(F.filter("base", lambda s: s["kind"] == 2)).cast("long").alias("n_card"),
        F.size(F.filter("base", lambda s: s["kind"] == 3)).cast("long").alias("n_phone"),
    ]
    base_sha256 = F.sha2(written("base"), 256).alias("base_sha256")
    spans = written(F.concat("base", "added")).alias("spans")  # kinds of added spans come last
    return rows.select(F.col("_id").alias("doc_id"), *counts, base_sha256, spans)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = bpe.round_trip(table(spark, sf_dir, "documents"), ["doc_id"], VOCABULARY, PATTERN)
    return back.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = langid.identify(docs, langid.learn(docs), ["doc_id"])
    return rows.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "margin", "rejected"
    )


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"), ["doc_id"])
    digits = F.lpad(F.lower(F.hex("fingerprint")), 16, "0")
    return rows.select("doc_id", digits.alias("fingerprint"), "component_id")


def op9_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.top_products(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    spans = F.transform("removed", lambda s: F.concat_ws(":", s["start"], s["end"]))
    lost = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return rows.select(
        "doc_id",
        F.size("removed").cast("long").alias("n_removed"),
        lost.alias("removed_chars"),
        F.array_join(spans, ",").alias("spans"),
        F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"),
    )


def alignment_rows(docs: DataFrame) -> DataFrame:
    return alignment.align(docs, ["doc_id"], BYTE_BPE, PIECES)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_rows(table(spark, sf_dir, "documents"))


def merkle_rows(docs: DataFrame) -> DataFrame:
    """Manifest of a documents table; every row whose id's crc32 is a multiple of 7 claims one more character."""
    claims = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    one_more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    n_chars = F.when(F.coalesce(claims, F.lit(False)), one_more).otherwise(F.col("n_chars").cast("string"))
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    rows = merkle.manifest(docs, ["doc_id"], fields, "lang", "doc_id", {"n_chars": n_chars})
    return rows.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_rows(table(spark, sf_dir, "documents"))


def sketch_rows(docs: DataFrame) -> DataFrame:
    rows = sketches.with_next_and_edited(docs)
    own, edited, after = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        sketches.written(own).alias("fingerprint"),
        sketches.written(edited).alias("edited_fingerprint"),
        sketches.containment(own, edited).alias("near_edited"),
        sketches.containment(own, after).alias("near_next"),
    )


def op13_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch_rows(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_balanced_mix,
        op2_graph_neighbours,
        op3_secrets,
        op4_quality,
        op5_personal,
        op6_byte_bpe,
        op7_language,
        op8_simhash,
        op9_pivot_search,
        op10_repeats,
        op11_alignment,
        op12_merkle_manifest,
        op13_scaled_sketch,
        pipeline,
    )
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
