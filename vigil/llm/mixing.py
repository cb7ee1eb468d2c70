"""Mixing sources to target sizes by balanced sampling (the cube method).

Every source has a target number of words.  A document of a source is taken
floor(target / size of the source) times, and once more with the fraction left
over as its chance.  Which documents are taken once more is a balanced sample:
chances move along directions that change neither the words nor the documents
expected from the source, until they meet 0 or 1.  A source is divided by hash
into blocks of ``BLOCK`` documents; each block leaves two chances undecided at
most, which form the blocks of the next round.  The last block of a source
lands: first without the balance of documents, then by chance.

All chance comes from hashes of the rows, so reruns agree, whatever the
partitions.

Defined cases: null texts have no words; a source without words has a target
of 0 and its documents are not taken; null is a source of its own, after all
others; rows alike in all columns are interchangeable; an empty table gives an
empty table; other columns of the input neither matter nor clash.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vigil.llm.common import row_hash, unused
from vigil.session import materialize

WEIGHTS = (3.0, 1.0, 2.0)
#: Words of the mix by words of the input; most words of a source by its words.
SHARE, MOST = 1.5, 2.0
#: Documents that one task decides together.
BLOCK = 4096
EDGE = 1e-9


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and U+0009 to U+000D; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``_source``, ``_rank``, ``_docs``, ``_words`` and ``_target`` of each source of (``_source``, ``_size``).

    One row a source; targets that pass ``most`` stop there and the rest is
    shared again.  Only sums come to the driver.
    """
    stats = sizes.groupBy("_source").agg(F.count(F.lit(1)).alias("_docs"), F.sum("_size").alias("_words"))
    order = W.orderBy(F.col("_source").asc_nulls_last())
    ranked = stats.withColumn("_rank", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = materialize(ranked.withColumn("_weight", weight), "sources")
    top = F.col("_words") * F.lit(most)
    total = ranked.agg(F.sum("_words")).first()[0] or 0
    per_weight, capped = 0.0, -1
    while True:
        stopped = F.col("_weight") * F.lit(per_weight) > top if capped >= 0 else F.lit(False)
        now = ranked.agg(
            F.sum(F.when(stopped, 1).otherwise(0)), F.sum(F.when(stopped, top)), F.sum(F.when(~stopped, F.col("_weight")))
        ).first()
        if now[0] is None or now[0] == capped or now[2] is None:
            break
        capped, per_weight = now[0], (share * total - (now[1] or 0.0)) / now[2]
    target = F.least(F.col("_weight") * F.lit(per_weight), top)
    return ranked.withColumn("_target", target).drop("_weight")


def decide(size: np.ndarray, chance: np.ndarray, draw: np.random.Generator, land: bool) -> np.ndarray:
    """Chances moved to 0 or 1 with words and documents kept; two stay between unless they ``land``."""
    chance = chance.astype(float).copy()
    open_ = [int(i) for i in np.flatnonzero((chance > EDGE) & (chance < 1 - EDGE))]
    luck = iter(draw.random(2 * len(open_) + 8))
    scale = max(1.0, float(size[open_].mean())) if open_ else 1.0
    x = (size / scale).tolist()
    p = chance.tolist()

    def move(units: list[int], direction: list[float]) -> None:
        """One step of the cube along a direction, up or down by chance, to where a unit meets 0 or 1."""
        up = min((1 - p[i]) / d if d > 0 else -p[i] / d for i, d in zip(units, direction) if d)
        down = min(p[i] / d if d > 0 else (p[i] - 1) / d for i, d in zip(units, direction) if d)
        step = up if next(luck) * (up + down) < down else -down
        for i, d in zip(units, direction):
            q = p[i] + step * d
            p[i] = 0.0 if q < EDGE else 1.0 if q > 1 - EDGE else q

    window: list[int] = []
    for unit in open_:
        window.append(unit)
        if len(window) == 3:
            a, b, c = (x[i] for i in window)
            # the null space of the rows (sizes) and (1, 1, 1); equal sizes balance by two units alone
            move(window, [b - c, c - a, a - b] if (a, b) != (b, c) else [1.0, -1.0, 0.0])
            window = [i for i in window if 0 < p[i] < 1]
    if land:
        if len(window) == 2:
            a, b = (x[i] for i in window)
            move(window, [b, -a] if a or b else [1.0, -1.0])
            window = [i for i in window if 0 < p[i] < 1]
        for i in window:
            p[i] = 1.0 if next(luck) < p[i] else 0.0
    return np.array(p)


def copies(df: DataFrame, key: list[str], source: str, text: str) -> DataFrame:
    """``key`` and ``_hash`` of every row, ``_size``, ``_words`` and ``_target`` of its source, ``_copies``."""
    narrow = df.select(
        *[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(key)],
        row_hash(df).alias("_hash"),
        F.col(f"`{source}`").alias("_source"),
        word_count(F.col(f"`{text}`")).alias("_size"),
    )
    narrow = materialize(narrow, "sizes")
    keys = [f"_k{i}" for i in range(len(key))]
    targets = materialize(source_targets(narrow.select("_source", "_size")), "targets").withColumnRenamed("_source", "_of")
    rows = narrow.join(targets, F.col("_source").eqNullSafe(F.col("_of"))).drop("_of", "_source")
    ratio = F.when(F.col("_words") > 0, F.col("_target") / F.col("_words")).otherwise(F.lit(0.0))
    rows = rows.withColumn("_whole", F.floor(ratio + EDGE)).withColumn("_chance", ratio - F.col("_whole"))
    rows = rows.withColumn("_chance", F.greatest(F.lit(0.0), "_chance")).withColumn("_left", F.col("_docs"))
    done, number = None, 0
    while True:
        blocks = F.ceil(F.col("_left") / F.lit(BLOCK))
        blocked = rows.withColumn("_last", blocks <= 1)
        blocked = blocked.withColumn("_block", F.pmod(F.xxhash64("_hash", *keys, F.lit(number)), blocks))
        decided = materialize(_decided(blocked, keys, number), f"round_{number}")
        settled = decided.where((F.col("_chance") == 0) | (F.col("_chance") == 1))
        done = settled if done is None else done.unionByName(settled)
        rows = decided.where((F.col("_chance") > 0) & (F.col("_chance") < 1))
        left = materialize(rows.groupBy("_rank").agg(F.count(F.lit(1)).alias("_left")), "left")
        if left.isEmpty():
            break
        rows = rows.drop("_left").join(left, "_rank")
        number += 1
    done = done.withColumn("_copies", (F.col("_whole") + F.col("_chance")).cast("long"))
    named = [F.col(k).alias(c) for k, c in zip(keys, key)]
    return done.select(*named, "_hash", "_size", "_words", "_target", "_copies")


def _decided(rows: DataFrame, keys: list[str], number: int) -> DataFrame:
    """One round: every block of a source decides its chances."""
    schema = rows.drop("_block", "_last").schema
    order = [(c, "ascending") for c in ("_hash", "_size", *keys)]

    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by(order)
        rank, part, last = (block.column(c)[0].as_py() for c in ("_rank", "_block", "_last"))
        draw = np.random.default_rng([zlib.crc32(block.column("_hash").to_numpy().tobytes()), rank, part, number])
        chance = decide(block.column("_size").to_numpy(), block.column("_chance").to_numpy(), draw, last)
        at = block.column_names.index("_chance")
        return block.set_column(at, "_chance", pa.array(chance)).select(schema.fieldNames())

    return rows.groupBy("_rank", "_block").applyInArrow(run, schema)


def mix(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of ``df``, each as often as the mix takes it."""
    own, of, hashed, times, alike, one = unused(df, "_own", "_of", "_hash", "_copies", "_rows", "_one")
    columns = [F.col(f"`{c}`") for c in df.columns]
    decided = copies(df, [doc_id], source, text)
    taken = decided.groupBy(F.col(doc_id).alias(of), F.col("_hash").alias(hashed))
    taken = materialize(taken.agg(F.sum("_copies").alias(times), F.count(F.lit(1)).alias(alike)), "copies")
    keyed = df.withColumn(own, row_hash(df))
    both = keyed.join(taken, F.col(doc_id).eqNullSafe(F.col(of)) & (F.col(own) == F.col(hashed)))
    single = both.where(F.col(alike) == 1).select(*columns, times)
    # rows alike in all columns are one row here, taken as often as all of them together
    several = both.where(F.col(alike) > 1).select(*columns, times).distinct()
    wanted = single.union(several).where(F.col(times) > 0)
    repeated = wanted.withColumn(one, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times))))
    return repeated.select(*columns)
