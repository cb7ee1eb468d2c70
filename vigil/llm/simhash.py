"""Near-duplicates by SimHash fingerprints, found through Golay codewords.

Fingerprint: a text's words, A-Z lower-cased, form shingles of n words,
repeats included (fewer words: the whole sequence); a bit is set if more than
half of the shingles' 64-bit hashes have it.

Search: the 64 bits are cut into segments of 22, 21 and 21 bits.  Padded with
zeros to 23 bits, a segment has one or six codewords of the perfect Golay code
within four bits, and two segments that differ in at most two bits have one of
them in common: the word half way between them lies within three bits of a
codeword, hence both within four.  Four differing bits always leave a segment with at most
two of them while at least two of the four halves of the other segments stay
equal.  So a key is a segment's codeword and two halves of the others: 3
segments x 6 pairs of halves x 1 or 6 codewords.  Two fingerprints that link
share a key; those that share a key are verified.

Defined cases: null and empty texts, and texts of white space, have
fingerprint zero and link like any other; equal fingerprints are searched
once; rows with a null id get the component of their fingerprint, whose id is
the smallest id that is not null (null if there is none); repeated rows give
repeated results; other columns are not read.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vigil.llm.common import map_texts, row_hash, unused
from vigil.llm.graphs import components
from vigil.session import materialize

BITS = 4  # most differing bits; the search below is proven for this number
SHINGLE = 4  # words
SEED = 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit and length
GENERATOR = 0b101011100011  # of the (23, 12) Golay code
BLOCK = 1 << 16  # hashes or fingerprints that are compared at once


def fingerprint(text: str | None, words: int = SHINGLE) -> int:
    """SimHash of a whole text as an unsigned integer."""
    import xxhash

    found = (text or "").encode().lower().split()
    if not found:
        return 0
    ends = list(accumulate(len(w) + 1 for w in found))
    joined, count = b" ".join(found), max(1, len(found) - words + 1)
    starts = [0, *ends][:count]
    hashed, seed = xxhash.xxh64_intdigest, SEED
    shingles = zip(starts, ends[words - 1 :] if len(found) >= words else ends[-1:])
    hashes = np.fromiter((hashed(joined[a : b - 1], seed) for a, b in shingles), dtype="<u8", count=count)
    set_in = np.zeros(64, dtype=np.int64)
    for i in range(0, count, BLOCK):
        bits = np.unpackbits(hashes[i : i + BLOCK].view(np.uint8), bitorder="little")
        set_in += bits.reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_in > count, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, kept: list[str], text: str = "text", words: int = SHINGLE) -> DataFrame:
    """``kept`` and ``fingerprint`` (the 64 bits as a long) of each whole text."""

    def make():
        return lambda texts: [np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).astype(np.int64)]

    return map_texts(df, kept, make, "fingerprint long", text)


def remainder(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words by the generator: equal for words of one coset."""
    rest = words.astype(np.int64)
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ GENERATOR << bit - 11, rest)
    return rest


def coset_errors() -> tuple[np.ndarray, np.ndarray]:
    """For each remainder the errors of at most four bits that lead to it (1 or 6), and their number."""
    errors = np.array([sum(1 << b for b in some) for n in range(5) for some in combinations(range(23), n)])
    errors, rest = errors, remainder(errors)
    order = np.argsort(rest, kind="stable")
    count = np.bincount(rest, minlength=2048)
    table = np.zeros((2048, 6), dtype=np.int64)
    place = np.arange(len(errors)) - np.repeat(np.cumsum(count) - count, count)
    table[rest[order], place] = errors[order]
    return table, count


def key_maker():
    """A function from fingerprints (uint64) to the arrays (key, fingerprint) of all their keys."""
    table, count = coset_errors()
    low, high = remainder(np.arange(1 << 12)), remainder(np.arange(1 << 11) << 12)

    def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        segments = [(fps >> np.uint64(a)).astype(np.int64) & (1 << n) - 1 for a, n in SEGMENTS]
        out_key, out_fp = [], []
        for at, word in enumerate(segments):
            halves = [h for k, s in enumerate(segments) if k != at for h in (s & 0x7FF, s >> 11)]
            rest = low[word & 0xFFF] ^ high[word >> 12]
            for many in (1, 6):
                some = np.flatnonzero(count[rest] == many)
                code = (word[some, None] ^ table[rest[some], :many]) >> 11
                for mask, (x, y) in enumerate(combinations(range(4), 2)):
                    exact = (halves[x][some] << 11 | halves[y][some])[:, None]
                    out_key.append(((at * 6 + mask) << 36 | code << 24 | exact).ravel())
                    out_fp.append(np.repeat(fps[some], many))
        return np.concatenate(out_key), np.concatenate(out_fp)

    return keys


def bucket_links(fps: np.ndarray) -> list[np.ndarray]:
    """Links that connect the fingerprints of one bucket as all links up to ``BITS`` would.

    Fingerprints are gathered around some of their own; members of a group
    need no further comparison with each other.  Groups are then compared
    member by member, larger groups first, and one link joins two of them.
    """
    groups, rest = [], fps
    while len(rest):
        near = np.bitwise_count(rest ^ rest[0]) <= BITS
        groups.append(rest[near])
        rest = rest[~near]
    groups.sort(key=len, reverse=True)
    links = [np.stack([np.broadcast_to(g[0], len(g) - 1), g[1:]], axis=1) for g in groups]
    others = np.concatenate(groups)
    owner = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    start = 0
    for number, group in enumerate(groups):
        start += len(group)
        if len(group) == 1:  # the rest are single and further apart than BITS
            break
        joined = np.zeros(len(groups), dtype=bool)
        step = max(1, (1 << 22) // max(1, len(others) - start))
        for i in range(0, len(group), step):
            part = group[i : i + step]
            mine, theirs = np.nonzero(np.bitwise_count(part[:, None] ^ others[None, start:]) <= BITS)
            met, first = np.unique(owner[start + theirs], return_index=True)
            first = first[~joined[met]]
            joined[met] = True
            links.append(np.stack([part[mine[first]], others[start + theirs[first]]], axis=1))
    return links


def run_links(keys: np.ndarray, fps: np.ndarray) -> np.ndarray:
    """Links of all buckets of sorted keys; most members link to the first of their bucket."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    length = np.diff(np.concatenate([first, [len(keys)]]))
    head = np.repeat(fps[first], length)
    near = np.bitwise_count(fps ^ head) <= BITS
    links = [np.stack([head, fps], axis=1)[near & (fps != head)]]
    apart = np.add.reduceat(~near, first) if len(first) else np.zeros(0, dtype=np.int64)
    for run in np.flatnonzero((apart > 0) & (length > 2)):
        links += bucket_links(fps[first[run] : first[run] + length[run]])
    found = np.concatenate(links)
    return np.unique(found, axis=0) if len(found) else found


def links(fps: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` between distinct fingerprints (column ``fingerprint``).

    They connect the same fingerprints as all pairs of at most ``BITS``
    differing bits; pairs that others connect are left out.
    """

    def spread(batches):
        make = key_maker()
        for batch in batches:
            every = batch.column("fingerprint").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for i in range(0, len(every), 4096):
                key, fp = make(every[i : i + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp.view(np.int64))], names=["key", "fp"])

    def join(batches):
        key, fp = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        for batch in batches:
            key = np.concatenate([key, batch.column("key").to_numpy()])
            fp = np.concatenate([fp, batch.column("fp").to_numpy().view(np.uint64)])
            if len(key) >= BLOCK:
                cut = np.searchsorted(key, key[-1])  # the last bucket may go on
                if cut:
                    yield as_batch(run_links(key[:cut], fp[:cut]))
                    key, fp = key[cut:], fp[cut:]
        if len(key):
            yield as_batch(run_links(key, fp))

    def as_batch(found: np.ndarray) -> pa.RecordBatch:
        found = found.reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    keyed = fps.select("fingerprint").mapInArrow(spread, "key long, fp long")
    sorted_keys = keyed.repartition("key").sortWithinPartitions("key", "fp")
    return sorted_keys.mapInArrow(join, "a long, b long")


def near_duplicates(
    df: DataFrame,
    kept: list[str],
    doc_id: str = "doc_id",
    text: str = "text",
    words: int = SHINGLE,
    bits: int = BITS,
) -> DataFrame:
    """``kept``, ``fingerprint``, ``component`` and ``component_id`` of every row.

    ``component`` is the smallest fingerprint reachable, ``component_id`` the
    smallest id (column ``doc_id``, which must be kept).
    """
    if bits != BITS:
        raise ValueError(f"the keys are made for {BITS} differing bits")
    rows = materialize(fingerprints(df, kept, text, words), "fingerprints")
    distinct = materialize(rows.groupBy("fingerprint").agg(F.min(doc_id).alias("_first")), "distinct_fingerprints")
    label = components(links(distinct)).select(F.col("node").alias("fingerprint"), "label")
    labelled = distinct.join(label, "fingerprint", "left")
    labelled = labelled.select("fingerprint", "_first", F.coalesce("label", "fingerprint").alias("component"))
    labelled = materialize(labelled, "labelled")
    smallest = materialize(labelled.groupBy("component").agg(F.min("_first").alias("component_id")), "smallest")
    owner = labelled.join(smallest, "component").select("fingerprint", "component", "component_id")
    return rows.join(materialize(owner, "owners"), "fingerprint").select(*kept, "fingerprint", "component", "component_id")


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """One row of each component: the smallest id (null last), then the smallest hash of the row."""
    own, of, hashed, number = unused(df, "_own", "_of", "_hash", "_number")
    keyed = df.withColumn(own, row_hash(df))
    narrow = keyed.select(F.col(doc_id).alias("_id"), F.col(own).alias("_row"), F.col(text).alias("_text"))
    found = near_duplicates(narrow, ["_id", "_row"], "_id", "_text", words, bits)
    place = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_row").alias("row"))
    first = found.groupBy("component").agg(F.min(place).alias("first"))
    first = materialize(first.select(F.col("first.id").alias(of), F.col("first.row").alias(hashed)), "firsts")
    both = keyed.join(first, (F.col(own) == F.col(hashed)) & F.col(doc_id).eqNullSafe(F.col(of)))
    alike = F.row_number().over(W.partitionBy(own, doc_id).orderBy(own))
    return both.withColumn(number, alike).where(F.col(number) == 1).select(*[F.col(f"`{c}`") for c in df.columns])
