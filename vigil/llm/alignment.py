"""Alignment of the tokens of two tokenizers over the same bytes.

Tokenizer A is byte-level BPE (a ``tokenizers`` file) and encodes a space and
the text; tokenizer B is a sentencepiece model, which adds the space itself.
Offsets where tokens of both end cut them into groups; the A and B token that
end together are a link.  A pair of ids counts as many links as the corpus has
of it.

Method: texts are shuffled by their full text, copies being counted before the
shuffle, and each distinct text is tokenised and aligned once.  Its pairs count
as often as the text occurs, and what is measured for it is joined to all rows
that hold it.  Texts are aligned in blocks of about ``BLOCK`` characters (a
longer text is a block): a block adds up its pairs itself, and only its
distinct pairs are shuffled to be counted and sent back to it.  So the exchange
grows with the blocks and their vocabulary, not with the links.

Both tokenizers are asked for pieces between cuts only: before a space that
follows anything but white space, no A pre-token and no B piece goes on (the
vocabulary is searched for pieces that would; with any, texts are encoded
whole).  Pieces seen before are remembered.

Defined cases: null and empty texts have no tokens, and neither have texts
whose tokens do not join to the bytes of a space and the text (such as those
with U+2581 or, for sentencepiece, NUL); texts of any length are aligned whole;
equal counts are all best; repeated rows get equal results; rows with a null id
are kept; an empty table stays empty; other columns are not read, so their
names cannot clash.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import slices, unused
from vigil.session import materialize

#: Characters of the distinct texts of a block.
BLOCK = 1 << 22
#: Characters of the pieces a worker remembers before it starts anew.
REMEMBERED = 1 << 25
#: What is given out for each text.
MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")

_SPACED = re.compile(r"(?:\A|\s) ")
_CUT = re.compile(r"(?<=\S)(?= )")


def byte_letters() -> dict[str, int]:
    """Byte that each letter of a byte-level vocabulary stands for: printable Latin-1 itself, the others from U+0100 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Aligner:
    """Both tokenizers and what they made of the pieces seen so far."""

    def __init__(self, a_file: str, b_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        letters = byte_letters()
        size = self.a.get_vocab_size()
        entries = [self.a.id_to_token(i) for i in range(size)]
        self.a_bytes = [
            bytes(map(letters.__getitem__, t)) if all(c in letters for c in t) else t.encode() for t in entries
        ]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.names = [str(i) for i in range(max(size, len(pieces)))]
        self.space = self.b.piece_to_id("▁")
        self.cuts = not any(re.search("[^▁]▁", p) for p in pieces)
        self.known: dict[str, tuple] = {}
        self.held = 0

    def pieces(self, text: str) -> list[str]:
        """The text in pieces, without the space in front of each."""
        if not self.cuts:
            return [text]
        if _SPACED.search(text):
            return [piece[1:] for piece in _CUT.split(" " + text)]
        return text.split(" ")

    def learn(self, pieces: set[str]) -> None:
        if self.held > REMEMBERED:
            self.known.clear()
            self.held = 0
        new = sorted(pieces.difference(self.known))
        for start in range(0, len(new), 1024):
            some = new[start : start + 1024]
            in_a = self.a.encode_batch_fast([" " + p for p in some], add_special_tokens=False)
            in_b = self.b.encode(some, out_type=int, num_threads=1)
            for piece, a, b in zip(some, in_a, in_b):
                self.known[piece] = self.align(piece, a.ids, b or [self.space])
                self.held += len(piece) + 64

    def align(self, piece: str, a: list[int], b: list[int]) -> tuple | None:
        """Tokens of A, of B, groups written out, packed links (A id << 32 | B id); None where bytes get lost."""
        mine, theirs = [self.a_bytes[i] for i in a], [self.b_bytes[i] for i in b]
        whole = (" " + piece).encode()
        if b"".join(mine) != whole or b"".join(theirs) != whole:
            return None
        name = self.names
        if len(a) == 1 or len(b) == 1:  # they end together at the end alone
            written = ",".join([name[i] for i in a]) + "|" + ",".join([name[i] for i in b])
            return len(a), len(b), written, struct.pack("<q", a[-1] << 32 | b[-1])
        groups, links, j, at_b, first, second = [], [], 0, 0, 0, 0
        at_a = 0
        for i, size in enumerate(map(len, mine), 1):
            at_a += size
            while at_b < at_a:
                at_b += len(theirs[j])
                j += 1
            if at_a == at_b:
                groups.append(",".join([name[k] for k in a[first:i]]) + "|" + ",".join([name[k] for k in b[second:j]]))
                links.append(a[i - 1] << 32 | b[j - 1])
                first, second = i, j
        return len(a), len(b), ";".join(groups), struct.pack(f"<{len(links)}q", *links)

    def of_texts(self, texts: list[str]) -> list[tuple | None]:
        """(A tokens, B tokens, digest of the groups, links) of each text, None where it has no tokens."""
        cut = [self.pieces(t) if t else [] for t in texts]
        self.learn(set().union(*cut))
        out = []
        for text, parts in zip(texts, cut):
            found = list(map(self.known.__getitem__, parts))
            if None in found and len(parts) > 1:  # judged by the whole text
                a = self.a.encode(" " + text, add_special_tokens=False).ids
                found = [self.align(text, a, self.b.encode(text, out_type=int))]
            if not found or found[0] is None:
                out.append(None)
                continue
            n_a, n_b, groups, links = zip(*found)
            written = hashlib.sha256(";".join(groups).encode()).hexdigest()
            out.append((sum(n_a), sum(n_b), written, np.frombuffer(b"".join(links), "<i8")))
        return out


class Vocabularies:
    """Both files as they are broadcast; a worker makes the tokenizers once, for all its tasks."""

    def __init__(self, a_path: str, b_path: str):
        with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
            self.files = a.read(), b.read()
        self.made: Aligner | None = None

    def aligner(self) -> Aligner:
        if self.made is None:
            self.made = Aligner(*self.files)
        return self.made


_ALIGNED = (
    "block long, digest binary, n_a long, n_b long, n_links long, groups_sha256 string,"
    " places binary, times binary, pairs binary, weights binary"
)


def _rows_of_block(block: int, held: list[tuple]) -> pa.RecordBatch:
    """Rows of a block's texts; the first also holds the block's distinct pairs and what they count in it.

    ``places`` and ``times`` are the pairs of a text, as places among those of
    the block, and how often it has them.
    """
    links = [np.unique(x[2][3], return_counts=True) if x[2] else (np.zeros(0, np.int64), np.zeros(0, np.int64)) for x in held]
    pairs, where = np.unique(np.concatenate([p for p, _ in links]), return_inverse=True)
    weights = np.zeros(len(pairs), dtype=np.int64)
    every = np.concatenate([n * x[1] for x, (_, n) in zip(held, links)])
    np.add.at(weights, where, every)
    columns: list[list] = [[] for _ in range(10)]
    at = 0
    for number, ((digest, _, found), (own, n)) in enumerate(zip(held, links)):
        place = where[at : at + len(own)].astype("<u4")
        at += len(own)
        a, b, written, whole = found or (0, 0, "", ())
        row = [block, digest, a, b, len(whole), written, place.tobytes(), n.astype("<u4").tobytes()]
        row += [pairs.astype("<i8").tobytes(), weights.astype("<i8").tobytes()] if number == 0 else [None, None]
        for column, value in zip(columns, row):
            column.append(value)
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.binary()] * 4]
    names = [x.split()[0] for x in _ALIGNED.split(",")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each pair of a block: block, place, pair, weight."""
    for batch in batches:
        for block, pairs, weights in zip(*[c.to_pylist() for c in batch.columns]):
            pair = np.frombuffer(pairs, "<i8")
            for start in range(0, len(pair), 1 << 16):
                some = pair[start : start + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(some), block, dtype=np.int64)),
                        pa.array(np.arange(start, start + len(some), dtype=np.int64)),
                        pa.array(some),
                        pa.array(np.frombuffer(weights, "<i8")[start : start + len(some)]),
                    ],
                    names=["block", "place", "pair", "weight"],
                )


def _measured(mine: pa.Table, counts: pa.Table) -> pa.Table:
    """Measures of a block's texts from the corpus counts of its pairs."""
    order = np.argsort(counts.column("place").to_numpy())
    total = counts.column("total").to_numpy()[order]
    best = counts.column("best").to_numpy()[order]
    sums, hits = [], []
    for places, times in zip(mine.column("places").to_pylist(), mine.column("times").to_pylist()):
        place, n = np.frombuffer(places, "<u4"), np.frombuffer(times, "<u4").astype(np.int64)
        sums.append(int((total[place] * n).sum()))
        hits.append(int((best[place] * n).sum()))
    out = mine.select(["digest", "n_a", "n_b", "n_links", "groups_sha256"])
    return out.append_column("n_best", pa.array(hits, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64()))


def align(df: DataFrame, kept: list[str], a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """``kept``, the measures of ``MEASURES`` and ``groups_sha256`` of every row.

    The vocabulary files are read on the driver and sent with the tasks; their
    size is that of vocabularies, whatever the data.
    """
    shared = df.sparkSession.sparkContext.broadcast(Vocabularies(a_path, b_path))
    block_size = BLOCK
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    distinct = df.select(value.alias("text")).groupBy("text").agg(F.count("*").alias("copies"))
    keyed = distinct.select(F.unhex(F.sha2("text", 256)).alias("digest"), "copies", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner = shared.value.aligner()
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in slices(batches):
            texts = batch.column(2).to_pylist()
            for start in range(0, len(texts), 32):
                some = texts[start : start + 32]
                digests = batch.column(0)[start : start + 32].to_pylist()
                copies = batch.column(1)[start : start + 32].to_pylist()
                held += zip(digests, copies, aligner.of_texts(some))
                size += sum(map(len, some))
                if size >= block_size:
                    yield _rows_of_block(number, held)
                    number, held, size = number + 1, [], 0
        if held:
            yield _rows_of_block(number, held)

    rows = materialize(keyed.mapInArrow(run, _ALIGNED), "aligned")
    packed = rows.where("pairs is not null").select("block", "pairs", "weights")
    pairs = packed.mapInArrow(_unpacked, "block long, place long, pair long, weight long")
    pairs = materialize(pairs, "pairs")
    counts = pairs.groupBy("pair").agg(F.sum("weight").alias("total"))
    counts = materialize(counts.withColumn("b", F.col("pair").bitwiseAND((1 << 32) - 1)), "counts")
    # one row for each id of B: bounded by its vocabulary
    highest = counts.groupBy("b").agg(F.max("total").alias("highest"))
    best = (F.col("total") == F.col("highest")).cast("long").alias("best")
    judged = counts.join(F.broadcast(highest), "b").select("pair", "total", best)
    sent = pairs.join(judged, "pair").select("block", "place", "total", "best")
    measured = (
        rows.drop("pairs", "weights")
        .groupBy("block")
        .cogroup(sent.groupBy("block"))
        .applyInArrow(
            _measured, "digest binary, n_a long, n_b long, n_links long, groups_sha256 string, n_best long, count_sum long"
        )
    )
    (own,) = unused(df.select(*kept), "_own")
    names = [F.col("n_links").alias("n_groups") if m == "n_groups" else F.col(m) for m in MEASURES]
    held_by = df.select(*[F.col(f"`{c}`") for c in kept], F.unhex(F.sha2(value, 256)).alias(own))
    both = held_by.join(measured, F.col(own) == F.col("digest"))
    return both.select(*[F.col(f"`{c}`") for c in kept], *names, "groups_sha256")

