"""Byte-level BPE by a sentencepiece model made from a rank file, and its inverse.

The rank file holds one byte string and its rank a line.  Each byte string
becomes a piece whose letters stand for bytes, scored by its negative rank, so
that sentencepiece merges the pair of lowest rank first, as the rank file asks.
Text is cut into pre-tokens by a pattern; each is encoded for itself.

Defined cases: a null text counts as empty; an empty text has no ids and
decodes to no bytes; texts of any length are encoded whole; repeated rows get
equal results; an empty table gives an empty table; columns beside those named
are not read, so their names cannot clash.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame

from vigil.llm.common import map_texts

#: First code point of the 256 letters that stand for bytes.
LETTERS = 0x100
BYTE_LETTERS = {i: LETTERS + i for i in range(256)}
#: Distinct pre-tokens a task remembers before it starts anew.
REMEMBERED = 1 << 18
#: Characters that are cut into pre-tokens before the new ones are encoded together.
BLOCK = 1 << 20


def read_ranks(path: str) -> list[bytes]:
    """Byte strings by rank; ranks must be 0, 1, 2 and so on, and hold all single bytes."""
    found = {}
    for line in Path(path).read_bytes().splitlines():
        if line:
            token, rank = line.split()
            found[int(rank)] = base64.b64decode(token)
    if sorted(found) != list(range(len(found))):
        raise ValueError("ranks have gaps")
    pieces = [found[i] for i in range(len(found))]
    if len({p for p in pieces if len(p) == 1}) != 256:
        raise ValueError("a byte has no rank")
    return pieces


def as_letters(data: bytes) -> str:
    return data.decode("latin-1").translate(BYTE_LETTERS)


def _field(number: int, kind: int, value: bytes | int) -> bytes:
    """One protobuf field: kind 0 an integer, 2 a length and bytes, 5 four bytes."""
    head = _varint(number << 3 | kind)
    if kind == 0:
        return head + _varint(value)
    return head + (_varint(len(value)) if kind == 2 else b"") + value


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def model_bytes(pieces: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model whose ids are the ranks.

    Identity normalisation, no dummy prefix, white space kept.  The piece for
    unknown letters, which byte letters never need, follows the last rank.
    """
    out = []
    for rank, piece in enumerate(pieces):
        body = _field(1, 2, as_letters(piece).encode()) + _field(2, 5, struct.pack("<f", -rank))
        out.append(_field(1, 2, body))
    out.append(_field(1, 2, _field(1, 2, b"<unk>") + _field(2, 5, struct.pack("<f", 0.0)) + _field(3, 0, 2)))
    trainer = _field(3, 0, 2) + _field(4, 0, len(pieces) + 1)  # model type BPE, vocabulary size
    normalizer = _field(1, 2, b"identity") + b"".join(_field(n, 0, 0) for n in (3, 4, 5))
    out += [_field(2, 2, trainer), _field(3, 2, normalizer)]
    return b"".join(out)


def encoder(model: bytes, pieces: list[bytes], pattern: str) -> Callable[[list[str]], list[bytes]]:
    """A function from texts to their ids, packed as little-endian unsigned 32-bit integers."""
    import regex
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_proto=model)
    whole = {piece: struct.pack("<I", rank) for rank, piece in enumerate(pieces)}
    cut = regex.compile(pattern)
    known: dict[str, bytes] = {}

    def learn(tokens: set[str]) -> None:
        """Ids of new pre-tokens: those that are a piece directly, the others in one call."""
        if len(known) > REMEMBERED:
            known.clear()
        rest = []
        for token in tokens.difference(known):
            packed = whole.get(token.encode())
            if packed is None:
                rest.append(token)
            else:
                known[token] = packed
        if rest:
            ids = processor.encode([as_letters(t.encode()) for t in rest], out_type=int, num_threads=1)
            known.update((t, struct.pack(f"<{len(x)}I", *x)) for t, x in zip(rest, ids))

    def encode(texts: list[str]) -> list[bytes]:
        out = []
        for block in blocks(texts):
            tokens = [cut.findall(text) for text in block]
            learn(set().union(*tokens))
            out += [b"".join(map(known.__getitem__, x)) for x in tokens]
        return out

    return encode


def blocks(texts: list[str], most: int = BLOCK) -> Iterator[list[str]]:
    """Runs of whole texts of about ``most`` characters; a longer text is a run by itself."""
    block, size = [], 0
    for text in texts:
        block.append(text)
        size += len(text)
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def decoder(pieces: list[bytes]) -> Callable[[bytes], bytes]:
    """A function from packed ids to the bytes they stand for."""
    import numpy as np

    blob = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    lengths = np.array([len(p) for p in pieces], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])

    def decode(packed: bytes) -> bytes:
        ids = np.frombuffer(packed, dtype="<u4")
        out = []
        for block in (ids[i : i + 65536] for i in range(0, len(ids), 65536)):
            if block.max(initial=0) >= len(lengths):
                raise ValueError("an id is beyond the vocabulary")
            size = lengths[block]
            ends = np.cumsum(size)
            place = np.arange(ends[-1]) + np.repeat(starts[block] - ends + size, size)
            out.append(blob[place].tobytes())
        return b"".join(out)

    return decode


def encode(df: DataFrame, kept: list[str], path: str, pattern: str, text: str = "text") -> DataFrame:
    """``kept`` and ``ids`` (binary, four bytes an id, lowest first) of each whole text.

    The vocabulary file is read on the driver and sent with the tasks: its
    size is that of a vocabulary, whatever the data.
    """
    pieces = read_ranks(path)
    shared = df.sparkSession.sparkContext.broadcast((model_bytes(pieces), pieces))

    def make():
        model, known = shared.value
        one = encoder(model, known, pattern)
        return lambda texts: [one([t or "" for t in texts])]

    return map_texts(df, kept, make, "ids binary", text)


def decode(df: DataFrame, kept: list[str], path: str, ids: str = "ids") -> DataFrame:
    """``kept`` and ``decoded`` (binary) of packed ids; null ids decode to no bytes."""
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(path))

    def make():
        one = decoder(shared.value)
        return lambda rows: [[one(x or b"") for x in rows]]

    return map_texts(df, kept, make, "decoded binary", ids)


def round_trip(df: DataFrame, kept: list[str], path: str, pattern: str, text: str = "text") -> DataFrame:
    """``kept``, ``ids`` as by ``encode`` and ``decoded`` as by ``decode`` of these ids, in one pass of one worker."""
    pieces = read_ranks(path)
    shared = df.sparkSession.sparkContext.broadcast((model_bytes(pieces), pieces))

    def make():
        model, known = shared.value
        into, back = encoder(model, known, pattern), decoder(known)

        def work(texts):
            ids = into([t or "" for t in texts])
            return [ids, [back(x) for x in ids]]

        return work

    return map_texts(df, kept, make, "ids binary, decoded binary", text)


def checked_ids(df: DataFrame, kept: list[str], path: str, pattern: str, text: str = "text") -> DataFrame:
    """``kept``, ``ids`` as by ``encode`` and ``decodes``: whether they give the text back.

    Ids are decoded and compared where they are made, so neither texts nor
    decoded bytes leave the worker.
    """
    pieces = read_ranks(path)
    shared = df.sparkSession.sparkContext.broadcast((model_bytes(pieces), pieces))

    def make():
        model, known = shared.value
        into, back = encoder(model, known, pattern), decoder(known)

        def work(texts):
            ids = into([t or "" for t in texts])
            return [ids, [back(x) == (t or "").encode() for x, t in zip(ids, texts)]]

        return work

    return map_texts(df, kept, make, "ids binary, decodes boolean", text)
