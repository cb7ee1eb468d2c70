"""Language identification by compression.

Each language has a sample of its text as zstandard raw-content dictionary.  A
text, lower-cased, is compressed with each dictionary; the language whose
dictionary leaves the fewest bytes wins.  Whole texts are compressed in blocks,
so that a long text cannot become its own dictionary.  Where the two best are
close, the blocks are compressed once more in much smaller pieces, which leaves
even less to the text itself, and both sums count.

A text is rejected if it is null or has no letter (``und``), or if its margin is
narrower than texts of its length show in a learned language: then it fits none.
How narrow that is comes from the sample: its rows are classified by what is left
of it without them, cut to several lengths.  Where even rows of learned languages
show no margin, as in the shortest texts, none is rejected for it.

Defined cases: null, empty and letterless texts are ``und`` with score 0; equal
sizes go to the language with more learned rows, then to the smaller name; rows
with a null id are predicted and never learned from; repeated rows get equal
results and one place in a sample; without any learned language every text is
``und``; with one learned language, or fewer than ``LEAST`` margins of every
length, no text is rejected for its margin; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass, field
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm.common import map_texts, may_learn

#: The sample: at most this many rows a language, of each this many characters, in excerpts from so many parts of it.
SAMPLE_ROWS, SAMPLE_CHARS, EXCERPTS = 64, 4096, 8
#: Bytes compressed at once, and in the second look.
BLOCK, PIECE = 2048, 64
#: Relative distance of the two best below which a second look is taken.
CLOSE = 0.03
#: Lengths in bytes whose limits are learned, margins a limit needs, rows classified for all languages together.
LENGTHS, LEAST, JUDGED_ROWS = (32, 64, 128, 256, 512, 1024, BLOCK), 20, 512
#: Parts of a sample, each classified by the others; the limit is SHARE of the margins' quantile LOW.
PARTS, LOW, SHARE = 4, 0.05, 0.4
UNKNOWN = "und"


@dataclass(frozen=True)
class Languages:
    """Learned names, most rows first, their samples, and least margins: (bytes, margin) by bytes."""

    names: list[str]
    samples: list[bytes]
    limits: list[tuple[int, float]] = field(default_factory=list)


def learn(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    rows: int = SAMPLE_ROWS,
    chars: int = SAMPLE_CHARS,
) -> Languages:
    """Samples from rows that may be learned from and name a language.

    Rows fall into ``rows`` classes by the hash of their id; each class gives
    the row of the smallest hash, so a sample has ``rows`` rows at most.  Counts
    cover all rows.  Names are chosen from narrow columns first; the second scan
    keeps ``chars`` characters of the chosen rows alone, from all over the text.
    """
    known = df.where(may_learn(F.col(doc_id)) & F.col(lang).isNotNull() & (F.col(text) != ""))
    known = known.select(F.col(lang).alias("_lang"), F.xxhash64(doc_id).alias("_hash"), F.col(text).alias("_text"))
    classed = known.withColumn("_class", F.pmod("_hash", F.lit(rows)))
    chosen = classed.groupBy("_lang", "_class").agg(F.min("_hash").alias("_hash"), F.count(F.lit(1)).alias("_rows"))
    picked = chosen.drop("_class").collect()  # names x rows at most, without text
    if not picked:
        return Languages([], [])
    schema = T.StructType([T.StructField("_lang", T.StringType()), T.StructField("_hash", T.LongType())])
    wanted = df.sparkSession.createDataFrame([(p["_lang"], p["_hash"]) for p in picked], schema)
    kept = known.join(F.broadcast(wanted), ["_lang", "_hash"])
    kept = kept.select("_lang", "_hash", excerpts(F.col("_text"), F.col("_hash"), chars).alias("_text"))
    found = kept.groupBy("_lang", "_hash").agg(F.min("_text").alias("_text")).collect()
    count: dict[str, int] = {}
    for p in picked:
        count[p["_lang"]] = count.get(p["_lang"], 0) + p["_rows"]
    names = sorted(count, key=lambda x: (-count[x], x))
    texts = [[x for _, x in sorted((r["_hash"], r["_text"]) for r in found if r["_lang"] == name)] for name in names]
    return Languages(names, [joined(rows) for rows in texts], least_margins(names, texts))


def excerpts(text: Column, seed: Column, chars: int) -> Column:
    """A text of at most ``chars`` characters, or a piece from a hashed place of each of ``EXCERPTS`` equal parts, by lines."""
    size = max(1, chars // EXCERPTS - 1)
    part = F.floor(F.length(text) / EXCERPTS)
    room = F.greatest(part - size + 1, F.lit(1))
    starts = [part * i + F.pmod(F.xxhash64(seed, F.lit(i)), room) + 1 for i in range(EXCERPTS)]
    pieces = [F.substring(text, start.cast("int"), F.lit(size)) for start in starts]
    return F.when(F.length(text) <= chars, text).otherwise(F.concat_ws("\n", *pieces))


def joined(rows: list[str]) -> bytes:
    return "\n".join(rows).lower().encode()


def least_margins(names: list[str], texts: list[list[str]]) -> list[tuple[int, float]]:
    """The least margin of a text of a learned language by length, from samples without the rows they classify.

    A row that goes to another language counts with its margin below zero.
    """
    margins: dict[int, list[float]] = {n: [] for n in LENGTHS}
    each = max(1, JUDGED_ROWS // max(1, len(names)))
    for part in range(PARTS):
        rest = [joined([x for i, x in enumerate(rows) if i % PARTS != part]) for rows in texts]
        learned = [(name, sample) for name, sample in zip(names, rest) if sample]
        if len(learned) < 2:
            continue
        classify = classifier(Languages(*map(list, zip(*learned))))
        for name, rows, sample in zip(names, texts, rest):
            for row in rows[:each][part::PARTS] if sample else []:
                data = row.lower().encode()
                for n in LENGTHS:
                    if len(data) < n:
                        break
                    at = (len(data) - n) // 2
                    best, _, margin, _ = classify(data[at : at + n].decode(errors="ignore"))
                    if best != UNKNOWN:
                        margins[n].append(margin if best == name else -margin)
    found = [(n, sorted(some)) for n, some in margins.items() if len(some) >= LEAST]
    return [(n, max(0.0, SHARE * some[int(LOW * len(some))])) for n, some in found]


def least_margin(limits: list[tuple[int, float]], size: int) -> float:
    """Between learned lengths in proportion to the logarithm; 0 below the first, the last one's beyond."""
    after = bisect_right(limits, size, key=lambda x: x[0])
    if after in (0, len(limits)):
        return limits[-1][1] if after else 0.0
    (a, low), (b, high) = limits[after - 1 : after + 1]
    return low + (high - low) * log2(size / a) / log2(b / a)


def classifier(languages: Languages) -> Callable[[str | None], tuple[str, float, float, bool]]:
    """A function from a text to (name, score, margin, rejected)."""
    import zstandard as z

    settings = z.ZstdCompressionParameters(
        strategy=z.STRATEGY_LAZY, min_match=3, search_log=5, hash_log=17, chain_log=17, window_log=18,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    tools = []
    for sample in languages.samples:
        words = z.ZstdCompressionDict(sample, dict_type=z.DICT_TYPE_RAWCONTENT)
        words.precompute_compress(compression_params=settings)
        tools.append(z.ZstdCompressor(compression_params=settings, dict_data=words).compress)

    def sizes(data: bytes, step: int) -> list[int]:
        parts = [data[i : i + step] for i in range(0, len(data), step)]
        return [sum(len(compress(p)) for p in parts) for compress in tools]

    def distance(found: list[int]) -> float:
        low = sorted(found)[:2]
        return (low[1] - low[0]) / low[1] if len(low) > 1 else 1.0

    def classify(text: str | None) -> tuple[str, float, float, bool]:
        if not tools or text is None or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, 0.0, True
        data = text.lower().encode()
        found = sizes(data, BLOCK)
        if distance(found) < CLOSE:
            found = [a + b for a, b in zip(found, sizes(data, PIECE))]
        best = min(found)
        margin = distance(found)
        score = 1 / sum(2.0 ** -min(size - best, 60) for size in found)
        return languages.names[found.index(best)], score, margin, margin < least_margin(languages.limits, len(data))

    return classify


def identify(df: DataFrame, languages: Languages, kept: list[str], text: str = "text") -> DataFrame:
    """``kept`` with ``lang_pred``, ``score`` (0 to 1), ``margin`` (relative) and ``rejected`` of each whole text."""
    shared = df.sparkSession.sparkContext.broadcast(languages)  # names x rows x characters at most

    def make():
        classify = classifier(shared.value)
        return lambda texts: list(zip(*map(classify, texts))) if texts else [[], [], [], []]

    return map_texts(df, kept, make, "lang_pred string, score double, margin double, rejected boolean", text)
