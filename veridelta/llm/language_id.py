"""Language identification by compression with a raw-content dictionary per language."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from ._text import column

LETTER = regex.compile(r"\p{L}")
LEVEL = 9
#: Where the best two tie, as they may for a few words, texts are encoded again at this level, with matches of three bytes too.
CLOSER = 13
UNKNOWN = "und"
#: Texts are encoded in blocks of this many bytes, so that a long one leans on the dictionary and not on itself.
BLOCK = 512
#: Texts are chosen by hashes of so many values.
PLACES = 1 << 30
_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def normal(text: bytes) -> bytes:
    """ASCII letters in lower case and all other characters beyond ASCII, runs of the rest as a space."""
    return b" ".join(text.lower().translate(_LETTERS).split())


def fit_languages(docs: DataFrame, *, dictionary_bytes: int = 1 << 16, sample: int = 100, most_languages: int = 500) -> dict[str, bytes]:
    """A dictionary for each language: texts, joined, up to ``dictionary_bytes``.

    Learns from the text and non-null lang of ``docs``: of each language, the
    ``sample`` distinct texts whose hash is least, so a bounded sample; texts
    without a letter are passed over. Of a text longer than a quarter of the
    dictionary, a piece of so many characters as a 64th of its bytes is taken
    from a place that the hash chooses. What reaches the driver is at most ``most_languages *
    dictionary_bytes``; more languages raise an error.
    """
    place = F.pmod(F.xxhash64("text"), F.lit(PLACES))
    rows = docs.select("lang", "text").where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).withColumn("place", place)
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("place").alias("texts")).orderBy("lang").limit(most_languages + 1).collect()
    if len(sizes) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    if not sizes:
        return {}
    # Several times as many texts as are wanted, by their hash; copies of one go before the shuffle.
    spark = docs.sparkSession
    below = spark.createDataFrame([(r["lang"], min(PLACES, 1 + 8 * sample * PLACES // max(1, r["texts"]))) for r in sizes], "lang string, below bigint")
    piece = dictionary_bytes // 16
    cut = F.substring("text", F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - piece, F.lit(1))).cast("int") + 1, F.lit(piece // 4))
    taken = F.when(F.octet_length("text") > dictionary_bytes // 4, cut).otherwise(F.col("text"))
    few = rows.join(F.broadcast(below), "lang").where("place < below").select("lang", "place", taken.alias("text")).distinct()
    ranked = few.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("place", "text"))).where(F.col("place") <= sample)
    joined = (
        ranked.withColumn("before", F.sum(F.octet_length("text") + 1).over(Window.partitionBy("lang").orderBy("place")))
        .where(F.col("before") <= dictionary_bytes)
        .groupBy("lang")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "\n").alias("text"))
    )
    return {r["lang"]: normal(r["text"].encode()) for r in joined.collect()}  # a row a language


class Classifier:
    """Compressed sizes of a text under each language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.names = sorted(dictionaries)
        self.packers, self.closer = [], []
        plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        for name in self.names:
            d = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.packers.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, **plain))
            d = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.closer.append(zstandard.ZstdCompressor(compression_params=zstandard.ZstdCompressionParameters.from_level(CLOSER, min_match=3, **plain), dict_data=d))

    def __call__(self, text: bytes) -> tuple[str, float, float]:
        """The best language, its score and the margin: by how much the next one's size is larger, as a share of it."""
        if not self.names or not LETTER.search(text.decode()):
            return UNKNOWN, 0.0, 0.0
        text = normal(text)
        blocks = [text[i : i + BLOCK] for i in range(0, max(1, len(text)), BLOCK)]
        sizes = sorted((sum(map(len, map(p.compress, blocks))), i) for i, p in enumerate(self.packers))
        if len(sizes) > 1 and sizes[0][0] == sizes[1][0]:
            sizes = sorted((sum(map(len, map(p.compress, blocks))), i) for i, p in enumerate(self.closer))
        margin = 1.0 if len(sizes) == 1 else 1 - sizes[0][0] / sizes[1][0]
        return self.names[sizes[0][1]], 1 - 0.5 * 2 ** (-margin * 50), margin


@lru_cache(1)
def _classifier(dictionaries: tuple[tuple[str, bytes], ...]) -> Classifier:
    return Classifier(dict(dictionaries))


def predict_language(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """doc_id, lang_pred, score and margin of every row; needs no shuffle.

    Texts that are null or hold no letter, and all texts where nothing was
    learnt, are ``und`` with score and margin 0. The score is 0.5 where the two
    best languages tie (the first name wins) and nears 1 as the margin grows.
    Null ids and repeated rows are kept; an empty table gives no rows; columns
    other than doc_id and text are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(sorted(dictionaries.items())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = _classifier(shared.value)
        for b in batches:
            got = list(map(classify, column(b, "text")))
            names, scores, margins = zip(*got, strict=True) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64())], ["doc_id", "lang_pred", "score", "margin"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double, margin double")


def keep_identified(docs: DataFrame, dictionaries: dict[str, bytes], *, min_margin: float = 0.0) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is identified; no shuffle.

    Rejected are texts that are null or hold no letter, those whose margin is
    below ``min_margin``, and, if that isn't 0, those whose best two languages tie
    to the byte, in the closer encoding too; texts of all lengths alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(sorted(dictionaries.items())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = _classifier(shared.value)
        for b in batches:
            keep = []
            for text in column(b):
                name, _, margin = classify(text)
                keep.append(name != UNKNOWN and (min_margin <= 0 or margin >= min_margin))
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))
