"""Token counts of byte-level BPE with a whole-token shortcut."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import Cached, byte_characters, column

#: ASCII white space, then other bytes. No pre-token of the byte-level pattern has white space after something else, so each match is counted alone.
SEGMENT = regex.compile(rb"[ \t\n\r\x0b\x0c]*[^ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+")
#: The pre-tokenizer's pattern, fixed by the library for byte-level files.
PRE_TOKENS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: White space beyond those six characters, also where engines disagree; around it segments may depend on each other.
ODD_SPACE = regex.compile(r"[\x1c-\x1f\x85\p{Z}--\x20]", regex.V1)


class Counter:
    """Counts the tokens of texts as ``tokenizers`` does.

    The shortcut is proved before any text is counted: each string of the
    vocabulary is encoded alone, and those that give one token are kept. A
    pre-token among them counts 1; only others are merged. Strings of special
    tokens in a text are tokens, the library's default.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = sorted((t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        if self.tokenizer.normalizer is not None or self.tokenizer.pre_tokenizer.pre_tokenize_str("a b") != [("a", (0, 1)), ("\u0120b", (1, 3))]:
            raise ValueError("not a plain byte-level tokenizer")
        self.bytes = byte_characters()
        self.spelled = str.maketrans({chr(b): c for c, b in self.bytes.items()})
        self.whole = self._proved()
        self.of = Cached(self._segment)
        self.merged = Cached(lambda token: len(self.tokenizer.model.tokenize(token)))

    def _proved(self) -> frozenset[str]:
        """Vocabulary strings, in the vocabulary's spelling, that encode alone as one token."""
        candidates, texts = [], []
        for token in self.tokenizer.get_vocab(with_added_tokens=False):
            try:
                text = bytes(self.bytes[c] for c in token).decode()
            except (KeyError, UnicodeDecodeError):
                continue
            if text and not any(s.decode() in text for s in self.special):
                candidates.append(token)
                texts.append(text)
        encoded = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return frozenset(t for t, e in zip(candidates, encoded, strict=True) if len(e.ids) == 1 and e.tokens[0] == t)

    def _segment(self, segment: bytes) -> int:
        text = segment.decode()
        if not text or max(text) > "\xff":
            tokens = [t for t, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        else:
            tokens = [t.encode().decode("latin-1").translate(self.spelled) for t in PRE_TOKENS.findall(text)]
        return sum(1 if t in self.whole else self.merged[t] for t in tokens)

    def __call__(self, text: bytes) -> int:
        if any(s in text for s in self.special) or (not text.isascii() or any(c in text for c in b"\x1c\x1d\x1e\x1f")) and ODD_SPACE.search(text.decode()):
            return len(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids)
        return sum(map(self.of.__getitem__, SEGMENT.findall(text)))


@lru_cache(2)
def counter(path: str) -> Counter:
    """One for each worker process and file, so that its caches serve all its tasks."""
    return Counter(path)


def count_tokens(docs: DataFrame, tokenizer: str, *, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row; needs no shuffle.

    Null texts count as empty, of 0 tokens. Null ids and repeated rows are kept
    as they are; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for b in batches:
            size, n = zip(*((len(t), count(t)) for t in column(b)), strict=True) if b.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
