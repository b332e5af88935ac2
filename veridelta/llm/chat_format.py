"""Chat formatting: whole conversations as one text, tokens with offsets, and a loss mask aligned with them.

Markers of turns are added tokens, so no token crosses them: what is encoded
between two markers doesn't depend on what is around. Strings in texts that would
read as markers, or as special tokens of the tokenizer, are escaped.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "conv_id bigint, part bigint, whole boolean, n_turns bigint, formatted string, ids array<int>, starts array<int>, ends array<int>, loss array<boolean>"
DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"

#: Longer texts are encoded in pieces of about so many characters.
PIECE = 1 << 20
#: A single space between two word characters: no pre-token of a byte-level tokenizer crosses its front.
_CUT = re.compile(r"(?<=\w)(?= \w)")


@dataclass(frozen=True)
class Template:
    """Marks around a turn: ``turn`` role ``text`` text ``end``."""

    turn: str = "<|turn|>"
    text: str = "<|text|>"
    end: str = "<|end|>"

    def marks(self) -> tuple[str, str, str]:
        return self.turn, self.text, self.end


class Codec:
    """Renders turns, reads them back, and encodes what it has rendered.

    A backslash in a text is doubled, and one is put behind the first character
    of each string that stands for a mark or a special token; to read, each
    backslash goes and what follows it stays.
    """

    def __init__(self, path: str, template: Template, learn: tuple[str, ...]):
        from tokenizers import AddedToken, Tokenizer, processors

        self.template, self.learn = template, frozenset(learn)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        marks = template.marks()
        controls = [*marks, *(t.content for t in self.tokenizer.get_added_tokens_decoder().values())]
        if len(set(marks)) < 3 or any(len(c) < 2 or "\\" in c or c != c.strip() for c in marks) or any(a != b and a in b for a in marks for b in marks):
            raise ValueError("marks must differ, none part of another, of two characters or more, without backslashes and spaces around")
        controls = sorted({c for c in controls if len(c) > 1 and "\\" not in c})
        self.unsafe = re.compile("|".join([r"\\", *(f"(?<={re.escape(c[0])})(?={re.escape(c[1:])})" for c in controls)]))
        self.safe = re.compile(r"\\(.)", re.DOTALL)
        self.turns = re.compile(f"{re.escape(marks[0])}(.*?){re.escape(marks[1])}(.*?){re.escape(marks[2])}", re.DOTALL)
        self.tokenizer.add_special_tokens([AddedToken(m, normalized=False, special=True) for m in marks])
        kind = json.loads(self.tokenizer.to_str())
        self.by_bytes = (kind.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not kind.get("normalizer")
        if self.by_bytes:  # offsets that hold the space in front of a word
            self.tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)

    def escape(self, text: str) -> str:
        return self.unsafe.sub(r"\g<0>\\", text)

    def unescape(self, text: str) -> str:
        return self.safe.sub(r"\1", text)

    def render(self, turns: Iterable[tuple[str | None, str | None]]) -> tuple[str, np.ndarray]:
        """The text of (role, text) turns, and the sorted spans of those to learn; null counts as empty."""
        out, spans, at = [], [], 0
        turn, text, end = self.template.marks()
        for role, said in turns:
            head, body = f"{turn}{self.escape(role or '')}{text}", self.escape(said or "")
            at += len(head)
            if role in self.learn and body:
                spans.append((at, at + len(body)))
            at += len(body) + len(end)
            out += [head, body, end]
        return "".join(out), np.array(spans, np.int64).reshape(-1, 2)

    def read(self, formatted: str) -> list[tuple[str, str]]:
        """The (role, text) turns of a rendered text."""
        return [(self.unescape(role), self.unescape(said)) for role, said in self.turns.findall(formatted)]

    def _pieces(self, text: str) -> Iterator[str]:
        at = 0
        while self.by_bytes and len(text) - at > PIECE and (cut := _CUT.search(text, at + PIECE)):
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the tokens of a rendered text and their (start, end), in characters."""
        ids, offsets, at = [], [], 0
        for piece in self._pieces(text):
            got = self.tokenizer.encode(piece, add_special_tokens=False)
            ids.append(np.array(got.ids, np.int32))
            offsets.append(np.array(got.offsets, np.int64).reshape(-1, 2) + at)
            at += len(piece)
        return np.concatenate(ids), np.concatenate(offsets)

    def mask(self, offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
        """Whether each token lies in a span to learn, by a binary search in the sorted ends of spans."""
        if not len(spans) or not len(offsets):
            return np.zeros(len(offsets), bool)
        at = np.minimum(np.searchsorted(spans[:, 1], offsets[:, 0], side="right"), len(spans) - 1)
        inside = (offsets[:, 0] < spans[at, 1]) & (offsets[:, 1] > spans[at, 0]) & (offsets[:, 1] > offsets[:, 0])
        if not ((offsets[inside, 0] >= spans[at[inside], 0]) & (offsets[inside, 1] <= spans[at[inside], 1])).all():
            raise ValueError("a token crosses the end of a turn")
        return inside

    def format(self, turns: list[tuple[str | None, str | None]]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
        """Text, ids, offsets and mask of some turns."""
        text, spans = self.render(turns)
        ids, offsets = self.encode(text)
        mask = self.mask(offsets, spans)
        if len("".join(under(text, offsets[mask]))) != int((spans[:, 1] - spans[:, 0]).sum()):
            raise ValueError("this tokenizer leaves out characters, so its tokens can't be masked exactly")
        return text, ids, offsets, mask


def under(text: str, offsets: np.ndarray) -> list[str]:
    """What some tokens cover, each character once: those of one character's bytes share its place."""
    out, done = [], 0
    for start, end in offsets.tolist():
        if end > done:
            out.append(text[max(start, done) : end])
            done = end
    return out


@lru_cache(4)
def codec(path: str, template: Template, learn: tuple[str, ...]) -> Codec:
    """One for each worker process."""
    return Codec(path, template, learn)


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values), kind))


class _Parts:
    """Rows of the result, handed out in batches of about ``most`` characters."""

    def __init__(self, codec: Codec, base: int, most: int = 1 << 20):
        self.codec, self.most, self.chars, self.rows, self.part = codec, most, 0, [], base

    def add(self, conv_id, whole: bool, turns: list) -> Iterator[pa.RecordBatch]:
        text, ids, offsets, mask = self.codec.format(turns)
        self.rows.append((conv_id, self.part, whole, len(turns), text, ids, offsets[:, 0], offsets[:, 1], mask))
        self.part += 1
        self.chars += len(text)
        if self.chars > self.most:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            cols = list(zip(*self.rows, strict=True))
            plain = [pa.array(c, t) for c, t in zip(cols[:5], (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.string()), strict=True)]
            lists = [_lists([np.asarray(v) for v in c], t) for c, t in zip(cols[5:], (pa.int32(), pa.int32(), pa.int32(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays([*plain, *lists], [c.split()[0] for c in SCHEMA.split(", ")])
            self.rows, self.chars = [], 0


def format_conversations(
    turns: DataFrame,
    tokenizer: str,
    *,
    template: Template = Template(),
    learn: tuple[str, ...] = ("assistant",),
    part_chars: int = 1 << 22,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """Formatted conversations with their tokens and loss mask; columns as in ``SCHEMA``.

    Rows are dealt out by ranges of (conversation, turn) and read in that order,
    so a conversation is rendered and encoded as a whole. One that is longer than
    ``part_chars`` characters, or that lies across two ranges (as one with a
    third of all rows does), comes in several rows, whose order is ``part``: since
    no token crosses a mark, their texts, ids and masks joined are those of the
    whole. ``whole`` says of which rows it is sure that they are all of one.
    ``starts`` and ``ends`` are the tokens' places in ``formatted``. ``loss`` is
    true for the tokens of texts of the roles in ``learn``, and for no others.

    The marks get the ids after the vocabulary's. Null roles and texts count as
    empty. Rows of a null id are one conversation; null turns come first; rows
    of equal turn are ordered by role and text, and repeated rows all stay. An
    empty table gives no rows. Texts past ``PIECE`` characters are encoded in
    pieces cut where no token can lie across. Other columns are ignored.
    """
    order = ["conv_id", "turn", "role", "text"]
    chosen = turns.select(F.col(id_col).cast("bigint").alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    # Ranges need the front of a text only: rows with the same front get to the same place, and are sorted there in full.
    dealt = chosen.repartitionByRange("conv_id", "turn", F.substring("role", 1, 64), F.substring("text", 1, 64)).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = _Parts(codec(tokenizer, template, learn), TaskContext.get().partitionId() << 32)
        now, held, chars, edge, some = None, [], 0, True, False
        for b in batches:
            for conv_id, role, said in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if some and (conv_id != now or chars > part_chars):
                    cut = conv_id == now
                    yield from parts.add(now, not (edge or cut), held)
                    held, chars, edge = [], 0, cut
                now, some = conv_id, True
                held.append((role, said))
                chars += len(said or "") + len(role or "")
        if some:
            yield from parts.add(now, False, held)
        yield from parts.flush()

    return dealt.select("conv_id", "role", "text").mapInArrow(run, SCHEMA)


def read_back(parts: DataFrame, tokenizer: str, *, template: Template = Template(), learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """What formatted conversations say, one row each, as in ``DIGEST``: read from their texts and from the tokens under their masks.

    A digest is taken over the parts of a conversation in order, by one task that
    holds a part at a time; a part that is a whole conversation sends its digest
    only. Null ids are one conversation. An empty table gives no rows.
    """

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer, template, learn)
        for b in batches:
            for i in range(b.num_rows):
                conv_id, part, whole, text = (b.column(c)[i].as_py() for c in range(4))
                offsets = np.stack([b.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (4, 5)], axis=1)
                mask = b.column(6)[i].values.to_numpy(zero_copy_only=False).astype(bool)
                turns = own.read(text)
                said = "".join(f"{role}\n{x}\n" for role, x in turns)
                learnt = own.unescape("".join(under(text, offsets[mask])))
                sha = [hashlib.sha256(x.encode()).hexdigest() if whole else None for x in (said, learnt)]
                sent = [None if whole else x for x in (said, learnt)]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((conv_id, part, len(turns), len(learnt), len(text), *sha, *sent), kinds, strict=True)], names)

    names = ["conv_id", "part", "n_turns", "loss_chars", "formatted_chars", "turns_sha256", "loss_sha256", "said", "learnt"]
    kinds = [pa.int64()] * 5 + [pa.string()] * 4
    each = parts.select("conv_id", "part", "whole", "formatted", "starts", "ends", "loss").mapInArrow(one, ", ".join(f"{n} {'bigint' if i < 5 else 'string'}" for i, n in enumerate(names)))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counts, shas, open_ = None, None, None, False

        def row(conv_id, counts, ends) -> pa.RecordBatch:
            values = (conv_id, counts[0], ends[0], counts[1], ends[1], counts[2])
            return pa.RecordBatch.from_arrays([pa.array([v], pa.string() if isinstance(v, str) else pa.int64()) for v in values], [c.split()[0] for c in DIGEST.split(", ")])

        for b in batches:
            for i in range(b.num_rows):
                r = {n: b.column(k)[i].as_py() for k, n in enumerate(b.schema.names)}
                if open_ and r["conv_id"] != now:
                    yield row(now, counts, [s.hexdigest() for s in shas])
                    open_ = False
                found = [r["n_turns"], r["loss_chars"], r["formatted_chars"]]
                if r["said"] is None:
                    yield row(r["conv_id"], found, [r["turns_sha256"], r["loss_sha256"]])
                    continue
                if not open_:
                    now, counts, shas, open_ = r["conv_id"], [0, 0, 0], [hashlib.sha256(), hashlib.sha256()], True
                counts = [x + y for x, y in zip(counts, found, strict=True)]
                for s, x in zip(shas, (r["said"], r["learnt"]), strict=True):
                    s.update(x.encode())
        if open_:
            yield row(now, counts, [s.hexdigest() for s in shas])

    return each.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(joined, DIGEST)
