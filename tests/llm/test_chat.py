"""Chat formatting: round trips, masks against spans by hand, and odd rows."""

import functools
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from tests.compare import same
from tests.llm.test_llm import docs, none, odd, shipped  # noqa: F401
from veridelta.llm import chat_format, queries

BYTE = public_tokenizers.path("byte_bpe_50k.json")
HARD = ["", " ", "\n\n", "\\", "\\\\", "<|turn|>", "<|text|>x<|end|>", "<\\|end|>", "<|end", "|>", "<|endoftext|>", "<<|turn|>|turn|>", "\\<|turn|>", "a\\", "é日本😀 b", "  two  spaces ", "ends with <", "\\### Assistant: </turn> ok"]
SCHEMA = "conv_id bigint, turn bigint, role string, text string, part int, ids string"


@functools.cache
def own():
    return chat_format.Codec(BYTE, chat_format.Template(), ("assistant",))


def plain(rows):
    """The digest of each conversation, from its rows alone."""
    least = lambda v: (v is not None, v if v is not None else 0)
    out = {}
    for conv in {r[0] for r in rows}:
        turns = [((r[2] or ""), (r[3] or "")) for r in sorted((r for r in rows if r[0] == conv), key=lambda r: (least(r[1]), (r[2] is not None, r[2] or ""), (r[3] is not None, r[3] or "")))]
        said, learnt = "".join(f"{a}\n{b}\n" for a, b in turns), "".join(b for a, b in turns if a == "assistant")
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), sum(23 + len(own().escape(x)) for t in turns for x in t) - 23 * len(turns))
    return out


def test_rendering_is_reversible():
    codec, rnd = own(), random.Random(4)
    alphabet = ["<", "|", ">", "\\", "turn", "text", "end", "oftext", "a", "\n", "é"]
    for n in range(400):
        turns = [("".join(rnd.choices(alphabet, k=rnd.randrange(6))), "".join(rnd.choices(alphabet, k=rnd.randrange(12)))) for _ in range(n % 4)] or [("user", x) for x in HARD]
        text, ids, offsets, mask = codec.format(turns)
        assert codec.read(text) == turns
        assert "".join(chat_format.under(text, offsets)) == text  # tokens leave nothing out
        # Marks stand where the template puts them, and nowhere else.
        assert sum(int(i) == codec.tokenizer.token_to_id("<|turn|>") for i in ids) == len(turns) == text.count("<|turn|>")
        assert codec.tokenizer.token_to_id("<|endoftext|>") not in ids
        assert not mask.any()


def test_mask_holds_assistant_texts_and_nothing_else():
    codec, rnd = own(), random.Random(5)
    for _ in range(200):
        turns = [(rnd.choice(["user", "assistant", "system", "assistant "]), rnd.choice(HARD) + rnd.choice(HARD)) for _ in range(rnd.randrange(1, 7))]
        text, _, offsets, mask = codec.format(turns)
        _, spans = codec.render(turns)
        by_hand = [any(a <= s and e <= b for a, b in spans.tolist()) for s, e in offsets.tolist()]
        assert mask.tolist() == by_hand
        assert codec.unescape("".join(chat_format.under(text, offsets[mask]))) == "".join(x for r, x in turns if r == "assistant")


def test_pieces_of_long_texts_have_the_tokens_of_the_whole(monkeypatch):
    codec, rnd = own(), random.Random(6)
    text = codec.render([("user", " ".join(rnd.choice(["word", "it's", "12", "é", "_x", "\n", " ", "<", "don't!"]) for _ in range(3000)))])[0]
    whole = codec.encode(text)
    monkeypatch.setattr(chat_format, "PIECE", 50)
    cut = codec.encode(text)
    assert all(np.array_equal(a, b) for a, b in zip(whole, cut, strict=True))


def test_tokenizers_that_drop_characters_are_refused():
    codec = chat_format.Codec(public_tokenizers.path("word_bpe_49k.json"), chat_format.Template(), ("assistant",))
    with pytest.raises(ValueError, match="leaves out"):
        codec.format([("assistant", "two words")])
    for marks in (("a|", "a|", "b|"), ("<a>", "<a>b", "<c>"), ("<\\>", "<a>", "<b>"), ("<", "<a>", "<b>")):
        with pytest.raises(ValueError, match="marks"):
            chat_format.Codec(BYTE, chat_format.Template(*marks), ())


@pytest.mark.parametrize("part_chars", [1 << 22, 40])
def test_conversations_of_odd_rows(shipped, part_chars):  # noqa: F811
    rnd = random.Random(7)
    rows = [(c, t, rnd.choice(["user", "assistant", "system", None]), rnd.choice(HARD)) for c in [*range(12), None] for t in [*range(rnd.randrange(1, 9)), None, 1]]
    rows += rows[:5]  # repeated rows stay
    rows += [(99, t, "assistant" if t % 2 else "user", f"{t} {rnd.choice(HARD)}") for t in range(400)]  # one with a large share of all
    rows += [(100, 0, "assistant", "long text " * 40_000), (101, 0, None, None)]
    df = shipped.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(5)
    parts = chat_format.format_conversations(df, BYTE, part_chars=part_chars)
    got = chat_format.read_back(parts, BYTE).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == plain(rows)
    assert len(got) == len({r[0] for r in rows})
    made = parts.collect()
    assert all(len(r.ids) == len(r.starts) == len(r.ends) == len(r.loss) for r in made)
    if part_chars == 40:
        assert sum(r.conv_id == 99 for r in made) > 50


def test_no_conversations(shipped):  # noqa: F811
    parts = chat_format.format_conversations(shipped.createDataFrame([], SCHEMA), BYTE)
    assert parts.count() == 0 == chat_format.read_back(parts, BYTE).count()


def test_conversations_against_sql(shipped, sf, duck):  # noqa: F811
    got = queries.op11_chat_format(shipped, sf).toPandas()
    same(got, duck.sql(queries.op11_sql()).df())
    assert got[got.conv_id == -7].formatted_chars.item() == 23 * 2 + len("user") + len("assistant") + 2 * (len("\\### Assistant: </turn> ok") + 1)
