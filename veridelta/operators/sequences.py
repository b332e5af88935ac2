"""Shortest edit scripts between sequences, by divide and conquer.

Anchors, the items that two sequences have in common in order, come from
Hirschberg's linear-space search: one half of a sequence is aligned with a
prefix of the other, the other half with the rest, where the lengths of both
common subsequences add up to most. A row of such lengths is held in the bits
of one integer (Hyyro's recurrence). Edits are what lies between anchors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import islice, pairwise, zip_longest

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: scripts of more deletions and insertions than this aren't looked for.
MOST_EDITS = 4000
#: Fixed value: edits of a batch.
EDITS_AT_ONCE = 10_000
#: Symbols of more places than this have their bits made once a row.
_OFTEN = 32


def _coded(a: Sequence, b: Sequence) -> tuple[np.ndarray, np.ndarray]:
    names: dict = {}
    return tuple(np.fromiter((names.setdefault(x, len(names)) for x in s), np.int64, len(s)) for s in (a, b))


def _row(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of ``a`` and each prefix of ``b``, from the empty one on."""
    m = len(b)
    if not m or not len(a):
        return np.zeros(m + 1, np.int64)
    order = np.argsort(b, kind="stable")
    first = np.searchsorted(b[order], a), np.searchsorted(b[order], a, side="right")
    made: dict[int, int] = {}

    def bits(symbol: int, lo: int, hi: int) -> int:
        if symbol in made:
            return made[symbol]
        raw = np.zeros(m, np.uint8)
        raw[order[lo:hi]] = 1
        value = int.from_bytes(np.packbits(raw, bitorder="little").tobytes(), "little")
        if hi - lo > _OFTEN:
            made[symbol] = value
        return value

    every = (1 << m) - 1
    unused = every
    for symbol, lo, hi in zip(a.tolist(), *(x.tolist() for x in first), strict=True):
        if lo < hi:
            met = unused & bits(symbol, lo, hi)
            unused = ((unused + met) | (unused - met)) & every
    left = np.unpackbits(np.frombuffer(unused.to_bytes((m + 7) // 8, "little"), np.uint8), count=m, bitorder="little")
    return np.concatenate([[0], np.cumsum(1 - left.astype(np.int64))])


def _equal_start(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


def anchors(a: Sequence, b: Sequence, most: int | None = None) -> tuple[list[tuple[int, int]], bool]:
    """Places (i, j) of a longest common subsequence, in order, and whether it was looked for.

    With ``most``, where more deletions and insertions are needed only common
    ends are anchors. Where several subsequences are as long, each halving of
    ``a`` takes the shortest prefix of ``b``, and a single item its first place.
    """
    x, y = _coded(a, b)
    found: list[tuple[int, int]] = []
    work = [(0, len(x), 0, len(y))]
    while work:
        i0, i1, j0, j1 = work.pop()
        s = _equal_start(x[i0:i1], y[j0:j1])
        found += zip(range(i0, i0 + s), range(j0, j0 + s), strict=True)
        i0, j0 = i0 + s, j0 + s
        e = _equal_start(x[i0:i1][::-1], y[j0:j1][::-1])
        found += zip(range(i1 - e, i1), range(j1 - e, j1), strict=True)
        i1, j1 = i1 - e, j1 - e
        p, q = x[i0:i1], y[j0:j1]
        if most is not None:
            # Only the first round gets here; what can't be short enough by counts alone isn't searched.
            size = max(len(p), len(q))
            apart = abs(len(p) - len(q)) if size <= most else int(np.abs(np.subtract(*(np.bincount(c, minlength=int(max(x.max(initial=0), y.max(initial=0))) + 1) for c in (p, q)))).sum())
            if apart > most or (len(p) + len(q) > most and len(p) + len(q) - 2 * int(_row(p, q)[-1]) > most):
                return sorted(found), False
            most = None
        if len(p) == 1 or len(q) == 1:
            hit = np.flatnonzero(q == p[0]) if len(p) == 1 else np.flatnonzero(p == q[0])
            if len(hit):
                found.append((i0, j0 + int(hit[0])) if len(p) == 1 else (i0 + int(hit[0]), j0))
        elif len(p) and len(q):
            half = len(p) // 2
            cut = int(np.argmax(_row(p[:half], q) + _row(p[half:][::-1], q[::-1])[::-1]))
            work += [(i0, i0 + half, j0, j0 + cut), (i0 + half, i1, j0 + cut, j1)]
    return sorted(found), True


def gaps(a: Sequence, b: Sequence, most: int | None = MOST_EDITS) -> tuple[list[tuple[range, range]], bool]:
    """The stretches of both sequences between anchors, in order, empty ones left out, and whether the script is a shortest one."""
    at, searched = anchors(a, b, most)
    ends = pairwise([(-1, -1), *at, (len(a), len(b))])
    between = [(range(i0 + 1, i1), range(j0 + 1, j1)) for (i0, j0), (i1, j1) in ends]
    return [g for g in between if g[0] or g[1]], searched


def edit_script(a: Sequence, b: Sequence, most: int | None = MOST_EDITS) -> list[tuple[int, int]]:
    """Pairs (i, j) of a shortest edit script: (i, -1) deletes, (-1, j) inserts, (i, j) replaces.

    Deletions and insertions of one stretch are paired in order. Where more than
    ``most`` are needed, everything between the common ends is one stretch.
    """
    return [p for gone, new in gaps(a, b, most)[0] for p in zip_longest(gone, new, fillvalue=-1)]


def _edits(batches: Iterator[pa.RecordBatch], most: int | None) -> Iterator[tuple]:
    for b in batches:
        for k in range(b.num_rows):
            key, x, y = (b.column(c)[k].as_py() for c in range(3))
            x, y = x or [], y or []
            between, shortest = gaps(x, y, most)
            for gone, new in between:
                yield from ((key, i, j, x[i] if i >= 0 else None, y[j] if j >= 0 else None, shortest) for i, j in zip_longest(gone, new, fillvalue=-1))


def edit_batches(batches: Iterator[pa.RecordBatch], most: int | None) -> Iterator[pa.RecordBatch]:
    """Edits of rows (id, before, after), which are taken one by one and handed on ``EDITS_AT_ONCE`` at a time."""
    schema = pa.schema([("id", pa.string()), ("i", pa.int64()), ("j", pa.int64()), ("before", pa.string()), ("after", pa.string()), ("shortest", pa.bool_())])
    rows = _edits(batches, most)
    while part := list(islice(rows, EDITS_AT_ONCE)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)


def sequence_diff(pairs: DataFrame, most: int | None = MOST_EDITS) -> DataFrame:
    """Edits (id, i, j, before, after, shortest) between the arrays before and after of each row.

    i and j are -1 where there is none; ``shortest`` is false where ``most``
    deletions and insertions don't suffice. A null array counts as empty.
    """
    run = lambda batches: edit_batches(batches, most)
    return pairs.select(F.col("id").cast("string").alias("id"), "before", "after").mapInArrow(run, "id string, i bigint, j bigint, before string, after string, shortest boolean")


#: Words that name nothing.
COMMON = frozenset("the a an of and or to in on for with is are be by as at from this that".split())
_WORD = re.compile(r"[^\W_]+(?:[-'][^\W_]+)*")


def _names_something(term: str) -> bool:
    return any(w.lower() not in COMMON and sum(map(str.isalpha, w)) >= 3 for w in term.split())


def replaced_terms(before: str | None, after: str | None, most: int = 8, longest: int = 80) -> list[tuple[str, str | None]]:
    """Terms that an edit takes out of a text and that stand nowhere in the new one, with what came in their place.

    The stretches taken out and put in correspond only if there are as many of
    each; else the replacement is None. At most ``most`` terms of at most
    ``longest`` characters that hold a word of three letters that isn't common.
    """
    x, y = _WORD.findall(before or ""), _WORD.findall(after or "")
    between, _ = gaps([w.lower() for w in x], [w.lower() for w in y])
    gone, new = ([" ".join(words[k] for k in side) for side in sides if side] for words, sides in zip((x, y), zip(*between, strict=True), strict=False)) if between else ([], [])
    held = f" {' '.join(y).lower()} "
    pairs = zip(gone, new if len(new) == len(gone) else [None] * len(gone), strict=True)
    return [(g, n) for g, n in pairs if len(g) <= longest and f" {g.lower()} " not in held and _names_something(g)][:most]


def term_changes(versions: DataFrame) -> DataFrame:
    """(id, term, replacement) of each row (id, before, after)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(key, *t) for key, before, after in zip(b["id"], b["before"], b["after"], strict=True) for t in replaced_terms(before, after)]
            yield pd.DataFrame(found, columns=["id", "term", "replacement"])

    return versions.select("id", "before", "after").mapInPandas(run, "id string, term string, replacement string")


def apply_edits(pairs: DataFrame, edits: DataFrame) -> DataFrame:
    """(id, edits, after): how many deletions and insertions each row (id, before) has, and the array they make of it."""
    own = edits.groupBy("id").agg(
        F.collect_list(F.when(F.col("i") >= 0, F.col("i"))).alias("_gone"),
        F.collect_list(F.when(F.col("j") >= 0, F.struct("j", "after"))).alias("_new"),
    )
    empty = F.array().cast("array<bigint>")
    j = pairs.select("id", F.coalesce("before", F.array().cast("array<string>")).alias("before")).join(own, "id", "left")
    j = j.withColumn("_gone", F.coalesce("_gone", empty)).withColumn("_at", F.coalesce(F.transform("_new", lambda x: x["j"]), empty))
    kept = j.withColumn("_kept", F.filter("before", lambda _, i: ~F.array_contains("_gone", i.cast("bigint"))))
    # Items kept fill the places that no insertion takes, in order.
    places = F.filter(F.sequence(F.lit(0).cast("bigint"), F.size("_kept") + F.size("_at") - F.lit(1).cast("bigint")), lambda p: ~F.array_contains("_at", p))
    free = F.when(F.size("_kept") > 0, places).otherwise(empty)
    items = F.concat(F.arrays_zip(free.alias("j"), F.col("_kept").alias("after")), F.coalesce("_new", F.array().cast("array<struct<j:bigint,after:string>>")))
    return kept.select("id", (F.size("_gone") + F.size("_at")).alias("edits"), F.transform(F.array_sort(items), lambda x: x["after"]).alias("after"))
