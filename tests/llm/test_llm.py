"""Training-data operators against brute force, round trips and held-out rows, and on odd tables."""

import collections
import hashlib
import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.compare import same
from veridelta.llm import decontamination, exact_dedup, language_id, license_scan, near_dedup, packing, quality, queries, suffix_tree, token_counts, toxicity

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [
    (1, "one two three four five six"), (2, None), (3, ""), (4, " \n\t "), (None, "one two three four five six"), (None, None), (5, "one two three four five six"), (5, "one two three four five six"),
    (5, "other words of the same id here"), (6, "İK<|endoftext|>ß \x1c  x"), (7, "w" * 30000), (8, "ab " * 9000), (9, "😀 日本語 é́"),
]


@pytest.fixture(scope="session")
def shipped(spark):
    from veridelta.session import ship

    ship(spark)
    return spark


@pytest.fixture(scope="session")
def odd(shipped):
    """Rows with nulls, repeats and extra columns named as inner ones are."""
    return shipped.createDataFrame([(i, t, "x", "en", 1) for i, t in ODD], "doc_id bigint, text string, name string, lang string, size int").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(shipped, sf):
    return shipped.read.parquet(f"{sf}/documents.parquet")


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


# Exact duplicates


@pytest.mark.parametrize(("block", "weak"), [(8192, False), (256, True), (3, True)])
def test_exact_duplicates_are_exact(docs, duck, block, weak):
    # A weak hash makes most blocks collide: bytes have to tell them apart.
    part = docs.where("length(text) < 3000") if block == 3 else docs
    got = exact_dedup.exact_duplicates(part, block=block, hash_block=(lambda b: F.crc32(b) % 20) if weak else F.xxhash64)
    same(got.toPandas(), duck.sql(queries.OP2_SQL.replace("FROM documents", "FROM documents WHERE length(text) < 3000" if block == 3 else "FROM documents")).df())


def test_exact_duplicates_of_odd_rows(odd, none):
    got = exact_dedup.exact_duplicates(odd).collect()
    assert len(got) == len(ODD)
    by_sha = collections.Counter(hashlib.sha256((t or "").encode()).hexdigest() for _, t in ODD)
    assert all(r.group_size == by_sha[r.text_sha256] for r in got)
    assert collections.Counter(r.text_sha256 for r in got if r.kept) == collections.Counter(dict.fromkeys(by_sha, 1))
    assert {r.keep_id for r in got if r.group_size == 4} == {5}
    kept = exact_dedup.drop_exact_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted((t or "") for t in (r.text for r in kept.collect())) == sorted({t or "" for _, t in ODD})
    assert exact_dedup.exact_duplicates(none).count() == 0 == exact_dedup.drop_exact_duplicates(none).count()


# Packing


def test_packing_keeps_every_id_once(odd, none, docs):
    for df in (odd, docs):
        texts = collections.defaultdict(list)
        encode = packing.WordIds(WORD)
        for r in df.select("doc_id", "text").collect():
            texts[r.doc_id].append(np.append(np.frombuffer(encode((r.text or "").encode()), "<u4"), 1))
        got = packing.pack_documents(df, WORD).collect()
        assert sum(r.length for r in got) == sum(len(x) for t in texts.values() for x in t)
        sequences = collections.defaultdict(list)
        for r in got:
            sequences[r.sequence_id].append(r)
            assert any(np.array_equal(x[r.start : r.start + r.length], r.ids) and len(x) == r.doc_tokens for x in texts[r.doc_id])
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        for rows in sequences.values():
            at = 0
            for r in sorted(rows, key=lambda r: r.offset):
                assert r.offset == at
                at += r.length
            assert at == rows[0].sequence_tokens <= 2048
            assert at & (at - 1) == 0
    assert packing.pack_documents(none, WORD).count() == 0


def test_packing_takes_linear_time():
    def took(n):
        packer, ids, start = packing.TierPacker((256, 512, 1024, 2048), 1 << 18, 1 << 15, 0), bytes(4 * n), time.process_time()
        assert sum(r[2] for r in [*packer.add(1, ids), *packer.end()]) == n
        return time.process_time() - start

    took(1 << 18)
    assert took(8 << 20) < 20 * max(took(1 << 20), 0.01)  # eight times the tokens


def test_word_ids_equal_the_library():
    from tokenizers import Tokenizer

    library, encode = Tokenizer.from_file(WORD), packing.WordIds(WORD)
    for text in [t or "" for _, t in ODD] + ["Don't they'll 12a ½² x_y--z", "ΑΣ Σ ς", "Á é \x7f \x00", "<|startoftext|>ab"]:
        assert np.frombuffer(encode(text.encode()), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


# Token counts


def test_token_counts_equal_the_library(odd, none, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTE)
    for df in (odd, docs):
        texts = collections.Counter((r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in df.collect())
        got = token_counts.count_tokens(df, BYTE).collect()
        assert collections.Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == texts
        assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
    assert token_counts.count_tokens(none, BYTE).count() == 0


def test_token_segments_around_odd_spaces():
    from tokenizers import Tokenizer

    library, count = Tokenizer.from_file(BYTE), token_counts.Counter(BYTE)
    rnd = random.Random(2)
    for _ in range(500):
        text = "".join(rnd.choice([" ", "  ", "\n", "\t", "\x1c", "\x85", " ", "　", "a", "Bc", "'s", "1", "½", "é", "!", "<|endoftext|>", "​"]) for _ in range(12))
        assert count(text.encode()) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


# License scan


def brute_base(text):
    w = re.findall(license_scan.WORD, (text or "").translate({c: c + 32 for c in range(65, 91)}))
    at = [(label, i) for label, p in license_scan.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), len(at), min((i for _, i in at), default=None), max((i for _, i in at), default=None), ",".join(sorted({x for x, _ in at}))


def test_license_phrases_against_a_walk(odd, none, docs, shipped):
    lines = ["Under the MIT License.", "x under-the (MIT) license and cc by-nc", "cc by nc cc by nc", "Apache License,\nVersion 2.0", "apache license version 20", "CC", "Kcc by nc", "İ cc by nc under the mit license"]
    more = shipped.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")
    for df in (odd, docs, more):
        want = collections.Counter((r.doc_id, *brute_base(r.text)) for r in df.collect())
        got = license_scan.scan_licenses(df).collect()
        assert collections.Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == want
        assert all(set(r.base_labels.split(",")) <= set(r.labels.split(",")) or not r.base_labels for r in got)
        assert all(0 <= r.score <= 1 for r in got)
    assert license_scan.scan_licenses(none).count() == 0


def test_license_templates_with_changed_words(shipped):
    full = dict((x, t) for x, t in license_scan.TEMPLATES)["mit"]
    w = full.split()
    rows = [(1, full), (2, " ".join([*w[:9], "new", *w[9:]])), (3, " ".join(w[: len(w) // 2])), (4, "licensed under the gnu general public license version 3")]
    got = {r.doc_id: r.labels for r in license_scan.scan_licenses(shipped.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: "mit", 2: "mit", 3: "", 4: "gpl-3"}


# Near duplicates


def brute_components(rows, percent):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    best = {}
    for n, (i, _) in enumerate(rows):
        r = root(n)
        best[r] = i if best.get(r) is None else min(best[r], i) if i is not None else best[r]
    return collections.Counter((i, len(sets[n]), best[root(n)]) for n, (i, _) in enumerate(rows))


def near_rows(n=260):
    """Copies of a few texts with words changed, so similarities lie around the threshold."""
    rnd = random.Random(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for base in range(6):
        text = [rnd.choice(vocabulary) for _ in range(120)]
        for _ in range(n // 8 if base else n // 2):
            copy = list(text)
            for _ in range(rnd.randrange(4)):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            rows.append((len(rows), " ".join(copy)))
    return rows


@pytest.mark.parametrize("limit", [1024, 24])
def test_near_duplicates_against_brute_force(shipped, limit):
    rows = near_rows()
    got = near_dedup.near_duplicates(shipped.createDataFrame(rows, "doc_id bigint, text string"), node_limit=limit, most_levels=2).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_every_pair_of_a_large_node_meets(shipped):
    rows = shipped.createDataFrame([(0, 7, n) for n in range(300)] + [(1, 7, n) for n in range(40)], "tree int, node bigint, sid bigint")
    met = collections.defaultdict(list)
    for r in near_dedup._pairs_of_parts(rows, 32).collect():
        met[r.tree, r.node].append(r.sid)
    assert max(map(len, met.values())) < 100
    pairs = {(tree, *p) for (tree, _), sids in met.items() for p in itertools.combinations(sorted(sids), 2)}
    assert len(pairs) == math.comb(300, 2) + math.comb(40, 2)


def test_pairs_in_a_crowd_are_found(shipped):
    """Two pages alike among pages of one template, all of which agree on every value turned on: pivots link neither."""
    rnd = random.Random(3)
    body = [f"b{i}" for i in range(400)]
    rows = [(n, " ".join([*body, *(f"u{n}x{k}" for k in range(110))])) for n in range(150)]
    own = [f"t{k}" for k in range(110)]
    rows += [(1000 + n, " ".join([*body, *own[:100], *(f"v{n}x{k}" for k in range(8))])) for n in range(2)]
    rnd.shuffle(rows)
    got = near_dedup.near_duplicates(shipped.createDataFrame(rows, "doc_id bigint, text string"), node_limit=16, most_levels=0).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, 85)
    assert {r.component_id for r in got if r.doc_id >= 1000} == {1000}


@pytest.mark.parametrize("t", [0.8, 0.85])
@pytest.mark.parametrize("levels", [0, 1, 4])
def test_trees_hold_the_recall_through_branchings(t, levels):
    """Pairs at the threshold, walked through branchings at random, stay together in a tree as often as assumed."""
    rnd, kept, runs = np.random.default_rng(5), 0, 20000
    for _ in range(runs):
        alive = int(rnd.random() < t**3)
        for _ in range(levels):
            mean = near_dedup.children(t)
            alive = rnd.binomial(alive * int(mean) + rnd.binomial(alive, mean % 1), t**near_dedup.TURNS)
        kept += alive > 0
    share = kept / runs
    trees = near_dedup.trees_needed(t, 3, levels, 1e-4)
    assert (1 - share) ** trees < 3e-4
    assert (1 - share) ** (trees - 1) > 3e-5
    assert levels == 0 or trees > near_dedup.trees_needed(t, 3, 0, 1e-4)


def test_near_duplicates_of_odd_rows(odd, none):
    got = near_dedup.near_duplicates(odd).collect()
    want = brute_components(ODD, 85)
    empty = [(r.doc_id, r.n_shingles, r.component_id) for r in got if r.n_shingles == 0]
    assert collections.Counter(empty) == collections.Counter((i, 0, i) for i, t in ODD if not words(t))
    assert collections.Counter((r.doc_id, r.n_shingles) for r in got) == collections.Counter({(i, n): c for (i, n), c in collections.Counter((i, n) for i, n, _ in want.elements()).items()})
    # An id with two texts ties no components together.
    assert {r.component_id for r in got if r.doc_id == 5} == {1, 5}
    assert near_dedup.near_duplicates(none).count() == 0
    kept = near_dedup.drop_near_duplicates(odd)
    assert kept.columns == odd.columns


def test_components_of_chains_and_stars(shipped):
    from veridelta.shared import Tables

    rnd = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(200 + rnd.randrange(30), 200 + rnd.randrange(30)) for _ in range(25)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = near_dedup.components(shipped.createDataFrame(edges, "a bigint, b bigint"), Tables(shipped)).collect()
    assert {r.v: r.c for r in got} == {v: root(v) for v in parent}


# Decontamination


def test_contamination_with_substituted_words(shipped, odd, none, docs):
    rnd = random.Random(3)
    vocabulary = sorted({w for r in docs.limit(60).collect() for w in re.findall(r"[a-z]+", r.text.lower())})
    items = [(i, " ".join(rnd.sample(vocabulary, 12 + 3 * i))) for i in range(12)] + [(90, ""), (91, None), (92, "a b")]
    benchmark = shipped.createDataFrame(items, "item_id bigint, text string")
    rows, want = [], set()
    for i, text in items[:12]:
        w = text.upper().split()
        for k in range(3):
            at = set(rnd.sample(range(len(w)), k * len(w) // 10))
            rows.append((len(rows), " ".join(rnd.sample(vocabulary, 30)) + ", " + ", ".join("zzz" if j in at else x for j, x in enumerate(w)) + " " + " ".join(rnd.sample(vocabulary, 30))))
            want.add((rows[-1][0], i))
    rows += [(1000 + i, " ".join(rnd.sample(vocabulary, 60))) for i in range(30)] + [(2000, " ".join(items[11][1].split()[:8])), (2001, None), (None, items[5][1])]
    df = shipped.createDataFrame(rows, "doc_id bigint, text string")
    for block in (4 << 20, 200):  # one block, and many
        got = decontamination.find_contamination(df, benchmark, block_bytes=block).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want | {(None, 5)}
        assert all(r.similarity >= 0.6 for r in got)
    kept = decontamination.decontaminate(df, benchmark)
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows if i is not None and (i >= 1000)}
    assert decontamination.find_contamination(odd, benchmark).count() == 0
    assert decontamination.find_contamination(df, benchmark.limit(0)).count() == 0
    assert decontamination.find_contamination(none, benchmark).count() == 0
    assert decontamination.decontaminate(odd, benchmark).columns == odd.columns


# Language


def test_languages_of_held_out_rows(docs, odd, none):
    learnt = language_id.fit_languages(docs.where(queries.fold(F.col("doc_id"), 3) != 1))
    got = language_id.predict_language(docs.where(queries.fold(F.col("doc_id"), 3) == 1), learnt).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.93 * len(got) > 0
    assert all(0 <= r.score <= 1 for r in got)
    blank = language_id.predict_language(odd, learnt).collect()
    assert len(blank) == len(ODD)
    assert sum(r.lang_pred == "und" for r in blank) == sum(not re.search(r"[^\W\d_]", t or "") for _, t in ODD)
    kept = language_id.keep_identified(odd, learnt)
    assert kept.columns == odd.columns
    assert kept.count() == sum(bool(re.search(r"[^\W\d_]", t or "")) for _, t in ODD)
    assert language_id.predict_language(none, learnt).count() == 0
    assert {r.lang_pred for r in language_id.predict_language(odd, {}).collect()} == {"und"}
    with pytest.raises(ValueError, match="languages"):
        language_id.fit_languages(docs, most_languages=1)


# Classifiers


def test_narrow_margins_are_rejected_and_clean_rows_stay(shipped, docs):
    """Gibberish goes, long and short; texts of one language stay."""
    rnd = random.Random(8)
    gibberish = [(n, " ".join("".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randint(2, 10))) for _ in range(300 if n < 100 else 6))) for n in range(200)]
    kept = corpus_pipeline.identify_language
    learnt = language_id.fit_languages(docs)
    left = language_id.keep_identified(shipped.createDataFrame(gibberish, "doc_id bigint, text string"), learnt, min_margin=0.04).collect()
    assert sum(r.doc_id < 100 for r in left) <= 2
    assert sum(r.doc_id >= 100 for r in left) <= 50
    clean = docs.where("octet_length(text) >= 256 AND lang IS NOT NULL")
    assert kept(shipped, docs, "").join(clean.select("doc_id"), "doc_id", "left_semi").count() >= 0.97 * clean.count() > 0


@pytest.mark.parametrize(("classify", "label", "threshold", "least"), [(quality.classify_quality, "quality", 0.3, 0.95), (toxicity.classify_toxicity, "toxic", 0.5, 0.88)])
def test_classifiers_on_held_out_rows(shipped, odd, none, classify, label, threshold, least):
    base = "/root/testdata/sf0.01"
    labels, docs = shipped.read.parquet(f"{base}/labels.parquet"), shipped.read.parquet(f"{base}/documents.parquet")
    train = labels.where(queries.fold(F.col("doc_id"), 5) != 0)
    got = classify(docs, train, threshold=threshold).join(labels.where(queries.fold(F.col("doc_id"), 5) == 0), "doc_id").collect()
    assert sum(r.predicted == r[label] for r in got) >= least * len(got) > 0
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= threshold) for r in got)
    blank = classify(odd, train, threshold=threshold).collect()
    assert len(blank) == len(ODD)
    assert classify(none, train).count() == 0
    assert {r.score for r in classify(odd, train.limit(0)).collect()} == {0.5}
    again = classify(docs.repartition(5), train, threshold=threshold)
    assert {(r.doc_id, r.predicted) for r in again.collect()} >= {(r.doc_id, r.predicted) for r in got}


# Language model


def brute_base_scores(train, rows):
    counts = collections.Counter(w for _, t in train for w in [*words(t), None])
    n, v = sum(counts.values()), len(counts)
    return collections.Counter((i, len(words(t)) + 1, sum(counts[w] > 0 for w in [*words(t), None]), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*words(t), None]), 5)) for i, t in rows)


def test_base_scores_against_a_walk(docs, odd, none):
    train = docs.where(queries.fold(F.col("doc_id"), 5) != 1)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    learnt = [(r.doc_id, r.text) for r in train.select("doc_id", "text").collect()]
    for df, want in ((docs, rows), (odd, ODD)):
        got = suffix_tree.score_texts(df, train, partitions=5).collect()
        assert collections.Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == brute_base_scores(learnt, want)
        assert all(math.isfinite(r.score) for r in got)
    held = suffix_tree.score_texts(docs.where(queries.fold(F.col("doc_id"), 5) == 1), train).agg(F.sum("score").alias("a"), F.sum("base_score").alias("b")).first()
    assert held.a > held.b
    assert suffix_tree.score_texts(none, train).count() == 0
    assert suffix_tree.score_texts(odd, none).count() == len(ODD)


class PlainTree:
    """The same tree from dictionaries of tuples, one text after the other."""

    def __init__(self, texts, depth, least, discount, strictness):
        self.depth, self.discount = depth, discount
        counts = collections.Counter(tuple(t[i : i + n]) for t in map(self.tokens, texts) for n in range(1, depth + 2) for i in range(len(t) - n + 1))
        self.single = {s[0]: n for s, n in counts.items() if len(s) == 1}
        self.total = sum(self.single.values())
        p = {(w,): self.root(w) for w, n in self.single.items() if n >= least}
        self.own, self.left = {}, {}
        for size in range(2, depth + 2):
            found = {s: n for s, n in counts.items() if len(s) == size and n >= least}
            own = {s: max(n - discount, 0) / counts[s[:-1]] for s, n in found.items()}
            by = collections.defaultdict(list)
            for s in found:
                by[s[:-1]].append(s)
            for c, seqs in by.items():
                if sum(found[s] * math.log(max(own[s], 1e-12) / p[s[1:]]) for s in seqs) > strictness * len(seqs) * math.log(max(2, self.total)):
                    self.left[c] = max(1 - sum(own[s] for s in seqs), 1e-9)
                    self.own |= {s: own[s] for s in seqs}
            p |= {s: own[s] + self.left[s[:-1]] * p[s[1:]] if s[:-1] in self.left else p[s[1:]] for s in found}

    @staticmethod
    def tokens(text):
        return [*words(text), None]

    def root(self, w):
        return (self.single.get(w, 0) + 0.5) / (self.total + 0.5 * (len(self.single) + 1))

    def p(self, history, w):
        out = self.root(w)
        for n in range(1, min(self.depth, len(history)) + 1):
            c = tuple(history[-n:])
            if c in self.left:
                out = self.own.get((*c, w), 0.0) + self.left[c] * out
        return out

    def score(self, text):
        t = self.tokens(text)
        return sum(math.log10(self.p(t[:i], w)) for i, w in enumerate(t))


def markov_texts(n, seed=9):
    rnd = random.Random(seed)
    follow = {w: rnd.choice("abcdef") for w in "abcdef"}
    for _ in range(n):
        w = [rnd.choice("abcdef")]
        for _ in range(rnd.randrange(40)):
            w.append(follow[w[-1]] if rnd.random() < 0.8 else "deep" if w[-3:] == ["a", "b", "c"] else rnd.choice("abcdef"))
        yield " ".join(w)


@pytest.mark.parametrize("partitions", [None, 1, 5])
def test_scores_against_a_plain_tree(shipped, partitions):
    """Every score, of learnt and held-out texts, odd ones and unknown words; and after any context probabilities add up to one."""
    texts = [*markov_texts(150), "", "a b", "a b c d", "zz yy zz"]
    how = {"depth": 4, "least_count": 3, "discount": 0.75, "strictness": 0.1}
    plain = PlainTree([t for n, t in enumerate(texts) if n % 5], 4, 3, 0.75, 0.1)
    assert max(map(len, plain.left)) == 4
    df = shipped.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = {n: pytest.approx(plain.score(t), abs=1e-7) for n, t in enumerate(texts)}
    for train in (F.col("doc_id") % 5 != 0, df.where("doc_id % 5 <> 0")):
        assert {r.doc_id: r.score for r in suffix_tree.score_texts(df, train, partitions=partitions, **how).collect()} == want
    for c in [(), *list(plain.left)[:40]]:
        unknown = plain.p(list(c), "never seen")
        assert sum(plain.p(list(c), w) for w in plain.single) + unknown == pytest.approx(1, abs=1e-9)


def test_caches_change_no_score(shipped, monkeypatch):
    df = shipped.createDataFrame(list(enumerate(markov_texts(60))), "doc_id bigint, text string")
    score = lambda: {r.doc_id: (r.n_known, r.base_score, r.score) for r in suffix_tree.score_texts(df, F.lit(True), least_count=2, strictness=0.1, partitions=3).collect()}
    want = score()
    none = suffix_tree.Vocabulary(np.empty(0, np.uint64), np.empty(0, np.int64))
    monkeypatch.setattr(suffix_tree, "vocabulary", lambda singles: none)
    frequent = suffix_tree.frequent_weights
    monkeypatch.setattr(suffix_tree, "frequent_weights", lambda weights: frequent(weights, 0))
    assert score() == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}


def test_labels_are_dealt_one_to_a_partition(shipped):
    for n in (1, 7, 64):
        labels = shipped.createDataFrame([(int(x),) for x in suffix_tree._labels(n)], "place int")
        assert sorted(r[0] for r in labels.repartition(n, "place").select(F.spark_partition_id()).collect()) == list(range(n))


def test_contexts_do_not_depend_on_the_size_of_the_corpus(shipped):
    """A phrase seen often enough is learnt however much else there is, and the cache changes no score."""
    rnd = random.Random(4)
    texts = [(n, "rare phrase here") for n in range(20)] + [(100 + n, " ".join(rnd.choices([f"w{k}" for k in range(50)], k=400))) for n in range(100)]
    df = shipped.createDataFrame(texts, "doc_id bigint, text string")
    asked = df.where("doc_id IN (0, 100)")
    got = {share: {r.doc_id: (r.base_score, r.score) for r in suffix_tree.score_texts(asked, df, least_share=share, partitions=3).collect()} for share in (1e-9, 1e-3, 0.5)}
    base, score = got[1e-3][0]
    assert score > base + 5
    for share in (1e-9, 0.5):
        assert {k: pytest.approx(v, abs=1e-9) for k, v in got[1e-3].items()} == got[share]


# Pipeline and registry


def test_pipeline_stages(shipped, sf):
    docs = shipped.read.parquet(f"{sf}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontamination", "packing"]
    kept = docs
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(shipped, kept, sf)
        assert kept.columns == docs.columns
        kept = shipped.createDataFrame(kept.collect(), docs.schema)
        sizes.append(kept.count())
    assert sizes == sorted(sizes, reverse=True)
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    texts = [t for _, t in rows]
    assert len(set(texts)) == len(texts)
    packed = corpus_pipeline.STAGES[-1][1](shipped, kept, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {i for i, _ in rows}
    assert corpus_pipeline.run(shipped, sf).select("doc_id").distinct().count() == len(rows)


def test_queries_run(shipped, sf, duck):
    found = queries.queries()
    assert [n.split("_")[0] for n in found] == [f"op{n}" for n in range(1, 14)]
    for name, sql in queries.oracle_sql().items():
        same(found[name](shipped, sf).toPandas(), duck.sql(sql).df())
