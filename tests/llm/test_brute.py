"""Operators against slower ways of the same result, and rows with awkward names, labels and repeats."""

import collections
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.test_llm import docs, odd, shipped  # noqa: F401  (fixtures)
from veridelta.llm import _text, decontamination, exact_dedup, ftrl, language_id, license_scan, near_dedup, packing, quality, toxicity

# Contamination


def plain_words(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())


def plain_search(doc, item, slip=3):
    """The best (matched, -start) of all diagonals, whether a seed meets there or not, and the most words that match on one; or None."""
    w, t = plain_words(doc), plain_words(item)

    def laid(d):
        return [0 <= d + i < len(w) and w[d + i] == x for i, x in enumerate(t)]

    def runs(m):
        return [any(all(m[k : k + 4]) and len(m[k : k + 4]) == 4 for k in range(max(0, i - 3), i + 1)) for i in range(len(m))]

    best, own = None, 0
    for d in range(-len(t) + 1, len(w)):
        m = laid(d)
        own = max(own, sum(m))
        for e in range(-slip, slip + 1):
            if e:
                m = [a or b for a, b in zip(m, runs(laid(d + e)), strict=True)]
        held = sum(m) >= (0.6 if len(t) >= 12 else 0.8) * len(t) - 1e-9 or (len(t) > 20 and max(sum(m[i : i + 20]) for i in range(len(t) - 19)) >= 16)
        if t and held and any(m):
            found = (sum(m), -max(d, 0))
            best = found if best is None else max(best, found)
    return best and (*best, own)


def test_contamination_against_all_diagonals(shipped):
    """Nothing is found that isn't held; all that holds 80 % of five words or more is; repeats and slips included."""
    rnd = random.Random(11)
    vocabulary = [f"w{n}" for n in range(40)]
    items = [(n, " ".join(rnd.choices(vocabulary, k=rnd.randint(2, 45)))) for n in range(14)] + [(50, "same " * 12), (51, "w1 w2 " * 8), (52, None)]
    texts = []
    for n in range(120):
        _, item = rnd.choice(items[:-1])
        w = item.split()
        for _ in range(rnd.randrange(4)):
            at = rnd.randrange(len(w) + 1)
            w = [*w[:at], *(["new"] if rnd.random() < 0.5 else []), *w[at + rnd.randrange(2) :]]
        texts.append((n, " ".join([*rnd.choices(vocabulary, k=rnd.randrange(30)), *w, *rnd.choices(vocabulary, k=rnd.randrange(30))])))
    texts += [(500, "same " * 40), (501, ""), (502, None)]
    df, benchmark = shipped.createDataFrame(texts, "doc_id bigint, text string"), shipped.createDataFrame(items, "item_id bigint, text string")
    truth = {(d, i): (len(plain_words(item)), *plain_search(doc, item)) for d, doc in texts for i, item in items if plain_search(doc, item)}
    for block in (4 << 20, 300):
        got = {(r.doc_id, r.item_id): (r.item_words, r.matched, -r.doc_start) for r in decontamination.find_contamination(df, benchmark, block_bytes=block).collect()}
        assert set(got) <= set(truth)
        assert all(got[k][1] <= truth[k][1] and got[k][0] == truth[k][0] for k in got)
        sure = {k for k, (n, *_, own) in truth.items() if own >= (0.8 if n >= 5 else 1) * n}
        assert sure <= set(got)
        clean = {r.doc_id for r in decontamination.decontaminate(df, benchmark, block_bytes=block).collect()}
        assert clean == {d for d, _ in texts} - {d for d, _ in got}


@pytest.mark.parametrize(("share", "sizes"), [(1.0, range(1, 12)), (0.8, range(5, 40, 3)), (0.7, range(12, 40, 3)), (0.6, [12, 13, 15, 18, 20, 23, 24, 28, 30, 40])])
def test_recall_by_length_of_items(share, sizes):
    rnd = random.Random(11)
    for n in sizes:
        found, items = 0, [(i, " ".join(f"w{rnd.randrange(10**9)}" for _ in range(n))) for i in range(150)]
        index = decontamination.Index(items, 0.6, 20, 0.8, 3)
        for i, text in items:
            kept = set(rnd.sample(range(n), math.ceil(share * n - 1e-9)))
            laid = [f"x{rnd.randrange(10**9)}" for _ in range(9)] + [w if k in kept else f"y{rnd.randrange(10**9)}" for k, w in enumerate(text.split())] + ["z"] * 9
            found += any(index.items[k][0] == i for k, *_ in index.search(decontamination.WordHasher(decontamination.ALNUM)(" ".join(laid).encode())))
        # All where the masks prove it: whole items, and up to 11 words with four in five kept.
        assert found >= (150 if share == 1 or share == 0.8 and n < 12 else 147), (share, n, found)


def test_repeated_words_take_linear_time():
    index = decontamination.Index([(1, "a " * 12), (2, "a b " * 30)], 0.6, 20, 0.8, 3)
    words = _text.WordHasher(_text.ALNUM)(b"a " * 20_000)
    found = index.search(words)
    assert [(k, start, n, got, share) for k, start, n, got, share in found] == [(0, 0, 12, 12, 1.0)]


# License spans


def test_license_words_stand_in_order(shipped):
    w = next(t for x, t in license_scan.TEMPLATES if x == "mit").split()
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    rnd = random.Random(2)
    shuffled = rnd.sample(grams, len(grams))
    halves = [*w[12:], *w[:12]]
    rows = [
        (1, " ".join(grams)), (2, " ".join(shuffled)), (3, " ".join(w)), (4, " ".join([*w[:5], "x", *w[5:]])), (5, " ".join([*w[:8], "x", "y", "z", "v", "u", *w[8:]])), (6, " ".join(halves)), (7, " ".join(w[::-1])),
    ]
    got = {r.doc_id: (r.labels, r.score) for r in license_scan.scan_licenses(shipped.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {n: x for n, (x, _) in got.items()} == {1: "", 2: "", 3: "mit", 4: "mit", 5: "", 6: "", 7: ""}
    assert got[3][1] == 1 and got[1][1] < 0.3


def plain_license(text):
    """labels and score by trying every first diagonal and every chain."""
    w = re.findall(license_scan.WORD, (text or "").translate({c: c + 32 for c in range(65, 91)}))
    labels, best = set(), 0.0
    for base, entries in ((True, license_scan.PHRASES), (False, license_scan.TEMPLATES)):
        for label, template in entries:
            t = template.split()
            hits = [(i, p) for i in range(len(w) - 2) for p in range(len(t) - 2) if w[i : i + 3] == t[p : p + 3]]
            slip = 0 if base or len(t) < 12 else 4
            for d in {i - p for i, p in hits}:
                own = sorted(h for h in hits if d <= h[0] - h[1] <= d + slip)
                longest = {}
                for i, p in own:
                    longest[i, p] = 1 + max((n for (a, b), n in longest.items() if a < i and b < p), default=0)
                share = max(longest.values()) / (len(t) - 2)
                best = max(best, share)
                if share >= (1 if slip == 0 else 0.8):
                    labels.add(label)
    return ",".join(sorted(labels)), best


def test_licenses_against_all_chains(shipped, docs):  # noqa: F811
    rnd = random.Random(6)
    texts = []
    for n in range(60):
        _, t = rnd.choice(license_scan.TEMPLATES)
        w = t.split()
        for _ in range(rnd.randrange(5)):
            at = rnd.randrange(len(w))
            w = rnd.choice(([*w[:at], "odd", *w[at:]], [*w[:at], *w[at + 1 :]], [*w[:at], "odd", *w[at + 1 :]], [*w[at:], *w[:at]], [*w, *w]))
        texts.append((n, " ".join(w)))
    df = shipped.createDataFrame(texts, "doc_id bigint, text string").unionByName(docs.select("doc_id", "text").withColumn("doc_id", F.col("doc_id") + 1000).limit(80))
    want = {r.doc_id: plain_license(r.text) for r in df.collect()}
    got = {r.doc_id: (r.labels, pytest.approx(r.score)) for r in license_scan.scan_licenses(df).collect()}
    assert want == got


# Classifiers


class PlainFtrl:
    """The same updates on dictionaries, a coordinate at a time."""

    def __init__(self, s):
        self.s, self.z, self.n = s, collections.defaultdict(float), collections.defaultdict(float)

    def weight(self, i):
        z, n = self.z[i], self.n[i]
        return 0.0 if abs(z) <= self.s.l1 else (math.copysign(self.s.l1, z) - z) / ((self.s.beta + math.sqrt(n)) / self.s.alpha + self.s.l2)

    def p(self, x):
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(self.weight(i) * v for i, v in x)))))

    def learn(self, x, y):
        off = self.p(x) - y
        for i, v in x:
            w, g = self.weight(i), off * v
            self.z[i] += g - (math.sqrt(self.n[i] + g * g) - math.sqrt(self.n[i])) / self.s.alpha * w
            self.n[i] += g * g


@pytest.mark.parametrize(("module", "classify", "label"), [(quality, quality.classify_quality, "quality"), (toxicity, toxicity.classify_toxicity, "toxic")])
def test_classifiers_against_plain_updates(shipped, sf, module, classify, label):
    df, labels = shipped.read.parquet(f"{sf}/documents.parquet").limit(150).cache(), shipped.read.parquet(f"{sf}/labels.parquet")
    settings = ftrl.Settings(bits=14, alpha=module.SETTINGS.alpha, l1=0.3, l2=module.SETTINGS.l2, epochs=2, sample=60)
    got = {r.doc_id: r.score for r in classify(df, labels, settings=settings).collect()}
    features, plain = module.features(14), PlainFtrl(settings)

    def x(text):
        at, value = features((text or "").encode())
        return [*zip(at.tolist(), map(float, value), strict=True), (-1, 1.0)]

    order = F.xxhash64("doc_id")
    chosen = labels.dropna(subset=["doc_id", label]).orderBy(order, "doc_id").limit(60)
    train = df.join(chosen.select("doc_id", label), "doc_id").orderBy(order, "doc_id").collect()
    assert len(train) > 20
    for _ in range(2):
        for r in train:
            plain.learn(x(r.text), r[label])
    assert got == {r.doc_id: pytest.approx(plain.p(x(r.text)), abs=2e-3) for r in df.collect()}


def test_labels_that_disagree_and_ids_that_repeat(shipped):
    texts = [(n, "good fine" if n % 2 else "bad ugly") for n in range(40)] + [(1, "bad ugly")] * 500 + [(7, None), (None, "good")]
    labels = [(n, n % 2) for n in range(40)] + [(3, 0)] * 3 + [(None, 1), (9, None), (5, 1), (5, 1)]
    df, marks = shipped.createDataFrame(texts, "doc_id bigint, text string"), shipped.createDataFrame(labels, "doc_id bigint, quality int")
    got = [classify.select("doc_id", "score").collect() for classify in (quality.classify_quality(df, marks), quality.classify_quality(df.repartition(7), marks.repartition(5)))]
    assert collections.Counter(map(tuple, got[0])) == collections.Counter(map(tuple, got[1]))
    assert len(got[0]) == len(texts)
    few = ftrl.Settings(bits=20, alpha=2.0, l1=0.02, l2=0.05, sample=12_000, sample_bytes=4)
    assert {r.score for r in quality.classify_quality(df, marks, settings=few).collect()} == {0.5}


# Language


def test_languages_against_sizes_by_hand(docs):  # noqa: F811
    learnt = language_id.fit_languages(docs)
    rows = docs.select("doc_id", "text").limit(60).collect()
    got = {r.doc_id: (r.lang_pred, r.margin) for r in language_id.predict_language(docs.limit(60), learnt).collect()}

    def size(text, name):
        d = zstandard.ZstdCompressionDict(learnt[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=9)
        c = zstandard.ZstdCompressor(level=9, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
        return sum(len(c.compress(text[i : i + 512])) for i in range(0, max(1, len(text)), 512))

    checked = 0
    for r in rows:
        text = re.sub(rb" +", b" ", bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in (r.text or "").encode().lower())).strip()
        sizes = sorted((size(text, n), n) for n in learnt)
        if re.search(r"[^\W\d_]", r.text or "") and sizes[0][0] < sizes[1][0]:
            checked += 1
            assert got[r.doc_id][0] == sizes[0][1]
            assert got[r.doc_id][1] == pytest.approx(1 - sizes[0][0] / sizes[1][0])
    assert checked > 30


def test_languages_of_long_texts_and_of_many_copies_are_learnt(shipped):
    de, en = "das ist ein langer text und er hat viele worte ", "this is a long text that has many words in it "
    rows = [(n, en, "en") for n in range(400)] + [(500 + n, f"{en} number {n} of them", "en") for n in range(20)] + [(1000 + n, (de + f"nummer {n} ") * 900, "de") for n in range(3)]
    learnt = language_id.fit_languages(shipped.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert set(learnt) == {"de", "en"}
    assert learnt["en"].count(b"number") == 20
    asked = shipped.createDataFrame([(1, "er hat ein langer text"), (2, "a text that has words")], "doc_id bigint, text string")
    assert {r.doc_id: r.lang_pred for r in language_id.predict_language(asked, learnt).collect()} == {1: "de", 2: "en"}


# Packing


def test_packed_ids_are_those_of_the_library(shipped, docs, odd):  # noqa: F811
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    part = docs.select("doc_id", "text").limit(120).unionByName(odd.where("doc_id = 6 OR doc_id > 6").select((F.col("doc_id") + 10**9).alias("doc_id"), "text"))
    want = {r.doc_id: [*library.encode(r.text or "", add_special_tokens=False).ids, 1] for r in part.collect()}
    pieces = packing.pack_documents(part, path).orderBy("doc_id", "start").collect()
    name = next(c for c in pieces[0].asDict() if isinstance(pieces[0][c], (list, bytes, bytearray)))
    got = collections.defaultdict(list)
    for r in pieces:
        ids = r[name] if isinstance(r[name], list) else np.frombuffer(r[name], "<u4").tolist()
        assert r.start == len(got[r.doc_id]) and len(ids) == r.length
        got[r.doc_id] += ids
    assert got == want


# Names and caches

NAMES = ["_id", "_sha", "_key_sha", "id", "sha", "row", "gone_id", "gone_sha", "repeated", "kept", "copy", "name", "_met", "key", "hash", "learn"]


def test_columns_may_have_the_names_of_inner_ones(shipped):
    rows = [(n, t, *(f"{c}{n}" for c in NAMES)) for n, t in ((1, "one two three four five six seven"), (2, "one two three four five six seven"), (3, "other words that stand here alone now"), (3, "other words that stand here alone now"), (4, None))]
    df = shipped.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"`{c}` string" for c in NAMES))
    benchmark = shipped.createDataFrame([(1, "nothing of the kind is here")], "item_id bigint, text string")
    learnt = {"en": b"one two three other words that stand", "de": b"und das ist nicht so"}
    for kept, ids in (
        (exact_dedup.drop_exact_duplicates(df), [2, 3, 4]), (near_dedup.drop_near_duplicates(df), [1, 3, 3, 4]), (decontamination.decontaminate(df, benchmark), [1, 2, 3, 3, 4]),
        (decontamination.decontaminate(df, benchmark, block_bytes=5), [1, 2, 3, 3, 4]), (language_id.keep_identified(df, learnt), [1, 2, 3, 3]),
    ):
        assert kept.columns == df.columns
        got = kept.collect()
        assert sorted(r.doc_id for r in got) == ids
        assert all(r[c] == f"{c}{r.doc_id}" for r in got for c in NAMES)


def test_of_repeated_rows_the_one_with_the_least_hash_stays(shipped):
    rows = [(1, "same", k, {"m": k}) for k in range(30)] + [(2, "other", 5, {"m": 1})]
    schema = "doc_id bigint, text string, extra int, more map<string,int>"
    kept = [{(r.doc_id, r.extra) for r in exact_dedup.drop_exact_duplicates(shipped.createDataFrame(order, schema).repartition(n)).collect()} for order, n in ((rows, 1), (rows[::-1], 7))]
    assert kept[0] == kept[1] and len(kept[0]) == 2


def test_caches_are_bounded_by_bytes():
    cache = _text.Cached(len)
    for n in range(200_000):
        assert cache[b"%0200d" % n] == 200
    assert sum(map(len, cache)) <= _text.CACHE_BYTES
    assert cache[b"x" * 10_000] == 10_000 and b"x" * 10_000 not in cache
