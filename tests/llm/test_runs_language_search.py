"""Periodic runs, language identification and ranked search against plain versions, with nulls, empty and very
long texts, ties, repeated rows, empty tables and clashing column names; and their registered queries."""

import collections
import hashlib
import math
import random
import re
import string
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankspark.llm import langid, queries, runs, search
from tools.oracle_check import duck_conn, rows_of

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, k string, t string, kept boolean, runs string, terms string, score string"


def docs_of(spark, texts, langs=None, ids=None):
    ids = ids or range(len(texts))
    langs = langs or ["en"] * len(texts)
    return spark.createDataFrame([(i, t, g, "s", "x", "y", None, "r", "z", "w") for i, t, g in zip(ids, texts, langs, strict=True)], DOC)


def prose(seed, n, letters=string.ascii_lowercase):
    r = random.Random(seed)
    return " ".join("".join(r.choices(letters, k=r.randint(2, 8))) for _ in range(n))


# -- periodic runs ---------------------------------------------------------------

def plain_runs(w, least):
    """Every stretch with a period, by trying all periods."""
    n, out = len(w), []
    for p in range(1, n // 2 + 1):
        t = 0
        while t + p < n:
            s = t
            while t + p < n and w[t] == w[t + p]:
                t += 1
            e = t + p
            if t - s >= p and e - s >= least and not any(all(w[i] == w[i + q] for i in range(s, e - q)) for q in range(1, p)):
                out.append((s, e - s, p))
            t += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_collapsed(w, found):
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return [x for i, x in enumerate(w) if i not in gone]


def test_runs_equal_trying_all_periods():
    r = random.Random(5)
    for _ in range(1000):
        n, k = r.randint(0, 60), r.choice([1, 2, 2, 3, 4])
        w = [r.randrange(k) for _ in range(n)]
        if n > 4 and r.random() < 0.5:
            a = r.randrange(n)
            p = 1 + (n - a) // r.randint(2, 9)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if r.random() < 0.3:
            w = ([0] * r.randint(1, 9) + [1]) * r.randint(1, 5) + [r.randrange(2)] * r.randint(0, 3)
            w = w * r.randint(1, 3)
        for least in (2, 12):
            found = runs.runs_of(w, least)
            assert found == plain_runs(w, least), (w, least)
            assert runs.collapsed(w, found) == plain_collapsed(w, found)


def test_runs_of_fibonacci_and_thue_morse_words():
    a, b = [0], [0, 1]
    while len(b) < 300:
        a, b = b, b + a
    assert runs.runs_of(b, 2) == plain_runs(b, 2)
    tm = [bin(i).count("1") % 2 for i in range(256)]
    found = runs.runs_of(tm, 2)
    assert found == plain_runs(tm, 2) and all(n == 2 * p for _, n, p in found)  # overlap-free
    assert runs.runs_of([(bin(i).count("1") + i) % 3 if i % 7 else 9 for i in range(200)], 2) == plain_runs([(bin(i).count("1") + i) % 3 if i % 7 else 9 for i in range(200)], 2)


def test_catcher_is_online():
    w = [0, 1, 0, 1, 0, 1, 2, 2, 2, 3, 1, 3, 1, 3]
    c = runs.SquareCatcher(least=2, room=1)
    for i, x in enumerate(w):
        c.append(x)
        assert c.result() == plain_runs(w[: i + 1], 2)


@pytest.mark.parametrize("w", [[0] * 60_000, ([0] * 200 + [1]) * 200, ([0, 1] * 400 + [1, 0] * 400) * 20, list(range(60_000)) * 2])
def test_work_stays_near_linear_on_repetitive_words(w):
    start = time.time()
    runs.runs_of(w)
    assert time.time() - start < 30


def test_find_runs_on_rows(spark):
    texts = [None, "", " \n\t ", "one", "a b c d e f " * 2, "a b c d e f " * 2, "x " * 11, "x " * 12, "y z " * 12, "q " + "a\tb\n" * 6 + "a c",
             prose(3, 400) + " " + prose(4, 40) + " " + prose(4, 40), "long " + prose(7, 7) * 1 + (" " + prose(8, 1000)) * 20]
    got = {r.doc_id: r for r in runs.find(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        want = plain_runs(w, 12) if len(w) < 2000 else [(8, 20_000, 1000)]
        assert got[i].n_words == len(w) and [tuple(x) for x in got[i].runs] == want, i
        assert got[i].kept == " ".join(plain_collapsed(w, want))
    d = docs_of(spark, ["x " * 12] * 3, ids=[None, 1, 1])
    assert [r.kept for r in runs.find(d).collect()] == ["x"] * 3
    assert runs.find(d.limit(0)).count() == 0


def plain_op11(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = runs.runs_of(w) if n > 800 else plain_runs(w, 12)
    top = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    four = (top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4
    return (doc_id, len(found), *four, sha("".join(f"{s},{m},{p}\n" for s, m, p in found)), sha(" ".join(plain_collapsed(w, found))))


def test_op11_query(spark):
    got = sorted(map(tuple, queries.op11_periodic_runs(spark, SF).collect()))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert got == sorted(plain_op11(r.doc_id, r.text) for r in docs)
    assert sum(r[1] for r in got) > 10


# -- language identification -------------------------------------------------------

def plain_grams(text):
    """The n-grams themselves, in plain Python."""
    t = "".join(c if c.isalpha() else " " for c in text.lower())
    t = " " + " ".join(t.split(" ")).strip() + " "
    t = re.sub(" +", " ", t)
    return collections.Counter(t[i : i + n] for n in langid.ORDERS for i in range(len(t) - n + 1))


def test_grams_count_what_plain_python_counts(monkeypatch):
    bucket = lambda g: int(langid._hashed(np.array(list(map(ord, g)), np.uint32), len(g) - 1)[len(g) - 1])
    for text in ["a", "Ab, c!", "  été\n\nNaïve 漢字 x ", "1 2 3", prose(1, 50)]:
        want = collections.Counter()
        for g, n in plain_grams(text).items():
            want[bucket(g)] += n
        for piece in (1 << 20, 3, 1):
            monkeypatch.setattr(langid, "PIECE", piece)
            assert collections.Counter(np.concatenate(list(langid.grams(text))).tolist()) == want, (text, piece)
    assert not list(langid.grams(""))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 8, 30])
def test_codewords_differ_and_correct_errors(n):
    code = langid.codewords(n)
    assert len({tuple(r) for r in code.tolist()}) == n
    if n > 1:
        assert (code.min(0) < 0).all() and (code.max(0) > 0).all()
        least = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
        assert least >= (2 ** (n - 2) if n <= langid.EXHAUSTIVE else 10)
        model = langid.Model([str(i) for i in range(n)], code, np.zeros((1, code.shape[1])), np.ones(code.shape))
        for i in range(n):  # fewer wrong bits than half the least distance are mended
            margins = code[i] * 5.0
            margins[: (least - 1) // 2] *= -1
            assert model.decode(margins)[0] == str(i)


LETTERS = {"aa": "abcdefgh", "bb": "defghijk", "cc": "klmnopqr", "dd": "opqrstuv", "ee": "éèçàùabc"}


def test_language_fit_equals_plain_counts_and_predicts(spark):
    texts, langs = [], []
    for s in range(150):
        lang = list(LETTERS)[s % 5]
        texts.append(prose(s, 5 + s % 60, LETTERS[lang]))
        langs.append(lang)
    train = docs_of(spark, texts + [None, "12 34", "x"], langs + ["aa", "aa", None])
    counted = {(r.lang, r.bucket): r.n for r in langid.counts(train).collect()}
    for lang in LETTERS:
        want = collections.Counter(b for t, g in zip(texts, langs, strict=True) if g == lang for a in langid.grams(t) for b in a.tolist())
        assert {b: n for (g, b), n in counted.items() if g == lang and b >= 0} == want
        assert counted[lang, -1] == 30
    model = langid.fit(train)
    assert model.languages == sorted(LETTERS) and model.code.shape == (5, 15)
    held = [(prose(1000 + s, 30, LETTERS[g]), g) for s in range(20) for g in LETTERS]
    d = docs_of(spark, [t for t, _ in held] + [None, "", "12 --", held[0][0] * 3000, held[0][0]])
    got = {r.doc_id: r for r in langid.predict(spark, d, model).collect()}
    assert all(got[i].lang_pred == g for i, (_, g) in enumerate(held))
    for i in (100, 101, 102):
        assert (got[i].lang_pred, got[i].score, got[i].ambiguous) == ("und", 0.0, False)
    assert got[103].lang_pred == got[104].lang_pred == held[0][1]
    assert all(0 <= r.score <= 1 for r in got.values())
    mixed = prose(5, 200, LETTERS["aa"]) + " " + prose(6, 200, LETTERS["cc"])
    sure, unsure = model.predict(prose(7, 100, LETTERS["aa"])), model.predict(mixed)
    assert not sure[2] and sure[1] > unsure[1]


def test_language_of_near_alike_languages_is_flagged(spark):
    texts = [prose(s, 30, "abcdef") for s in range(60)]
    model = langid.fit(docs_of(spark, texts, ["aa", "bb"] * 30))
    said = [model.predict(prose(500 + s, 30, "abcdef")) for s in range(20)]
    assert sum(unsure for *_, unsure in said) >= 10


def test_language_corner_tables(spark):
    d = docs_of(spark, ["abc", None, "-"], ids=[None, 2, 2])
    none = langid.fit(d.limit(0))
    assert none.languages == [] and {r.lang_pred for r in langid.predict(spark, d, none).collect()} == {"und"}
    one = langid.fit(d)
    assert sorted((r.lang_pred, r.score) for r in langid.predict(spark, d, one).collect()) == [("en", 1.0), ("und", 0.0), ("und", 0.0)]
    assert langid.predict(spark, d.limit(0), one).count() == 0


def test_op12_query_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()}
    got = queries.op12_language_id(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        text = docs[r.doc_id].text
        assert (r.lang_pred == "und") == (not text or not any(map(str.isalpha, text)))
    held = [r for r in got if r.held_out and docs[r.doc_id].lang and r.lang_pred != "und"]
    assert len(held) > 200 and sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.98 * len(held)


# -- ranked search -------------------------------------------------------------------

def plain_terms(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def plain_rank(docs, items, k):
    """(item number, rank, doc, score) by scoring every document."""
    held = [(i, collections.Counter(plain_terms(t)), len(plain_terms(t))) for i, t in docs]
    n_docs, total = sum(n > 0 for *_, n in held), sum(n for *_, n in held)
    df = collections.Counter(t for _, c, _ in held for t in c)
    out = []
    for number, text in enumerate(items):
        scored = []
        for i, c, n in held:
            m = 75 + 25 * n * n_docs // max(total, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in plain_terms(text) if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(number, rank + 1, None if null else i, -s) for rank, (s, null, i) in enumerate(sorted(scored)[:k])]
    return out


def zipf(seed, n, words):
    r = random.Random(seed)
    return " ".join(words[min(int(r.paretovariate(0.6)) - 1, len(words) - 1)] for _ in range(n))


WORDS = [f"{a}{b}" for a in "AbCéß漢9x" for b in "01Yzñ"]


def test_search_equals_scoring_everything(spark):
    texts = [None, "", "--", "A0", "a0", "A0 a0", zipf(1, 5000, WORDS)] + [zipf(s, 1 + s % 90, WORDS) for s in range(300)]
    texts += [texts[40]] * 30
    ids = [None, *range(1, len(texts))]
    items = ["A0 bY", None, "", "unknown", " ".join(WORDS), "9z 9z 9z xñ", "9z 9z 9z xñ", texts[40], zipf(77, 30, WORDS)]
    q = spark.createDataFrame([(i // 2, t, 1) for i, t in enumerate(items)], "item_id long, text string, score int")
    for parts in (1, 7):
        got = search.rank(docs_of(spark, texts, ids=ids).repartition(parts), q, k=5).collect()
        want = plain_rank(zip(ids, texts, strict=True), items, 5)
        assert sorted((r.item_id, r["rank"], r.doc_id is None, r.doc_id or 0, r.score) for r in got) == sorted((n // 2, r, d is None, d or 0, s) for n, r, d, s in want)
    d = docs_of(spark, texts)
    assert search.rank(d.limit(0), q).count() == 0 and search.rank(d, q.limit(0)).count() == 0
    assert search.rank(d.select("doc_id", F.lit(None).cast("string").alias("text")), q).count() == 0


def test_index_of_all_terms_gives_the_same(spark):
    texts = [zipf(s, 1 + s % 50, WORDS) for s in range(80)]
    q = spark.createDataFrame([(0, "A0 9z"), (1, WORDS[7])], "item_id long, text string")
    d = docs_of(spark, texts)
    index, total = search.build(d)
    assert set(WORDS) and index.where("term = 'a0'").count() >= 1
    whole = search.search(index, total, q, 7).withColumnRenamed("doc", "doc_id").collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, search.rank(d, q, 7).collect()))


def test_items_in_lots_give_the_same(spark, monkeypatch):
    texts = [zipf(s, 1 + s % 50, WORDS) for s in range(80)]
    q = spark.createDataFrame([(i, zipf(900 + i, 9, WORDS)) for i in range(12)], "item_id long, text string")
    d = docs_of(spark, texts)
    want = sorted(map(tuple, search.rank(d, q, 4).collect()))
    monkeypatch.setattr(search, "LOT", 10)
    assert sorted(map(tuple, search.rank(d, q, 4).collect())) == want


def _shard(texts, total):
    found = [search.terms_of(t) for t in texts]
    terms = search.Terms(None)
    ids = [np.fromiter(map(terms.__getitem__, f), np.int64, len(f)) for f in found]
    docs = [np.full(len(f), i, np.int64) for i, f in enumerate(found)]
    lengths = np.array([len(f) for f in found], np.int64)
    rows = list(search._lists("s", terms, np.concatenate(ids), np.concatenate(docs), lengths, total))
    part = search.mass(lengths, total)
    return {r["term"]: search.Postings(r, part) for r in rows}


def test_blocks_round_trip():
    r = np.random.default_rng(1)
    for width in (3, 300, 70_000, 2**33):
        docs = np.unique(r.integers(0, width, 90))
        tfs = r.integers(1, width, len(docs))
        got = search.unpack(search._pack(docs, tfs))
        assert np.array_equal(got[0], docs) and np.array_equal(got[1], tfs)


@pytest.mark.parametrize("block,window", [(2, 3), (4, 64), (128, 4096)])
def test_block_max_pruning_is_exact_and_skips_blocks(monkeypatch, block, window):
    monkeypatch.setattr(search, "BLOCK", block)
    monkeypatch.setattr(search, "WINDOW", window)
    texts = [zipf(s, 1 + s % 40, WORDS) for s in range(400)]
    total = (len(texts), sum(len(search.terms_of(t)) for t in texts))
    items = [zipf(5000 + i, 12, WORDS) for i in range(25)]
    want = collections.defaultdict(list)
    for n, _, d, s in plain_rank(list(enumerate(texts)), items, 3):
        want[n].append((d, s))
    unpacked = held = 0
    for n, text in enumerate(items):
        lists = _shard(texts, total)
        weights = collections.Counter(plain_terms(text))
        used = [(c * search.weight(total[0], sum(len(p.block(i)[0]) for i in range(len(p.lasts)))), p) for t, c in weights.items() if (p := lists.get(t))]
        for _, p in used:
            p.held.clear()
        best = search.best_of(used, len(texts), search.Best(3, np.arange(len(texts))))
        assert list(zip(best.docs.tolist(), best.scores.tolist(), strict=True)) == want[n]
        unpacked += sum(len(p.held) for _, p in used)
        held += sum(len(p.lasts) for _, p in used)
    if block < 100:
        assert unpacked < 0.95 * held


def test_op13_query_against_sql(spark):
    con = duck_conn(SF)
    df = queries.op13_ranked_search(spark, SF)
    want = con.execute(queries.ORACLES["op13_ranked_search"])
    names = [c[0] for c in want.description]
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, want.fetchall())
