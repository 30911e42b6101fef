"""Null ids, rows that agree in id and text, very long texts, empty tables and clashing columns, operator by operator and
stage by stage; and how far the fingerprint radius of decontamination reaches."""

import base64
import hashlib
import random
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rankspark.llm import bpe, decontam, lines, lm, quality, secrets, simhash, suffix, urls

DOC = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, row string, t string, fp long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), None, "r", "x", 7) for i, t in rows], DOC)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choices(string.ascii_lowercase, k=r.randint(2, 8))) for _ in range(n))


def test_quality_of_rows_that_agree(spark):
    rows = [(1, prose(1, 50))] * 3 + [(None, prose(2, 50)), (None, None)]
    got = quality.judge(docs_of(spark, rows)).select("row.doc_id", "n_words", "kept").collect()
    assert sorted((r.doc_id or 0, r.n_words, r.kept) for r in got) == [(0, 0, False), (0, 50, True), (1, 50, True), (1, 50, True), (1, 50, True)]


def test_urls_of_repeated_pages_null_ids_and_long_texts(spark):
    long = "https://a.net/" + "x" * 200_000
    rows = [(1, "https://x.com/de/1", None, "h"), (1, "https://x.com/de/1", None, "h"), (None, "https://y.org/", "<a href='https://x.com/de/2'>z</a>" * 20_000, "h"), (3, long, None, "h"), (None, None, None, None)]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).select("page_id", "path", "verdict").collect()
    assert sorted(((r.page_id or 0), len(r.path), r.verdict) for r in got) == [(0, 0, "allow"), (0, 1, "allow"), (1, 5, "block"), (1, 5, "block"), (3, 200_001, "allow")]


def test_bpe_of_null_and_repeated_keys(spark):
    import public_tokenizers as P

    rows = [(1, "same text"), (1, "same text"), (None, "same text"), (None, None)]
    got = bpe.digests(docs_of(spark, rows), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    sha = hashlib.sha256(b"same text").hexdigest()
    assert sorted((r.doc_id or 0, r.decoded_sha256 == sha, r.n_tokens > 0) for r in got) == [(0, False, False), (0, True, True), (1, True, True), (1, True, True)]


def test_lines_of_null_ids_and_rows_that_agree(spark):
    text = "\n".join(["one line", "two line", "three line", "four line"])
    got = lines.dedup(docs_of(spark, [(None, text), (5, text + "\nfive"), (5, text + "\nfive")])).select("row.doc_id", "kept_text").collect()
    null = [r.kept_text for r in got if r.doc_id is None]
    assert null == [text]  # null ids come first, so theirs is the first place
    assert [r.kept_text for r in got if r.doc_id == 5] == ["five", "five"]


def test_simhash_of_null_ids_and_rows_that_agree(spark):
    t = prose(4, 60)
    d = docs_of(spark, [(3, t), (3, t), (None, t), (9, t), (10, prose(5, 60))])
    got = simhash.near_duplicates(d).collect()
    assert len(got) >= 4 and {r.component_id for r in got if r.doc_id in (3, 9)} == {3}
    assert {r.component_id for r in got if r.doc_id == 10} == {10}


def test_lm_of_null_ids_and_rows_that_agree(spark):
    d = docs_of(spark, [(1, "a b c"), (1, "a b c"), (None, "a b d"), (2, None)])
    got = lm.score(d, spark.createDataFrame([(1,)], "doc_id long")).collect()
    assert len(got) == 4
    one = [(r.target_loss, r.corpus_loss) for r in got if r.doc_id == 1]
    null = next(r for r in got if r.doc_id is None)
    assert one[0] == one[1] and null.score > one[0][0] - one[0][1]  # null ids are background


def test_decontamination_of_null_ids_rows_that_agree_and_a_long_text(spark):
    item = prose(7, 40)
    bench = spark.createDataFrame([(1, item), (1, item), (None, item), (4, None)], "item_id long, text string")
    long = prose(8, 150_000) + " " + item + " " + prose(9, 50_000)
    d = docs_of(spark, [(1, f"x y {item} z"), (1, f"x y {item} z"), (None, item), (3, long), (4, prose(10, 300)), (5, None)])
    found = decontam.contaminated(d, bench).select("doc").distinct().collect()
    assert {r["doc"] for r in found} == {1, None, 3}
    left = decontam.clean(d, bench).select("doc_id").collect()
    assert sorted(r.doc_id for r in left) == [4, 5]


def test_radius_reaches_windows_at_the_least_similarity():
    """Pairs whose shingles are just 0.8 alike, by number of shingles: all fingerprints lie within RADIUS."""
    r = np.random.default_rng(3)
    for s in (9, 12, 20, 40, 80, 160):
        c = -(-8 * s // 9)  # shared shingles of two windows of s
        bits = lambda k: r.integers(0, 2, (1000, 64, k), dtype=np.int8).sum(2)
        both = bits(c)
        apart = ((2 * (both + bits(s - c)) > s) != (2 * (both + bits(s - c)) > s)).sum(1)
        assert (apart <= decontam.RADIUS).mean() >= 0.999, s


def plain_base(text):
    """The base spans, by a plain scan."""
    import re

    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(out))


def test_secrets_base_spans_equal_a_plain_scan(spark):
    r = random.Random(8)
    bits = ["password", "PassWord", "token", "api_key", "apikey", " = ", ":", "'", '"', "hunter2hunter2", "AKIA", "ABCD1234EFGH5678", "deadbeef" * 3, "0" * 23, "é漢", " ", "\n", "x", "="]
    texts = ["".join(r.choices(bits, k=r.randint(1, 25))) for _ in range(300)] + [None, "", "é" * 50_000 + "secret: abcdefgh"]
    rows = list(enumerate(texts)) + [(None, "token=abcdef123"), (7, texts[7])]
    got = secrets.scan_documents(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    for g in got:
        t = "token=abcdef123" if g.doc_id is None else texts[g.doc_id] or ""
        want = plain_base(t)
        assert g.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), t
        assert (g.n_assign, g.n_access, g.n_hex) == tuple(want.count(k + ":") for k in ("assign", "access", "hex"))
    empty = secrets.scan_documents(docs_of(spark, rows[:1]).limit(0))
    assert empty.count() == 0 and empty.columns[0] == "doc_id"
    assert "password" not in base64.b64encode(b"password=hunter22hunter22").decode()


def test_suffix_of_null_ids_and_rows_that_agree(spark):
    t, other = prose(11, 120), prose(12, 120)
    got = suffix.digests(docs_of(spark, [(1, t), (1, t), (None, other), (2, "é" + prose(13, 100)), (3, None)])).collect()
    said = sorted((r.doc_id or 0, r.n_removed, r.n_spans) for r in got)
    n = len(t.encode())
    assert said == [(0, 0, 0), (1, n, 1), (1, n, 1), (2, 0, 0), (3, 0, 0)]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stages_on_nulls_empty_tables_and_rows_that_agree(spark, tmp_path, name, stage):
    sf = "/root/testdata/sf0.001"
    t = prose(21, 80)
    d = docs_of(spark, [(1, t), (1, t), (None, prose(22, 80)), (3, None), (4, ""), (5, prose(23, 3000)), (6, prose(24, 60))])
    out = stage(spark, d, sf)
    assert out.columns == d.columns
    ids = [r.doc_id for r in out.collect()]
    assert 6 in ids and 5 in ids and set(ids) <= {1, None, 3, 4, 5, 6}
    assert stage(spark, d.limit(0), sf).count() == 0


def test_pipeline_runs_on_an_empty_table(spark, tmp_path):
    src = "/root/testdata/sf0.001"
    spark.read.parquet(f"{src}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{src}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_superseded_rounds_are_deleted(spark):
    import os

    from rankspark.llm.graph import components
    from rankspark.session import checkpoint_root

    folder = checkpoint_root(spark).removeprefix("file://")
    count = lambda: sum(n.startswith(("graph-", "url-rank")) for n in os.listdir(folder))
    before = count()
    chain = spark.range(200).selectExpr("id AS a", "id + 1 AS b")
    assert {r.root for r in components(chain).collect()} == {0}
    assert count() == before + 1
    edges = spark.createDataFrame([(f"h{i}", f"h{i + 1}", 1) for i in range(30)], "src string, dst string, n long")
    seeds = spark.createDataFrame([("distrust", "h30", 1.0)], "kind string, host string, seed double")
    assert urls.propagate(edges, seeds).count() == 31
    assert count() == before + 2
