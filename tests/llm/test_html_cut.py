"""Main-text extraction: whole pages against a brute-force labelling, costs that are learnt, blocks that the cut decides,
and pages whose class names speak of other parts without being them."""

import collections
import itertools
import random

import pytest

from rankspark.llm import html, queries

SENTENCE = " ".join(["word and more of it"] * 8)
PARAS = f"<p>{SENTENCE} one.</p><p>{SENTENCE} two.</p>"

PAGES = {
    "layout word": (f'<body><nav><a href=x>m</a></nav><div class="has-sidebar"><article><h1>T</h1>{PARAS}</article></div><div class="sidebar"><p>{SENTENCE} side</p></div></body>', ["T", "one.", "two."]),
    "no sidebar": (f'<body><div class="layout no-sidebar"><h1>Title</h1>{PARAS}</div><footer>f</footer></body>', ["Title", "one.", "two."]),
    "page in a form": (f'<body><form id="aspnetForm"><div id="menu"><a href=x>m</a></div><h1>Title</h1>{PARAS}</form></body>', ["Title", "one.", "two."]),
    "form in a page": (f"<body><article>{PARAS}<form><p>Your name and {SENTENCE}</p></form></article></body>", ["one.", "two."]),
    "sections": (f'<body><article><h1>T</h1><section id="discussion"><h2>Discussion</h2>{PARAS}</section><section id="related-work"><p>{SENTENCE} work</p></section></article></body>',
                 ["T", "Discussion", "one.", "two.", "work"]),
    "parts of an article": (f'<body><article>{PARAS}<div class="comments"><p>{SENTENCE} c</p></div><div class="ad"><p>{SENTENCE} ad</p></div><div class="notice">{SENTENCE}</div></article></body>', ["one.", "two."]),
    "many comments": (f'<body><article>{PARAS}</article><div id="comments"><article class="comment-body"><p>{SENTENCE} c</p></article>{PARAS * 5}</div></body>', ["one.", "two."]),
    "wrapper of the article": (f'<body><div class="widget"><main>{PARAS}</main></div><div class="widget"><p>{SENTENCE} w</p></div></body>', ["one.", "two."]),
    "no container": (f"<body><div><a href=1>home</a> <a href=2>about</a></div><div><p>{SENTENCE} one.</p><div>Ok.</div><p>{SENTENCE} two.</p></div><div>(c)</div></body>", ["one.", "Ok.", "two."]),
    "hidden": (f'<body><article>{PARAS}<p hidden>{SENTENCE}</p><div aria-hidden="true">x</div></article></body>', ["one.", "two."]),
}


@pytest.mark.parametrize("name", list(PAGES))
def test_pages_keep_their_article(name):
    page, ends = PAGES[name]
    assert [t.split(" ")[-1] for t in html.main_text(page).split("\n")] == ends


def cost(costs, edges, yes):
    return sum(t if y else s for (s, t), y in zip(costs, yes, strict=True)) + sum(c for i, j, c in edges if yes[i] != yes[j])


def random_page(r):
    def part(depth):
        kind = r.choice(["p", "div", "h2", "li", "section", "article", "div class=ad", "div class='related'", "section id=discussion", "form", "aside", "a href=x"])
        inner = " ".join(r.choices(["word", "and", "more", "of", "it."], k=r.choice([1, 2, 4, 12, 30])))
        if depth < 3 and r.random() < 0.5:
            inner = "".join(part(depth + 1) for _ in range(r.randint(1, 3)))
        return f"<{kind}>{inner}</{kind.split()[0]}>"

    return "<body>" + "".join(part(0) for _ in range(r.randint(1, 4))) + "</body>"


def test_whole_pages_against_all_labellings():
    r, flips, pages = random.Random(4), 0, 0
    learnt = {c: (r.randint(0, 300), r.randint(0, 300)) for c in range(0, 160, 3)}
    for _ in range(600):
        page = random_page(r)
        found = html.blocks(page)
        if not 0 < len(found) <= 11:
            continue
        pages += 1
        costs, edges = html.network(found, learnt)
        said = html.labels(page, learnt)
        best = min(cost(costs, edges, y) for y in itertools.product((False, True), repeat=len(found)))
        assert cost(costs, edges, [y for _, y, _ in said]) == best
        flips += any(y != own for _, y, own in said)
    assert pages > 200 and flips > 30  # the cut decides: blocks that their own costs alone would call otherwise


def test_isolated_blocks_follow_their_neighbours():
    said = {t.split(" ")[-1]: (y, own) for t, y, own in html.labels(PAGES["no container"][0])}
    assert said["Ok."] == (True, False) and said["(c)"] == (False, False)


def test_classifier_is_learnt_from_pages_that_mark_their_article(spark):
    article = "<article>" + "".join(f"<p>Short {i}.</p>" for i in range(8)) + "</article>"
    menu = "<div>" + "".join(f"<div>{SENTENCE} menu {i}</div>" for i in range(4)) + "</div>"
    pages = [(i, None, article + menu, "x", 1) for i in range(60)] + [(100, "u", None, "x", 1), (101, "u", "", "x", 1), (102, "u", "<p>no mark</p>", "x", 1)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text string, cell int")
    learnt = html.fit(df)
    want = collections.defaultdict(lambda: [0, 0])
    for _, _, h, *_ in pages:
        for c, y in html.told(h):
            want[c][0 if y else 1] += 1
    assert learnt == {c: tuple(v) for c, v in want.items()}
    plain = "<body>" + article.replace("article", "section") + menu + "</body>"
    assert "menu" in html.main_text(plain) and "menu" not in html.main_text(plain, learnt)
    assert "Short 3." in html.main_text(plain, learnt)
    assert html.fit(df.limit(0)) == {}


def test_rows_that_agree_null_ids_and_clashing_columns(spark):
    page = PAGES["sections"][0]
    rows = [(1, "u", page, "t", "n"), (1, "u", page, "t", "n"), (None, None, page, None, None), (2, "u", f"<article><p>{SENTENCE * 2000}</p></article>", None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars string")
    got = html.extract(df).collect()
    want = html.main_text(page)
    assert [r.text for r in got if r.page_id != 2] == [want] * 3 and {r.n_chars for r in got if r.page_id != 2} == {len(want)}
    assert [r.n_chars for r in got if r.page_id == 2] == [len(SENTENCE) * 2000]
    assert html.extract(df.limit(0)).count() == 0


def test_op5_query_keeps_the_whole_article(spark):
    import re

    sf = "/root/testdata/sf0.001"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = queries.op5_html_extraction(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        inside = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)
        if inside and "<div" not in inside[1] and "<form" not in inside[1] and "<aside" not in inside[1]:
            plain = re.sub(r"<[^>]*>", " ", re.sub(r"<!--.*?-->|<(script|style)\b.*?</\1>", " ", inside[1], flags=re.S))
            import html as std

            assert re.sub(r"\s+", "", r.text) == re.sub(r"\s+", "", std.unescape(plain))
