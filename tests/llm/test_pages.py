"""Operator 11 against pages of known text and a plain reader."""

from __future__ import annotations

import random
from html.parser import HTMLParser

import numpy as np
import pytest
from groovemill.llm import html_text, queries
from pyspark.sql import functions as F

SCHEMA = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def tree(spark):
    return html_text.trained(html_text.labelled_pages(spark))


def read(spark, tree, pages):
    found = html_text.main_text(spark.createDataFrame([(i, f"u{i}", p) for i, p in enumerate(pages)], SCHEMA), tree).collect()
    assert all(r["n_chars"] == len(r["text"]) and r["url"] == f"u{r['page_id']}" for r in found)
    return [r["text"] for r in sorted(found, key=lambda r: r["page_id"])]


class Plain(HTMLParser):
    """Text of headings and paragraphs in an article, for pages that have their main text nowhere else."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.lines, self.own = 0, [], []

    def cut(self):
        text = " ".join("".join(self.own).split())
        self.lines += [text] if text and self.inside else []
        self.own = []

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.own.append(" ")
        elif tag not in ("b", "a"):
            self.cut()
        self.inside += tag == "article"

    def handle_endtag(self, tag):
        if tag not in ("b", "a"):
            self.cut()
        self.inside -= tag == "article"

    def handle_data(self, data):
        self.own.append(data)


def test_query_by_a_plain_reader(spark, sf_dir):
    got = {r["page_id"]: r["text"] for r in queries.op11_html_text(spark, sf_dir).collect()}
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert len(got) == len(pages) == len({r["page_id"] for r in pages})
    for r in pages:
        plain = Plain()
        plain.feed(r["html"] or "")
        plain.close()
        plain.cut()
        assert got[r["page_id"]] == "\n".join(plain.lines)


PROSE = "the quiet harbour kept its lamps lit until the last boats had come home through heavy rain and fog".split()


def prose(seed, n):
    return " ".join(random.Random(seed).choices(PROSE, k=n))


def test_parts_beside_the_article(spark, tree):
    body = [prose(i, n) for i, n in enumerate((5, 30, 2, 80, 1, 12))]
    article = f"<h1>{body[0]}</h1><p>{body[1]}</p><p>{body[2]}<p>{body[3]}</p><ul><li>{body[4]}</li><li>{body[5]}</li></ul>"
    link = "<a href='/x'>go on reading</a>"
    beside = {
        "menu": f"<nav><ul><li>{link}</li><li>{prose(8, 9)}</li></ul></nav>",
        "header": f"<header><h1>{prose(9, 3)}</h1><p>{prose(10, 20)}</p></header>",
        "footer": f"<footer><p>{prose(11, 40)}</p></footer>",
        "sidebar": f"<aside><h3>{prose(12, 2)}</h3><p>{prose(13, 50)}</p></aside>",
        "sidebar by class": f"<div class='right-sidebar'><p>{prose(14, 50)}</p></div>",
        "notice": f"<div id='cookie-notice' role='dialog'><p>{prose(15, 30)}</p><button>Fine</button></div>",
        "advert": f"<div class='ad'><p>{prose(16, 30)}</p></div><!-- <p>{prose(17, 9)}</p> -->",
        "form": f"<form action='/s'><p>{prose(18, 20)}</p><label>Name</label><input name=q><select><option>one</select><textarea>two</textarea></form>",
        "script": "<script>var t = '<p>three</p>';</script><style>p { margin: 0 }</style><noscript><p>Turn scripts on</p></noscript>",
        "comments": f"<section id='comments'><h2>2 comments</h2><article class='comment'><p>{prose(19, 40)}</p></article><div><p>{prose(20, 3)}</p></div></section>",
    }
    pages, names = [], []
    for name, part in beside.items():
        for shape in ("<body>{part}<article>{article}</article></body>", "<body><article>{article}</article>{part}</body>", "<body><main><article>{article}{part}</article></main>", "<body><div class='content'>{article}</div>{part}"):
            if name == "header" and "{article}{part}" in shape:
                continue
            pages.append("<!DOCTYPE html><html><head><title>not this</title></head>" + shape.format(part=part, article=article))
            names.append((name, shape))
    for name, got in zip(names, read(spark, tree, pages), strict=True):
        assert got == "\n".join(body), name


def test_pages_without_names(spark, tree):
    long = [prose(i, 40 + i) for i in range(4)]
    menu = "".join(f"<div><a href='/{i}'>{prose(i, 1 + i % 2)}</a></div>" for i in range(5))
    page = f"<body>{menu}<div>{long[0]}</div><div>{long[1]}</div><div>Yes.</div><div>{long[2]} <a href=x>here</a></div><div>{long[3]}</div>{menu}</body>"
    assert read(spark, tree, [page]) == ["\n".join([long[0], long[1], "Yes.", f"{long[2]} here", long[3]])]


def test_characters_and_white_space(spark, tree):
    page = "<article><p>\n a &amp; b&nbsp;&lt;c&gt;  <b>d</b>e&#233;&#x1F600; &am &copy f<br>g\t<i> h </i></p>\r\n<p> </p><p>&quot;&amp;amp;&quot;</p></article>"
    assert read(spark, tree, [page]) == ['a & b <c> deé\U0001f600 &am © f g h\n"&amp;"']


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("   ", ""),
        ("<p>just a line of text", "just a line of text"),
        ("<article><p>cut off in the mid<p cla", "cut off in the mid"),
        ("<article><p>one<p>two <!-- open comment <p>three", "one\ntwo"),
        ("<article><p>a < b and c > d</p></article>", "a < b and c > d"),
        ("<article><P CLASS=x>upper</P></ARTICLE>", "upper"),
        ("<article></div></p><p title='a > b'>quoted</p>", "quoted"),
        ("<script>never closed <p>x</p>", ""),
        ("<nav><a href=1>all</a></nav>", ""),
    ],
)
def test_broken_markup(page, text):
    tree = html_text.Node(False, "aside", 0.5, html_text.Node(True), html_text.Node(False))
    blocks = html_text.flat_blocks(page)
    assert "\n".join(b["text"] for b in blocks if (b["aside"] <= tree.bound)) == text


@pytest.mark.parametrize("page", ["<div>" * 200_000 + "deep", "</div>" * 200_000 + "deep", '<a href="' * 50_000, "<" * 300_000, "<p>" + "word " * 300_000, "<b " + "x=1 " * 100_000 + ">deep"])
def test_long_pages_in_linear_time(page):
    import time

    began = time.process_time()
    html_text.flat_blocks(page)
    assert time.process_time() - began < 20


def test_features_and_tree_by_plain_loops(spark, tree):
    pages = html_text.labelled_pages(spark)
    rows = html_text.with_blocks(pages).select("blocks", F.transform("blocks", lambda x, i: html_text.compiled(tree, html_text.features(F.col("blocks"), x, i))).alias("main"), F.split("text", "\n").alias("lines")).collect()
    wrong = 0
    for r in rows:
        blocks = [b.asDict() for b in r["blocks"]]
        nothing = {"words": 0, "linked": 0}
        article = any(b["inside"] == 2 and not b["aside"] for b in blocks)
        for i, b in enumerate(blocks):
            before, after = blocks[i - 1] if i else nothing, blocks[i + 1] if i + 1 < len(blocks) else nothing
            known = {"words": b["words"], "inside": b["inside"], "aside": b["aside"], "heading": b["heading"], "item": b["item"], "elsewhere": article and b["inside"] < 2}
            for name, x in (("", b), ("before_", before), ("after_", after)):
                known |= {f"{name}words": x["words"], f"{name}density": x["linked"] / x["words"] if x["words"] else 0}
            at = tree
            while at.feature is not None:
                at = at.yes if known[at.feature] <= at.bound else at.no
            assert at.main == r["main"][i]
            wrong += at.main != (b["text"] in r["lines"])
    assert wrong <= 0.06 * sum(len(r["blocks"]) for r in rows)


def test_least_impurity():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 9, (60, len(html_text.FEATURES))).astype(float)
    y = x[:, 3] > 4
    assert html_text.grown(x, y) == html_text.Node(y.sum() * 2 >= 60, html_text.FEATURES[3], 4.5, html_text.Node(False), html_text.Node(True))

    def impurity(split):
        return sum(2 * len(s) * s.mean() * (1 - s.mean()) for s in (y[split], y[~split]) if len(s))

    y = (x[:, 1] + x[:, 4] + rng.normal(0, 2, 60)) > 8
    first = html_text.grown(x, y, 1)
    least = min(impurity(x[:, f] <= v) for f in range(x.shape[1]) for v in np.unique(x[:, f])[:-1] if min((x[:, f] <= v).sum(), (x[:, f] > v).sum()) >= html_text.LEAST)
    if first.feature is not None:
        assert abs(impurity(x[:, html_text.FEATURES.index(first.feature)] <= first.bound) - least) < 1e-9


def test_odd_rows(spark, tree):
    rows = [(1, "u", None), (1, "u", None), (2, None, ""), (None, None, "<article><p>text</p></article>"), (3, "v", "<p>" + "x" * 100_000)]
    pages = spark.createDataFrame(rows, SCHEMA).withColumns({"blocks": F.lit(1), "text": F.lit("t"), "n_chars": F.lit(2)})
    got = html_text.main_text(pages, tree)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got.collect()) == [(0, 4), (1, 0), (1, 0), (2, 0), (3, 100_000)]
    assert html_text.main_text(pages.limit(0), tree).count() == 0
    with pytest.raises(ValueError):
        html_text.trained(html_text.labelled_pages(spark).limit(0))
