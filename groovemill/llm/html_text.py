"""Operator 11: main text of web pages from flat blocks, told apart by a decision tree.

Executors cut each page into flat blocks of text; how long these are, how much of them is linked, what stands next to them
and what they stand in are columns of Spark, as is the tree, which is trained on a small labelled table and compiled into
one expression. No rows are moved.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import slices

BLOCKS = "array<struct<text: string, words: int, linked: int, inside: int, aside: int, heading: int, item: int>>"

# fixed values: names of the public HTML standard and words that page authors use for parts of a page
#: Elements that don't end a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content isn't markup.
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
#: Elements whose text isn't text of the page.
UNREAD = frozenset("template object svg canvas select button datalist audio video".split())
#: Elements beside the main text.
ASIDE = frozenset("nav footer aside noscript dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form note".split())
#: Names of classes and ids of such parts: the start of one of their words, or a whole word.
BESIDE = re.compile(
    "(?:nav|menu|sidebar|foot|comment|cookie|consent|gdpr|advert|banner|breadcrumb|newsletter|promo|sponsor|share|social|related|recommend|subscri|popup|modal|overlay|widget|signup|login|search|toolbar|pagination|pager|masthead|notice|notification|disclaimer|skip|disqus|respon[ds]|topbar|teaser|copyright|reaction|reply|replies|feedback)|(?:ads?|header|alert|aside|legal|form|tags|rail|discussion|hidden)$"
)
MAIN_NAMES = frozenset("article articlebody post entry story content main text body maincontent".split())
LIST_OF_P = frozenset("li dt dd td th tr option".split())

_TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</(?![a-zA-Z])[^>]*+(?:>|\Z)
    |<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[\s/]++|=?[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+)?+)?+|=)*+)(?:>|\Z)
    |(?P<text>[^<]++|<)""",
    re.DOTALL | re.VERBOSE,
)
_ATTRIBUTE = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+("[^"]*+"?|'[^']*+'?|[^\s>]++))?+""")

_ASIDE, _FORM, _UNREAD, _ITEM = 1, 2, 4, 8


def _attributes(rest: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(rest):
        found.setdefault(name.lower(), entities.unescape(value.strip("\"'")))
    return found


class Frame(NamedTuple):
    """An open element and what its text stands in: ``inside`` is 2 in an article, 1 in other main parts."""

    name: str
    flags: int
    inside: int


def _entered(above: Frame, name: str, rest: str) -> Frame:
    flags, inside = above.flags, above.inside
    found = _attributes(rest) if rest and not rest.isspace() else {}
    names = f"{found.get('class', '')} {found.get('id', '')} {found.get('itemprop', '')}".lower()
    words = re.findall("[a-z]+", names)
    own = name in ("article", "main") or found.get("role") in ("main", "article")
    if name in ("html", "body"):
        beside = False
    elif own:  # an article within an article is a comment or a teaser if it says so
        beside = any(x in ("comment", "teaser", "ad", "advert", "advertisement", "promo", "sponsored") or x.startswith("comment-") for x in names.split())
    else:
        named = not MAIN_NAMES.isdisjoint(words)
        beside = any(BESIDE.match(x) and not (x == "header" and (named or inside)) for x in words)
        beside |= name in ASIDE or (name == "header" and not inside) or found.get("role") in ROLES
        beside |= "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
        if named and not beside:
            inside = max(inside, 2 if "articlebody" in words else 1)
    if own:
        flags &= ~(_FORM | _ITEM)
        inside = max(inside, 2 if name == "article" or found.get("role") == "article" else 1)
    flags |= _ASIDE * beside | _FORM * (name in ("form", "fieldset")) | _UNREAD * (name in UNREAD) | _ITEM * (name in LIST_OF_P)
    return Frame(name, flags, inside)


def flat_blocks(page: str) -> list[dict]:
    """The blocks of text of a page in order. Markup that doesn't end is read as browsers do, up to the end of the page."""
    stack, opened, found, pieces, linked = [Frame("", 0, 0)], Counter(), [], [], []
    link, at, size = 0, 0, len(page)  # link: depth of the stack where the open link began

    def flush() -> None:
        text = " ".join("".join(pieces).split())
        if text:
            top, words = stack[-1], text.count(" ") + 1
            heading = int(len(top.name) == 2 and top.name[0] == "h" and top.name[1] in "123456")
            found.append({"text": text, "words": words, "linked": min(words, len("".join(linked).split())), "inside": top.inside, "aside": int(bool(top.flags & (_ASIDE | _FORM))), "heading": heading, "item": int(bool(top.flags & _ITEM))})
        pieces.clear()
        linked.clear()

    def leave(name: str) -> None:
        nonlocal link
        while True:
            gone = stack.pop()
            opened[gone.name] -= 1
            if gone.name == name:
                break
        if len(stack) < link:
            link = 0

    while at < size:
        token = _TOKEN.match(page, at)
        at = token.end()
        if token["text"] is not None:
            if not stack[-1].flags & _UNREAD:
                text = entities.unescape(token["text"])
                pieces.append(text)
                if link:
                    linked.append(text)
            continue
        if token["name"] is None:
            continue
        name = token["name"].lower()
        if token["end"]:
            if name == "a":
                link = 0
                linked.append(" ")
            elif name in INLINE:
                pass
            elif opened[name]:
                flush()
                leave(name)
            elif name == "p":
                flush()
            continue
        if name == "a":
            link = len(stack) if re.search(r"\bhref\b", token["rest"], re.IGNORECASE) else 0
        elif name == "br":
            pieces.append(" ")
        elif name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.IGNORECASE).search(page, at)
            at = end.start() if end else size
        elif name not in INLINE:
            flush()
            if stack[-1].name == "p":
                leave("p")
            if name in LIST_OF_P and stack[-1].name == name or name in ("dt", "dd") and stack[-1].name in ("dt", "dd") or name in ("td", "th") and stack[-1].name in ("td", "th"):
                leave(stack[-1].name)
            if name not in VOID:
                stack.append(_entered(stack[-1], name, token["rest"]))
                opened[name] += 1
    flush()
    return found


def with_blocks(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with their flat blocks in a column ``blocks`` instead of the html; null html has none."""
    others = [c for c in pages.columns if c != html]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, html):
            columns = [batch.column(i) for i, c in enumerate(batch.schema.names) if c != html]
            pages_of = batch.column(batch.schema.get_field_index(html)).to_pylist()
            kind = pa.list_(pa.struct([("text", pa.string()), *((x, pa.int32()) for x in ("words", "linked", "inside", "aside", "heading", "item"))]))
            yield pa.RecordBatch.from_arrays([*columns, pa.array([flat_blocks(x or "") for x in pages_of], kind)], names=[*others, "blocks"])

    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in pages.schema if f.name != html)
    return pages.mapInArrow(run, f"{fields}, blocks {BLOCKS}" if fields else f"blocks {BLOCKS}")


#: What the tree may ask of a block, of those before and after it and of its page.
FEATURES = ("words", "density", "before_words", "before_density", "after_words", "after_density", "inside", "elsewhere", "aside", "heading", "item")


def features(blocks: Column, block: Column, i: Column) -> dict[str, Column]:
    """The features of the i-th of ``blocks``. Beyond the ends of a page stand blocks of no words.

    density: linked words per word; inside: 2 in an article, 1 in another main part; elsewhere: the page has an article, which
    the block doesn't stand in; aside: in a menu, header, footer, sidebar, notice, advert, form or comments.
    """
    number = lambda x: x.cast("double")
    density = lambda x: F.coalesce(x["linked"] / x["words"], F.lit(0.0))
    before, after = F.get(blocks, i - 1), F.get(blocks, i + 1)
    found = {"words": number(block["words"]), "density": density(block)}
    for name, x in (("before", before), ("after", after)):
        found |= {f"{name}_words": F.coalesce(number(x["words"]), F.lit(0.0)), f"{name}_density": density(x)}
    article = F.exists(blocks, lambda x: (x["inside"] == 2) & (x["aside"] == 0))
    found["elsewhere"] = ((block["inside"] < 2) & article).cast("double")
    return found | {x: number(block[x]) for x in ("inside", "aside", "heading", "item")}


class Node(NamedTuple):
    """A leaf (``feature`` None) with a verdict, or a question: is the feature at most ``bound``?"""

    main: bool
    feature: str | None = None
    bound: float = 0.0
    yes: Node | None = None
    no: Node | None = None


#: Depth of the tree, and fewest blocks on either side of a question.
DEPTH, LEAST = 6, 2
#: Most labelled blocks that a tree is trained on.
MOST_LABELLED = 20_000


def grown(x: np.ndarray, y: np.ndarray, depth: int = DEPTH) -> Node:
    """A tree of least Gini impurity at each question; ties go to the feature and bound that come first."""
    main = bool(2 * y.sum() >= len(y))
    if depth == 0 or len(y) < 2 * LEAST or y.all() or not y.any():
        return Node(main)
    best, at = 2.0 * len(y) * y.mean() * (1 - y.mean()) - 1e-9, None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        value, good = x[order, f], np.cumsum(y[order])
        left = np.arange(1, len(y))
        right, good, total = len(y) - left, good[:-1], good[-1]
        cost = 2 * good * (left - good) / left + 2 * (total - good) * (right - total + good) / right
        cost[(value[1:] == value[:-1]) | (left < LEAST) | (right < LEAST)] = np.inf
        k = int(cost.argmin())
        if cost[k] < best:
            best, at = float(cost[k]), (f, float(value[k] + value[k + 1]) / 2)
    if at is None:
        return Node(main)
    side = x[:, at[0]] <= at[1]
    yes, no = grown(x[side], y[side], depth - 1), grown(x[~side], y[~side], depth - 1)
    if yes == no:  # leaves of one verdict
        return yes
    return Node(main, FEATURES[at[0]], at[1], yes, no)


def compiled(tree: Node, columns: dict[str, Column]) -> Column:
    """The tree's verdict as one expression."""
    if tree.feature is None:
        return F.lit(tree.main)
    return F.when(columns[tree.feature] <= tree.bound, compiled(tree.yes, columns)).otherwise(compiled(tree.no, columns))


#: Layouts of labelled pages. {n}: n words, [n]: a link of n words; what begins with + is main text.
LAYOUTS = (
    "<title>{5}</title><nav><ul><li>[1]<li>[2]<li>[1]<li>[1]</ul></nav><div class=ad>{9}</div><article><h1>+{8}</h1><p>+{45}</p><p>+{3}</p><p>+{1}</p><p>+{80} [2] {12}</p></article><footer>{9}</footer>",
    "<header><a href=/>{2}</a><p>{6}</p></header><main><article><h1>+{6}</h1><p>+{30}<p>+{5}<h2>+{3}</h2><ul><li>+{6}<li>+{2}<li>+{9} [1] {3}</ul><p>+{60}</article><aside><h3>{2}</h3><p>{25}</p><ul><li>[6]<li>[7]</ul></aside></main><footer><p>{14}</p><p>[1] [1] [2]</p></footer>",
    "<div id=menu>[1] [1] [1] [2]</div><div class=content><h1>+{7}</h1><p>+{50}</p><p>+{4}</p><p>+{35} [3] {8}</p><table><tr><td>+{1}<td>+{2}</tr><tr><td>+{3}<td>+{1}</tr></table></div><div class=sidebar><p>{20}</p><p>[5]</p></div><div class=footer>{12}</div>",
    "<div class=cookie-notice><p>{22} [2]</p></div><div><a href=/>{3}</a></div><div>[1] [1] [1]</div><h1>+{9}</h1><p>+{70}</p><p>+{2}</p><p>+{40}</p><p>+{6}</p><p>+{55} [4] {20}</p><div>[4]</div><div>[6]</div><div>[5]</div><div>{5}</div>",
    "<article><h1>+{5}</h1><p>+{24}</p><figure><figcaption>+{7}</figcaption></figure><blockquote><p>+{18}</p></blockquote><p>+{33}</p><ul><li>[5]<li>[6]<li>[8]</ul><div class=share>[1] [1] [1]</div><section id=comments><h3>{2}</h3><div><p>{40}</p><p>{6}</p></div><div><p>{28}</p></div></section></article><form><p>{6}</p><label>{2}</label></form>",
    "<nav>[2] [1]</nav><main><p>{8}</p><article><h2>+{4}</h2><p>+{12}</p><p>+{2}</p><p>+{15} [1] {4}</p><p>+[2] {9}</p></article><p>{4} [3]</p><p>{30}</p></main><footer><div>{20}</div></footer>",
    "<div>[1] [1] [1] [1]</div><div>{2}</div><div><div>+{6}</div><div>+{90}</div><div>+{65} [2] {30}</div><div>+{8}</div><div>+{44}</div></div><div>[3] [2]</div><div>[2] [2] [2]</div><div>{6}</div>",
    "<header><h1>{3}</h1><nav>[1] [1]</nav></header><div class=banner><p>{16}</p></div><article><header><h1>+{7}</h1></header><p>+{20}</p><aside><p>{18}</p></aside><p>+{11}</p><p>+{48}</p><p>+[4]</p><footer><p>{10}</p></footer></article><div class=newsletter><p>{15}</p></div>",
    "<div>[2] [2] [2]</div><div>{3}</div><div>[9]</div><div>[8]</div><div>[7]</div><div>{4}</div>",
    "<nav>[1] [1]</nav><article><h1>+{4}</h1><p>+{3}</p><p>+{10}</p></article><footer>{5}</footer>",
    "<nav><ul><li>[1]<li>[1]</ul></nav><article><h1>+{1}</h1><p>+{1}</p></article><p>[2]</p>",
    "<ul class=menu><li>[2]<li>[1]</ul><article><p>+{6}</p><p>+{2}</p><p>+[3]</p><p>+[5] {4}</p><p>+{7}</p></article><p>{32}</p><p>{12}</p>",
    "<nav>[1]</nav><main><h1>+{2}</h1><p>+{7}</p><p>+[2]</p><p>+{4}</p></main><footer>[1]</footer>",
    "<header>[1]</header><article><h2>+[6]</h2><p>+{14}</p><h3>+{2}</h3><ol><li>+{4}<li>+{8}</ol><p>+{1}</p><div>+{5}</div></article><div>{40}</div><div>[3]</div>",
    "<div class=navbar>[1] [2]</div><div id=content><h2>+{5}</h2><p>+{9}</p><p>+{3}</p><p>+[2] {3}</p><ul><li>+{3}<li>+{4}</ul></div><div class=comments><p>{30}</p><p>{5}</p></div>",
    "<div>[1]</div><div>[1]</div><div>[2]</div><div>+{5}</div><div>+{31}</div><div>+{3}</div><div>+{28}</div><div>{4} [2]</div><div>[2]</div><div>{3}</div>",
    "<p>[1] [1] [1]</p><h1>+{6}</h1><p>+{16} [1]</p><p>+{22}</p><p>+{2}</p><p>+{64}</p><p>[2] [2]</p><p>[1]</p>",
    "<nav>[1]</nav><article><h1>+{5}</h1><p>+{20}</p><p>+{4}",
    "<div class=menu>[1] [1]</div><p>+{30}</p><p>+{4}</p>",
    "<header>{3}</header><h1>+{5}</h1><p>+{12}</p><p>+{60}</p>",
    "<article><p>+{9}</p><p>+{2}</p></article>",
    "<p>+{7}</p>",
    "+{40}",
    "<ul><li>[1]<li>[1]<li>[2]</ul><p>+{26}</p><p>+{38}</p><p>+{5}</p><p>+{29}</p><p>[4]</p><p>[3]</p>",
)


def labelled_pages(spark: SparkSession) -> DataFrame:
    """The small labelled table that the tree is trained on by default: html, and its main text with a line for each block."""
    rows = []
    for layout in LAYOUTS:
        word, main = iter(range(10_000)), []

        def filled(match: re.Match, word=word, main=main) -> str:
            shown, plain = [], []
            for kind, n in re.findall(r"([{[])(\d+)", match[2]):
                text = " ".join(f"w{next(word)}" for _ in range(int(n)))
                plain.append(text)
                shown.append(text if kind == "{" else f"<a href=x>{text}</a>")
            if match[1]:
                main.append(" ".join(plain))
            return " ".join(shown)

        page = re.sub(r"(\+?)((?:\{\d+\}|\[\d+\])(?: (?:\{\d+\}|\[\d+\]))*)", filled, layout)
        rows.append((page, "\n".join(main)))
    return spark.createDataFrame(rows, "html string, text string")


def trained(labelled: DataFrame) -> Node:
    """A tree for ``labelled`` pages (html, text: the main text as ``main_text`` returns it).

    A block is main text if it is a line of the page's text. At most MOST_LABELLED blocks are taken, in the order of a hash of
    the page: it is a labelled table, and its size doesn't follow that of the pages to be read.
    """
    rows = with_blocks(labelled.select("html", F.col("html").alias("page"), F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines")))

    def row(x: Column, i: Column) -> Column:
        known = features(F.col("blocks"), x, i)
        return F.struct(F.array(*(known[f] for f in FEATURES)).alias("x"), F.array_contains("lines", x["text"]).alias("y"))

    found = rows.select(F.xxhash64("page").alias("h"), "page", F.posexplode(F.transform("blocks", row)).alias("i", "b")).orderBy("h", "page", "i").limit(MOST_LABELLED).select("b.*").collect()
    if not found:
        raise ValueError("no labelled blocks")
    return grown(np.array([r["x"] for r in found]), np.array([r["y"] for r in found], bool))


def main_text(pages: DataFrame, tree: Node | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each row of ``pages`` (page_id, url, html).

    White space within a block is one space; blocks that the tree takes for main text stand in page order, one to a line.
    Null or empty html, and pages without such blocks, have an empty text. Rows stay as they are, repeated ones as well;
    further columns of ``pages`` are ignored.
    """
    tree = trained(labelled_pages(pages.sparkSession)) if tree is None else tree
    blocks = with_blocks(pages.select("page_id", "url", "html"))
    kept = F.filter("blocks", lambda x, i: compiled(tree, features(F.col("blocks"), x, i)))
    text = F.array_join(F.transform(kept, lambda x: x["text"]), "\n")
    return blocks.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
