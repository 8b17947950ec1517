"""Main text of web pages: flat text blocks, classified by a decision tree.

A page becomes a flat list of text blocks. Each block is described by its word count and link
density, those of the blocks before and after it, whether it is a heading, and what kind of
container holds it. A decision tree over these numbers keeps or drops the block. The tree is
trained with Spark on the blocks of a small labelled table (``extraction_samples``), then
applied to every page inside one Arrow-batched function: no shuffle, no state between pages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pandas as pd
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.llm.common import table
from hearthline.llm.extraction_samples import SAMPLES

#: Elements whose content is never text of the page.
SILENT = frozenset("script style title noscript template svg textarea select button iframe canvas audio video object dialog".split())
#: Those of them that run to the end of the page when no end tag follows; of the others only the tag is skipped.
RAW = frozenset(("script", "style"))
#: Elements that begin and end a block.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot "
    "th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold no article, whatever stands inside them.
ASIDE = frozenset("aside footer form menu nav".split())
#: Words of class, id or role that name a container beside the article.
BESIDE = frozenset(
    "ad ads adv advert advertisement advertising adverts alert banner breadcrumb breadcrumbs complementary consent contentinfo "
    "cookie cookies copyright disclaimer dialog feedback foot footer form gdpr header legal login masthead menu modal nav "
    "navbar navigation newsletter notice notices notification outbrain pager pagination popup promo promoted promotion "
    "recommend recommended related search share sharing sidebar signup skip social sponsor sponsored subscribe "
    "subscription taboola teaser toolbar topbar widget widgets".split()
)
#: The same for what readers wrote.
READERS = frozenset("comment comments commentlist discussion disqus replies reply respond responses reviews".split())
#: Words that name the article's container.
WITHIN = frozenset("article articlebody content entry main maincontent post story".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*|[^>]*)>|<[!?][^>]*>|<[a-zA-Z/][^>]*\Z",
    re.S | re.I,
)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
ENDS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in SILENT}
CLOSED = re.compile(r"(?:^|[\s\"'])/$")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden|aria-hidden\s*=\s*[\"']?true", re.I)
QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
#: The attribute by its name; what is quoted is taken out before.
HIDDEN_NAME = re.compile(r"(?:^|[\s\"])hidden(?=[\s/=]|$)", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Names that tell a state, a layout or a subject, not what the container is.
STATE = re.compile(r"^(?:has|with|without|no|is|category|tag|topic|format|status|layout)[-_]|[-_](?:on|off|enabled|disabled|open|closed)$", re.I)
SIDE = re.compile(r"[-_](?:left|right)$", re.I)
#: What decides whether a form spans the page: an article's element before the form's end.
FORM_PART = re.compile(r"<(?:(?P<end>/form)|article|main|h1)(?=[\s/>])", re.I)

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "heading", "place")


def _place(tag: str, attrs: str, outer: int) -> int:
    """What a container is: 2 the article, 1 unknown, 0 beside the article, -1 and never the article."""
    if outer < 0 or tag in ASIDE:
        return -1
    if attrs and (HIDDEN.search(attrs) or HIDDEN_NAME.search(QUOTED.sub('""', attrs))):
        return -1
    named = [x for x in NAMES.findall(attrs)] if attrs else []
    parts = [(x, {w.lower() for w in WORD.findall(x)}) for value in named for x in value.strip("\"'").split() if not STATE.search(x)]
    # next to a name of the article's container, "sidebar-right" says where the sidebar is
    article = any(w & WITHIN and not w & BESIDE for _, w in parts)
    words = {w for x, own in parts if not (article and SIDE.search(x)) for w in own}
    if tag == "main":
        return 2
    if words & READERS:
        return -1
    if tag in ("html", "body"):
        return 1
    if words & BESIDE:
        return outer if outer == 2 and words & BESIDE <= {"header"} else 0
    if tag == "article":
        return 2
    if tag == "header":
        return 2 if outer == 2 else 0
    if words & WITHIN:
        return 2 if outer else 0
    return outer


def blocks(html: str | None) -> list[tuple[str, int, float, int, int]]:
    """Text, words, link density, heading and place of each block that has text, in page order."""
    found: list[tuple[str, int, float, int, int]] = []
    page = html or ""
    stack: list[tuple[str, int]] = []
    text: list[str] = []
    linked: list[str] = []
    link = heading = 0
    at = 0
    forms = True  # whether the rest of the page may hold what decides about a form
    unended: set[str] = set()  # silent elements without an end tag in the rest of the page

    def flush() -> None:
        nonlocal text, linked
        words = unescape("".join(text)).split()
        if words:
            share = min(1.0, len(unescape("".join(linked)).split()) / len(words))
            found.append((" ".join(words), len(words), share, heading, stack[-1][1] if stack else 1))
        text, linked = [], []

    def put(piece: str) -> None:
        text.append(piece)
        if link:
            linked.append(piece)

    while token := TOKEN.search(page, at):
        if token.start() > at:
            put(page[at:token.start()])
        at = token.end()
        if token["tag"] is None:
            continue
        tag = token["tag"].lower()
        if tag in SILENT:
            if token["end"] or tag in unended or (tag not in RAW and CLOSED.search(token["attrs"])):
                continue
            end = ENDS[tag].search(page, at)
            if end:
                at = end.end()
            elif tag in RAW:
                at = len(page)
            else:
                unended.add(tag)
        elif tag == "a":
            link = 0 if token["end"] else 1
            if link:
                linked.append(" ")
        elif tag == "br":
            put(" ")
        elif tag in BLOCK:
            flush()
            link = 0
            if token["end"]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
            elif tag not in VOID:
                while stack and (stack[-1][0] == "p" or stack[-1][0] in HEADING):
                    stack.pop()
                if tag in ("li", "td", "th", "tr", "dd", "dt") and stack and stack[-1][0] == tag:
                    stack.pop()
                outer = stack[-1][1] if stack else 1
                spans = False
                if tag == "form" and forms:
                    part = FORM_PART.search(page, at)
                    forms = part is not None
                    spans = forms and not part["end"]
                stack.append((tag, outer if spans else _place(tag, token["attrs"], outer)))
            heading = int(bool(stack) and stack[-1][0] in HEADING)
    if at < len(page):
        put(page[at:])
    flush()
    return found


def features(found: list[tuple[str, int, float, int, int]]) -> list[tuple[float, ...]]:
    """FEATURES of each block; a missing neighbour has no words and no links."""
    sides = [("", 0, 0.0, 0, 1), *found, ("", 0, 0.0, 0, 1)]
    return [
        (float(x[1]), x[2], float(a[1]), a[2], float(b[1]), b[2], float(x[3]), float(x[4]))
        for a, x, b in zip(sides, found, sides[2:])
    ]


@dataclass(frozen=True)
class Node:
    """A tree: a leaf's verdict, or a split on ``feature`` at ``threshold``."""

    keep: bool
    feature: int = -1
    threshold: float = 0.0
    low: Node | None = None
    high: Node | None = None

    def verdict(self, x: tuple[float, ...]) -> bool:
        node = self
        while node.low and node.high:
            node = node.low if x[node.feature] <= node.threshold else node.high
        return node.keep


def labelled_blocks(spark: SparkSession) -> DataFrame:
    """The labelled table: a row of features and a label for each block of the sample pages."""
    rows = []
    for parts in SAMPLES:
        page, labels = "", []
        for keep, html in parts:
            page += html
            labels += [keep] * len(blocks(html))
        found = blocks(page)
        if len(found) != len(labels):
            raise ValueError("a sample's parts split into other blocks than the page")
        rows += [(*x, float(y)) for x, y in zip(features(found), labels)]
    return spark.createDataFrame(rows, [*FEATURES, "label"])


def train(spark: SparkSession, depth: int = 6) -> Node:
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(labelled_blocks(spark).coalesce(1))
    model = DecisionTreeClassifier(featuresCol="x", labelCol="label", maxDepth=depth, maxBins=64, seed=1).fit(data)

    def copy(node) -> Node:
        keep = float(node.prediction()) == 1.0
        if node.subtreeDepth() == 0:
            return Node(keep)
        split = node.split()
        return Node(keep, split.featureIndex(), float(split.threshold()), copy(node.leftChild()), copy(node.rightChild()))

    return copy(model._java_obj.rootNode())


def main_text(html: str | None, tree: Node) -> str:
    found = blocks(html)
    return "\n\n".join(x[0] for x, f in zip(found, features(found)) if tree.verdict(f))


def extract(pages: DataFrame, tree: Node | None = None, html_col: str = "html") -> DataFrame:
    """``pages`` with columns ``text`` (empty when nothing is kept or ``html`` is null) and ``n_chars``.

    Whole pages are read; every other column stays. Pages are independent, so repeated rows
    give repeated results and an empty table gives none.
    """
    tree = tree or train(pages.sparkSession)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(x, tree) for x in batch], dtype="object")

    text = F.pandas_udf(run, "string")(F.col(html_col))
    others = [c for c in pages.columns if c not in ("text", "n_chars")]
    return pages.select(*others, text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")).select(
        "page_id", "url", "text", "n_chars"
    )
