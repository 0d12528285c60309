"""Main text of web pages: flat text blocks classified by a decision tree.

A page is read as a flat row of text blocks, cut at block-level tags. A block's features are its words and its share
of linked words, those of its neighbours, and what encloses it: an article, a heading, or an element whose tag,
role or class says that it is no main text. A decision tree learned from a small labelled table of page layouts
(``main_text_labels``) says which blocks stay; they are joined in page order.

Cases: a null or empty page has the empty text; unclosed elements and comments end with the page, an unfinished
tag at the end is dropped; character references are decoded once; repeated pages are read alike; an empty table gives an empty
result; further columns are not read.

Forms, dialogs, field sets and elements whose class, id or role names another use are only suspected of it. Of a page's articles
those in the fewest suspected elements stay; on a page without an article the blocks in so few of them that they hold half of its
words; inside an article a suspected part goes unless it holds most of the article. Reader comments are never taken for the text by
their size.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.main_text_labels import labelled_pages

FEATURES = ("words", "linked", "words_before", "linked_before", "words_after", "linked_after", "in_article", "page_has_article", "heading", "other_use", "frame")

# Element names and words of class, id and role
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul video audio".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style noscript template textarea iframe title svg math object canvas noembed noframes xmp".split())
#: Elements that are read like others where they stand in an article.
EMBEDDED_TAGS = frozenset("noscript svg math object canvas".split())
OTHER_TAGS = frozenset("nav aside button select menu head".split())
#: Elements that often hold what is no main text, and sometimes all of it.
SUSPECT_TAGS = frozenset("form dialog fieldset".split())
OTHER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices alert popup modal overlay "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager sidebar aside complementary related recommended share sharing social "
    "newsletter subscribe subscription signup login search comment comments discussion disqus replies reply widget toolbar skip".split()
)
COMMENT_WORDS = frozenset("comment comments discussion disqus replies reply".split())
#: First and last parts of compound names that tell a state of the element, not its use.
STATES, ENDINGS = frozenset("has have with without no is not show shows hide hides allow allows enable enables supports".split()), frozenset("open opened closed enabled disabled allowed on off".split())
FRAME_WORDS = frozenset("header footer masthead contentinfo".split())
ARTICLE_TAGS = frozenset(("article", "main"))
#: Elements that an opening tag closes by itself.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?P<end>>|\Z)", re.S
)
_NAMED = re.compile(r"(?:^|\s)(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)


@dataclass
class Element:
    name: str
    other: bool
    suspect: bool
    comment: bool
    frame: bool
    article: bool
    link: bool
    heading: bool


@dataclass
class Blocks:
    """Collects the blocks of a page."""

    rows: list[list] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked_parts: list[str] = field(default_factory=list)
    around: list[tuple] = field(default_factory=list)  # of each block, see ``close``

    def close(self, stack: list[Element]) -> None:
        text = " ".join(entities.unescape("".join(self.parts)).split())
        if text:
            words = text.count(" ") + 1
            linked = len(entities.unescape(" ".join(self.linked_parts)).split())
            article = any(e.article for e in stack) and not any(e.comment for e in stack)  # reader comments are often articles
            inner = max((i for i, e in enumerate(stack) if e.article), default=len(stack))
            outside, inside = stack[: inner + 1], stack[inner + 1 :]
            # suspected elements that are or hold its article (or hold it, if it has none), and what is suspected inside of that
            self.around.append((sum(e.suspect or e.comment for e in outside), any(e.comment for e in outside), any(e.suspect for e in inside), any(e.comment for e in inside)))
            self.rows.append([text, words, min(1.0, linked / words), article, any(e.heading for e in stack), any(e.other for e in stack), any(e.frame for e in stack)])
        self.parts, self.linked_parts = [], []

    def judge(self) -> list[list]:
        """The blocks, of other use also where the suspicion about elements around them holds."""
        plain = [r[1] * (1 - r[2]) for r in self.rows]  # words without links
        if any(r[3] for r in self.rows):
            least = min((a[0] for a, r in zip(self.around, self.rows) if r[3] and not r[5]), default=0)
            own = [(a, n) for a, r, n in zip(self.around, self.rows, plain) if r[3] and not r[5] and a[0] <= least and not a[3]]
            most = sum(n for a, n in own if a[2]) > 4 * sum(n for a, n in own if not a[2])  # nearly all of it is in a suspected part
            for (count, _, suspect, comment), row in zip(self.around, self.rows):
                row[5] = row[5] or comment or (suspect and not most) or count > (least if row[3] else 0)
            return self.rows
        open_ = [(a[0], n) for a, r, n in zip(self.around, self.rows, plain) if not (r[5] or r[6] or a[1])]
        total, held, least = sum(n for _, n in open_), 0.0, 0
        for least in sorted({count for count, _ in open_}):
            held += sum(n for count, n in open_ if count == least)
            if 2 * held >= total:
                break
        for (count, comment, _, _), row in zip(self.around, self.rows):
            row[5] = row[5] or comment or count > least
        return self.rows


def _said(names: str) -> set[str]:
    """The words of class names, but for those that tell a state: ``has-sidebar``, ``comments-open``."""
    out: set[str] = set()
    for name in names.split():
        parts = re.findall(r"[a-z]+", name)
        if len(parts) == 1 or (parts and parts[0] not in STATES and parts[-1] not in ENDINGS):
            out.update(parts)
    return out


def _element(name: str, rest: str, stack: list[Element]) -> Element:
    said: set[str] = set()
    hidden = False
    if rest and len(rest) > 2:
        for key, value in _NAMED.findall(rest):
            key, value = key.lower(), value.strip("\"'").lower()
            if key in ("class", "id", "role"):
                said |= _said(value)
            elif key == "style":
                hidden = hidden or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) is not None
            else:
                hidden = hidden or key == "hidden" or value == "true"
    inside = any(e.article for e in stack)
    frame = name == "footer" or "footer" in said or (not inside and (name == "header" or bool(said & FRAME_WORDS)))
    named = name not in ("body", "html")
    comment = named and bool(said & COMMENT_WORDS)
    suspect = name in SUSPECT_TAGS or (named and not comment and bool(said & OTHER_WORDS))
    return Element(name, name in OTHER_TAGS or hidden, suspect, comment, frame, name in ARTICLE_TAGS, name == "a", name in ("h1", "h2", "h3", "h4", "h5", "h6"))


def page_blocks(page: str | None) -> list[list]:
    """``text, words, linked, in_article, heading, other_use, frame`` of each block, in page order."""
    page = page or ""
    out, stack, at = Blocks(), [], 0

    def text(upto: int) -> None:
        if upto > at:
            out.parts.append(page[at:upto])
            if any(e.link for e in stack):
                out.linked_parts.append(page[at:upto])

    while True:
        found = _TOKEN.search(page, at)
        if found is None:
            text(len(page))
            break
        text(found.start())
        at = found.end()
        name = (found["name"] or "").lower()
        if not name or not found["end"]:
            continue
        if name in BLOCK_TAGS:
            out.close(stack)
        if found["close"]:
            place = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].name == name), None)
            if place is not None:
                del stack[place:]
            continue
        if name in RAW_TAGS and not (name in EMBEDDED_TAGS and any(e.article for e in stack)):
            if not found["rest"].endswith("/"):
                closing = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = closing.end() if closing else len(page)
            continue
        if name in VOID_TAGS or found["rest"].endswith("/"):
            continue
        if name in CLOSES and stack and stack[-1].name in CLOSES[name]:
            stack.pop()
        if name == "p" and stack and stack[-1].name == "p":
            stack.pop()
        stack.append(_element(name, found["rest"], stack))
    out.close(stack)
    return out.judge()


def block_features(rows: list[list]) -> list[tuple]:
    """The features of each block of a page, in the order of ``FEATURES``."""
    has_article = float(any(r[3] for r in rows))
    edge = [None, 0, 0.0]
    out = []
    for i, (_, words, linked, article, heading, other, frame) in enumerate(rows):
        before, after = (rows[i - 1] if i else edge), (rows[i + 1] if i + 1 < len(rows) else edge)
        out.append((float(words), linked, float(before[1]), before[2], float(after[1]), after[2], float(article), has_article, float(heading), float(other), float(frame)))
    return out


def labelled_table(spark: SparkSession) -> DataFrame:
    """``label`` and the features of every block of the labelled layouts."""
    rows = []
    for page in labelled_pages():
        blocks = page_blocks(page)
        for block in blocks:
            block[1] -= 1  # the label is no word of the text
        rows += [(float(b[0].startswith("+")), *f) for b, f in zip(blocks, block_features(blocks))]
    return spark.createDataFrame(rows, "label double, " + ", ".join(f"{name} double" for name in FEATURES))


Tree = float | tuple


def learned_tree(table: DataFrame, depth: int = 6) -> Tree:
    """Fit Spark's decision tree and return it as nested ``(feature, threshold, low, high)`` with the class at its leaves."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(table)
    model = DecisionTreeClassifier(maxDepth=depth, maxBins=64, minInstancesPerNode=1, seed=1).fit(rows)
    lines = iter([line.strip() for line in model.toDebugString.splitlines()[1:] if line.strip()])

    def node() -> Tree:
        line = next(lines)
        if line.startswith("Predict:"):
            return float(line.split(":")[1])
        feature, threshold = re.match(r"If \(feature (\d+) <= ([-\d.E]+)\)", line).groups()
        low = node()
        next(lines)  # Else
        return int(feature), float(threshold), low, node()

    return node()


def tree_says(tree: Tree, block: Column) -> Column:
    """The tree as a condition on a block."""
    if not isinstance(tree, tuple):
        return F.lit(tree > 0.5)
    feature, threshold, low, high = tree
    return F.when(block[FEATURES[feature]] <= threshold, tree_says(low, block)).otherwise(tree_says(high, block))


def blocks_of(pages: DataFrame, html_col: str = "html", *keep: str) -> DataFrame:
    """``keep`` columns and ``blocks``: an array of text and features for every page."""
    shape = "array<struct<text: string, " + ", ".join(f"{name}: double" for name in FEATURES) + ">>"
    kind = pa.list_(pa.struct([("text", pa.string())] + [(name, pa.float64()) for name in FEATURES]))
    read = pages.select(*keep, F.col(html_col).alias("page_html"))
    out = read.select(*keep, F.lit(None).cast(shape).alias("blocks")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                piece = batch.slice(at, 500)
                lists = []
                for page in piece.column(len(keep)).to_pylist():
                    rows = page_blocks(page)
                    lists.append([{"text": r[0], **dict(zip(FEATURES, f))} for r, f in zip(rows, block_features(rows))])
                yield pa.RecordBatch.from_arrays([*piece.columns[: len(keep)], pa.array(lists, kind)], names=[*keep, "blocks"])

    return read.mapInArrow(run, out)


def main_text(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), tree: Tree | None = None) -> DataFrame:
    """``keep`` columns, ``text`` and ``n_chars`` of every page."""
    tree = tree if tree is not None else learned_tree(labelled_table(pages.sparkSession))
    chosen = F.filter("blocks", lambda b: tree_says(tree, b))
    text = F.array_join(F.transform(chosen, lambda b: b["text"]), " ")
    return blocks_of(pages, html_col, *keep).select(*keep, text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
