"""Main text of web pages as the maximum-scoring stretch of words and tags.

A page becomes a sequence of text runs and tags.  Runs score positive per word,
tags negative; both weights are learned from pages that label themselves, by an
``article`` or ``main`` element around their text.  One linear scan finds the
stretch with the largest sum.  What a page marks as no content (menus, headers,
footers, sidebars, notices, adverts, forms, scripts, reader comments, hidden
parts) is known by element, role, class or id; it costs one tag and gives no
text, also inside the stretch.  Classes and ids count on containers only and as
whole known tokens, as slugs of headings use the same words; a container that
opens with a heading inside an article needs a token that names a list or box of
them, or comments.  An aside inside an article is judged like a ``div``.

Learning reads at most ``LABELLED_PAGES`` different labelled pages, chosen by a
hash, and gathers one row per feature (element names of a fixed list).  Extraction
works on each whole page alone, in time linear in its length and whatever the
depth of its elements.

Defined results: NULL and empty pages, and pages without words, have the empty
text; repeated rows are treated alike; without a labelled page every word weighs
the same and every other tag costs the least; an empty table gives an empty table;
columns called ``text`` and ``n_chars`` are replaced, others stay as they are.
Broken mark-up is read as far as it goes: an unfinished tag ends the page.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read

LABELLED_PAGES = 2000
LEAST_TAG = 0.01
LANDMARK = 20.0

# Elements, roles and words of class names and ids.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp "
                    "small span strike strong sub sup time tt u var wbr".split())
_BLOCKS = frozenset("address article blockquote body caption center dd details div dl dt fieldset figcaption figure "
                    "h1 h2 h3 h4 h5 h6 hgroup hr li main ol p pre section summary table tbody td tfoot th thead tr "
                    "ul".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_NO_CONTENT = frozenset("annotation annotation-xml applet aside audio button canvas datalist dialog footer form frameset head input label map "
                        "menu meter nav noscript object optgroup option output progress select svg template "
                        "video".split()) | _RAW
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search "
                   "status tablist toolbar tooltip".split())
_LABELS = frozenset(
    "ad ads adbox adslot adsense advert adverts advertisement advertisements advertising adv aside banner breadcrumb "
    "breadcrumbs byline-social comment comments commentlist consent cookie cookies copyright disclaimer discussion "
    "disqus footer footnav gdpr hidden login masthead menu modal nav navbar navigation navbox newsletter notice "
    "notices notification overlay pager pagination paywall popup promo promoted promotion recommended "
    "recommendations related replies reply respond search share sharebar sharing sidebar signup skip-link social "
    "sponsor sponsored sponsors subscribe subscription tagcloud teaser toolbar topbar widget widgets".split())
_COMMENT = frozenset("comment comments commentlist disqus replies reply respond discussion".split())
_ONLY_COMMENT = frozenset("comment comments commentlist disqus".split())
# Elements that classes and ids may rule, and the words that may stand beside known ones in a token.
_CONTAINERS = frozenset("article aside center details div dl fieldset footer header li ol section table tbody td tr ul".split())
_BOXES = frozenset("articles bar bars box boxes btn button buttons container icons items links list posts slot slots "
                   "stories strip widget widgets wrap wrapper".split())
_BESIDE = _BOXES | frozenset("area block body bottom col column content form global inner inline item left main module "
                             "outer page panel primary rail right row secondary section site sticky top unit".split())
_CLOSED_BY = {
    "p": _BLOCKS - {"body"}, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}),
    "tr": frozenset({"tr", "tbody", "tfoot"}), "td": frozenset({"td", "th", "tr"}),
    "th": frozenset({"td", "th", "tr"}), "option": frozenset({"option", "optgroup"}),
}

# Up to the end of a tag: a quote opens a value only after "=", and only if it is closed.
_TAG = re.compile(r"""[^>=]*+(?:=\s*+(?:"[^"]*"|'[^']*')?+[^>=]*+)*+>""")
_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""(?<![^\s=/"'<>])([^\s=/"'<>]++)\s*+=\s*+("[^"]*"|'[^']*'|[^\s>]+)""")
_FLAG = re.compile(r"\shidden(?=[\s/>]|$)", re.I)
_BEFORE_HEADING = re.compile(r"(?:\s|<!--.*?-->|</?(?:a|div|header|hgroup|span)\b[^<>]*>)*+", re.I | re.S)
_HEADING = re.compile(r"<h[1-6][\s>]", re.I)
_WORDS = re.compile(r"[a-z0-9]+|[A-Z]+(?![a-z])|[A-Z][a-z0-9]*")


@dataclass(slots=True)
class Item:
    """A run of text (``text`` not None) or a tag; ``label`` tells the kind of its place."""

    label: str
    text: str | None = None
    inside: bool = False
    breaks: bool = True


def _tokens(attributes: dict[str, str], names: tuple[str, ...]) -> list[set[str]]:
    """The words of every class name and id."""
    tokens = []
    for name in names:
        for token in attributes.get(name, "").split():
            parts = [w.lower() for w in _WORDS.findall(token)]
            if not {"has", "with", "no", "without"} & set(parts[:1]):
                tokens.append({w for w in parts if not w.isdigit()})
    return tokens


def _named(tokens: list[set[str]], known: frozenset[str]) -> bool:
    """Whether a whole token consists of known words, and words that stand beside them."""
    return any(words & known and not words - known - _LABELS - _BESIDE for words in tokens)


def _no_content(tag: str, attributes: dict[str, str], raw: str, in_article: bool, opens_with_heading: Callable[[], bool]) -> str:
    """'': content; 'soft': no content unless an article begins in it; 'hard': none at all."""
    if tag in _NO_CONTENT and not (tag == "aside" and in_article):
        return "hard"
    style = attributes.get("style", "").replace(" ", "").lower()
    if "display:none" in style or "visibility:hidden" in style or attributes.get("aria-hidden") == "true" or (
            _FLAG.search(raw) and _FLAG.search(_ATTRIBUTE.sub("", raw))):
        return "hard"
    if tag in ("html", "body", "main"):
        return ""
    tokens = _tokens(attributes, ("class",) if tag in ("article", "li") else ("class", "id")) if tag in _CONTAINERS else []
    if tokens and in_article and opens_with_heading():
        tokens = [words for words in tokens if words & (_BOXES | _ONLY_COMMENT)]
    if _named(tokens, _COMMENT) or tag == "article" and _named(_tokens(attributes, ("id",)), _ONLY_COMMENT):
        return "hard"
    if tag == "article":
        return ""
    if attributes.get("role", "").lower() in _ROLES or _named(tokens, _LABELS):
        return "soft"
    return "soft" if tag == "header" or _named(tokens, frozenset({"header"})) else ""


class _Open:
    """The elements open at a place of a page, with what is asked of them counted, so that depth costs nothing."""

    def __init__(self):
        self.stack: list[tuple[str, str]] = []  # element, and what _no_content said
        self.at: dict[str, list[int]] = {}  # depths of each element
        self.blocks: list[str] = []
        self.cleared = 0  # below this depth nothing is skipped any more
        self.skipping = self.besides_header = self.hard = self.landmarks = self.articles = self.headings = 0

    def _count(self, tag: str, skip: str, by: int) -> None:
        self.skipping += by * bool(skip)
        self.besides_header += by * (bool(skip) and tag != "header")
        self.hard += by * (skip == "hard")
        self.landmarks += by * (tag in ("article", "main") and not skip)
        self.articles += by * (tag == "article" and not skip)
        self.headings += by * (tag in _HEADINGS)

    def push(self, tag: str, skip: str) -> None:
        self.at.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, skip))
        if tag in _BLOCKS:
            self.blocks.append(tag)
        self._count(tag, skip, 1)

    def pop(self) -> None:
        tag, skip = self.stack.pop()
        self.at[tag].pop()
        if tag in _BLOCKS:
            self.blocks.pop()
        self._count(tag, "" if len(self.stack) < self.cleared else skip, -1)
        self.cleared = min(self.cleared, len(self.stack))

    def close(self, tag: str) -> None:
        """Close the innermost element of this name and all in it; nothing if there is none."""
        if self.at.get(tag):
            depth = self.at[tag][-1]
            while len(self.stack) > depth:
                self.pop()

    def clear(self) -> None:
        """Nothing that is open now is skipped any more."""
        self.cleared = len(self.stack)
        self.skipping = self.besides_header = self.hard = 0


def parse(page: str) -> list[Item]:
    """The text runs and tags of a page; parts that are no content are one tag each.  Linear in the page."""
    items: list[Item] = []
    open_ = _Open()
    at, n = 0, len(page)
    run = (0, -1, False)  # the last look ahead for a heading: from, up to, and whether there was one

    def heading_follows(place: int) -> bool:
        nonlocal run
        if not run[0] <= place <= run[1]:  # else within what was skipped then, which ends at the same heading
            end = _BEFORE_HEADING.match(page, place).end()
            run = (place, end, _HEADING.match(page, end) is not None)
        return run[2]

    def text(run_: str) -> None:
        kept = not open_.skipping or (open_.landmarks and open_.headings and not open_.besides_header)
        if kept and run_:
            place = open_.blocks[-1] if open_.blocks else "body"
            items.append(Item(f"{place}{' link' if open_.at.get('a') else ''}", entities.unescape(run_), open_.landmarks > 0))

    while at < n:
        to = page.find("<", at)
        if to < 0:
            text(page[at:])
            break
        following = page[to + 1:to + 2]
        if following in ("!", "?"):
            text(page[at:to])
            if page.startswith("<!--", to):
                end = page.find("-->", to + 4)
                at = n if end < 0 else end + 3
            else:
                end = page.find(">", to)
                at = n if end < 0 else end + 1
            continue
        if not (following.isascii() and following.isalpha()) and not (
                following == "/" and page[to + 2:to + 3].isascii() and page[to + 2:to + 3].isalpha()):
            if following == "/":  # not a tag: skipped up to its end
                text(page[at:to])
                end = page.find(">", to)
                at = n if end < 0 else end + 1
            else:
                text(page[at:to + 1])
                at = to + 1
            continue
        text(page[at:to])
        whole = _TAG.match(page, to + 1)
        if whole is None:
            break
        at = whole.end()
        raw = page[to + 1:at - 1]
        tag = _NAME.match(raw)[1].lower()
        breaks = tag not in _INLINE
        if raw[0] == "/":
            was = open_.skipping
            open_.close(tag)
            if not was:
                items.append(Item(tag, breaks=breaks, inside=open_.landmarks > 0))
            continue
        while open_.stack and tag in _CLOSED_BY.get(open_.stack[-1][0], ()):
            open_.pop()
        attributes = {m[1].lower(): m[2].strip("\"'") for m in _ATTRIBUTE.finditer(raw)} if "=" in raw else {}
        skip = _no_content(tag, attributes, raw, open_.articles > 0, lambda place=at: heading_follows(place))
        if tag in ("article", "main") and not skip and open_.skipping and not open_.hard:
            open_.clear()
        if not open_.skipping:
            items.append(Item("none" if skip else tag, breaks=breaks, inside=open_.landmarks > 0))
        if tag in _RAW:
            close = re.compile(f"</{tag}[\\s/>]", re.I).search(page, at)
            at = n if close is None else page.find(">", close.start()) + 1 or n
            continue
        if tag in _VOID or raw.endswith("/") and tag not in _BLOCKS:
            continue
        open_.push(tag, skip)
    return items


def _known(label: str) -> str:
    return label if label.split()[0] in _BLOCKS or label in _INLINE or label == "none" else "other"


def count_features(page: str) -> Counter:
    """(kind, label, inside) of the words and tags of a labelled page; the labelling tags themselves don't count."""
    counts: Counter = Counter()
    for item in parse(page):
        if item.text is None:
            if item.label not in ("article", "main"):
                counts["tag", _known(item.label), item.inside] += 1
        else:
            counts["word", _known(item.label), item.inside] += len(item.text.split())
    return counts


@dataclass
class Weights:
    """Of a word by its place, above 0; of a tag, below 0: the log odds of standing outside, ``LEAST_TAG`` at least.

    Where labelled pages say nothing a word weighs as if counted once inside and
    once outside, a tag the least.  The labelling tags weigh ``LANDMARK``, so that
    only a good deal of text leads beyond them.
    """

    words: dict[str, float]
    tags: dict[str, float]

    @classmethod
    def from_counts(cls, counts: dict[tuple[str, str, bool], int]) -> Weights:
        def odds(kind: str, label: str, inside: bool) -> float:
            return (counts.get((kind, label, inside), 0) + 1) / (counts.get((kind, label, not inside), 0) + 1)

        labels = {(kind, label) for kind, label, _ in counts}
        return cls({label: math.log1p(odds("word", label, True)) for kind, label in labels if kind == "word"},
                   {label: -max(LEAST_TAG, math.log(odds("tag", label, False))) for kind, label in labels if kind == "tag"})

    def of(self, item: Item) -> float:
        label = _known(item.label)
        if item.text is not None:
            return len(item.text.split()) * self.words.get(label, math.log(2))
        return -LANDMARK if item.label in ("article", "main") else self.tags.get(label, -LEAST_TAG)


def best_stretch(scores: list[float]) -> tuple[int, int]:
    """Begin and end of the contiguous stretch with the largest sum, the first and shortest of equal ones."""
    best, found, total, begin = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, i
        total += score
        if total > best:
            best, found = total, (begin, i + 1)
    return found


def main_text(page: str | None, weights: Weights) -> str:
    items = parse(page or "")
    begin, end = best_stretch([weights.of(item) for item in items])
    parts = [(" " if item.breaks else "") if item.text is None else item.text for item in items[begin:end]]
    return " ".join("".join(parts).split())


def learn(pages: DataFrame, page: str = "html", most: int = LABELLED_PAGES) -> Weights:
    """Weights from at most ``most`` different pages with an ``article`` or ``main`` element.

    The pages are chosen by their hashes, which are all that is gathered to
    choose them; each is read where it lies, or once if it is repeated.
    """
    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            total = sum(map(count_features, batch["page"]), Counter())
            yield pd.DataFrame([(*f, n) for f, n in total.items()], columns=["kind", "label", "inside", "n"])

    labelled = pages.select(F.col(page).alias("page")).where(F.col("page").rlike(r"(?i)<(article|main)[\s>]")).withColumn(
        "hash", F.xxhash64("page"))
    last = labelled.select("hash").distinct().orderBy("hash").limit(most).agg(F.max("hash")).first()[0]
    if last is None:
        return Weights.from_counts({})
    sample = labelled.where(F.col("hash") <= last).groupBy("hash").agg(F.any_value("page").alias("page")).select("page")
    counts = sample.mapInPandas(counted, "kind string, label string, inside boolean, n long").groupBy(
        "kind", "label", "inside").agg(F.sum("n").alias("n")).collect()
    return Weights.from_counts({(r.kind, r.label, r.inside): r.n for r in counts})


def extract(pages: DataFrame, weights: Weights, page: str = "html") -> DataFrame:
    """Add ``text`` (the main text) and ``n_chars`` (its code points), replacing columns of these names."""
    @F.pandas_udf("string")
    def text(column: pd.Series) -> pd.Series:
        return column.map(lambda p: main_text(p, weights))

    return pages.withColumn("text", text(F.col(page))).withColumn("n_chars", F.length("text").cast("long"))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return extract(pages.select("page_id", "url", "html"), learn(pages)).select("page_id", "url", "text", "n_chars")


QUERIES = {"op1_html_extraction": op1_html_extraction}
ORACLES: dict[str, str] = {}
