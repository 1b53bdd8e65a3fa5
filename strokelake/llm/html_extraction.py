"""Main text of web pages by the maximum-scoring subsequence.

A page becomes a row of tokens: words and tags. A word scores by the features of its place (kind, length and link share of
its block, links, lists, headings, elements and names that mostly hold menus, adverts, comments and the like), a tag scores
below zero by its kind, and one linear scan finds the contiguous run of tokens with the largest sum. The run is widened to
whole blocks and no further. Inside it, elements whose names mark them and whose own words sum to less than zero are left
out: an advert between two paragraphs, a form, a list of related pages.

Weights are logistic regressions of lying inside the labelled region, one for words and one for tags, fitted to a bounded
sample: at most `FIT_PAGES` pages, those with the least hash of page_id, that mark their content with an article or main
element. They are shrunk towards the prior weights below, which stand where no page is labelled, and which decide a page
on which no word scores above zero. Whether a word lies in an article or main element is the label, so it is not fitted; it
adds the prior's weight. In such an element what is left out weighs nothing, so it does not part the text around it.

Names that layout wrappers carry as well (sidebar, header, social and so on) are not heeded on an element that holds most
of the page's words, an article or main element, or a first heading that is not a link.

Defined cases: null or empty html gives an empty text; pages without tags are one block; unclosed and stray tags are
closed by what follows; time grows with a page's length, however deep its elements are; an empty table gives an empty
result; repeated rows are extracted one by one; other input columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIT_PAGES = 2000

# Element names of HTML by role.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav",
    "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul",
}
SILENT = {"canvas", "datalist", "head", "noscript", "object", "script", "style", "svg", "template", "title"}
ROLE = {
    "aside": "aside", "button": "form", "dialog": "notice", "footer": "footer", "form": "form", "iframe": "notice", "input": "form", "menu": "nav", "nav": "nav",
    "noembed": "notice", "noframes": "notice", "option": "form", "select": "form", "textarea": "form", "xmp": "notice",
}
KIND = {"p": "p", "li": "list", "dd": "list", "dt": "list", "td": "table", "th": "table", "caption": "table", "pre": "p", "blockquote": "p"} | {f"h{i}": "head" for i in range(1, 7)}
CLOSES_P = BLOCK - {"caption", "dd", "dt", "legend", "li", "summary", "tbody", "td", "tfoot", "th", "thead", "title", "tr"}
P_FENCE = {"button", "td", "th", "li", "div", "section", "article", "main", "aside"}
ITEMS, ITEM_FENCE = {"li", "option", "tr", "td", "th", "dd", "dt"}, {"ul", "ol", "table", "dl", "select", "menu", "nav"}
# Words of class, id and role that mark what is not content: surely, and those that layout wrappers carry as well.
STRONG = re.compile(
    r"advert|comment-?(?:list|section|body|form)|cookie|newsletter|(?:^|[\s_-])(?:ads?|captcha|comments?|commentlist|consent|disqus\w*|feedback|login|modal|notices?|overlay|popup|promo\w*|"
    r"recommend\w*|related|repl(?:y|ies)|responses|signup|sponsor\w*|subscri\w*|teasers?|trending|widgets?)(?:$|[\s_-]|\d)", re.IGNORECASE)
WEAK = re.compile(
    r"sidebar|(?:^|[\s_-])(?:banners?|breadcrumbs?|byline-social|footer|header|masthead|menus?|nav|navbar|navigation|pager|pagination|search|share|sharing|skip|social|"
    r"toolbar|topbar)(?:$|[\s_-]|\d)", re.IGNORECASE)
ROLES = {"alert", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation", "search"}
UNMARKED = {"article", "body", "html", "main"}
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attributes2>[^>]*)>", re.DOTALL)
# Once a quote is never closed, quotes do not count for the rest of the page; so no tag is looked at to the page's end twice.
UNQUOTED = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(?P<end>)(?P<tag>)(?P<attributes>)(?!)|<(?P<end2>/?)(?P<tag2>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attributes2>[^>]*)>", re.DOTALL)
CLOSED = re.compile(r"(?:^|[\s\"'])/\s*\Z")  # a slash of its own, not the end of an unquoted value
ATTRIBUTE = re.compile(r"(?:^|[\s\"'])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?(?=[\s/\"']|$)", re.IGNORECASE)

# Prior weights of features, and how strongly the fitted ones are drawn to them.
PRIOR = {
    "word": 0.3, "p": 0.7, "head": 1.2, "list": 0.2, "table": 0.2, "plain": 0.2, "under 5": -0.3, "under 15": 0.0, "under 40": 0.3, "40 or more": 0.6, "link": -0.8, "mostly links": -0.8,
    "nav": -2.5, "aside": -2.5, "footer": -2.5, "form": -2.5, "notice": -2.5, "header": -2.5, "hidden": -3.0, "strong": -2.5, "weak": -2.5, "content": 1.0,
    "tag": -0.2, "inline tag": 0.0, "block tag": -0.2, "item tag": 0.0, "box tag": -0.4, "marked tag": -0.5,
}
PRIOR_TOKENS = 30.0
MARKS = ("nav", "aside", "footer", "form", "notice", "header", "hidden", "strong", "weak")
MOST, MOST_TAG, LEAST_TAG = 2.0, 1.0, 0.05  # a word scores between -MOST and MOST, a tag between -MOST_TAG and -LEAST_TAG


def marks(tag: str, attributes: str) -> tuple[str | None, bool]:
    """What an element's name and attributes say: a role or "strong" or "hidden" if it is surely no content, and whether it has a weak mark."""
    role, weak = ROLE.get(tag), tag == "header"
    if not attributes or tag in UNMARKED:
        return role, weak
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return "hidden", weak
        if name == "role" and value.lower() in ROLES:
            role = role or "strong"
        elif name in ("class", "id"):
            if STRONG.search(value):
                role = role or "strong"
            weak = weak or bool(WEAK.search(value))
    return role, weak


class Element:
    __slots__ = ("content", "h1", "head", "holds", "kind", "link", "link_words", "marked", "parent", "role", "tag", "weak", "words")

    def __init__(self, tag: str, parent: Element | None, role: str | None, weak: bool) -> None:
        self.tag, self.parent, self.role, self.weak = tag, parent, role, weak
        self.kind = KIND.get(tag) or (parent.kind if parent and tag not in BLOCK else "plain")
        self.link = tag == "a" or bool(parent and parent.link)
        self.content = tag in ("article", "main") or bool(parent and parent.content)
        self.words = self.link_words = 0  # of the element and what it holds, once it is closed
        self.h1: Element | None = self if tag == "h1" else parent.h1 if parent and tag not in BLOCK else None
        self.holds = tag in ("article", "main")  # whether it holds a content element, or
        self.head = False  # a first heading that is no link
        self.marked: Element | None = None  # the outermost marked element around it, itself included


class Page:
    """Tokens in order: texts with their numbers of words or tags, the number of their block and the element they lie in."""

    def __init__(self, page: str) -> None:
        self.texts: list[str | None] = []
        self.counts: list[int] = []
        self.tags: list[str | None] = []
        self.blocks: list[int] = []
        self.at: list[Element] = []
        self.elements: list[Element] = []
        self.labelled = False
        root = Element("", None, None, False)
        self.elements.append(root)
        # Of each open element: the open p and list items that a new one closes, as places in the stack.
        stack: list[tuple[Element, int, dict[str, int]]] = [(root, -1, {})]
        open_tags: Counter = Counter()
        block, at, end, silent = 0, 0, len(page), 0

        def pop(to: int) -> None:
            nonlocal silent
            while len(stack) > to:
                own = stack.pop()[0]
                open_tags[own.tag] -= 1
                silent -= own.tag in SILENT
                above = own.parent
                above.words += own.words
                above.link_words += own.link_words
                above.holds |= own.holds
                above.head |= own.head

        last, pattern, unclosed = page.rfind(">") + 1, TOKEN, set()  # after the last >, only a comment can begin
        while at < end:
            found = pattern.search(page, at, last) if at < last else None
            start = found.start() if found else end
            if not found or found[0].startswith("<!--") and not found[0].endswith("-->"):
                if (comment := page.find("<!--", at)) >= 0:
                    start, found = comment, None
            if start > at and not silent:
                self.add(entities.unescape(page[at:start]), None, block, stack[-1][0])
            if not found:
                break
            at = found.end()
            if found["tag2"]:
                pattern = UNQUOTED
            tag = (found["tag"] or found["tag2"] or "").lower()
            if not tag:
                continue
            closing, attributes = found["end"] or found["end2"], found["attributes"] or found["attributes2"] or ""
            if not closing and tag in RAW and not CLOSED.search(attributes):
                close = None if tag in unclosed else re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE).search(page, at, last)
                if not close:
                    unclosed.add(tag)
                at = close.end() if close else (end if tag in ("script", "style") else at)
                block += tag in BLOCK
                continue
            if closing:
                if tag in VOID:
                    continue
                if open_tags[tag]:
                    to = len(stack) - 1
                    while stack[to][0].tag != tag:
                        to -= 1
                    pop(to)
            else:
                if open_tags["head"] and tag in BLOCK and tag not in ("head", "title"):
                    pop(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0].tag == "head"))
                if tag in CLOSES_P and stack[-1][1] > 0:
                    pop(stack[-1][1])
                if tag in ITEMS and (to := stack[-1][2].get(tag, 0)):
                    pop(to)
                above, p, items = stack[-1]
                role, weak = marks(tag, attributes)
                own = Element(tag, above, role, weak and not above.content)
                self.labelled |= tag in ("article", "main") and role is None
                self.elements.append(own)
                if tag not in VOID and not CLOSED.search(attributes):
                    place = len(stack)
                    p = place if tag == "p" else -1 if tag in P_FENCE else p
                    items = {} if tag in ITEM_FENCE else items | {tag: place} if tag in ITEMS else items
                    stack.append((own, p, items))
                    open_tags[tag] += 1
                    silent += tag in SILENT
            if tag in BLOCK:
                block += 1
            if not silent:
                kind = "inline" if tag not in BLOCK else "item" if tag in KIND else "block" if tag in ("body", "center", "html", "hr") else "box"
                self.add(" " if tag == "br" else None, f"{kind} tag", block, stack[-1][0])
        pop(1)
        self.judge()

    def add(self, text: str | None, tag: str | None, block: int, at: Element) -> None:
        n = len(text.split()) if text and not tag else 0
        at.words += n
        if at.link:
            at.link_words += n
        if n and at.h1 and not at.link:
            at.h1.head = True
        self.texts.append(text)
        self.counts.append(n)
        self.tags.append(tag)
        self.blocks.append(block)
        self.at.append(at)

    def judge(self) -> None:
        """Which elements are marked, now that it is known what each holds."""
        all_words = self.elements[0].words
        for own in self.elements:  # parents first
            above = own.parent.marked if own.parent else None
            if own.weak and (own.holds or own.head and 2 * own.link_words <= own.words or 2 * own.words > all_words):
                own.weak = False
            own.marked = above or (own if own.role or own.weak else None)

    def features(self) -> Iterator[tuple[str, ...]]:
        """Of each token."""
        size: Counter = Counter()
        linked: Counter = Counter()
        for block, n, own in zip(self.blocks, self.counts, self.at, strict=True):
            size[block] += n
            linked[block] += n * own.link
        for tag, block, own in zip(self.tags, self.blocks, self.at, strict=True):
            mark = own.marked
            if tag:
                yield ("tag", tag, "marked tag") if mark else ("tag", tag)
                continue
            n = size[block]
            named = "under 5" if n < 5 else "under 15" if n < 15 else "under 40" if n < 40 else "40 or more"
            found = ["word", own.kind, named]
            if own.link:
                found.append("link")
            if 2 * linked[block] > n:
                found.append("mostly links")
            if mark:
                found.append(mark.role or ("header" if mark.tag == "header" else "weak"))
            yield tuple(found)

    def labels(self) -> Counter:
        """Tokens by features and whether they lie inside the labelled region."""
        out: Counter = Counter()
        for found, own, n in zip(self.features(), self.at, self.counts, strict=True):
            out[found, own.content and not own.marked] += n if found[0] == "word" else 1
        return out

    def scores(self, weights: dict[str, float]) -> list[float]:
        known: dict[tuple, float] = {}
        out = []
        for found, own, n in zip(self.features(), self.at, self.counts, strict=True):
            key = (found, own.content)
            if (score := known.get(key)) is None:
                total = sum(weights[f] for f in found if f not in MARKS) + (weights["content"] if own.content and found[0] == "word" else 0)
                mark = sum(weights[f] for f in found if f in MARKS)
                score = max(-MOST, min(MOST, total) + mark) if found[0] == "word" else min(-LEAST_TAG, max(-MOST_TAG, total))
                known[key] = score
            out.append(score * n if found[0] == "word" else score)
        return out

    def main_text(self, weights: dict[str, float]) -> tuple[float, str]:
        """Kadane's scan over the tokens, widened to whole blocks: its sum, and the blocks joined by one space."""
        scores = self.scores(weights)
        best, best_from, best_to, total, start = 0.0, 0, -1, 0.0, 0
        for i, (gain, own) in enumerate(zip(scores, self.at, strict=True)):
            if own.marked and own.content and gain < 0:
                continue
            if total <= 0:
                total, start = 0.0, i
            total += gain
            if total > best:
                best, best_from, best_to = total, start, i
        if best_to < 0:
            return 0.0, ""
        while best_from > 0 and self.blocks[best_from - 1] == self.blocks[best_from]:
            best_from -= 1
        while best_to + 1 < len(self.tags) and self.blocks[best_to + 1] == self.blocks[best_to]:
            best_to += 1
        sums: Counter = Counter()  # of each marked element's words
        for gain, own, n in zip(scores, self.at, self.counts, strict=True):
            if own.marked and n:
                sums[id(own.marked)] += gain
        blocks: dict[int, list[str]] = {}
        for i in range(best_from, best_to + 1):
            mark = self.at[i].marked
            if self.texts[i] and not (mark and sums[id(mark)] <= 0):
                blocks.setdefault(self.blocks[i], []).append(self.texts[i])
        whole = (" ".join("".join(b).split()) for b in blocks.values())
        return best, " ".join(b for b in whole if b)


def main_text(page: str, weights: dict[str, float]) -> str:
    """The page's main text; where no word scores above zero, by the prior weights."""
    parsed = Page(page)
    best, text = parsed.main_text(weights)
    return text if best > 0 else parsed.main_text(PRIOR)[1]


def logistic(found: dict[tuple[tuple[str, ...], bool], int], rounds: int = 60) -> dict[str, float]:
    """Weights from token counts by (features, inside), drawn to the prior: Newton's method on the grouped counts."""
    names = sorted({f for combination, _ in found for f in combination})
    combinations = sorted({c for c, _ in found})
    x = np.array([[float(f in c) for f in names] for c in combinations])
    a, b = (np.array([found.get((c, side), 0) for c in combinations], float) for side in (True, False))
    # each combination counts by its share of tokens, so that long pages do not outweigh the prior without end
    scale = 1e4 / max(1.0, (a + b).sum())
    a, b = a * scale, b * scale
    w = prior = np.array([PRIOR[f] for f in names])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (a - (a + b) * p) - PRIOR_TOKENS * (w - prior)
        curve = (x * ((a + b) * p * (1 - p))[:, None]).T @ x + PRIOR_TOKENS * np.eye(len(names))
        step = np.linalg.solve(curve, slope)
        w = w + step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return dict(zip(names, w.tolist(), strict=True))


def fit(pages: DataFrame, limit: int = FIT_PAGES) -> dict[str, float]:
    """Weights of all features: those of the labelled sample, and the prior's for features that it does not have."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                page = Page(text or "")
                if page.labelled:
                    total.update(page.labels())
        rows = [("|".join(f), inside, n) for (f, inside), n in total.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.int64())],
                                         names=["features", "inside", "n"])

    pages = pages.select("page_id", F.col("html").cast("string").alias("html"))
    chosen = pages.where("html IS NOT NULL").select(F.col("page_id").alias("chosen")).orderBy(F.xxhash64("chosen"), "chosen").limit(limit).distinct()
    sample = pages.join(F.broadcast(chosen), F.col("page_id").eqNullSafe(F.col("chosen")), "left_semi").select("html")
    counted = sample.mapInArrow(count, "features string, inside boolean, n bigint").groupBy("features", "inside").agg(F.sum("n").alias("n"))
    found = {(tuple(r.features.split("|")), r.inside): r.n for r in counted.collect()}  # a row for each combination of features
    weights = dict(PRIOR)
    for side in ("word", "tag"):
        if own := {k: n for k, n in found.items() if k[0][0] == side}:
            weights |= logistic(own)
    return weights


def extract(pages: DataFrame, limit: int = FIT_PAGES) -> DataFrame:
    """Rows (page_id, url, text), one per input row."""
    weights = fit(pages, limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(t.as_py() or "", weights) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    return pages.select("page_id", "url", F.col("html").cast("string")).mapInArrow(run, f"{kinds}, text string")
