"""Main text of web pages by tag-path ratios.

A page is read as text nodes in order, each with its root-to-leaf tag path. Text length and punctuation are summed for
each path and divided by its number of nodes; both ratios are smoothed over the nodes in page order, fused into one
score, averaged over each path's nodes, and lowered for paths that hold little text in all. Tags, classes, ids and roles
that name something beside the article only lower a path's score further (NAMED), unless they hold the article, as
page-wide forms and wrappers do: a named path is still content where it holds as much text, as dense, as the rest of the
page. Names alone decide (PENALTY) on comments, which are prose as the article is, and where no path holds ENOUGH text
for its ratios to say something.

Paths of at least HIGH of the reference score (the mean by length of text, up to LONG a node) are content; the lowest element around
their nodes (or <article>, or <main> where that holds most of them) is the root. In it nodes of lesser paths stay where they are
supported: by a score of LOW, or by an article or a container whose text is mostly content, as headings, short items and
cells are. Headings right before the root are taken too, with what stands between them and it. Nodes whose score was
lowered only count if they pass HIGH, and never where names alone decide.

Elements are numbered as they open, so what they hold is summed in one pass from last to first, and a page costs
time in proportion to its length however deep its elements are.

Defined results: null or empty html, or none with main text, gives an empty text; open elements end with the page, tags,
comments and declarations that don't end are dropped; repeated rows give the same; other columns don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, table

# HTML's element classes
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
HIDDEN = frozenset("head script style noscript template title iframe object svg math canvas audio video textarea select button datalist map".split())
ASIDE = frozenset("nav footer aside form menu dialog".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
#: Parts of a class or id that name something beside the article.
ASIDE_NAMES = re.compile(
    r"(?:^|[-_\s])(?:ad|ads|adv|advert\w*|adsense|banner|promo\w*|sponsor\w*|cookies?|consent|gdpr|notice|notices|notification\w*|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|"
    r"menu|nav|navbar|navigation|breadcrumbs?|pagination|pager|sidebar|sidebars|aside|widget\w*|related|recommended|share|sharing|social|footer|masthead|topbar|toolbar|skip|"
    r"comments?|commentlist|comment\w*|reader-comments|replies|reply|respond|disqus|login|search|copyright|disclaimer|legal|outbrain|taboola)(?:$|[-_\s])",
    re.IGNORECASE,
)
#: Classes and ids that name such a thing as a whole, whatever its size.
FIRM_NAMES = re.compile(
    r"(?:^|\s)(?:ad|ads|advert\w*|adsense|cookies?|consent|gdpr|newsletter|outbrain|taboola|related|recommended|comments?|commentlist|reader-comments|replies|respond|disqus)"
    r"(?:[-_](?:list|area|section|box|notice|banner|bar|thread|slot|unit|items?|posts?|articles?))*(?:$|\s)",
    re.IGNORECASE,
)
#: Classes and ids of what readers write.
COMMENT_NAMES = re.compile(r"(?:^|[-_\s])(?:comments?|commentlist|comment\w*|reader-comments|replies|reply|respond|disqus)(?:$|[-_\s])", re.IGNORECASE)
FIRM_TAGS = frozenset("nav footer aside header".split())
FIRM_ROLES = frozenset("navigation contentinfo complementary".split())
HEADER_NAMES = re.compile(r"(?:^|[-_\s])(?:header|site-header|page-header|head)(?:$|[-_\s])", re.IGNORECASE)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What holds several blocks; a root is one of these.
HOLDERS = frozenset("html body article main div section center details fieldset form dialog td table".split())
#: An open element of the first kind ends when one of the second begins.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot", "thead"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option", "optgroup"}}
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？؛،]")
#: What an article's parts stand in; a part's own container supports it.
REGIONS = frozenset("#page html body article main section div center form dialog fieldset".split())
#: Neighbours on each side that a node's ratios are smoothed with.
REACH = 2
#: Length and punctuation of a node beyond which more of it says no more.
LONG, MARKED = 200, 5
#: Shares of the reference score from which a path is content, and from which it may be part of it.
HIGH, LOW = 0.3, 0.1
#: What is left of the score of a path beside the article by its names, and of one that names alone decide on.
NAMED, PENALTY = 0.35, 0.03
#: Text of one path from which its ratios say something.
ENOUGH = 400
#: Share of all score from which a flagged element inside an article is the article's own wrapper.
WHOLE = 0.9
#: Share of all text, links too, below which it doesn't: a search box on a page of links.
SOME = 0.1
#: Share of all score from which an element holds the article, whatever it is called.
MOST = 0.5
#: How an element says that it is beside the article: not at all, by a name or form that a wrapper of the page may have too, or plainly.
NO, SOFT, FIRM = 0, 1, 2
_COMMENT_END = re.compile(r"--!?>")


class Node(NamedTuple):
    """A text node: its path's number, innermost element, block, length, whether it is linked, and what its score is lowered to."""

    text: str
    path: int
    element: int
    block: int
    size: int
    linked: bool
    penalty: float = 1.0


class Page(HTMLParser):
    """A page's visible text nodes, and its elements with their parents, tags, paths and flags; element 0 is the page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parent, self.tags, self.path, self.flags, self.hidden, self.linked, self.in_article = [-1], ["#page"], [0], [NO], [False], [False], [False]
        self.comments = [False]
        self.nodes: list[Node] = []
        self.block = 0
        self._open = [0]  # elements
        self._frames: list[tuple[int, dict[str, int]]] = [(0, {})]  # place of each open block, and how many of each other tag stand in it
        self._blocks: dict[str, int] = {}  # open blocks of each tag
        self._paths: dict[tuple[int, str], int] = {}

    def read(self, html: str) -> Page:
        self.feed(html)
        # what is left is text, or a tag that doesn't end
        if self.cdata_elem is None and not re.match(r"<[a-zA-Z/!?]", self.rawdata):
            self.close()
        return self

    # nothing of a comment or declaration, known or not, is text; those that don't end take the rest

    def parse_comment(self, i: int, report: int = 1) -> int:
        for short in ("<!-->", "<!--->"):
            if self.rawdata.startswith(short, i):
                return i + len(short)
        end = _COMMENT_END.search(self.rawdata, i + 4)
        return end.end() if end else len(self.rawdata)

    def parse_html_declaration(self, i: int) -> int:
        return self.rawdata.find(">", i) + 1 or len(self.rawdata)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.handle_data("\n")
            return
        if tag in BLOCKS:
            self.block += 1
            # an open paragraph, or item of the same kind, cannot go on around a new block
            at, _ = self._frames[-1]
            name = self.tags[self._open[at]]
            if name == "p" or tag in CLOSES.get(name, ()):
                self._close(at)
        if tag in VOID:
            return
        given = {k: v or "" for k, v in attrs}
        up = self._open[-1]
        step = f"{tag}.{given['class']}" if given.get("class") else tag
        self.parent.append(up)
        self.tags.append(tag)
        self.path.append(self._paths.setdefault((self.path[up], step), len(self._paths) + 1))
        self.flags.append(self._flag(tag, given, self.in_article[up]))
        self.comments.append(COMMENT_NAMES.search(f"{given.get('class', '')} {given.get('id', '')}") is not None)
        self.hidden.append(self.hidden[up] or tag in HIDDEN or "hidden" in given or given.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", given.get("style", "")) is not None)
        self.linked.append(self.linked[up] or tag == "a")
        self.in_article.append(self.in_article[up] or tag in ("article", "main"))
        if tag in BLOCKS:
            self._frames.append((len(self._open), {}))
            self._blocks[tag] = self._blocks.get(tag, 0) + 1
        else:
            inside = self._frames[-1][1]
            inside[tag] = inside.get(tag, 0) + 1
        self._open.append(len(self.tags) - 1)

    @staticmethod
    def _flag(tag: str, given: dict[str, str], inside: bool) -> int:
        if tag in ("html", "body", "article", "main") or tag in HEADINGS:
            return NO
        names = f"{given.get('class', '')} {given.get('id', '')}".strip()
        role = given.get("role", "").lower()
        if tag in FIRM_TAGS and not (tag == "header" and inside) or role in FIRM_ROLES or names and FIRM_NAMES.search(names):
            return FIRM
        if tag in ASIDE or role in ASIDE_ROLES or names and ASIDE_NAMES.search(names) or names and not inside and HEADER_NAMES.search(names):
            return SOFT
        return NO

    def _close(self, at: int) -> None:
        """End the open elements from this place on."""
        for element in self._open[at:]:
            tag = self.tags[element]
            if tag in BLOCKS:
                self._blocks[tag] -= 1
        while self._frames[-1][0] >= at and len(self._frames) > 1:
            self._frames.pop()
        inside = self._frames[-1][1]
        for element in self._open[at:]:
            tag = self.tags[element]
            if tag in BLOCKS:
                break
            inside[tag] -= 1
        del self._open[at:]

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.block += 1
        # a tag that isn't open, or not within the block, ends nothing
        if not (self._blocks if tag in BLOCKS else self._frames[-1][1]).get(tag):
            return
        at = len(self._open) - 1
        while self.tags[self._open[at]] != tag:
            at -= 1
        self._close(at)

    def handle_data(self, data: str) -> None:
        if len(self._open) == 1:
            if not data.strip():
                return
            self.handle_starttag("body", [])
        element = self._open[-1]
        if not self.hidden[element]:
            self.nodes.append(Node(data, self.path[element], element, self.block, len(data.strip()), self.linked[element]))

    # what elements hold, and what holds for all in them

    def sums(self, nodes: list[Node], values) -> np.ndarray:
        """For each element the sum of its nodes' values, those of the elements in it included."""
        total = np.zeros(len(self.tags))
        np.add.at(total, [n.element for n in nodes], values)
        total = total.tolist()
        for e in range(len(total) - 1, 0, -1):
            total[self.parent[e]] += total[e]
        return np.array(total)

    def within(self, elements: set[int]) -> list[bool]:
        """Which elements are one of these or lie in one."""
        out = [0 in elements]
        for e in range(1, len(self.tags)):
            out.append(out[self.parent[e]] or e in elements)
        return out

    def above(self, kinds: tuple[str, ...], full: np.ndarray) -> set[int]:
        """The elements around those of some kinds that hold text."""
        out: set[int] = set()
        for e in range(len(self.tags) - 1, 0, -1):
            if full[e] and (self.tags[e] in kinds or e in out):
                out.add(self.parent[e])
        return out


def path_ratios(nodes: list[Node]) -> np.ndarray:
    """For each node the ratio of its path: length and punctuation a node, smoothed, fused and averaged, times the path's text
    over itself and LONG more, and, where names put the path beside the article, over all text that they don't."""
    _, at = np.unique([n.path for n in nodes], return_inverse=True)
    count = np.bincount(at)
    length = np.array([0.0 if n.linked else n.size for n in nodes])
    marks = np.array([0.0 if n.linked else len(PUNCTUATION.findall(n.text)) for n in nodes])
    weight = np.exp(-0.5 * (np.arange(-REACH, REACH + 1) / max(1, REACH / 2)) ** 2)
    smooth = lambda x: np.convolve(x, weight)[REACH : REACH + len(nodes)]
    full = smooth(np.ones(len(nodes)))
    ratios = [smooth(np.minimum(np.bincount(at, x) / count, most)[at]) / full for x, most in ((length, LONG), (marks, MARKED))]
    fused = np.sqrt(ratios[0] * (1 + ratios[1]))
    held = np.bincount(at, length)[at]
    named = np.array([n.penalty < 1 for n in nodes])
    rest = max(length[~named].sum(), 1.0)
    held = held / (held + LONG) * np.where(named, np.minimum(held / rest, 1), 1)
    return (np.bincount(at, fused * held) / count)[at]


def path_scores(nodes: list[Node]) -> np.ndarray:
    """For each node the score of its path: its ratio, lowered where names say that it lies beside the article."""
    _, at = np.unique([n.path for n in nodes], return_inverse=True)
    return path_ratios(nodes) * (np.bincount(at, [n.penalty for n in nodes]) / np.bincount(at))[at]


def content(nodes: list[Node], share: float) -> np.ndarray:
    """Which nodes' paths reach a share of the reference score, the mean over unlinked text, as far as it isn't beside the article."""
    score = path_scores(nodes)
    weight = np.array([min(n.size, LONG) * n.penalty * (not n.linked) for n in nodes])
    if not weight.any():
        weight = np.array([n.size * n.penalty for n in nodes])
    return score >= share * (score @ weight) / weight.sum()


def weights(nodes: list[Node]) -> np.ndarray:
    """The length of each node whose path may be content, of all nodes where none does."""
    length = np.array([float(n.size) for n in nodes])
    own = length * content(nodes, LOW) * [not n.linked for n in nodes]
    return own if own.any() else length


def beside(page: Page, solid: list[Node]) -> set[int] | None:
    """The elements that names and tags put beside the article. None that holds <main> is, nor one of a soft flag that
    holds, with its likes of the same path, most of the score. None if all text lies in such."""
    tags, flags = page.tags, page.flags
    size = np.array([float(n.size) for n in solid])
    full = page.sums(solid, size)
    around_main, around_article = page.above(("main",), full), page.above(("article",), full)
    plain = {e for e in range(len(tags)) if flags[e] == FIRM and full[e]} - around_main
    # where nothing else is left, advertisements and comments by name, and all that holds an article, are looked at like wrappers
    for firm in (plain, {e for e in plain - around_article if tags[e] in FIRM_TAGS}):
        gone = page.within(firm)
        rest = [n for n in solid if not gone[n.element]]
        out = set(firm)
        if rest:
            length = np.array([float(n.size) for n in rest])
            weight = weights(rest)
            left, held = page.sums(rest, length), page.sums(rest, weight)
            flagged = [e for e in range(len(tags)) if flags[e] and left[e] and not gone[e]]
            joint: dict[int, np.ndarray] = {}
            for e in flagged:
                joint[page.path[e]] = joint.get(page.path[e], 0.0) + np.array([held[e] / weight.sum(), left[e] / length.sum()])
            in_flagged = page.within(set(flagged))
            # whether an article stands in no flagged element
            free = any(left[e] and tags[e] in ("article", "main") and not page.in_article[page.parent[e]] and not in_flagged[page.parent[e]] for e in range(1, len(tags)))
            around = page.above(("article", "main"), left)
            need = lambda e: WHOLE if page.in_article[e] else MOST if e in around or not free else 2.0
            out |= {e for e in flagged if e not in around_main and (joint[page.path[e]] < (need(e), SOME)).any()}
        inside = page.within(out)
        if not all(inside[n.element] for n in solid):
            return out
    return None


def named(page: Page, solid: list[Node], out: set[int]) -> list[float]:
    """What is left of the scores in each element: of those beside the article NAMED, where their ratios can say otherwise."""
    aside, comments = page.within(out), page.within({e for e in out if page.comments[e]})
    held: dict[int, int] = {}
    for n in solid:
        if not (aside[n.element] or n.linked):
            held[n.path] = held.get(n.path, 0) + n.size
    soft = NAMED if max(held.values(), default=0) >= ENOUGH else PENALTY
    return [PENALTY if c else soft if a else 1.0 for a, c in zip(aside, comments, strict=True)]


def root_of(page: Page, chosen: list[Node]) -> tuple[int, bool]:
    """The lowest element around all chosen nodes that holds several blocks, or the article around it, and whether it is that."""
    held = page.sums(chosen, np.ones(len(chosen)))
    chain = [e for e in range(len(page.tags)) if held[e] == len(chosen)]
    whole = next((e for e in chain if page.tags[e] in ("article", "main")), None)
    if whole is not None:
        return whole, True
    return next((e for e in reversed(chain) if page.tags[e] in HOLDERS), 0), False


def main_nodes(page: Page) -> list[Node]:
    """The nodes of the main text, in page order."""
    tags = page.tags
    solid = [n for n in page.nodes if n.size]
    out = beside(page, solid) if solid else None
    if out is None:
        return []
    left = named(page, solid, out)
    nodes = [n._replace(penalty=left[n.element]) if left[n.element] < 1 else n for n in page.nodes]
    solid = [n for n in nodes if n.size]
    # names alone decide on what has no more than PENALTY left
    strong = content(solid, HIGH) & [not n.linked and n.penalty > PENALTY for n in solid]
    free = np.array([n.penalty == 1 for n in solid])
    if not (strong & free).any():
        strong = free
    mains = page.within({e for e in range(len(tags)) if tags[e] == "main"})
    sizes = np.array([n.size for n in solid]) * strong
    in_main = np.array([mains[n.element] for n in solid])
    if sizes @ in_main >= MOST * sizes.sum():
        strong &= in_main
    chosen = [n for n, ok in zip(solid, strong, strict=True) if ok]
    root, whole = root_of(page, chosen)
    in_root = page.within({root})

    # what supports a lesser path: its own score, its article, or a container that is mostly content
    own = [n.size * (n.penalty == 1 and not n.linked) for n in solid]
    share = page.sums(chosen, [n.size for n in chosen]) >= MOST * page.sums(solid, own)
    owner, article = [0], [-1]
    for e in range(1, len(tags)):
        owner.append(e if tags[e] in REGIONS else owner[page.parent[e]])
        article.append(e if tags[e] in ("article", "main") and share[e] else article[page.parent[e]])
    fair = dict(zip((id(n) for n in solid), content(solid, LOW), strict=True))
    picked = {id(n) for n in chosen}
    stays = [in_root[n.element] and (id(n) in picked or n.penalty == 1 and bool(fair.get(id(n)) or share[owner[n.element]] or article[n.element] >= 0)) for n in nodes]
    first = next(k for k, n in enumerate(nodes) if id(n) in picked)
    heads = page.within({e for e in range(len(tags)) if tags[e] in HEADINGS})
    if not any(ok and heads[n.element] for n, ok in zip(nodes, stays, strict=True)):
        # the last heading before the root, others right before it, and what stands beside the root after them
        near = page.within({page.parent[root]}) if root else in_root
        before = next((k for k in range(first - 1, -1, -1) if nodes[k].size and heads[nodes[k].element] and nodes[k].penalty == 1), -1)
        between = [k for k in range(before + 1, first) if nodes[k].size and not in_root[nodes[k].element] and nodes[k].penalty == 1 and not nodes[k].linked]
        if before >= 0 and (near[nodes[before].element] or not between):
            for k in between:
                stays[k] = near[nodes[k].element]
            while before >= 0 and (not nodes[before].size or heads[nodes[before].element]):
                stays[before] = nodes[before].penalty == 1
                before -= 1
    if not whole:
        # lists of links around the article
        kept = [n for n, ok in zip(nodes, stays, strict=True) if ok]
        both = page.sums(kept, [n.size for n in kept])
        links = page.sums(kept, [n.size * n.linked for n in kept])
        chain = set()
        up = root
        while up >= 0:
            chain.add(up)
            up = page.parent[up]
        lists = page.within({e for e in range(len(tags)) if tags[e] in ("ul", "ol", "table", "div", "section") and e not in chain and both[e] and links[e] > 0.8 * both[e]})
        stays = [ok and (page.in_article[n.element] or not lists[n.element]) for n, ok in zip(nodes, stays, strict=True)]
    return [n for n, ok in zip(nodes, stays, strict=True) if ok]


def main_text(html: str) -> str:
    if not html:
        return ""
    blocks: dict[int, list[str]] = {}
    for n in main_nodes(Page().read(html)):
        blocks.setdefault(n.block, []).append(n.text)
    return " ".join(t for t in (" ".join("".join(parts).split()) for parts in blocks.values()) if t)


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), text_col: str = "text") -> DataFrame:
    """The columns `keep` and each page's main text, which takes another name where that clashes."""
    kept = pages.select(*keep)
    raw, text = fresh(kept, "_html"), fresh(kept, text_col)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch.drop(columns=raw)
            out[text] = [main_text(h) if h else "" for h in batch[raw]]
            yield out

    rows = pages.select(*keep, F.col(html_col).alias(raw))
    return rows.mapInPandas(work, kept.withColumn(text, F.lit("")).schema)


def op10_html_text(spark, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
