"""Main text of web pages by consensus paths of their hosts.

Each page's containers are scored by the text they hold. Pages vote for the generalised path (tags and classes, digits
as one sign) of their best container; Spark counts the votes of each host. Then every page is extracted again from its
host's winning path, or from its own best container where it has nothing at that path. A container that is part of an
article stands for the whole article: the element around all containers at the path is extracted.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probefleet.llm import text as T
from probefleet.llm.workspace import settled

#: The consensus container must score at least this share of the page's best one.
LEAST_SHARE = 0.25
#: Paths of a page that get votes.
VOTES = 3
#: Length of a path; elements further out do not tell containers apart.
PATH_STEPS = 16

_RAW = "script style template noscript iframe textarea title svg math object select button".split()
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<({'|'.join(_RAW)})(?![\w:-])(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][\w:-]*)([^>]*)(?:>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q s samp small span"
    " strike strong sub sup time tt u var wbr".split()
)
_SKIPPED = set("nav header footer aside form head menu dialog".split())
_CONTAINERS = set("article main section div td body center".split())
_OUTERMOST = {"body", "html", "#root"}
#: Elements that an opening tag closes: the same kind, inside the nearest of the stops.
_CLOSES = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
           "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
           "option": ({"option"}, {"select"})}
#: Words that mark, as a whole class, id or role or joined with each other and with a place, what is not the article.
_BOILERPLATE = set(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsors sponsored promo promos promotion banner nav"
    " navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar side-bar widget widgets footer header masthead comment"
    " comments replies respond disqus cookie cookies consent gdpr notice notices newsletter subscribe subscription signup login popup"
    " modal overlay share sharing social related recommended recommendations complementary contentinfo search skip-link skiplink"
    " toolbar taglist tagslist tag-list tags-list".split()
)
_PLACES = set("site page main user users top bottom left right primary secondary global mobile box bar area list links wrapper container section".split())
#: Marks of what is never taken for the article, however much of a page it holds.
_NEVER = re.compile(r"ads?|advert\w*|sponsor\w*|promos?|comments?|replies|respond|disqus|cookies?|consent|gdpr|notices?|newsletter|subscri\w+|popup|modal|overlay", re.I)
_NEVER_TAGS = set("head menu dialog nav".split())
_COMMENTS = re.compile(r"(?<![a-z])(?:comments?|replies|reply)(?![a-z])", re.I)
#: What ends a nav without an end tag: any of the first, or a block after its list.
_AFTER_NAV = set("main article section h1 h2 h3 h4 h5 h6 p table header footer aside form".split())
_KEPT_WITH_MARK = {"body", "html", "main", "article"}


@dataclass
class Node:
    tag: str
    #: Tag and generalised classes.
    step: str
    #: The element around the node that is no inline one, -1 for the root.
    parent: int
    skipped: bool
    first: int
    #: The nearest container around the node, -1 for the root.
    around: int = -1
    last: int = -1
    text: int = 0
    linked: int = 0
    #: Unlinked text that is in no container inside.
    own: float = 0.0
    score: float = 0.0
    #: Of a skipped element: the outermost skipped one around it; of that: the unlinked text inside, whether an article or a
    #: main is inside, and whether it is none whatever it holds.
    root: int = -1
    hidden: int = 0
    holds: bool = False
    never: bool = False
    #: Whether an end tag closed it, and whether a list inside has ended.
    ended: bool = False
    listed: bool = False


@dataclass
class Page:
    """Elements of a page in order, and pieces of text; a node's text is pieces[first:last]."""

    nodes: list[Node] = field(default_factory=list)
    pieces: list[str] = field(default_factory=list)

    def path(self, node: Node) -> str:
        """The generalised path of a node: its innermost PATH_STEPS elements, without inline ones."""
        steps: list[str] = []
        while node.parent >= 0 and len(steps) < PATH_STEPS:
            steps.append(node.step)
            node = self.nodes[node.parent]
        return "".join(f"/{step}" for step in reversed(steps))

    def text(self, node: Node) -> str:
        return " ".join("".join(self.pieces[node.first : node.last]).split())


def _words(values: Iterable[str]) -> list[list[str]]:
    return [re.split(r"[-_]+", name) for value in values for name in value.lower().split()]


def _marked(values: Iterable[str]) -> bool:
    """Whether a class, id or role names a part that is not the article; `has-sidebar` and `market-share` do not."""
    for words in _words(values):
        if "-".join(words) in _BOILERPLATE:
            return True
        if all(w in _BOILERPLATE or w in _PLACES for w in words) and any(w in _BOILERPLATE for w in words):
            return True
    return False


def _step(tag: str, names: dict[str, str]) -> str:
    classes = sorted({re.sub(r"\d+", "#", c) for c in names.get("class", "").lower().split()})
    return ".".join([tag, *classes])


def parse(source: str) -> Page:
    """Elements and text of a page; text of skipped parts leaves no piece. Unclosed and stray tags are tolerated.

    A page that has no article or main outside of its skipped parts may have it in one of them: that part is kept which holds
    an article or main, or most of the page's unlinked text, whatever its name. Adverts, notices and comments never are.
    """
    page = _parse(source, frozenset(), frozenset())
    kept, unclosed = frozenset(), frozenset(i for i, n in enumerate(page.nodes) if n.tag == "nav" and not n.ended)
    if unclosed:
        page = _parse(source, kept, unclosed)
    while more := _wrongly_skipped(page) - kept:
        kept |= more
        page = _parse(source, kept, unclosed)
    return page


def _wrongly_skipped(page: Page) -> frozenset[int]:
    nodes = page.nodes
    if any(n.tag in ("article", "main") and n.last > n.first and page.text(n) for n in nodes if not n.skipped):
        return frozenset()
    roots = [i for i, n in enumerate(nodes) if n.root == i and not n.never]
    all_text = sum(nodes[i].hidden for i in roots) + sum(n.text - n.linked for n in nodes if not n.skipped)
    holding = frozenset(i for i in roots if nodes[i].holds)
    return holding or frozenset(i for i in roots if 2 * nodes[i].hidden > all_text)


def _parse(source: str, kept: frozenset[int], unclosed: frozenset[int]) -> Page:
    """The page with the elements of these numbers not skipped, and these navs ended where their block ends."""
    page = Page()
    nodes, pieces = page.nodes, page.pieces
    root = Node("#root", "", -1, False, 0)
    nodes.append(root)
    stack = [0]
    # Numbers of open tags, so that stray tags in deep pages do not search the whole stack.
    opened: Counter[str] = Counter()

    def close(upto: int) -> None:
        while len(stack) > upto:
            node = nodes[stack.pop()]
            node.last = len(pieces)
            opened[node.tag] -= 1
            if node.tag in ("ul", "ol") and stack:
                nodes[stack[-1]].listed = True

    def add_text(raw: str) -> None:
        node = nodes[stack[-1]]
        if raw and node.skipped and not opened["a"]:
            nodes[node.root].hidden += len(raw) - raw.count(" ") if raw.strip() else 0
        if raw and not node.skipped:
            value = entities.unescape(raw) if "&" in raw else raw
            pieces.append(value)
            size = len(value) - value.count(" ") if value.strip() else 0
            if size:
                node.text += size
                node.linked += size * (opened["a"] > 0)

    at = 0
    for m in _TOKEN.finditer(source):
        add_text(source[at : m.start()])
        at = m.end()
        name = m[3] or m[6]
        if not name:
            if m[1]:
                pieces.append(" ") if m[1].lower() not in _INLINE else None
            continue
        tag, closing, rest = name.lower(), m[2] or m[5], (m[4] or m[7] or "")
        block = tag not in _INLINE
        if block and not nodes[stack[-1]].skipped:
            pieces.append(" ")
        if closing:
            for k in () if not opened[tag] else range(len(stack) - 1, 0, -1):
                if nodes[stack[k]].tag == tag:
                    nodes[stack[k]].ended = True
                    close(k)
                    break
                if tag in _INLINE and nodes[stack[k]].tag not in _INLINE:
                    break  # a stray end of an inline element closes no block
            continue
        if tag in _VOID:
            continue
        if tag in _CLOSES:
            kinds, stops = _CLOSES[tag]
            for k in () if not any(opened[kind] for kind in kinds) else range(len(stack) - 1, 0, -1):
                if nodes[stack[k]].tag in kinds:
                    close(k)
                    break
                if nodes[stack[k]].tag in stops:
                    break
        elif block:
            for k in () if not opened["p"] else range(len(stack) - 1, 0, -1):
                if nodes[stack[k]].tag == "p":
                    close(k)
                    break
                if nodes[stack[k]].tag not in _INLINE:
                    break
        if stack[-1] in unclosed and block and (tag in _AFTER_NAV or nodes[stack[-1]].listed):
            close(len(stack) - 1)
        if tag == "body":
            close(1 + (len(stack) > 1 and nodes[stack[1]].tag == "html"))
        names = {}
        if "=" in rest:
            for x in _NAMES.finditer(rest):
                names.setdefault(x[1].lower(), x[2] or x[3] or x[4] or "")
        inside = nodes[stack[-1]]
        number = len(nodes)
        skipped = inside.skipped or tag in _SKIPPED
        if names and not skipped and tag not in _KEPT_WITH_MARK:
            skipped = _marked(names.values())
        elif names and not skipped and tag == "article":
            skipped = bool(_COMMENTS.search(" ".join(names.values())))
        if number in kept:
            skipped = inside.skipped
        parent = inside.parent if inside.tag in _INLINE else stack[-1]
        above = nodes[parent]
        around = parent if above.tag in _CONTAINERS or above.parent < 0 else above.around
        node = Node(tag, "" if skipped else _step(tag, names), parent, skipped, len(pieces), around)
        nodes.append(node)
        if skipped:
            node.root = inside.root if inside.skipped else number
            comment = any(_NEVER.fullmatch(word) for words in _words(names.values()) for word in words)
            if node.root == number:
                node.never = tag in _NEVER_TAGS or comment
            elif tag == "main" or tag == "article" and not comment:
                nodes[node.root].holds = True
        stack.append(len(nodes) - 1)
        opened[tag] += 1
    add_text(source[at:])
    close(0)
    return page


def score(page: Page) -> list[Node]:
    """Containers with a positive score, best first; the outermost of equal ones first.

    A block's unlinked text counts for its container in full and for each container further out at half the weight
    of the one inside, so the innermost element that holds most of the text wins.
    """
    nodes = page.nodes
    for node in nodes:
        gain = node.text - 2.0 * node.linked
        if node.skipped or not node.text:
            continue
        at = node if node.tag in _CONTAINERS or node.parent < 0 else nodes[node.around]
        weight = 1.0
        at.own += gain
        # Beyond fifty levels the weight is below the precision of the sum.
        while weight > 2**-50:
            at.score += gain * weight
            weight /= 2
            if at.around < 0:
                break
            at = nodes[at.around]
    return sorted((n for n in nodes if n.score > 0), key=lambda n: -n.score)


def whole(page: Page, node: Node) -> Node:
    """What a container is a part of: the article around it, or the container of a table's cell that has text of its own;
    then the innermost container around all that share its path.

    Directly in the body, and for cells of a table, others count only if they hold LEAST_SHARE of its score, and then the
    page from the first to the last of them is taken.
    """
    nodes = page.nodes
    above = node
    while above.tag not in _OUTERMOST and above.tag != "article" and above.around >= 0:
        above = nodes[above.around]
    if above.tag == "article":
        node = above
    elif node.tag == "td":
        above = nodes[node.around]
        while above.tag == "td":
            above = nodes[above.around]
        if above.own > 0 and above.tag not in _OUTERMOST:
            node = above
    if node.tag in _OUTERMOST:
        return node
    path = page.path(node)
    # Paths of limited length are also shared by nested elements.
    apart = (n for n in nodes if n.score > 0 and n.step == node.step and (n.first >= node.last or n.last <= node.first))
    alike = [n for n in apart if page.path(n) == path]
    strong = [node, *(n for n in alike if n.score >= LEAST_SHARE * node.score)]
    alike = strong if node.tag == "td" else [node, *alike]
    if len(alike) == 1:
        return node
    around = node
    first, last = min(n.first for n in alike), max(n.last for n in alike)
    while around.around >= 0 and not (around.first <= first and last <= around.last):
        around = nodes[around.around]
    if around.tag not in _OUTERMOST:
        return around
    return Node("#span", "", -1, False, min(n.first for n in strong), last=max(n.last for n in strong))


def chosen(page: Page, path: str | None) -> Node | None:
    """The whole of the best container at a path if it holds enough, else of the page's best, else the body."""
    ranked = score(page)
    if ranked:
        last = path.rpartition("/")[2] if path else None
        at_path = next((n for n in ranked if n.step == last and page.path(n) == path), None)
        return whole(page, at_path if at_path and at_path.score >= LEAST_SHARE * ranked[0].score else ranked[0])
    return next((n for n in page.nodes if n.tag == "body"), page.nodes[0])


def votes_of(page: Page) -> dict[str, int]:
    """The VOTES best paths of a page, with the shares of their best containers in the sum."""
    best: dict[str, float] = {}
    for n in score(page):
        if len(best) == VOTES:
            break
        if n.parent >= 0:
            best.setdefault(page.path(n), n.score)
    total = sum(best.values())
    return {path: round(1e6 * x / total) for path, x in best.items()}


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[^/?#]*?://([^/?#]*)", 1)), F.lit(""))


def page_votes(pages: DataFrame) -> DataFrame:
    """host, path, vote: a page's best paths, each once, with their shares of the summed scores."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.text_slices(batches, "html"):
            hosts, paths, votes = [], [], []
            for at, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                for path, vote in votes_of(parse(source or "")).items():
                    hosts.append(at), paths.append(path), votes.append(vote)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(votes, pa.int64())],
                ["host", "path", "vote"],
            )

    return pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(rows, "host string, path string, vote long")


def winning_paths(votes: DataFrame) -> DataFrame:
    """host, path: the path with the most votes of each host, the first in order among equals."""
    counted = votes.groupBy("host", "path").agg(F.sum("vote").alias("votes"))
    best = F.max_by("path", F.struct("votes", F.col("_turned"))).alias("path")
    # Among equal votes the smaller path: order by its bytes, each turned round.
    return (
        counted.withColumn("_turned", F.translate(F.hex(F.col("path").cast("binary")), "0123456789ABCDEF", "FEDCBA9876543210"))
        .withColumn("_turned", F.concat("_turned", F.lit("G")))
        .groupBy("host")
        .agg(best)
    )


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points of text) of every page.

    A null or empty html has an empty text; a null url or one without a host votes and wins under an empty host. Equal
    pages of a host get equal texts. Columns other than page_id, url and html are not read. The winning paths are
    written first, so the join with the pages is a broadcast only if their size allows it.
    """
    won = settled(winning_paths(page_votes(pages)), "host-paths")

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.text_slices(batches, "html"):
            found = []
            for path, source in zip(batch.column("path").to_pylist(), batch.column("html").to_pylist(), strict=True):
                page = parse(source or "")
                found.append(page.text(chosen(page, path)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    batch.column("url"),
                    pa.array(found, pa.string()),
                    pa.array([len(x) for x in found], pa.int64()),
                ],
                ["page_id", "url", "text", "n_chars"],
            )

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host(F.col("url")).alias("host"))
    return (
        own.join(won, "host", "left")
        .select("page_id", "url", "html", "path")
        .mapInArrow(rows, "page_id long, url string, text string, n_chars long")
    )
