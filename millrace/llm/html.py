"""Main text of web pages by equivalence-class template deduction.

Pages of one host are taken in groups of bounded size. Within a group every token (a tag or
the text of a block, told apart by its path of enclosing elements) has an occurrence vector: how
often it is on each page; equal pages count once. Tokens with the same vector form an equivalence
class. A class is valid if its tokens keep one order on all pages and their spans nest; valid
classes that occur once on a page are nested into the group's template. What lies between
template tokens are slots. The slots inside the template's main element hold the article. Menus,
adverts, notices, comments and the like are left out by fixed lists of elements and names, and
outside article and main elements also the blocks that the template holds on nearly all pages.
A page of which the template holds nearly all the text is a near copy and keeps its blocks.

Defined results: a null or empty page gives an empty text; elements nested deeper than ``DEEPEST``
count as part of the one at that depth; a page alone in its group is read
with its own elements as template; a null url counts as one host; repeated rows are read each
by itself; text repeated inside the article stays; extra columns are ignored.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

GROUP_PAGES = 48
# The list of hosts with several groups is copied to every task up to this length, else it is joined.
LISTED_HOSTS = 500_000

_NAME = r"<(/?)([a-zA-Z][^\s/>]*)"
_TAG = re.compile(_NAME + r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_LOOSE_TAG = re.compile(_NAME + r"([^>]*+)>")  # once a quote is left open, quotes mean nothing any more
_ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
# Elements of HTML by their kind.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "canvas"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
SPACES = {"br", "wbr", "img"}
OUTSIDE = {"nav", "footer", "aside", "form", "button", "select", "dialog", "head", "menu", "label", "option", "input"}
MAIN = ("article", "main")
# Words in class, id or role that mark what is not the article.
MARKED = set(
    "ad ads advert advertisement adverts advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice"
    " notices alert alerts newsletter subscribe subscription signup sidebar aside menu nav navbar navigation breadcrumb breadcrumbs"
    " footer comment comments commentlist disqus replies reply related recommended share sharing social toolbar pagination"
    " pager login popup modal overlay search widget complementary contentinfo skip".split()
)
# Words beside a marked one that leave a name's meaning as it is (``sidebar-left``, not ``has-sidebar``).
NEUTRAL = set(
    "top bottom left right main page site global primary secondary inner outer box block bar slot unit area zone wrap wrapper container"
    " holder panel section list item items link links button buttons icon icons module region header head form field input js post posts"
    " article articles entry media group row col the my".split()
)
# Elements nested deeper count as part of the one at this depth; long class names are cut in a path.
DEEPEST, LONGEST_CLASS = 200, 100
# Rounds in which elements are found to be wrappers; all that lie in each other are found in one.
ROUNDS = 4
# A marked element with this share of a page's text is no mark but the page's wrapper.
WRAPPER_SHARE = 0.75
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")


class Node:
    __slots__ = ("name", "path", "out", "link", "mark", "place", "inside", "block", "size")

    def __init__(self, name: str, path: str, out: bool, link: bool, mark: int | None = None) -> None:
        self.name, self.path, self.out, self.link = name, path, out, link
        self.mark = mark  # place of the outermost marked element, if only its mark makes this one outside
        self.place = None  # own place, if marked
        self.inside = False  # in an article or main element, itself included
        self.block = 0  # depth of the nearest block, itself included
        self.size = 0  # length of the counted text


def _is_marked(attributes: str) -> tuple[bool, str]:
    """Whether class, id or role mark the element as outside; and its class as part of the path."""
    marked, shown = False, ""
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = "".join(values)
        if name.lower() == "class":
            shown = "." + ".".join(value.split()[:2])[:LONGEST_CLASS]
        for token in value.split():
            words = {w.lower() for w in _WORD.findall(token)}
            marked |= bool(words & MARKED) and words <= MARKED | NEUTRAL
    return marked, shown


def read(page: str) -> list[tuple[str, str, bool, bool, str]]:
    """Tokens of a page in order: (kind, path, outside, in a link, text). Kinds are ``text`` and,
    for the start and end of blocks, ``tag`` and ``end``. Missing end tags are put right. Class,
    id or role do not mark an element that holds most of the page's text outside links."""
    spared: set[int] = set()
    for _ in range(ROUNDS):
        out, total, marks = _read(page, spared)
        wrappers = {k for k, n in marks.items() if n >= WRAPPER_SHARE * total}
        if not wrappers:
            return out
        spared |= wrappers
    return _read(page, spared)[0]


def _read(page: str, spared: set[int]) -> tuple[list[tuple[str, str, bool, bool, str]], int, dict[int, int]]:
    """Tokens; length of the text that is not in links or left out by its element; of this, the
    length in each marked element, by its place. Elements at ``spared`` are not marked.

    Runs once over the page, whatever is left open in it: a ``<`` behind the last ``>`` is text,
    comments and raw elements without an end go to the end of the page, after a quote without an
    end the next ``>`` ends a tag, and an end tag without a start is passed over."""
    out: list[tuple[str, str, bool, bool, str]] = []
    total, marks = 0, {}
    stack, open_ = [Node("", "", False, False)], Counter()
    at, size, last, loose = 0, len(page), page.rfind(">"), False

    def close(k: int) -> None:
        while len(stack) > k:
            node = stack.pop()
            open_[node.name] -= 1
            stack[-1].size += node.size
            if node.place is not None:
                marks[node.place] = node.size

    while at < size:
        m = None
        if page[at] == "<":
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                at = size if end < 0 else end + 3
                continue
            if at < last:
                if page[at + 1] in "!?":
                    at = page.find(">", at) + 1
                    continue
                m = (_LOOSE_TAG if loose else _TAG).match(page, at)
                if m is None and (page[at + 1].isascii() and page[at + 1].isalpha() or page[at + 1] == "/"):
                    m = _LOOSE_TAG.match(page, at)
                    loose = loose or m is not None
        if m is None:
            end = at + 1 if page[at] == "<" else page.find("<", at)
            text = page[at : size if end < 0 else end]
            at += len(text)
            top = stack[-1]
            out.append(("text", top.path, top.out, top.link, text))
            if not top.link and (top.mark is not None or not top.out) and not text.isspace():
                total += len(text)
                top.size += len(text)
            continue
        at = m.end()
        name = m.group(2).lower()
        if m.group(1):  # end tag
            if open_[name]:
                k = len(stack) - 1
                while stack[k].name != name:
                    k -= 1
                close(k)
            if name in BLOCKS:
                top = stack[-1]
                out.append(("end", top.path + "/" + name, top.out, top.link, ""))
            continue
        if name in RAW:
            if not m.group(3).endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\s*>|\Z", re.I).search(page, at)
                at = end.end()
            continue
        if name in SPACES:
            top = stack[-1]
            out.append(("text", top.path, top.out, top.link, " "))
        if name in VOID:
            if name == "hr":
                out.append(("tag", stack[-1].path + "/hr", stack[-1].out, stack[-1].link, ""))
            continue
        if name in BLOCKS:  # an open paragraph ends where another block starts
            k = stack[-1].block
            if k and (stack[k].name == "p" or (name == "li" and stack[k].name == "li") or (name in ("td", "th", "tr") and stack[k].name in ("td", "th"))):
                close(k)
        marked, shown = _is_marked(m.group(3))
        inside = stack[-1].inside
        if name in MAIN and not inside:  # an advert that was left open ends here
            while len(stack) > 1 and stack[-1].out and stack[-1].name not in OUTSIDE:
                close(len(stack) - 1)
        top = stack[-1]
        marked = marked and m.start() not in spared and name not in ("html", "body", "a", "b", "i", "em", "strong", *MAIN)
        fixed = name in OUTSIDE or (name == "header" and not inside)
        mark = None if fixed or (top.out and top.mark is None) else top.mark if top.out else m.start() if marked else None
        path = f"{top.path}/{name}{shown}" if len(stack) <= DEEPEST else top.path
        node = Node(name, path, top.out or fixed or marked, top.link or name == "a", mark)
        node.place = m.start() if marked and not fixed else None
        node.inside, node.block = top.inside or name in MAIN, len(stack) if name in BLOCKS else top.block
        stack.append(node)
        open_[name] += 1
        if name in BLOCKS:
            out.append(("tag", node.path, node.out, node.link, ""))
    close(1)
    return out, total, marks


def units(tokens):
    """(path, mark, wholly in links) of block tags and the blocks of text between them, without
    text outside. Marks are "" for a start, "/" for an end and "=" with the words for a block."""
    held, path, linked = [], None, True
    for kind, where, outside, link, text in [*tokens, ("close", "", False, False, "")]:
        if kind == "text":
            if not outside:
                held.append(references.unescape(text))  # a reference ends with its token
                if not text.isspace():
                    path, linked = where if path is None else path, linked and link
            continue
        if words := "".join(held).split():
            yield path or "", "=" + " ".join(words), linked
        held, path, linked = [], None, True
        if kind != "close":
            yield where, "" if kind == "tag" else "/", False


def template(pages: list[list[tuple[str, str, bool, bool, str]]]) -> list[tuple[str, str]]:
    """Tokens of the nested valid equivalence classes, in page order.

    Only tokens that occur at most once on a page and on most pages (blocks of text on four of
    five) can frame slots; they are grouped by their occurrence vector, tags and blocks apart, and
    a class is kept when its order is the same on all its pages and its span nests with the
    classes kept before (the most frequent first, tags before blocks)."""
    places: list[dict[tuple[str, str], int]] = []
    vectors: dict[tuple[str, str], list[int]] = defaultdict(lambda: [0] * len(pages))
    for k, tokens in enumerate(pages):
        first: dict[tuple[str, str], int] = {}
        for n, (path, mark, _) in enumerate(units(tokens)):
            vectors[path, mark][k] += 1
            first.setdefault((path, mark), n)
        places.append(first)
    classes: dict[tuple[tuple[int, ...], bool], list[tuple[str, str]]] = defaultdict(list)
    for token, vector in vectors.items():
        block = token[1].startswith("=")
        if max(vector) == 1 and sum(vector) >= max(2, 0.8 * len(pages) if block else len(pages) // 2):
            classes[tuple(vector), block].append(token)
    kept: list[tuple[str, str]] = []
    for (vector, _), tokens in sorted(classes.items(), key=lambda x: (-sum(x[0][0]), x[0])):
        on = [k for k, v in enumerate(vector) if v]
        order = sorted(tokens, key=lambda t: places[on[0]][t])
        if all(places[k][a] < places[k][b] for k in on for a, b in zip(order, order[1:])):
            merged = kept + order
            known = [t for t in merged if all(t in places[k] for k in on)]
            line = sorted(known, key=lambda t: places[on[0]][t])
            if all(places[k][a] < places[k][b] for k in on for a, b in zip(line, line[1:])):
                kept = merged
    return kept


def main_path(pages, frame: list[tuple[str, str]]) -> str:
    """The template element whose slots hold the article: an article or main element if the
    template has one, else the deepest element with most of the text that is not in links."""
    own: Counter = Counter()
    for tokens in pages:
        for kind, path, outside, link, text in tokens:
            if kind == "text" and not outside and not link:
                own[path] += len(text.split())
    weight: Counter = Counter()
    for path, n in own.items():
        parts = path.split("/")
        for k in range(1, len(parts) + 1):
            weight["/".join(parts[:k])] += n
    known = {p for p, w in frame if not w} | {""}
    for name in MAIN:
        named = [p for p in known if p.rsplit("/", 1)[-1].split(".")[0] == name and weight[p]]
        if named:
            return max(named, key=lambda p: (weight[p], -len(p)))
    total = weight[""]
    return max((p for p in known if weight[p] >= 0.8 * total), key=lambda p: (p.count("/"), weight[p], p))


def main_text(tokens, path: str, fixed: frozenset[tuple[str, str]]) -> str:
    """Blocks of the slots inside the main element, in page order, one to a line. An element that
    is no article or main is widened by the text beside it (title, lead, further sections) that is
    neither template nor wholly in links."""
    if not any(p == path or p.startswith(path + "/") for kind, p, *_ in tokens if kind == "text"):
        path = ""
    named = path.rsplit("/", 1)[-1].split(".")[0] in MAIN
    within = lambda p: path == "" or p == path or p.startswith(path + "/")
    inside = [x for x in tokens if not named or within(x[1]) or (x[0] == "tag" and path.startswith(x[1]))]
    blocks = [x for x in units(inside) if x[1].startswith("=")]
    if not named:
        blocks = [x for x in blocks if within(x[0]) or not x[2]]
        own = [x for x in blocks if x[:2] not in fixed]
        n_own, n = (sum(len(mark.split()) for _, mark, linked in found if not linked) for found in (own, blocks))
        if own and n_own >= 0.2 * n:
            blocks = own
    return "\n".join(mark[1:] for _, mark, _ in blocks)


def _extract(table: pa.Table) -> pa.Table:
    rows = table.select(["page_id", "url", "html"]).sort_by([("url", "ascending"), ("page_id", "ascending")])
    pages = [read(x or "") for x in rows.column("html").to_pylist()]
    full = [p for p in pages if p]
    distinct = [p for p in dict(zip(rows.column("html").to_pylist(), pages)).values() if p]
    frame = template(distinct) if len(distinct) > 1 else [(path, "") for kind, path, *_ in (full or [[]])[0] if kind == "tag"]
    path = main_path(full, frame)
    texts = []
    for tokens in pages:
        # a page without the group's main element is read by its own
        has = any(p == path or p.startswith(path + "/") for _, p, *_ in tokens)
        texts.append(main_text(tokens, path if has else main_path([tokens], [(p, "") for k, p, *_ in tokens if k == "tag"]), frozenset(frame)))
    out = rows.select(["page_id", "url"]).append_column("text", pa.array(texts, pa.string()))
    return out.append_column("n_chars", pa.array([len(t) for t in texts], pa.int64()))


def extract(pages: DataFrame, group_pages: int = GROUP_PAGES) -> DataFrame:
    """page_id, url, text, n_chars. A host with many pages is split into groups by a hash."""
    kind = pages.schema["page_id"].dataType.simpleString()
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    rows = pages.select("page_id", "url", "html", host.alias("_host"))
    sizes = rows.groupBy("_host").agg(F.ceil(F.count(F.lit(1)) / group_pages).cast("int").alias("_groups"))
    large = stored(sizes.where("_groups > 1"))
    if large.count() <= LISTED_HOSTS:
        large = F.broadcast(large)
    group = F.pmod(F.xxhash64("page_id", "url"), F.coalesce("_groups", F.lit(1)))
    rows = rows.join(large, "_host", "left").withColumn("_group", group).drop("_groups")
    # dealt by host and group: a host with a third of all pages is spread over all tasks
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "_host", "_group")
    return rows.groupBy("_host", "_group").applyInArrow(_extract, f"page_id {kind}, url string, text string, n_chars bigint")
