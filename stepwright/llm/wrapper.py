"""Main text of pages by wrapper induction over hosts.

A page is parsed to a tree of block elements; runs of text (with inline markup
removed) are its blocks. For each host one reference page is chosen (smallest
hash, over all its pages). Every page is aligned with its host's reference by
simple tree matching, and votes: for each node of the reference, how many pages
have a matching node, and how many of these have the same text. Summed over all
pages of the host the votes are its wrapper: nodes with the same text nearly
everywhere are template, varying slots are content. A page is then aligned with
the wrapper again. Its content is where its varying slots are: the outermost
article and main elements, with the headings and paragraphs right before them, if
these hold half of that text, else the lowest node over all of it. What the template or a role (menu, footer, advert, form,
comments, ...) marks inside is left out. Roles come from elements, ARIA roles and
words of classes and ids, a compound word only if all its parts fit.

The wrappers are a table by host. It is broadcast if its size, which is
measured, is below ``BROADCAST_BYTES``; beyond that pages meet it in a merge
join, whose hot hosts the adaptive planner can split. Votes of a host are summed
in each task first, so a host with a third of all pages costs a row per task.

Defined cases: null or empty html gives text '' and n_chars 0. A null or odd url
belongs to the host ''. A host with fewer than ``MIN_SUPPORT`` pages has no
template, only roles. Unclosed and stray tags are closed as browsers do for
block elements. A page whose blocks all fall to roles has empty text. Repeated
rows are pages of their own. Other columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few_tasks, map_arrow, materialize, values_of

MIN_SUPPORT = 3
#: A node is template if it is on this share of the host's pages and has the same text on this share of those.
TEMPLATE_PAGES, TEMPLATE_SHARE = 0.5, 0.9
MAX_TEMPLATE = 0.7
BROADCAST_BYTES = 32 << 20
CACHE_HOSTS = 5_000

#: Elements of HTML by what they mean for text.
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "svg", "object", "canvas", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"html", "head", "body", "title", "address", "article", "aside", "blockquote", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "search", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "caption", "button", "label", "legend"}
BREAKS = {"br", "hr"}
CLOSES_P = BLOCK - {"button", "label", "option", "legend", "caption", "title"}
SIBLING_CLOSERS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}}
SCOPES = {"ul", "ol", "dl", "table", "select", "menu", "body", "html", "div", "article", "section", "main", "nav", "aside", "form", "blockquote", "td", "th", "footer", "header", "figure", "details"}
ROLE_TAGS = {"head", "nav", "footer", "aside", "form", "menu", "button", "select", "dialog", "fieldset", "search"}
ROLE_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "adsense", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "discussion", "disqus", "feedback", "consent", "cookie", "cookies", "copyright", "footer", "header", "menu", "nav", "navbar", "navigation", "masthead", "newsletter", "notice", "pagination", "pager", "popup", "modal", "promo", "promotion", "related", "recommended", "replies", "reply", "responses", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"}
#: Parts that a class or id may have beside a word of a role and still name that role: "comment-list", but not "ad-hoc".
ROLE_PARTS = {"area", "bar", "block", "body", "bottom", "box", "buttons", "column", "container", "content", "form", "global", "group", "header", "holder", "icons", "inner", "item", "items", "left", "link", "links", "list", "main", "media", "outer", "page", "panel", "posts", "primary", "right", "secondary", "section", "side", "site", "skip", "slot", "stories", "thread", "top", "unit", "user", "wrap", "wrapper"}
COMMENT_WORDS = {"comment", "comments", "reply", "replies"}
#: Words that do not name a role where another word of the same element says that it is the content.
WEAK_WORDS = {"widget", "social", "banner", "notice", "header", "toolbar", "responses"}
CONTENT_WORDS = {"content", "article", "post", "entry", "story", "main"}
ARIA = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
MAIN_TAGS = {"article", "main"}
LEAD_TAGS = {"h1", "h2", "h3", "p", "hgroup", "figure"}

#: A quote opens a value only after '='; one that is never closed ends with the tag. Elsewhere it is part of a name.
_VALUE = r"=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+)"
_LEX = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|" + _VALUE + r")*+)>?", re.S)
_ATTR = re.compile(r"([^\s<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: An element that closes itself: a slash before the end that is no part of an unquoted value. Only foreign elements may.
_CLOSED = re.compile(r"(?:^|[\s\"'])/$|^[^=]*/$")
_FOREIGN = {"svg"}
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_NUMBER = re.compile(r"\d*")


class Node:
    """A block element: its tag, whether it has a boilerplate role, and its child nodes and text runs in order.

    ``shape`` is equal for nodes whose trees have the same tags and roles.
    """

    __slots__ = ("tag", "role", "items", "kids", "shape")

    def __init__(self, tag: str, role: bool = False):
        self.tag, self.role, self.items, self.kids, self.shape = tag, role, [], [], 0

    def text(self) -> str:
        return "\n".join(x for x in self.items if isinstance(x, str))


def _parts(word: str) -> list[str]:
    """The parts of a word of a class or id: at dashes, underlines and humps, without numbers."""
    return [x for x in _CAMEL.sub("-", word).lower().replace("_", "-").split("-") if not _NUMBER.fullmatch(x)]


def _names_role(parts: list[str], not_roles: set[str]) -> bool:
    """Do the parts of a word name a boilerplate role?"""
    return any(x in ROLE_WORDS - not_roles for x in parts) and all(x in ROLE_WORDS or x in ROLE_PARTS for x in parts)


def _role(tag: str, attributes: str, in_main: bool) -> bool:
    if tag in ROLE_TAGS or (tag == "header" and not in_main):
        return True
    if not attributes or tag in ("html", "body"):
        return False
    seen = set()
    for name, a, b, c in _ATTR.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in seen:  # the first of a name counts
            continue
        seen.add(name)
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        if name == "role" and value.strip().lower() in ARIA:
            return True
        if name in ("class", "id"):
            words = list(map(_parts, value.split()))
            content = any(w and set(w) <= CONTENT_WORDS | {"body", "text"} and set(w) & CONTENT_WORDS for w in words)
            not_roles = (WEAK_WORDS if content else set()) | ({"header"} if in_main else set())  # inside an article its own header is none
            if any(w[0] in COMMENT_WORDS for w in words if len(w) == 1) if tag in MAIN_TAGS else any(_names_role(w, not_roles) for w in words):
                return True
    return False


def parse(html: str) -> Node:
    """The tree of block elements of a page."""
    root = Node("html")
    stack, run, at, n = [root], [], 0, len(html)
    main_depth = 0

    def flush():
        if run:
            t = " ".join(html_lib.unescape("".join(run)).split())
            run.clear()
            if t:
                stack[-1].items.append(t)

    def pop_to(depth: int):
        nonlocal main_depth
        flush()
        while len(stack) > depth:
            if stack.pop().tag in MAIN_TAGS:
                main_depth -= 1

    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            run.append(html[at:])
            break
        if lt > at:
            run.append(html[at:lt])
        m = _LEX.match(html, lt)
        if m is None:
            run.append("&lt;")
            at = lt + 1
            continue
        at, tag = m.end(), (m.group(2) or "").lower()
        if not tag:
            if m.group().startswith("<![CDATA["):
                run.append(html_lib.escape(m.group()[9:].removesuffix("]]>")))
            continue
        closing = m.group(1) == "/"
        if tag in RAW:
            if not closing and not (tag in _FOREIGN and _CLOSED.search(m.group(3))):
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
                at = end.end() if end else n
            continue
        if tag in BREAKS:
            flush()
        if tag in VOID or tag not in BLOCK:
            continue
        if closing:
            for d in range(len(stack) - 1, 0, -1):
                if stack[d].tag == tag:
                    pop_to(d)
                    break
                if tag == "p" and stack[d].tag in SCOPES:
                    break
            else:
                flush()
            continue
        flush()
        if tag == "html":
            continue
        if tag in CLOSES_P and stack[-1].tag == "p":
            pop_to(len(stack) - 1)
        if tag in ("body",):
            for d in range(len(stack) - 1, 0, -1):
                if stack[d].tag == "head":
                    pop_to(d)
                    break
        if tag[0] == "h" and tag[1:].isdigit() and stack[-1].tag[0] == "h" and stack[-1].tag[1:].isdigit():
            pop_to(len(stack) - 1)
        closers = SIBLING_CLOSERS.get(tag)
        if closers:
            d = len(stack) - 1
            lowest = None
            while d > 0 and stack[d].tag not in SCOPES - closers:
                if stack[d].tag in closers:
                    lowest = d
                d -= 1
            if lowest:
                pop_to(lowest)
        node = Node(tag, _role(tag, m.group(3), main_depth > 0))
        stack[-1].items.append(node)
        stack[-1].kids.append(node)
        stack.append(node)
        if tag in MAIN_TAGS:
            main_depth += 1
    flush()
    for x in reversed(nodes_of(root)):  # children come before their parents
        x.shape = hash((x.tag, x.role, *[k.shape for k in x.kids]))
    return root


def _key(node: Node) -> tuple:
    return node.tag, node.role


def _align(a: Node, b: Node, chosen: dict):
    """Size of the largest matching of two trees with equal roots; asks for those of children by yielding them.

    Children at both ends of the two lists whose trees have one shape are paired
    without the quadratic table, which is what runs of paragraphs come to: such a
    pair matches all of both trees, so no other matching is larger.
    """
    x, y, i, j = a.kids, b.kids, 0, 0
    while i < len(x) and i < len(y) and x[i].shape == y[i].shape:
        i += 1
    while j < len(x) - i and j < len(y) - i and x[-1 - j].shape == y[-1 - j].shape:
        j += 1
    ends = [*zip(x[:i], y[:i]), *zip(x[len(x) - j :], y[len(y) - j :])]
    size, middle = 1, []
    for pair in ends:
        size += yield pair
    x, y = x[i : len(x) - j], y[i : len(y) - j]
    if x and y:
        worth: dict = {}
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for r in range(len(x)):
            for c in range(len(y)):
                most = max(best[r][c + 1], best[r + 1][c])
                if _key(x[r]) == _key(y[c]):
                    worth[r, c] = n = yield x[r], y[c]
                    most = max(most, best[r][c] + n)
                best[r + 1][c + 1] = most
        r, c = len(x), len(y)
        size += best[r][c]
        while r and c:
            if best[r][c] == best[r - 1][c]:
                r -= 1
            elif best[r][c] == best[r][c - 1]:
                c -= 1
            else:
                r, c = r - 1, c - 1
                middle.append((x[r], y[c]))
    chosen[id(a), id(b)] = ends + middle
    return size


def match(a: Node, b: Node) -> tuple[int, list]:
    """Simple tree matching of two trees: the size of the largest matching that keeps order and levels, and its pairs of nodes.

    Works with a stack of its own: pages may be nested deeper than Python's calls.
    """
    if _key(a) != _key(b):
        return 0, []
    chosen: dict = {}
    stack, said = [_align(a, b, chosen)], None
    while stack:
        try:
            x, y = stack[-1].send(said)
        except StopIteration as end:
            stack.pop()
            said = end.value
            continue
        if x.shape == y.shape:
            said = len(nodes_of(x))
        else:
            stack.append(_align(x, y, chosen))
            said = None
    pairs, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        if x.shape == y.shape:
            pairs += zip(nodes_of(x), nodes_of(y))
        else:
            pairs.append((x, y))
            todo += chosen[id(x), id(y)]
    return len(pairs), pairs


def nodes_of(root: Node) -> list[Node]:
    """The nodes in document order."""
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        out.append(x)
        todo += reversed(x.kids)
    return out


def outside_roles(root: Node) -> list[Node]:
    """The nodes in document order without those of a role and all below them."""
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        if not x.role:
            out.append(x)
            todo += reversed(x.kids)
    return out


def _length(x: Node) -> int:
    return sum(len(t) for t in x.items if isinstance(t, str))


def votes(page: Node, reference: list[Node]) -> np.ndarray:
    """Three numbers for each reference node: is it matched, with the same text, and (at the root) the page's text outside roles."""
    index = {id(x): i for i, x in enumerate(reference)}
    out = np.zeros((len(reference), 3), dtype=np.int64)
    for r, p in match(reference[0], page)[1]:
        i = index[id(r)]
        out[i, 0] += 1
        out[i, 1] += r.text() == p.text()
    out[0, 2] = sum(map(_length, outside_roles(page)))
    return out


def constant_nodes(reference: list[Node], wrapper: np.ndarray) -> np.ndarray:
    """Which reference nodes are the host's template, by the votes of all its pages.

    Where constant text is over ``MAX_TEMPLATE`` of the host's text outside roles,
    its pages are copies of one article rather than frames around different ones,
    and nothing is template.
    """
    none = np.zeros(len(reference), dtype=bool)
    if not len(wrapper) or wrapper[0, 0] < MIN_SUPPORT:
        return none
    constant = (wrapper[:, 0] >= TEMPLATE_PAGES * wrapper[0, 0]) & (wrapper[:, 1] >= TEMPLATE_SHARE * wrapper[:, 0])
    plain = {id(x) for x in outside_roles(reference[0])}
    same = sum(int(wrapper[i, 1]) * _length(x) for i, x in enumerate(reference) if constant[i] and id(x) in plain)
    return constant if same <= MAX_TEMPLATE * wrapper[0, 2] else none


def template_texts(page: Node, reference: list[Node], constant: np.ndarray) -> set[int]:
    """Ids of page nodes that match a constant node and have its text."""
    if not constant.any():
        return set()
    index = {id(x): i for i, x in enumerate(reference)}
    return {id(p) for r, p in match(reference[0], page)[1] if constant[index[id(r)]] and r.text() == p.text() and p.text()}


def content_roots(page: Node, template: set[int]) -> list[Node]:
    """Where the varying text outside roles is: all outermost article and main elements if they hold half of it, else the lowest node over all of it."""
    order = outside_roles(page)
    mass: dict[int, int] = {}
    for x in reversed(order):
        mass[id(x)] = (0 if id(x) in template else _length(x)) + sum(mass.get(id(k), 0) for k in x.kids)
    if not mass.get(id(page)):
        return [page]
    mains, todo = [], [page]
    while todo:
        x = todo.pop()
        if x.tag in MAIN_TAGS:
            mains.append(x)
        else:
            todo += [k for k in reversed(x.kids) if mass.get(id(k))]
    if mains and 2 * sum(mass[id(x)] for x in mains) >= mass[id(page)]:
        return [*_leads(page, mains, mass), *mains]
    x = page
    while True:
        full = [k for k in x.kids if mass.get(id(k), 0) == mass[id(x)]]
        if not full:
            return [x]
        x = full[0]


def _leads(page: Node, mains: list[Node], mass: dict[int, int]) -> list[Node]:
    """Headings and paragraphs with varying text that stand right before the first main element, beside it."""
    for x in outside_roles(page):
        if any(k is mains[0] for k in x.kids):
            at = next(i for i, k in enumerate(x.kids) if k is mains[0])
            first = at
            while first and x.kids[first - 1].tag in LEAD_TAGS and mass.get(id(x.kids[first - 1])):
                first -= 1
            return x.kids[first:at]
    return []


def main_text(page: Node, template: set[int]) -> str:
    """The blocks below the content roots that neither a role nor the template marks, in page order, a line each."""
    found: list[str] = []
    todo: list = list(reversed(content_roots(page, template)))
    while todo:
        x = todo.pop()
        if isinstance(x, tuple):
            found.append(x[0])
        elif not x.role:
            todo += [t if isinstance(t, Node) else (t,) for t in reversed(x.items) if isinstance(t, Node) or id(x) not in template]
    return "\n".join(found)


def _host(url):
    return F.coalesce(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _memo(cache: dict, host: str, html: str) -> list[Node]:
    """The nodes of a host's reference page, parsed once per task."""
    if host not in cache:
        if len(cache) >= CACHE_HOSTS:
            cache.clear()
        cache[host] = nodes_of(parse(html or ""))
    return cache[host]


def _with(pages: DataFrame, table: DataFrame, size: int) -> DataFrame:
    """Pages with their host's row: by broadcast if the measured size allows, else by merge join."""
    return pages.join(F.broadcast(table) if size <= BROADCAST_BYTES else table.hint("merge"), "host", "left")


def references(pages: DataFrame) -> DataFrame:
    """host, reference html: the page of the host with the smallest hash, over all its pages."""
    order = F.struct(F.xxhash64("html"), F.col("html"))
    return pages.filter("html is not null and html != ''").groupBy("host").agg(F.min(order)["html"].alias("reference"))


def induce(pages: DataFrame, refs: DataFrame, size: int) -> DataFrame:
    """host, reference and wrapper (votes over all pages of the host, three numbers a node)."""
    import pyarrow as pa

    def vote(batches):
        total: dict = {}
        cache: dict = {}
        for b in batches:
            for host, html, ref in zip(*map(values_of, b.columns)):
                if html and ref:
                    v = votes(parse(html), _memo(cache, host, ref))
                    total[host] = total[host] + v if host in total else v
            if len(total) > CACHE_HOSTS:
                yield pa.RecordBatch.from_pydict({"host": list(total), "votes": pa.array([v.reshape(-1).tolist() for v in total.values()], pa.list_(pa.int64()))})
                total = {}
        yield pa.RecordBatch.from_pydict({"host": pa.array(list(total), pa.string()), "votes": pa.array([v.reshape(-1).tolist() for v in total.values()], pa.list_(pa.int64()))})

    parts = map_arrow(_with(pages, refs, size).select("host", "html", "reference"), vote, "host string, votes array<long>")
    summed = parts.select("host", F.posexplode("votes").alias("k", "v")).groupBy("host", "k").agg(F.sum("v").alias("v"))
    wrappers = summed.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("wrapper"))
    return refs.join(wrappers, "host", "left")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of (page_id, url, html)."""
    import pyarrow as pa

    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").withColumn("host", _host(F.col("url")))

    def apply(batches):
        cache: dict = {}
        constant: dict = {}
        for b in batches:
            page_ids, urls, hosts, htmls, refs, wrappers = b.columns
            texts = []
            for host, html, ref, w in zip(values_of(hosts), values_of(htmls), values_of(refs), wrappers):
                if not html:
                    texts.append("")
                    continue
                page = parse(html)
                if ref and host not in constant:
                    if len(constant) >= CACHE_HOSTS:
                        constant.clear()
                    constant[host] = constant_nodes(_memo(cache, host, ref), np.array(w.values.to_numpy() if w.is_valid else [], dtype=np.int64).reshape(-1, 3))
                texts.append(main_text(page, template_texts(page, _memo(cache, host, ref), constant[host]) if ref else set()))
            yield pa.RecordBatch.from_arrays([page_ids, urls, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    spark = pages.sparkSession
    refs = materialize(references(p), "references", few_tasks(spark, 0))
    size = refs.agg(F.coalesce(F.sum(F.octet_length("reference") + F.octet_length("host")), F.lit(0))).first()[0]
    wrappers = materialize(induce(p, refs, size), "wrappers", few_tasks(spark, 0))
    return map_arrow(_with(p, wrappers, 2 * size).select("page_id", "url", "host", "html", "reference", "wrapper"), apply, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
