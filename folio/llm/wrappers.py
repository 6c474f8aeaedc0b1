"""Main text of web pages by wrappers: union-free regular expressions inferred from the token streams of a host.

A page becomes a balanced stream of block tags (with class, id and role) and texts; ends that HTML leaves out are put in,
inline markup is dropped. Inside a page and then between the pages of a host, streams are aligned again and again. What
differs is resolved in one of three ways: texts become a text slot (``#``), a group that only one side has becomes optional (``?``), and a
group that follows itself becomes repeated (``+``). The result for a host is one expression, such as
``<body>(<nav><ul>(<li>#</li>)+</ul></nav>)?<article><h1>#</h1>(<p>#</p>)+</article></body>``.

Pages with equal expressions are one row with a count; the rows of a host are merged in groups of about ``FAN`` by hash, round by
round, so no task gets a host whole. All pages are then read along the wrapper of their host, and each slot gets its amount of text, the
share of it in links, and how many titles (pages of one title count once) show the very same text. A slot is dropped
if it is under an element that is no article text by its tag or its names (menus, headers, footers, sidebars, notices, adverts,
forms, comments). Of the rest the slots in ``article``, else in ``main``, are kept; where a host has neither, those under the element that gathers most of the
text that differs from title to title, but for slots that are mostly links (and, if that element is the whole body, slots that show one text under most titles).

Defined results: a null or empty html has an empty text, as has a page without any text that is kept. A null url has an
empty host. Repeated rows are extracted each. A page that its host's wrapper finds nothing in is read along its own.
A tag without its end is text. Elements nested more than ``DEPTH`` deep count as part of the one at that depth. Empty tables give an empty result.
"""

from __future__ import annotations

import html as entities
import json
import re
from bisect import bisect_left
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import small, written

FAN, DEPTH, PERIOD = 16, 60, 4
#: Share of links from which a slot is a list of links; share of titles, and how many, from which a text is the template's.
LINKS, TEMPLATE, TITLES = 0.5, 0.5, 4
#: Share of an element's text that one child must have for the search to go on in it.
GATHERS = 0.7
#: Wrappers that a task remembers as trees.
REMEMBERED = 200

BLOCKS = frozenset(
    "address article aside blockquote body button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe "
    "legend li main map menu nav noscript object ol optgroup option p pre script search section select style summary svg table tbody template textarea tfoot thead title tr ul video audio".split()
)
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
RAW = frozenset(("script", "style", "textarea", "title", "iframe", "noscript", "xmp"))
#: Elements that follow each other as items, whatever each holds; share of what two containers hold beyond which one is the other again.
ITEMS = frozenset("# dd dt h1 h2 h3 h4 h5 h6 li option p pre tbody td th tr".split())
SAME = 0.5
#: What stands between two cells or lines of a block counts as white space.
SPACED = frozenset(("br", "td", "th", "img", "hr", "wbr"))
#: Open elements that a start tag ends.
ENDS = {
    **dict.fromkeys("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split(), ("p",)),
    "li": ("p", "li"), "dt": ("p", "dt", "dd"), "dd": ("p", "dt", "dd"), "tr": ("p", "tr"), "tbody": ("p", "tr", "tbody", "thead"), "tfoot": ("p", "tr", "tbody", "thead"), "option": ("option",), "body": ("head",),
}
#: Elements that are no article text.
DROPPED = frozenset("aside audio button canvas dialog dir fieldset footer form head iframe map menu nav noscript object option script search select style svg template textarea video".split())
#: Words in class, id or role that say the same.
NAMES = frozenset(
    "ad ads adsense advert adverts advertisement advertising alert alertdialog banner breadcrumb breadcrumbs captcha comment comments commentlist complementary consent contentinfo cookie cookies copyright "
    "dialog discussion disqus feedback footer form gdpr hidden login masthead menu menubar modal nav navbar navigation newsletter notice notices notification outbrain overlay pager pagination paywall popup promo promotion "
    "recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription taboola teaser toolbar tooltip topbar widget widgets".split()
)
#: Such words that stand for a part of the article when they are inside of it.
HEADS = frozenset(("header", "heading", "head"))

_TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/<>"']*+)((?:[^<>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)>|<(/?)([a-zA-Z][^\s/<>"']*+)([^<>]*+)>""", re.S)
_ATTR = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")
_NAMED = re.compile(r"[.#@]")
_DIGITS = re.compile(r"[0-9]+")
_CLOSE = {tag: re.compile(f"</{tag}", re.I) for tag in RAW}


class Node:
    """An element with its children: nodes, and texts as [text, length in links]."""

    __slots__ = ("kids", "label", "place", "tag")

    def __init__(self, tag: str, label: str):
        self.tag, self.label, self.kids, self.place = tag, label, [], None


def _label(tag: str, attributes: str) -> str:
    """The tag with its names; digits count as 0, so that numbered names are one."""
    if not attributes or "=" not in attributes:
        return tag
    names = []
    for name, *values in _ATTR.findall(attributes):
        value = _DIGITS.sub("0", _CAMEL.sub(r"\1-\2", "".join(values)).lower())
        names += [f"{ {'class': '.', 'id': '#'}.get(name.lower(), '@')}{x}" for x in value.split()]
    return tag + "".join(sorted(set(names)))


def parse(text: str) -> tuple[Node, str]:
    """The page as a tree of block elements, and its title."""
    root, title, at, linked = Node("html", "html"), "", 0, False
    stack, labels = [root], {}

    def put(piece: str) -> None:
        kids = stack[-1].kids
        if kids and type(kids[-1]) is list:
            kids[-1][0].append(piece)
        else:
            kids.append([[piece], 0])
        if linked:
            kids[-1][1] += len(piece)

    while True:
        m = _TAG.search(text, at)
        if m is None:
            if at < len(text):
                put(text[at:])
            return root, title
        if m.start() > at:
            put(text[at : m.start()])
        at = m.end()
        end, tag, attributes = m.group(1, 2, 3) if m[2] else m.group(4, 5, 6)
        if not tag:
            continue
        tag = tag.lower()
        if tag in SPACED:
            put(" ")
        if tag == "a":
            linked = not end
        if not end and tag in RAW:
            close = _CLOSE[tag].search(text, at)
            inside = text[at : close.start() if close else len(text)]
            at = close.start() if close else len(text)
            if tag == "title" and not title:
                title = inside
        if tag not in BLOCKS or tag in VOID or tag == "html":
            continue
        if end:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            linked = linked and tag not in ("li", "p", "ul", "nav")
            continue
        closing = ENDS.get(tag, ())
        while len(stack) > 1 and stack[-1].tag in closing:
            stack.pop()
        if len(stack) > DEPTH:
            put(" ")
            continue
        label = labels.get((tag, attributes))
        if label is None:
            label = labels[tag, attributes] = _label(tag, attributes)
        node = Node(tag, label)
        stack[-1].kids.append(node)
        stack.append(node)


def tag_of(label: str) -> str:
    return _NAMED.split(label, maxsplit=1)[0]


def clean(pieces: list[str]) -> str:
    return " ".join(entities.unescape("".join(pieces)).split())


# An expression is [label, repeated, optional, parts]; a text slot has the label "#", a group without an element "()".


def expression(node: Node) -> list:
    parts = [expression(k) if type(k) is Node else ["#", 0, 0, []] for k in node.kids if type(k) is Node or clean(k[0])]
    return [node.label, 0, 0, fold(parts)]


def shape(part: list) -> str:
    return part[0] if part[0] != "()" else "(" + " ".join(shape(p) for p in part[3]) + ")"


def alike(a: list, b: list) -> float:
    """Shapes that two parts have in common inside, of all that they have."""
    x, y = {shape(p) for p in a[3]}, {shape(p) for p in b[3]}
    return len(x & y) / len(x | y) if x or y else 1.0


def follows(a: list, b: list) -> bool:
    """Whether b, of the shape of a, is a again: items of text always are, containers if they hold the same for the most part."""
    return tag_of(a[0]) in ITEMS or alike(a, b) > SAME


def join(a: list, b: list, repeated: int) -> list:
    """One expression for both of two that have the same shape."""
    return [a[0], repeated | a[1] | b[1], a[2] | b[2], align(a[3], b[3])]


def fold(parts: list) -> list:
    """Groups of up to PERIOD parts that follow themselves become one repeated group."""
    for period in range(1, PERIOD + 1):
        names, out, at = [shape(p) for p in parts], [], 0
        while at < len(parts):
            group, n = parts[at : at + period], 1
            own = names[at : at + period]
            while len(own) == period and (period == 1 or len(set(own)) > 1) and names[at + n * period : at + (n + 1) * period] == own and all(map(follows, group, parts[at + n * period :])):
                group = [join(x, y, period == 1) for x, y in zip(group, parts[at + n * period : at + (n + 1) * period], strict=True)]
                n += 1
            if n > 1:
                out += group if period == 1 else [["()", 1, 0, group]]
                at += n * period
            else:
                out.append(parts[at])
                at += 1
        parts = out
    return parts


def align(a: list, b: list) -> list:
    """The parts of both sides in one order (a common subsequence of most shapes, alike inside); what one side lacks becomes optional."""
    if a == b:
        return a
    x, y = [shape(p) for p in a], [shape(p) for p in b]
    if x == y:
        return [join(p, q, 0) for p, q in zip(a, b, strict=True)]
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1], best[i + 1][j + 1] + 1 + alike(a[i], b[j]) if x[i] == y[j] else 0)
    out, i, j = [], 0, 0
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and x[i] == y[j] and best[i][j] > max(best[i + 1][j], best[i][j + 1]):
            out.append(join(a[i], b[j], 0))
            i, j = i + 1, j + 1
        elif j == len(y) or i < len(x) and best[i + 1][j] >= best[i][j + 1]:
            out.append([*a[i][:2], 1, a[i][3]])
            i += 1
        else:
            out.append([*b[j][:2], 1, b[j][3]])
            j += 1
    return fold(out)


def merge(a: list, b: list) -> list:
    return [a[0], a[1] | b[1], a[2] | b[2], align(a[3], b[3])]


def regex(part: list) -> str:
    """The expression as text."""
    label, repeated, optional, parts = part
    inner = "".join(map(regex, parts))
    text = inner if label == "()" else "#" if label == "#" else f"<{label}>{inner}</{tag_of(label)}>"
    mark = "*" if repeated and optional else "+" if repeated else "?" if optional else ""
    return f"({text}){mark}" if mark else text


class Wrapper:
    """A node of an expression to read pages along: numbered, with its parts by label; groups are dissolved in their order."""

    __slots__ = ("at", "inside", "label", "number", "parts")

    def __init__(self, part: list, count: list[int]):
        self.label, self.number = part[0], count[0]
        count[0] += 1
        self.parts, self.at = [], {}
        self._take(part[3], count)
        self.inside = frozenset(self.at)

    def _take(self, parts: list, count: list[int]) -> None:
        for p in parts:
            if p[0] == "()":
                self._take(p[3], count)
            elif p[0] != "#":
                self.at.setdefault(p[0], []).append(len(self.parts))
                self.parts.append(Wrapper(p, count))


def follow(page: Node, wrapper: Wrapper) -> None:
    """Sets the place of every node of the page that the wrapper has: of those of its label the next one that holds most of the same, or any when a group begins again."""
    page.place = wrapper.number
    at = 0
    for kid in page.kids:
        if type(kid) is Node and (found := wrapper.at.get(kid.label)):
            if len(found) > 1:
                own = {k.label for k in kid.kids if type(k) is Node}
                fits = lambda k, own=own: len(own & wrapper.parts[k].inside) / max(1, len(own | wrapper.parts[k].inside)) if own or wrapper.parts[k].inside else 1.0
                found = found[bisect_left(found, at) :] or found
                at = max(found, key=lambda k: (fits(k), -k))
            else:
                at = found[0]
            follow(kid, wrapper.parts[at])


def texts(node: Node):
    """(node, texts as (text, length in links)) of every element with text of its own."""
    own = [(t, k[1]) for k in node.kids if type(k) is list and (t := clean(k[0]))]
    if own:
        yield node, own
    for k in node.kids:
        if type(k) is Node:
            yield from texts(k)


def dropped(label: str, inside: bool) -> bool:
    """Whether an element is no article text by its tag or names; inside: of an article or main element."""
    tag = tag_of(label)
    if tag in DROPPED:
        return True
    names = _WORDS.findall(label[len(tag) :])
    if tag in ("html", "body", "article", "main"):
        return False
    return not NAMES.isdisjoint(names) or not inside and (tag == "header" or "header" in names)


def _main(label: str) -> int:
    """2 for an article, 1 for the main element, else 0."""
    tag = tag_of(label)
    return 2 if tag == "article" or "@articlebody" in label or "@article-body" in label or "@article" in label else 1 if tag == "main" or "@main" in label else 0


def decide(wrapper: Wrapper, stats: dict[int, tuple[int, int, float, int]]) -> str:
    """For each node of the wrapper, by number, k if its own text is kept, else d.

    stats: by number characters, characters in links, largest share of titles with one text, titles.
    """
    nodes: list[tuple[Wrapper, bool, int]] = []
    up: dict[int, int] = {}

    def walk(w: Wrapper, out: bool, kind: int, parent: int) -> None:
        out = out or dropped(w.label, kind > 0)
        kind = max(kind, _main(w.label)) if not out else 0
        nodes.append((w, out, kind))
        up[w.number] = parent
        for p in w.parts:
            walk(p, out, kind, w.number)

    walk(wrapper, False, 0, -1)
    nodes.sort(key=lambda x: x[0].number)
    none = (0, 0, 0.0, 0)
    kind = max((k for w, out, k in nodes if not out and stats.get(w.number, none)[0]), default=0)
    if kind:
        return "".join("k" if not out and k == kind else "d" for _, out, k in nodes)
    weight = [0.0] * len(nodes)
    good, own = [False] * len(nodes), [False] * len(nodes)
    for w, out, _ in nodes:
        chars, linked, share, titles = stats.get(w.number, none)
        good[w.number] = not out and linked <= LINKS * chars
        own[w.number] = good[w.number] and not (titles >= TITLES and share >= TEMPLATE)
        if own[w.number]:
            at = w.number
            while at >= 0:
                weight[at] += chars
                at = up[at]
    at = wrapper
    while at.parts:
        best = max(at.parts, key=lambda p: weight[p.number])
        if not weight[best.number] or weight[best.number] < GATHERS * weight[at.number] or not best.parts:
            break
        at = best
    inside = set()

    def take(w: Wrapper) -> None:
        inside.add(w.number)
        for p in w.parts:
            take(p)

    take(at)
    kept = own if tag_of(at.label) in ("html", "body") else good  # an element of the article's own may hold a text on every page
    return "".join("k" if kept[w.number] and w.number in inside else "d" for w, _, _ in nodes)


def main_text(page: Node, decision: str, keep: bool = False) -> list[str]:
    """The blocks whose nodes are kept, in page order; nodes that the wrapper lacks go with the element around them."""
    if page.place is not None:
        keep = decision[page.place] == "k"
    elif dropped(page.label, True):
        return []
    out = []
    for k in page.kids:
        if type(k) is Node:
            out += main_text(k, decision, keep)
        elif keep and (t := clean(k[0])):
            out.append(t)
    return out


def _alone(page: Node) -> list[str]:
    """The main text of a page by its own expression."""
    wrapper = Wrapper(expression(page), [0])
    follow(page, wrapper)
    stats: dict[int, tuple[int, int, float, int]] = {}
    for node, own in texts(page):
        old = stats.get(node.place, (0, 0, 0.0, 0))
        stats[node.place] = (old[0] + sum(len(t) for t, _ in own), old[1] + sum(min(len(t), n) for t, n in own), 0.0, 0)
    return main_text(page, decide(wrapper, stats))


def host(url) -> F.Column:
    """What stands after the first :// up to / ? # or the end, A-Z in lower case; else empty."""
    rest = F.substring_index(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), "/", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def _pages(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    return pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), host(F.col(url)).alias("host"), F.coalesce(F.col(html), F.lit("")).alias("html"))


def infer(rows: DataFrame) -> DataFrame:
    """(host, wrapper, pages): one expression (as JSON) for each host of (host, html)."""

    def outline(batches):
        for b in batches:
            found = [json.dumps(expression(parse(t)[0]), separators=(",", ":"), ensure_ascii=False) for t in b["html"]]
            yield pd.DataFrame({"host": b["host"], "wrapper": found})

    each = rows.select("host", "html").mapInPandas(outline, "host string, wrapper string")
    level = written(each.groupBy("host", "wrapper").agg(F.count("*").alias("pages")))

    def together(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        trees = [json.loads(w) for w in sorted(own["wrapper"])]
        out = trees[0]
        for t in trees[1:]:
            out = merge(out, t)
        return pd.DataFrame({"host": [key[0]], "wrapper": [json.dumps(out, separators=(",", ":"), ensure_ascii=False)], "pages": [own["pages"].sum()]})

    while True:
        sizes = level.groupBy("host").agg(F.count("*").alias("n"))
        if sizes.agg(F.max("n").alias("n")).first().n in (None, 1):
            return level
        many = sizes.filter("n > 1").withColumn("groups", F.ceil(F.col("n") / FAN))
        dealt = level.join(small(many), "host", "left").withColumn("part", F.when(F.col("groups") > 1, F.pmod(F.xxhash64("wrapper"), F.col("groups"))).otherwise(F.lit(0)))
        merged = dealt.filter("n IS NOT NULL").groupBy("host", "part").applyInPandas(together, "host string, wrapper string, pages long")
        level = written(merged.unionByName(dealt.filter("n IS NULL").select("host", "wrapper", "pages")))


class _Known:
    """Wrappers as trees, of which a task remembers some."""

    def __init__(self):
        self.found: dict[str, Wrapper] = {}

    def __call__(self, text: str) -> Wrapper:
        if text not in self.found:
            if len(self.found) >= REMEMBERED:
                self.found.clear()
            self.found[text] = Wrapper(json.loads(text), [0])
        return self.found[text]


def decided(rows: DataFrame, wrappers: DataFrame) -> DataFrame:
    """(host, wrapper, pages, decision): which nodes of the wrapper hold main text, from all pages of (host, html)."""

    def measure(batches):
        known = _Known()
        for b in batches:
            out = []
            for h, t, w in zip(b["host"], b["html"], b["wrapper"], strict=True):
                page, title = parse(t)
                follow(page, known(w))
                name, gathered = clean([title]) or t, {}
                for node, own in texts(page):
                    if node.place is not None:
                        said = gathered.setdefault(node.place, [0, 0, []])
                        for x, n in own:
                            said[0] += len(x)
                            said[1] += min(len(x), n)
                            said[2].append(x)
                out += [(h, k, c, n, hash_of("\n".join(x)), hash_of(name)) for k, (c, n, x) in gathered.items()]
            yield pd.DataFrame(out, columns=["host", "node", "chars", "linked", "text", "title"])

    def hash_of(x: str) -> int:
        return int.from_bytes(blake2b(x.encode(errors="replace"), digest_size=8).digest(), "little", signed=True)

    joined = rows.select("host", "html").join(small(wrappers.select("host", "wrapper")), "host")
    each = joined.mapInPandas(measure, "host string, node int, chars long, linked long, text long, title long")
    by_title = written(each.groupBy("host", "node", "text", "title").agg(F.sum("chars").alias("chars"), F.sum("linked").alias("linked")))
    by_text = by_title.groupBy("host", "node", "text").agg(F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), F.count("*").alias("shown"))
    titles = by_title.select("host", "node", "title").distinct().groupBy("host", "node").agg(F.count("*").alias("titles"))
    slots = by_text.groupBy("host", "node").agg(F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), F.max("shown").alias("shown")).join(titles, ["host", "node"])
    listed = slots.groupBy("host").agg(F.collect_list(F.struct("node", "chars", "linked", (F.col("shown") / F.col("titles")).alias("share"), "titles")).alias("slots"))

    def judge(batches):
        for b in batches:
            found = [decide(Wrapper(json.loads(w), [0]), {s["node"]: (s["chars"], s["linked"], s["share"], s["titles"]) for s in (x if x is not None else ())}) for w, x in zip(b["wrapper"], b["slots"], strict=True)]
            yield pd.DataFrame({"host": b["host"], "wrapper": b["wrapper"], "pages": b["pages"], "decision": found})

    return wrappers.join(listed, "host", "left").mapInPandas(judge, "host string, wrapper string, pages long, decision string")


def wrappers_of(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(host, wrapper, pages): the wrapper of each host as a regular expression."""
    return infer(_pages(pages, page_id, url, html)).select("host", F.udf(lambda w: regex(json.loads(w)))("wrapper").alias("wrapper"), "pages")


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    rows = _pages(pages, page_id, url, html)
    made = written(decided(rows, infer(rows)).select("host", "wrapper", "decision"))
    kinds = dict(rows.dtypes)

    def read(batches):
        known = _Known()
        for b in batches:
            found = []
            for t, w, d in zip(b["html"], b["wrapper"], b["decision"], strict=True):
                page = parse(t)[0]
                follow(page, known(w))
                found.append("\n".join(main_text(page, d) or _alone(page)))
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": found})

    out = rows.join(small(made), "host").select("page_id", "url", "html", "wrapper", "decision").mapInPandas(read, f"page_id {kinds['page_id']}, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))


#: Right for pages whose main text is one article element with the references that these pages hold.
SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS x FROM pages),
b AS (SELECT page_id, url, unnest(regexp_split_to_array(x, '</?(p|h1)>')) AS t, generate_subscripts(regexp_split_to_array(x, '</?(p|h1)>'), 1) AS i FROM a),
c AS (SELECT page_id, url, i, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '<[^>]*>', ' ', 'g'), '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS t FROM b),
d AS (SELECT page_id, url, coalesce(string_agg(t, chr(10) ORDER BY i) FILTER (t <> ''), '') AS text FROM c GROUP BY ALL)
SELECT page_id, url, text, length(text) AS n_chars FROM d
"""
