"""Main text of web pages, by union-free regular-expression inference over each host's pages.

A page is parsed to a tree of tags, whose children are its token streams.  The
streams of one host's pages are aligned into a wrapper: a tag that only some
pages have becomes optional, neighbours of one kind become one repeated group,
and a stretch in which kinds come back becomes a repeated group of optional
members.  Texts that are equal stay constants and others become a slot.  So a
wrapper has no alternatives, and its size depends on the kinds of nodes and not
on the number or length of pages: a slot keeps how much text it has, how much
of it is link text, and a summary of its frequent texts.

The summary is that of Misra and Gries: at most four texts for each that a page
has in the slot, on average, and eight more; where there are more, the least counts are taken off all.
It merges in any order and surely holds what nearly all pages share.  A second pass over
the pages counts exactly these candidates, so neither the order of rows nor
their partitions decide what is a constant.

Wrappers are folded per partition, then per host in two steps, so a host with
a third of all pages is never one task.  A host's wrapper gives the path of its
main part: the article or main element with most text, else the innermost node
with most text outside menus and the like.  Within it the slots decide what
else goes: blocks that nearly all pages repeat word for word, of three or more
different contents; groups that are mostly link text; and parts whose names
speak of menus, notices, adverts or comments, unless such a part holds most of
the text.  A name that only contains such a word needs a slot of much link text
besides.  Headings and a page's only text stay.  Pages without the path are
their own host.  Tags nested deeper than ``DEPTH`` count as neighbours.

Defined results: null or empty html gives an empty text; a url without host
goes by ""; repeated rows are extracted one by one; an empty table gives no
rows; ``extract`` keeps other columns, its results replacing their namesakes.
"""

from __future__ import annotations

import html
import json
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, materialised, table

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|iframe|svg|title|head)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*>|<(/?)([a-zA-Z][^\s>/]*+)((?:[^>\"']|\"[^\"<]*\"|'[^'<]*')*+)>|<(/?)([a-zA-Z][^\s>/]*+)([^>]*+)>",
    re.S | re.I,
)
HINT = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article blockquote body caption center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
APART = frozenset("nav header footer aside form button select option input dialog menu fieldset label object embed canvas audio video map".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
WITHIN = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
#: Words of class, id and role names that speak of what is not the article; and what may follow them in a name.
WORD = (
    r"(?:ads?|adv|advert\w*|banners?|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alerts?|popups?|modal|overlay|menus?|nav\w*|breadcrumbs?"
    r"|sidebars?|side|complementary|footer|contentinfo|masthead|comments?|disqus|repl(?:y|ies)|respond|share|sharing|social|related|recommend\w*"
    r"|newsletters?|subscribe|signup|login|search|form|dialog|pagination|pager|toolbar|skip|hidden|sr-only)"
)
AFTER = r"(?:[_-](?:area|bar|block|body|box|boxes|button|buttons|container|content|footer|form|group|header|inner|item|items|left|link|links|list|main|menu|notice|outer|panel|popup|posts|right|section|slot|top|unit|widget|wrap|wrapper|\d+))*"
NAMES = re.compile(rf"(?:^|[\s_-]){WORD}(?:$|[\s_-])", re.I)
STRONG = re.compile(rf"(?:[a-z]+[_-])?{WORD}{AFTER}", re.I)
ROOTS, HEADING = frozenset(("html", "body", "main", "article")), re.compile("h[1-6]")


#: Names that can tell kinds of nodes apart; those with digits are often made anew for each page.
STABLE = re.compile(r"[A-Za-z]+(?:[-_][A-Za-z]+)*")
DEPTH = 200


class Node:
    """A tag with its kind, whether it stands apart from the main text, and its children.

    A kind ends in ! if a name contains a word of ``WORD``, and in !! if it is one.
    """

    __slots__ = ("apart", "children", "kind", "tag")

    def __init__(self, tag: str, attributes: str = "", inside: bool = False):
        names = " ".join(a or b or c for _, a, b, c in HINT.findall(attributes)) if attributes else ""
        marks = ""
        if names and tag not in ROOTS and NAMES.search(names):
            marks = "!!" if any(map(STRONG.fullmatch, names.split())) and not HEADING.fullmatch(tag) else "!"
        self.tag, self.children = tag, []
        self.kind = ".".join([tag, *(n for n in names.split() if STABLE.fullmatch(n))]) + marks
        self.apart = (tag in APART and not (inside and tag == "header")) or bool(attributes and HIDDEN.search(attributes))


def parse(page: str) -> Node:
    """The tree of a page; ends that are missing are implied, as browsers do."""
    root = Node("#page")
    stack, at, open_ = [root], 0, False
    last = page.rfind(">") + 1  # behind it there are no tags
    for m in TOKEN.finditer(page, 0, last):
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        at = m.end()
        end, tag, attributes = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
        if not tag:
            open_ = at == last and (m[0].startswith("<!--") and not m[0].endswith("-->") or bool(m[1]) and not re.search(r"</\w+\s*>\Z", m[0]))
            continue
        tag = tag.lower()
        if end:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in ("article", "body", "table") and tag not in ROOTS and tag != "table":
                    break
            continue
        closes = CLOSES.get(tag)
        if closes:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in closes:
                    del stack[i:]
                    break
                if stack[i].tag in WITHIN[tag]:
                    break
        if tag in BLOCKS:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in BLOCKS or stack[i].tag in APART:
                    break
        node = Node(tag, attributes, tag == "header" and any(n.tag in ("article", "main") for n in stack))
        stack[-1].children.append(node)
        if tag not in VOID and not attributes.endswith("/") and len(stack) < DEPTH:
            stack.append(node)
    if at < len(page) and not open_:
        stack[-1].children.append(page[at:].partition("<!--")[0])
    return root


# A wrapper node is a list: kind, apart, optional, repeated, pages, characters,
# link characters, number of texts and, for blocks without blocks inside, the summary
# of the texts by digest, and children.
KIND, AWAY, OPTIONAL, REPEATED, PAGES, CHARS, LINKS, TEXTS, SHARED, BELOW = range(10)
#: The share of the main part's pages that a constant is in; it stands beside three different contents or more.
OFTEN = 0.9


def content_of(node: Node) -> int:
    """A digest of the text outside what stands apart."""
    texts, todo = [], [node]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            texts += n.split()
        elif not n.apart:
            todo += n.children[::-1]
    return xxhash.xxh32_intdigest(" ".join(texts).encode("utf-8", "replace"))


def leaf_text(node: Node) -> str | None:
    """The text of a block without blocks inside; None for any other node."""
    if node.tag not in BLOCKS or node.tag in ROOTS:
        return None
    texts, todo = [], [node]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            texts.append(html.unescape(n))
        elif n is not node and n.tag in BLOCKS:
            return None
        elif n is node or not n.apart:
            todo += n.children[::-1]
    return " ".join("".join(texts).split())


def digest_of(text: str) -> str:
    return xxhash.xxh32_hexdigest(text.encode("utf-8", "replace"))


def wrapper_of(node: Node, in_link: bool = False) -> list:
    """The wrapper that fits one page's node."""
    in_link = in_link or node.tag == "a"
    n = len(" ".join(" ".join(c for c in node.children if isinstance(c, str)).split()))
    below: list = []
    for c in node.children:
        if isinstance(c, Node):
            _append(below, wrapper_of(c, in_link))
    text = leaf_text(node)
    return [node.kind, node.apart, False, False, 1, n, n * in_link, 1 if text else 0, {digest_of(text): 1} if text else {}, _folded(below)]


def _shared(a: dict, b: dict, pages: int, texts: int, beside: bool) -> dict:
    """The summary of two slots' texts: counts may be too small, by less than a quarter of the pages where these are alike."""
    total = dict(a)
    for text, n in b.items():
        total[text] = max(total.get(text, 0), n) if beside else total.get(text, 0) + n
    most = 4 * -(-texts // pages) + 8
    if len(total) > most and not beside:
        off = sorted(total.values(), reverse=True)[most]
        total = {t: n - off for t, n in total.items() if n > off}
    return total


def _append(below: list, child: list) -> None:
    """Neighbours of one kind become one repeated group."""
    if below and below[-1][KIND] == child[KIND]:
        below[-1] = _joined(below[-1], child, True)
    else:
        below.append(child)


def _joined(a: list, b: list, beside: bool) -> list:
    """Two nodes of one kind as one; beside: both stand in one page."""
    pages = max(a[PAGES], b[PAGES]) if beside else a[PAGES] + b[PAGES]
    return [
        a[KIND], a[AWAY], a[OPTIONAL] or b[OPTIONAL], a[REPEATED] or b[REPEATED] or beside, pages,
        a[CHARS] + b[CHARS], a[LINKS] + b[LINKS], a[TEXTS] + b[TEXTS], _shared(a[SHARED], b[SHARED], pages, a[TEXTS] + b[TEXTS], beside), align(a[BELOW], b[BELOW], beside),
    ]


def _folded(below: list) -> list:
    """A stretch in which kinds come back becomes a repeated group of optional members."""
    out, place = [], {}
    for c in below:
        start = place.setdefault(c[KIND], len(out))
        if start == len(out):
            out.append(c)
            continue
        for i in range(start, len(out)):
            if not (out[i][OPTIONAL] and out[i][REPEATED]):
                out[i] = [*out[i][:OPTIONAL], True, True, *out[i][PAGES:]]
        out[start] = _joined(out[start], c, True)
    return out


def align(a: list, b: list, beside: bool = False) -> list:
    """Children of two wrappers as one list; those of only one side become optional.

    Within a list each kind stands once, so the longest common order is found
    by walking both lists; kinds in another order end in a repeated group.
    """
    place = {c[KIND]: i for i, c in enumerate(b)}
    out, at = [], 0
    optional = lambda c: [*c[:OPTIONAL], True, *c[REPEATED:]]
    for c in a:
        i = place.get(c[KIND])
        if i is None:
            out.append(optional(c))
        elif i >= at:
            out += [optional(d) for d in b[at:i]]
            out.append(_joined(c, b[i], beside))
            at = i + 1
        else:  # it came earlier on the other side
            out.append(optional(c))
    out += [optional(d) for d in b[at:]]
    return _folded(out)


def merge(a: list, b: list) -> list:
    """The wrapper of two groups of pages of a host."""
    return _joined(a, b, False)


def away(node: list, names: bool) -> bool:
    return node[AWAY] or (names and node[KIND].endswith("!!"))


def weight(node: list, names: bool = True) -> tuple[int, int]:
    """Characters and link characters of a node, without what stands apart, with ``names`` by its name too."""
    if away(node, names):
        return 0, 0
    chars, links = node[CHARS], node[LINKS]
    for c in node[BELOW]:
        x, y = weight(c, names)
        chars, links = chars + x, links + y
    return chars, links


def tag_of(node: list) -> str:
    return node[KIND].partition(".")[0].rstrip("!")


def main_part(wrapper: list, names: bool) -> tuple[list, list[str]]:
    """The node of the main part, and the kinds on its path."""
    best: tuple = (0, None, None)
    todo: list = [(wrapper, [])]
    while todo:
        node, path = todo.pop()
        if away(node, names):
            continue
        if tag_of(node) in ("article", "main") or ".main" in node[KIND] + ".":
            chars = weight(node, names)[0]
            if best[1] is None and chars > 0 or best[1] is not None and (chars, len(path), path) > (best[0], len(best[1]), best[1]):
                best = chars, path, node
            if tag_of(node) == "article":
                continue
        todo += [(c, [*path, c[KIND]]) for c in node[BELOW]]
    if best[1] is not None:
        return best[2], best[1]
    node, path = wrapper, []
    while True:
        own = max(node[BELOW], key=lambda c: (weight(c, names)[0] - weight(c, names)[1], c[KIND]), default=None)
        chars, links = weight(node, names)
        if own is None or tag_of(own) not in BLOCKS or tag_of(own) in ("p", "li", "td", "pre", "blockquote"):
            break
        if weight(own, names)[0] - weight(own, names)[1] <= 0.6 * (chars - links):
            break
        if own[REPEATED] and own[PAGES] == 1:
            break
        node, path = own, [*path, own[KIND]]
    return node, path


def rule(wrapper: list) -> list:
    """[kinds on the path of the main part, paths within it that go, and texts that may be constants by the path within it]."""
    names = 2 * weight(wrapper)[0] > weight(wrapper, False)[0]  # else names put most of the text apart, and mean nothing here
    node, path = main_part(wrapper, names)
    chars, links = weight(node, False)
    gone, texts = [], {}
    todo = [(c, [c[KIND]]) for c in node[BELOW]]
    while todo:
        c, below = todo.pop()
        if c[AWAY]:
            continue
        own, own_links = weight(c, False)
        marks, group = c[KIND].count("!"), tag_of(c) in ("div", "section", "ul", "ol", "dl", "table", "menu")
        marks += (1 + (own_links >= 0.8 * own)) * (group and own_links > 0.5 * own)
        if marks >= 2 and 2 * (own - own_links) <= chars - links:
            gone.append(below)
            continue
        if c[SHARED] and not HEADING.fullmatch(tag_of(c)):
            texts["\n".join(below)] = sorted(c[SHARED])
        todo += [(x, [*below, x[KIND]]) for x in c[BELOW]]
    return [path, sorted(gone), texts]


def found(node: Node, path: list[str]) -> list[Node]:
    """The nodes at a path, in page order."""
    here = [node]
    for kind in path:
        here = [c for n in here for c in n.children if isinstance(c, Node) and c.kind == kind and not c.apart]
    return here


def text_of(nodes: list[Node], gone=(), texts=None) -> str:
    """The blocks of the nodes, white space turned to single spaces, without paths and texts that go."""
    blocks, words = [], []
    gone, texts = {tuple(g) for g in gone}, {tuple(k.split("\n")): {*v} for k, v in (texts or {}).items()}

    def flush() -> None:
        block = " ".join("".join(words).split())
        if block:
            blocks.append(block)
        words.clear()

    def walk(node: Node, path: tuple) -> None:
        block = node.tag in BLOCKS or node.tag == "header"
        if path in gone or (path in texts and digest_of(leaf_text(node) or "") in texts[path]):
            flush()
            return
        if block:
            flush()
        for c in node.children:
            if isinstance(c, str):
                words.append(html.unescape(c))
            elif c.tag == "br":
                words.append(" ")
            elif not c.apart:
                walk(c, (*path, c.kind))
        if block:
            flush()

    for n in nodes:
        walk(n, ())
        flush()
    return "\n".join(blocks)


def constants_in(page: str, known: list) -> tuple[int, set[tuple[str, str]]] | None:
    """The digest of a page's content, and (path, digest) of the rule's candidates that are in its main part; None without that part."""
    root = parse(page)
    nodes = found(root, known[0])
    if not nodes:
        return None
    asked = {tuple(k.split("\n")): {*v} for k, v in known[2].items()}
    has: set = set()
    todo: list = [(n, ()) for n in nodes]
    while todo:
        node, path = todo.pop()
        if path in asked:
            digest = digest_of(leaf_text(node) or "")
            if digest in asked[path]:
                has.add(("\n".join(path), digest))
        todo += [(c, (*path, c.kind)) for c in node.children if isinstance(c, Node) and not c.apart]
    return content_of(root), has


def main_text(page: str | None, known: list | None) -> str:
    """The main text of a page under its host's rule, or under its own if the rule does not fit."""
    if not page:
        return ""
    root = parse(page)
    nodes = found(root, known[0]) if known else []
    if not nodes:
        known = [*rule(wrapper_of(root))[:2], {}]  # one page has no constants
        nodes = found(root, known[0])
    return text_of(nodes, *known[1:]) or text_of(nodes)


def host_of(url: str):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def wrappers(pages: DataFrame, held: int = 5000) -> DataFrame:
    """host and wrapper, as JSON, over all pages; pages has host and html."""

    def fold(batches):
        own: dict = {}

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array(own.keys(), pa.string()), pa.array(map(json.dumps, own.values()), pa.string())], ["host", "wrapper"])
            own.clear()
            return out

        for batch in batches:
            for host, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if page:
                    one = wrapper_of(parse(page))
                    own[host] = merge(own[host], one) if host in own else one
            if len(own) > held:
                yield rows()
        yield rows()

    def meet(t: pa.Table) -> pa.Table:
        total = None
        for w in sorted(t["wrapper"].to_pylist()):
            total = merge(total, json.loads(w)) if total else json.loads(w)
        return pa.table({"host": [t["host"][0].as_py()], "wrapper": [json.dumps(total)]})

    kind = "host string, wrapper string"
    some = pages.select("host", "html").mapInArrow(fold, kind).withColumn("lane", F.pmod(F.xxhash64("wrapper"), F.lit(64)))
    step = lambda t: meet(t).append_column("lane", pa.array([0], pa.int64()))
    return some.groupBy("host", "lane").applyInArrow(step, kind + ", lane long").select("host", "wrapper").groupBy("host").applyInArrow(meet, kind)


def rules(pages: DataFrame) -> DataFrame:
    """host and rule, as JSON, over all pages; pages has host and html."""

    def drafted(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([json.dumps(rule(json.loads(w))) for w in batch.column(1).to_pylist()], pa.string())], ["host", "rule"])

    drafts = materialised(wrappers(pages).mapInArrow(drafted, "host string, rule string"), "drafts")

    def counted(batches):
        parsed: dict = {}
        for batch in batches:
            rows = []
            for host, page, r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r not in parsed:
                    if len(parsed) > 10_000:
                        parsed.clear()
                    parsed[r] = json.loads(r)
                if page and (own := constants_in(page, parsed[r])):
                    rows += [(host, None, None, own[0]), *((host, *x, own[0]) for x in own[1])]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], ["host", "path", "digest", "content"])

    asked = pages.join(drafts.filter("rule not like '%{}]'"), "host").select("host", "html", "rule")
    seen = asked.mapInArrow(counted, "host string, path string, digest string, content long").withColumn("c", F.col("content").cast("decimal(20,0)"))
    sums = seen.groupBy("host", "path", "digest").agg(F.count("*").alias("n"), F.min("c").alias("a"), F.max("c").alias("b"), F.sum("c").alias("s"), F.sum(F.col("c").cast("decimal(10,0)") * F.col("c").cast("decimal(10,0)")).alias("q"))
    sums = materialised(sums, "constants")
    # All contents are the least or the greatest if the sum of (c - a) * (c - b), none of which is above zero, is zero.
    third = F.col("q") - (F.col("a") + F.col("b")).cast("decimal(11,0)") * F.col("s").cast("decimal(26,0)") + F.col("n").cast("decimal(16,0)") * (F.col("a").cast("decimal(10,0)") * F.col("b").cast("decimal(10,0)"))
    whole = sums.filter("path is null").select("host", F.col("n").alias("pages"))
    often = sums.filter("path is not null").join(whole, "host").filter((F.col("n") >= OFTEN * F.col("pages")) & (third != 0))
    texts = often.groupBy("host", "path").agg(F.array_sort(F.collect_list("digest")).alias("digests")).groupBy("host").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", "digests"))))).alias("texts"))

    def final(batches):
        for batch in batches:
            out = [json.dumps([*json.loads(r)[:2], json.loads(t or "{}")]) for r, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["host", "rule"])

    return materialised(drafts.join(texts, "host", "left").select("host", "rule", "texts").mapInArrow(final, "host string, rule string"), "rules")


def extract(pages: DataFrame, page: str = "html", url: str = "url", keep: list[str] | None = None) -> DataFrame:
    """``pages``, or its columns ``keep``, with the main text of each row and its n_chars."""
    bounded_batches(pages.sparkSession)
    keep = [c for c in keep or pages.columns if c not in ("text", "n_chars")]
    own = pages.select(F.struct(*keep).alias("row"), host_of(url).alias("host"), F.col(page).alias("html"))

    known = rules(own)
    schema = T.StructType([*(pages.schema[c] for c in keep), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        parsed: dict = {None: None}
        for batch in batches:
            texts = []
            for p, r in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if r not in parsed:
                    if len(parsed) > 10_000:
                        parsed.clear()
                    parsed[r] = r and json.loads(r)
                texts.append(main_text(p, parsed[r]))
            row = batch.column(0).flatten()
            yield pa.RecordBatch.from_arrays([*row, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*keep, "text", "n_chars"])

    return own.join(known, "host", "left").select("row", "html", "rule").mapInArrow(run, schema)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"), keep=["page_id", "url"]).select("page_id", "url", "text", "n_chars")
