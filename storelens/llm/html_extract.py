"""Main text of web pages by wrapper induction.

Pages of one host are aligned: a node's place is its path of labels (tag, id
and class, digits as one) from the root, each with its number among siblings of
that label, counted from the front or, a second place, from behind. Nodes are
elements, and lines of text between elements; inline elements are nodes where
no text stands beside them. Spark counts exactly, for every place of a host, the
different pages that have it and the pages of each text there. A text on at
least SHARE of its place's pages is constant, so that few deviating pages hide
no template; a place that fewer than HOST_SHARE of the host's different pages
have proves nothing, as all of these may be near copies of one article. What is constant over a host's pages is template, within an article
too, what varies is content.
Of what is left, the parts that the page itself marks as its article (or else
as main) are taken, if it marks any. In both passes the parts that their own
markup names as no content (menus, headers, footers, sidebars, notices, adverts,
forms, scripts, comments of readers) are left out, whether constant or not.
Classes and ids count as whole names only, within an article only those of
adverts, navigation and comments, and never where they would hide the only
article or all text of a page; a form that holds blocks of content is a wrapper.

Every page takes part in the induction with all its nodes, however many and
however deep; copies of one page count once. Counts are grouped aggregates,
combined map-side, so a host with a third of all pages is spread over all
tasks. A host's constant places then meet its pages in a join by host, salted
on the pages' side. Places on fewer than SUPPORT different pages of a host are
no evidence, so hosts with fewer pages have no template: there markup alone decides.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from storelens.llm.common import checkpointed, text_or_empty

#: Different pages of a host that must have a place, the share of the host's different pages that must, and the share of
#: those that have it on which one text makes that text template.
SUPPORT = 5
HOST_SHARE = 0.5
SHARE = 0.75
#: Place of a page as a whole: its count is the number of a host's different pages.
WHOLE = 0
#: Salts of a host's pages in the join with its template.
GROUPS = 64

# Fixed values of HTML: element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span"
    " strike strong sub sup time tt u var wbr img"
    " math mi mn mo mrow ms mspace mtext msub msup msubsup mfrac msqrt mroot mstyle munder mover munderover semantics".split()
)
#: A start tag of the key closes an open element of the value's kinds (within the nearest block).
P_CLOSERS = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3"
    " h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}}
SCOPE = frozenset("ul ol menu dl table tbody thead tfoot select article section main body html div td th".split())

# Elements, roles and class or id words that name what is no main text.
CHROME = frozenset("nav header footer aside form button select dialog menu svg object audio video canvas head".split())
#: Of these, elements that are kept where they hold blocks of content, and elements whose text counts within an article (as that of its header does).
WRAPPERS = frozenset("form button".split())
MEDIA = frozenset("object audio video canvas".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar toolbar form".split())
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu"
    " menubar breadcrumb breadcrumbs sidebar aside footer header masthead topbar cookie cookies consent notice notices"
    " gdpr popup modal overlay newsletter subscribe signup login share sharing social related recommended comment"
    " comments commentlist disqus reply replies respond toolbar pagination pager widget widgets".split()
)
#: Words that may stand beside a chrome word in a name (cookie-notice, top-nav, footer_links).
BESIDE = frozenset(
    "bar block bottom box container form global group holder inner item items link links list main outer page panel primary"
    " row secondary section site slot top unit wrap wrapper".split()
)
#: Within an article or main element only these words count: what others wrote or paid for, and navigation.
FOREIGN_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsored nav navbar navigation breadcrumb breadcrumbs cookie cookies"
    " gdpr newsletter comment comments commentlist disqus pagination pager".split()
)
KEEP = frozenset("article main body html".split())
MARKED = frozenset("article main".split())
#: Blocks of content by which a form or button is known to be a wrapper.
CONTENT = frozenset("article main p h1 h2 h3 h4 h5 h6 blockquote pre table section".split())
#: Kinds of chrome: by a name of the class or id alone; by element, role or style; a form or button without content so far.
SOFT, HARD, WRAP = 1, 2, 3

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
WORD_CUT = re.compile(r"[^a-z0-9]+")
DIGITS = re.compile(r"[0-9]+")
SPACES = re.compile(r"[\s ]+")


class Node:
    """An element with a label (tag, id and class), its children, and for a text node its raw text.

    ``block`` is False for text and for inline elements that hold no block; ``sum`` is a hash of the text below,
    and ``inside`` says that the node is, or is within, an article or main element.
    """

    __slots__ = ("block", "chrome", "inside", "kids", "label", "sum", "tag", "text")

    def __init__(self, tag: str, label: str, chrome: int = 0, text: str | None = None):
        self.tag, self.label, self.chrome, self.text, self.kids = tag, label, chrome, text, []
        self.block, self.sum = text is None and tag not in INLINE and tag not in VOID, b""
        self.inside = tag in MARKED


def _is_chrome(tag: str, attributes: str, inside: bool) -> tuple[int, str]:
    """Whether the element's own markup names it as no content, and its id and class, digits as one.

    ``inside`` says that it is within an article or main element.
    """
    kind = WRAP if tag in WRAPPERS else 0
    if tag in RAW or (tag in CHROME and not kind and not (inside and (tag in MEDIA or tag == "header"))):
        return HARD, ""
    if not attributes:
        return kind, ""
    found = {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)}
    name = f"{found.get('class', '')} {found.get('id', '')}".strip().lower()
    names, name = name.split(), DIGITS.sub("0", name)
    if tag in KEEP:
        return 0, name
    out = found.get("role", "").lower() in ROLES - {tag} or "hidden" in found or found.get("aria-hidden", "").lower() == "true"
    if out or "display:none" in found.get("style", "").replace(" ", ""):
        return HARD, name
    if any(_names_chrome(x, FOREIGN_WORDS if inside else CHROME_WORDS) for x in names):
        return SOFT, name
    return kind, name


def _names_chrome(name: str, words: frozenset[str]) -> bool:
    """Whether a class or id as a whole names chrome: all its words do, or only words of place and form stand beside."""
    parts = [x for x in WORD_CUT.split(name) if x and not x.isdigit()]
    return any(x in words for x in parts) and all(x in CHROME_WORDS or x in BESIDE for x in parts)


def parse(page: str) -> Node:
    """DOM tree of a page, with the end tags that authors leave out put in."""
    root = Node("#root", "#root")
    stack, at, n = [root], 0, len(page)
    forms: list[Node] = []  # forms and buttons that were opened since the last block of content
    held: list[list[Node]] = []  # for every article and main: the elements around it that are chrome
    while at < n:
        m = TOKEN.search(page, at)
        if m is None or m.start() > at:
            text = page[at : m.start() if m else n]
            if text.strip():
                node = Node("#text", "#text", text=text)
                stack[-1].kids.append(node)
            elif text:
                stack[-1].kids.append(Node("#text", "#text", text=" "))
        if m is None:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in SCOPE and tag not in SCOPE:
                    break
            continue
        closed = CLOSES.get(tag, ())
        closed = {"p"} if tag in P_CLOSERS else closed
        for i in range(len(stack) - 1, 0, -1) if closed else ():
            if stack[i].tag in closed:
                del stack[i:]
                break
            if stack[i].tag in SCOPE:
                break
        chrome, name = _is_chrome(tag, m[3], stack[-1].inside)
        node = Node(tag, f"{tag}.{name}" if name else tag, chrome)
        node.inside = node.inside or stack[-1].inside
        stack[-1].kids.append(node)
        for x in reversed(stack) if node.block and chrome < HARD else ():
            if x.block:
                break
            x.block = True
        if tag in CONTENT:
            for x in forms:
                if x.chrome == WRAP and any(x is y for y in stack):
                    x.chrome = 0
            forms.clear()
        if tag in MARKED and not stack[-1].inside:
            held.append([x for x in stack if x.chrome])
        if tag in RAW:
            end = re.compile(f"</{tag}[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
        elif tag not in VOID:
            stack.append(node)
            if chrome == WRAP:
                forms.append(node)
    if all(held):  # no article is outside of chrome: names alone do not hide one
        for around in held:
            for x in around if all(x.chrome < HARD for x in around) else ():
                x.chrome = 0
    return root


def plain(node: Node) -> str:
    """All text below a node that is not chrome, white space collapsed."""
    out: list[str] = []
    _gather(node, out)
    return SPACES.sub(" ", "".join(out)).strip()


def _gather(node: Node, out: list[str]) -> None:
    todo = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.chrome:
            continue
        elif x.text is not None:
            out.append(entities.unescape(x.text) if "&" in x.text else x.text)
        else:
            if x.tag not in INLINE:
                out.append(" ")
                todo.append(" ")
            todo.extend(reversed(x.kids))


def _hash(data: bytes) -> bytes:
    return blake2b(data, digest_size=8).digest()


def _joined(sums: list[bytes]) -> bytes:
    """Hash of texts that follow each other (empty ones, and wrappers around one text, change nothing)."""
    some = [x for x in sums if x]
    return some[0] if len(some) == 1 else _hash(b"".join(some)) if some else b""


def _sum_texts(root: Node) -> None:
    """Put the hash of its text, white space collapsed and what is surely chrome left out, into every node."""
    order, todo = [], [root]
    while todo:
        x = todo.pop()
        if x.chrome < HARD:
            order.append(x)
            todo.extend(x.kids)
    for x in reversed(order):
        if x.text is None:
            x.sum = _joined([k.sum for k in x.kids])
        else:
            words = (entities.unescape(x.text) if "&" in x.text else x.text).split()
            x.sum = _hash(" ".join(words).encode("utf-8", "surrogatepass")) if words else b""


def units(node: Node) -> list[tuple[str, list[Node]]]:
    """What is aligned of an element: (label, nodes) of its elements and of its lines of text."""
    out: list[tuple[str, list[Node]]] = []
    line: list[Node] = []
    for k in [*node.kids, None]:
        if k is not None and not k.block:
            line.append(k)
            continue
        if any(x.text is not None and x.sum for x in line):
            out.append(("#text", line))
        else:
            out += [(x.label, [x]) for x in line if x.sum and x.chrome < HARD]
        line = []
        if k is not None and k.sum and k.chrome < HARD:
            out.append((k.label, [k]))
    return [] if len(out) == 1 and out[0][0] == "#text" else out  # such an element is one with its text


def aligned(root: Node) -> Iterator[tuple[list[Node], int, list[int]]]:
    """The nodes of a page that hold text: (nodes, hash of the text, hashes of the places), each before those below it.

    Below nodes that are marked as chrome while they are held out, nothing follows.
    """
    _sum_texts(root)
    todo = [(root, b"front", b"behind", False)]
    while todo:
        node, front, behind, two = todo.pop()
        mine = units(node)
        total, met = Counter(label for label, _ in mine), Counter()
        for label, nodes in mine:
            name, n = label.encode("utf-8", "surrogatepass"), total[label]
            here = _hash(b"%s%d %s" % (front, met[label], name))
            # the place from behind is another one only where a label of the path has siblings of its kind
            there, other = _hash(b"%s%d %s" % (behind, n - 1 - met[label], name)), two or n > 1
            met[label] += 1
            text = _number(nodes[0].sum if len(nodes) == 1 else _joined([x.sum for x in nodes]))
            yield nodes, text, [_number(here), _number(there)] if other else [_number(here)]
            if len(nodes) == 1 and nodes[0].chrome < HARD:
                todo.append((nodes[0], here, there, other))


def _number(digest: bytes) -> int:
    return int.from_bytes(digest, "little", signed=True)


def page_keys(root: Node) -> tuple[int, list[int], list[int]]:
    """A page's hash, and the places of its nodes with the hashes of their texts; equal pages have equal hashes."""
    places, texts = [], []
    for _, text, where in aligned(root):
        places += where
        texts += [text] * len(where)
    return _number(_hash(b"".join(x.to_bytes(8, "little", signed=True) for x in [*places, *texts]))), places, texts


def overlay(root: Node) -> dict:
    """The induction's input from one page, in memory: pages, and the nodes (place, text) of the different ones."""
    page, places, texts = page_keys(root)
    return {"n": 1, "pages": {page: list(zip(places, texts, strict=True))}}


def merge(a: dict, b: dict) -> dict:
    return {"n": a["n"] + b["n"], "pages": a["pages"] | b["pages"]}


def template_keys(tree: dict) -> frozenset[int]:
    """What ``induce`` finds, from pages in memory."""
    counts: dict[int, Counter] = {}
    for nodes in tree["pages"].values():
        for place, text in nodes:
            counts.setdefault(place, Counter())[text] += 1
    least = max(SUPPORT, HOST_SHARE * len(tree["pages"]))
    return frozenset(
        place ^ text
        for place, texts in counts.items()
        for text, n in texts.most_common(1)
        if texts.total() >= least and n >= SHARE * texts.total()
    )


def match_size(a: dict, b: dict) -> int:
    """Simple tree matching: nodes in the largest top-down, order-preserving matching of two trees.

    A measure of how alike two layouts are; the induction aligns by place and needs no pairs of trees.
    """
    if a["l"] != b["l"]:
        return 0
    return 1 + _pairing(a["k"], b["k"])[0]


def _pairing(xs: list[dict], ys: list[dict]) -> tuple[int, list[tuple[int, int]]]:
    """Size of the best order-preserving matching of two child lists, and its pairs."""
    if not xs or not ys:
        return 0, []
    if [x["l"] for x in xs] == [y["l"] for y in ys]:  # the usual case: the same layout
        return sum(match_size(x, y) for x, y in zip(xs, ys, strict=True)), [(i, i) for i in range(len(xs))]
    size = [[match_size(x, y) for y in ys] for x in xs]
    best = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
    for i in range(1, len(xs) + 1):
        for j in range(1, len(ys) + 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + size[i - 1][j - 1])
    pairs, i, j = [], len(xs), len(ys)
    while i and j:
        if size[i - 1][j - 1] and best[i][j] == best[i - 1][j - 1] + size[i - 1][j - 1]:
            i, j = i - 1, j - 1
            pairs.append((i, j))
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return best[-1][-1], pairs[::-1]


def strip_template(root: Node, keys: frozenset[int]) -> None:
    """Mark the nodes of a page as chrome whose text is that of their place on the host's pages."""
    if not keys:
        return
    for nodes, text, places in aligned(root):
        if any(p ^ text in keys for p in places):
            for x in nodes:
                x.chrome = HARD


def main_node(root: Node) -> Node | None:
    """The articles or main elements of a page if it has some with text, as one node; else the body or what there is."""
    for wanted in ("article", "main"):
        found, todo = [], [root]
        while todo:
            x = todo.pop()
            if x.tag == wanted and not x.chrome:
                found.append(x)
            elif not x.chrome:
                todo.extend(reversed(x.kids))
        top = Node("#root", "#root")
        top.kids = found
        if found and plain(top):
            return top
    return root


def extract(page: str, tree: dict | None) -> str:
    """Main text of a page, given its host's pages as merged overlays (None: markup alone decides)."""
    return main_text(page, template_keys(tree) if tree else frozenset())


def main_text(page: str, keys: frozenset[int]) -> str:
    """Main text of a page, given the constant nodes of its host.

    Where markup leaves nothing of a page, what only its names call chrome is content after all.
    """
    root = parse(page)
    strip_template(root, keys)
    text = plain(main_node(root))
    if not text and not plain(main_node(root := parse(page))):
        strip_template(root, keys)
        todo = [root]
        while todo:
            x = todo.pop()
            x.chrome = 0 if x.chrome == SOFT else x.chrome
            todo.extend(x.kids)
        text = plain(main_node(root))
    return text


def host_of(url: Column) -> Column:
    """Host of a URL in lower case, '' for a null or a URL without one."""
    return F.lower(F.coalesce(F.regexp_extract(url.cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def _page_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [page_keys(parse(page.as_py())) for page in batch.column("html")]
        columns = [pa.array([m[0] for m in made], pa.int64())]
        columns += [pa.array([[WHOLE, *m[i]] for m in made], pa.list_(pa.int64())) for i in (1, 2)]
        yield pa.RecordBatch.from_arrays([batch.column("host"), *columns], ["host", "page", "place", "text"])


def induce(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, keys): the constant nodes of every host (place xor text), counted over all of its different pages."""
    source = pages.select(host_of(pages[url_col]).alias("host"), text_or_empty(pages[html_col]).alias("html"))
    each = source.mapInArrow(_page_keys, "host string, page bigint, place array<bigint>, text array<bigint>")
    each = each.dropDuplicates(["host", "page"]).select("host", F.inline(F.arrays_zip("place", "text")))
    counted = each.groupBy("host", "place", "text").agg(F.count(F.lit(1)).alias("n"))
    placed = counted.groupBy("host", "place").agg(
        F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("text", "n").alias("text")
    )
    whole = F.col("place") == WHOLE
    evident = checkpointed(placed.filter(whole | ((F.col("n") >= SUPPORT) & (F.col("most") >= SHARE * F.col("n")))))
    hosts = evident.filter(whole).select("host", F.col("n").alias("pages"))
    constant = evident.filter(~whole).join(hosts, "host").filter(F.col("n") >= HOST_SHARE * F.col("pages"))
    return constant.groupBy("host").agg(F.collect_list(F.col("place").bitwiseXOR(F.col("text"))).alias("keys"))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row of ``pages``: page_id, url, text, n_chars (code points).

    Text is that of the article: character references decoded, white space
    within a block as one space, blocks joined by one space; empty if there is
    none or the html is null. Pages whose URL has no host are one host.
    Repeated rows give repeated results; an empty table none; other columns are
    not read.
    """
    template = checkpointed(induce(pages, url_col, html_col))
    id_type = pages.schema[id_col].dataType.simpleString()
    salted = template.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(GROUPS - 1))))
    source = pages.select(
        pages[id_col].alias("page_id"), pages[url_col].cast("string").alias("url"), text_or_empty(pages[html_col]).alias("html"),
        host_of(pages[url_col]).alias("host"),
    ).withColumn("salt", F.pmod(F.xxhash64("url", "html"), F.lit(GROUPS)).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, frozenset[int]] = {}
        for batch in batches:
            texts = []
            for host, page, keys in zip(batch.column("host"), batch.column("html"), batch.column("keys"), strict=True):
                host = host.as_py()
                if host not in held:
                    if len(held) >= 256:
                        held.clear()
                    held[host] = frozenset(keys.as_py() or ())
                texts.append(main_text(page.as_py(), held[host]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    joined = source.join(salted, ["host", "salt"], "left").select("page_id", "url", "html", "host", "keys")
    return joined.mapInArrow(run, f"page_id {id_type}, url string, text string, n_chars bigint")
