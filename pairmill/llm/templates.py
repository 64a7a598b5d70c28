"""Main text of web pages: site templates are found by counting element subtrees per host.

Every block element is hashed with all it holds. Spark counts in how many distinct pages of a host each
subtree stands (pages with one tree are one page); those in at least LEAST_PAGES pages and either
ENOUGH_PAGES or LEAST_SHARE of the host's distinct pages are template and are deleted, together with elements that say by tag, role or class that they are no article. No class or role
says so of html, body, article, main or an element with more than half of the page's text. Where a page
marks its article (article or main), only that is kept. Blocks of prose inside it (paragraphs, headings,
quotes, what holds them and what they hold) may be quotes, which stand on few pages: they are template from
PROSE_SHARE of the host's distinct pages on.

Cases: null or empty html gives an empty text; a null url belongs to a host of its own name "";
unclosed tags end where their parent or the page ends; a page that stands twice counts once and gets
two rows; further columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairmill.llm.textblock import arrow_schema
from pairmill.storage import broadcast_if_bounded, staged

#: Distinct pages of its host on which a template stands: at least LEAST_PAGES, and LEAST_SHARE of a host of
#: up to ENOUGH_PAGES / LEAST_SHARE pages; ENOUGH_PAGES do on a larger one.
LEAST_PAGES, LEAST_SHARE, ENOUGH_PAGES = 5, 0.01, 100
#: The share for prose inside articles, besides LEAST_PAGES.
PROSE_SHARE = 0.25
#: At most this many template keys (8 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 4_000_000
#: Rows of hot template keys are dealt over so many groups when they are joined.
SALTS = 16
PAGES_AT_ONCE = 256

#: Element names of HTML by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math textarea select button canvas video audio head title".split())
NO_ARTICLE = frozenset("nav footer aside form menu dialog".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
BLOCKS = PROSE | NO_ARTICLE | frozenset(
    "html body article main header section div ul ol li dl dt dd table thead tbody tfoot tr td th caption figure figcaption "
    "address details summary fieldset hr center".split()
)
#: Elements that no class word marks.
NEVER_MARKED = frozenset("html body article main".split())
ENDS_PARAGRAPH = BLOCKS - frozenset("html body".split())
#: Words in class, id or role that mark what is no article.
MARKS = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo banner cookie cookies consent gdpr notice sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs footer masthead comment comments disqus respond related share sharing social newsletter subscribe popup modal "
    "search pagination contentinfo complementary".split()
)
_SAME_ENDS = {"li": ("li", ("ul", "ol")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S
)
_CLASS = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
_WHITE = re.compile(r"\s+")
_MASK = (1 << 64) - 1
#: Flips a digest, or its key, to that of the same subtree as prose of an article.
_AS_PROSE = 0x5DEECE66D1B54A33


class Node:
    __slots__ = ("tag", "parent", "marked", "parts", "text", "size", "prose", "digest", "label")

    def __init__(self, tag: str, parent: Node | None, label: str, said: str):
        self.tag, self.parent, self.label = tag, parent, label
        self.marked = tag in NO_ARTICLE or (tag not in NEVER_MARKED and bool(MARKS.intersection(_WORD.findall(said))))
        self.parts: list[Node | str] = []
        self.prose = tag in PROSE  # or holds some
        self.text, self.size, self.digest = False, 0, 0  # size: characters outside NO_ARTICLE elements


def parse(page: str) -> Node:
    """The tree of a page; elements whose content is no text are left out."""
    root = Node("#page", None, "", "")
    here, at, end = root, 0, len(page)
    open_now: Counter[str] = Counter()

    def close(node: Node) -> None:
        content = []
        for part in node.parts:
            if isinstance(part, str):
                if words := _WHITE.sub(" ", entities.unescape(part)).strip():
                    content.append("t" + words)
                    node.text = True
                    node.size += len(words)
            else:
                content.append(f"e{part.digest}")
                node.text |= part.text
                node.prose |= part.prose
                node.size += 0 if part.tag in NO_ARTICLE else part.size
        node.digest = xxhash.xxh64_intdigest("\x00".join([node.tag, node.label, *content]).encode("utf-8", "surrogatepass")) - (1 << 63)

    def leave(names, stops) -> None:
        nonlocal here
        if not any(open_now[n] for n in names):
            return
        node = here
        while node is not root and node.tag not in names:
            if node.tag in stops:
                return
            node = node.parent
        if node is root:
            return
        while True:
            close(here)
            open_now[here.tag] -= 1
            done, here = here, here.parent
            if done is node:
                return

    while at < end:
        tag = _TAG.search(page, at)
        begin = tag.start() if tag else end
        if begin > at:
            here.parts.append(page[at:begin])
        if not tag:
            break
        at = tag.end()
        name = tag["name"]
        if not name:
            continue
        name = name.lower()
        if tag["end"]:
            leave((name,), ("article", "main") if name not in ("article", "main", "body", "html") else ())
            continue
        if name in RAW:
            if not tag["rest"].endswith("/"):
                stop = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
                at = stop.end() if stop else end
            here.parts.append(" ")
            continue
        if name in ENDS_PARAGRAPH:
            leave(("p",), ENDS_PARAGRAPH - {"p"})
        if name in _SAME_ENDS:
            names, stops = _SAME_ENDS[name]
            leave(names.split(), stops)
        found = _CLASS.findall(tag["rest"]) if tag["rest"] else ()
        # the id of a paragraph or heading names its subject, not its role
        said = [" ".join(x[1:]).lower() for x in found if name not in PROSE or x[0].lower() != "id"]
        node = Node(name, here, " ".join(" ".join(x[1:]) for x in found).lower(), " ".join(said))
        here.parts.append(node)
        if name in VOID or tag["rest"].endswith("/"):
            close(node)
        else:
            here = node
            open_now[name] += 1
    while here is not root:
        close(here)
        here = here.parent
    close(root)
    _unmark_most(root)
    return root


def _unmark_most(root: Node) -> None:
    """No class word marks an element that holds more than half of the page's text."""
    node: Node | None = root
    while node is not None:
        most = [p for p in node.parts if not isinstance(p, str) and p.tag not in NO_ARTICLE and 2 * p.size > root.size]
        node = most[0] if most else None
        if node is not None:
            node.marked = False


def _articles(root: Node) -> list[Node]:
    """Outermost article or main elements with text that are not marked otherwise."""
    found, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.marked:
            continue
        if node.tag in ("article", "main") and node.text:
            found.append(node)
            continue
        stack += [p for p in reversed(node.parts) if not isinstance(p, str)]
    return found


def _eligible(node: Node) -> bool:
    return node.text and node.tag in BLOCKS and node.tag not in NEVER_MARKED


def subtrees(root: Node) -> dict[int, bool]:
    """Digests of all block elements that may be template, and whether they are prose of an article (if they
    are so in one place, and no prose in another, they count as prose)."""
    articles, out = {id(a) for a in _articles(root)}, {}
    stack = [(root, False, False)]
    while stack:
        node, inside, quoted = stack.pop()
        inside = inside or id(node) in articles
        quoted = inside and (quoted or node.tag in PROSE)
        if _eligible(node):
            out[node.digest] = out.get(node.digest, False) or quoted or (inside and node.prose)
        stack += [(p, inside, quoted) for p in node.parts if not isinstance(p, str)]
    return out


def main_text(root: Node, template: frozenset[int] | set[int]) -> str:
    articles = _articles(root)
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if words := _WHITE.sub(" ", entities.unescape("".join(line))).strip():
            blocks.append(words)
        line.clear()

    for top in articles or [root]:
        flush()
        stack: list[tuple[Node | str | None, bool]] = [(top, False)]
        while stack:
            node, inside = stack.pop()
            if node is None:
                flush()
                continue
            if isinstance(node, str):
                line.append(node)
                continue
            if node.marked or (_eligible(node) and node.digest in template):
                if node.tag in BLOCKS:  # an inline element does not end its paragraph
                    flush()
                continue
            if node.tag == "header" and not (articles and _holds_heading(node)):
                flush()
                continue
            if node.tag == "br":
                line.append(" ")
                continue
            if node.tag in BLOCKS or node is top:
                flush()
                stack.append((None, inside))
            stack += [(p, inside) for p in reversed(node.parts)]
        flush()
    return "\n".join(blocks)


def _holds_heading(node: Node) -> bool:
    stack = [node]
    while stack:
        one = stack.pop()
        if one.tag in ("h1", "h2", "h3"):
            return True
        stack += [p for p in one.parts if not isinstance(p, str)]
    return False


def host_of(url: str) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def _key(host: str, digest: int) -> int:
    """A digest of one host; the same subtree of another host has another key."""
    mixed = (digest & _MASK) ^ xxhash.xxh64_intdigest(host.encode("utf-8", "surrogatepass"))
    return mixed - (1 << 64) if mixed >> 63 else mixed


def _map_pages(df: DataFrame, schema: str, work) -> DataFrame:
    """``work`` makes lists of columns from the lists of columns of PAGES_AT_ONCE rows."""
    kinds = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, PAGES_AT_ONCE):
                columns = work(batch.slice(a, PAGES_AT_ONCE).columns)
                arrays = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, kinds)]
                yield pa.RecordBatch.from_arrays(arrays, schema=kinds)

    return df.mapInArrow(run, schema)


def page_blocks(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """host, page, keys: each distinct page of a host once, with the keys of its block elements."""

    def work(columns):
        hosts = columns[0].to_pylist()
        roots = [parse(page or "") for page in columns[1].to_pylist()]
        return [columns[0], [r.digest for r in roots], [[_key(h, d) for d in subtrees(r)] for h, r in zip(hosts, roots)]]

    rows = pages.select(host_of(url).alias("host"), F.col(html).alias("html"))
    return _map_pages(rows, "host string, page bigint, keys array<bigint>", work).dropDuplicates(["host", "page"])


def template_keys(blocks: DataFrame) -> DataFrame:
    """key: the subtrees that stand on enough distinct pages of their host, and as prose those that stand on
    enough for prose. No row gathers those of a host."""
    hosts = broadcast_if_bounded(blocks.groupBy("host").agg(F.count(F.lit(1)).alias("pages")))
    counts = blocks.select("host", F.explode("keys").alias("key")).groupBy("host", "key").agg(F.count(F.lit(1)).alias("n"))
    share = F.least(F.col("pages") * LEAST_SHARE, F.lit(float(ENOUGH_PAGES)))
    often = counts.filter(F.col("n") >= LEAST_PAGES).join(hosts, "host")
    plain = F.when(F.col("n") >= share, F.col("key"))
    prose = F.when(F.col("n") >= F.col("pages") * PROSE_SHARE, F.col("key").bitwiseXOR(F.lit(_AS_PROSE)))
    return often.select(F.explode(F.array_compact(F.array(plain, prose))).alias("key"))


def _templates_of_pages(blocks: DataFrame, keys: DataFrame) -> DataFrame:
    """host, page, template: the template keys among a page's own, plain and as prose."""
    salts = F.explode(F.array(*[F.lit(k) for k in range(SALTS)]))
    both = F.concat("keys", F.transform("keys", lambda k: k.bitwiseXOR(F.lit(_AS_PROSE))))
    own = blocks.select("host", "page", F.explode(both).alias("key"), F.pmod("page", F.lit(SALTS)).cast("int").alias("salt"))
    return own.join(keys.withColumn("salt", salts), ["key", "salt"]).groupBy("host", "page").agg(F.collect_list("key").alias("template"))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    kind = pages.select(page_id).schema[0].dataType.simpleString()
    schema = f"page_id {kind}, url string, text string, n_chars bigint"
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(url).alias("host"))
    blocks = staged(page_blocks(pages, url, html), "page-blocks")
    keys = staged(template_keys(blocks), "templates")

    if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        sent = pages.sparkSession.sparkContext.broadcast(_sorted_keys(keys))

        def known(columns):
            hosts, roots = columns[3].to_pylist(), [parse(page or "") for page in columns[2].to_pylist()]
            return _texts(columns, roots, [_among(sent.value, h, subtrees(r)) for h, r in zip(hosts, roots)])

        return _map_pages(rows, schema, known)

    def tree(columns):
        return [*columns, [parse(page or "").digest for page in columns[2].to_pylist()]]

    def joined(columns):
        hosts, roots = columns[3].to_pylist(), [parse(page or "") for page in columns[2].to_pylist()]
        return _texts(columns, roots, [_own(h, subtrees(r), set(found or ())) for h, r, found in zip(hosts, roots, columns[4].to_pylist())])

    paged = _map_pages(rows, f"page_id {kind}, url string, html string, host string, page bigint", tree)
    both = paged.join(_templates_of_pages(blocks, keys), ["host", "page"], "left")
    return _map_pages(both.select("page_id", "url", "html", "host", "template"), schema, joined)


def _sorted_keys(keys: DataFrame) -> bytes:
    return np.sort(keys.toArrow().column(0).to_numpy()).astype("<i8").tobytes()


def _asked(host: str, own: dict[int, bool]) -> list[int]:
    return [_key(host, d ^ _AS_PROSE if prose else d) for d, prose in own.items()]


def _own(host: str, own: dict[int, bool], template: set[int]) -> set[int]:
    """The digests whose keys, plain or as prose, are template."""
    return {d for d, key in zip(own, _asked(host, own)) if key in template}


def _among(sent: bytes, host: str, own: dict[int, bool]) -> set[int]:
    """The same, with the template keys sent in order."""
    keys, asked = np.frombuffer(sent, "<i8"), np.array(_asked(host, own), "<i8")
    if not len(keys) or not len(asked):
        return set()
    place = np.minimum(keys.searchsorted(asked), len(keys) - 1)
    return {d for d, there in zip(own, keys[place] == asked) if there}


def _texts(columns, roots: list[Node], templates: list[set[int]]) -> list:
    texts = [main_text(r, t) for r, t in zip(roots, templates)]
    return [columns[0], columns[1], texts, [len(t) for t in texts]]
