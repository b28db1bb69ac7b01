"""Main text of web pages: style trees of sites, importance of their branches by entropy, removal of the rest."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repomine.llm.text import free_names, map_batches, read_table
from repomine.operators.joins import small_side_join
from repomine.session import cut_lineage

# A branch of the style tree below this importance is noise, if so many pages of the site have it.
LEAST_IMPORTANCE = 0.3
LEAST_PAGES = 6
# Share of a branch's importance that its content has; the rest is that of its presentation.
CONTENT_SHARE = 0.9
# A branch with more than this share of the site's text is never noise, however alike the pages are, and whatever
# its class or id says.
MAIN_SHARE = 0.5

_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody "
    "td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Their content is not markup.
_RAW = frozenset("iframe noembed noframes noscript script style svg template textarea title xmp".split())
# Tags, roles and words in class or id that say a branch is not part of the article.
_NOISE_TAGS = _RAW | frozenset(
    "applet aside audio button canvas datalist dialog footer form head input label map math menu nav object optgroup "
    "option select video".split()
)
_NOISE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status tablist toolbar".split())
_NOISE_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "copyright disclaimer discussion disqus dropdown footer form login masthead menu modal nav navbar navigation newsletter "
    "notice notices notification overlay pager pagination popup promo promoted promotion recommended related replies reply "
    "respond search share sharing sidebar signup skip social sponsor sponsored sponsors subscribe subscription teaser "
    "toolbar topbar widget".split()
)
# An opening tag of the first kind ends the open elements of the second, up to the third.
_P_ENDS = _BLOCKS - {"body", "html"}
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}
_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*)>"""
    r"""|</?[a-zA-Z][^>]*\Z|</[^>]*(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
# Elements of an article that have no style of their own are its text: a site may hold copies of one article.
_ARTICLE_TEXT = r">article[^>]*+(?:>[a-z0-9]+)*+$"
# Elements nested deeper have the path of the one at this depth, so paths stay short. They open and close
# like any other.
_DEPTH = 256
_NUMBER = re.compile(r"\d+")
_WORDS = re.compile(r"[a-z]+")


@dataclass
class Node:
    """An element, or the style of it: elements of one path are one node of the site's style tree."""

    tag: str
    label: str
    path: str
    parent: Node | None
    # Tag, role or attributes of it, or of an element around it, say that it is noise.
    hard: bool
    # A word of its class or id says so.
    named: bool = False
    # What holds in the end, see ``_resolve``.
    noise: bool = False
    article: bool = False
    main: bool = False
    # An article or main element, or around one.
    holder: bool = False
    children: list[str] = field(default_factory=list)


@dataclass
class Block:
    """A run of text between block elements, as pieces with the element each stands in."""

    pieces: list[tuple[Node, str]]


def _attributes(rest: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(rest)}


def _label(tag: str, attributes: dict[str, str]) -> str:
    """Tag, classes and id, numbers left out: what elements of one style have in common."""
    if not attributes:
        return tag
    classes = "".join(f".{c}" for c in sorted(set(attributes.get("class", "").split())))
    own = f"#{attributes['id']}" if attributes.get("id") else ""
    return tag + _NUMBER.sub("0", re.sub(r"[\s>]", "_", classes + own))


def _is_noise(tag: str, attributes: dict[str, str], in_article: bool) -> bool:
    """Whether tag, role or attributes say so."""
    if tag in _NOISE_TAGS or (tag == "header" and not in_article):
        return True
    if not attributes:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", ""), re.I):
        return True
    return bool(_NOISE_ROLES & set(attributes.get("role", "").lower().split()))


def _is_named_noise(attributes: dict[str, str], in_article: bool) -> bool:
    """Whether a word of class or id says so."""
    if not attributes:
        return False
    named = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    words = set(_WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", named).lower()))
    return bool(words & _NOISE_WORDS) or (not in_article and "header" in words)


def _resolve(nodes: list[Node], kept: frozenset[str] | None) -> None:
    """Say of every node whether it is noise; without ``kept`` no class or id makes one so.

    The names of an article, a main element and the elements around them do not count, nor those of the
    paths in ``kept``. The elements of an article go by their names, articles in it too: those are comments.
    """
    for node in nodes:
        named = kept is not None and node.named and not node.holder and node.path not in kept
        node.noise = node.parent.noise or node.hard or named


def parse_page(html: str) -> tuple[list[Node], list[Block]]:
    """Elements and text blocks of a page, in order. Never fails: what is not understood is left out.

    Elements that are not closed end where a block of their kind begins; closing tags without an opening one
    are ignored; an unfinished tag or comment at the end is dropped. Which nodes are noise is said by
    ``_resolve``.
    """
    root = Node("", "", "", None, False)
    nodes, blocks, open_nodes = [], [], [root]
    open_tags: Counter[str] = Counter()
    pieces: list[tuple[Node, str]] = []

    def flush() -> None:
        nonlocal pieces
        if pieces:
            blocks.append(Block(pieces))
            pieces = []

    def close(kinds: set[str] | frozenset[str], limits: set[str] | frozenset[str]) -> None:
        if not any(open_tags[kind] for kind in kinds):
            return
        for at in range(len(open_nodes) - 1, 0, -1):
            if open_nodes[at].tag in kinds:
                if any(n.tag in _BLOCKS for n in open_nodes[at:]):
                    flush()
                open_tags.subtract(n.tag for n in open_nodes[at:])
                del open_nodes[at:]
                return
            if open_nodes[at].tag in limits:
                return

    at = 0
    while True:
        found = _TAG.search(html, at)
        text = html[at : found.start() if found else len(html)]
        if text:
            pieces.append((open_nodes[-1], text))
        if not found:
            break
        at = found.end()
        if found["data"]:
            pieces.append((open_nodes[-1], found["data"]))
        tag = (found["name"] or "").lower()
        if not tag:
            continue
        if found["end"]:
            if tag == "br":
                pieces.append((open_nodes[-1], " "))
            # A closing inline tag does not end the blocks around it.
            close({tag}, frozenset() if tag in _BLOCKS else _BLOCKS)
            if tag in _BLOCKS:
                flush()
            continue
        if tag in _P_ENDS:
            close({"p"}, {"table", "td", "th", "button", "article", "section", "div", "li"} - {tag} if tag == "p" else {"table", "td", "th", "button"})
            flush()
        if tag in _ENDS:
            close(*_ENDS[tag])
        parent = open_nodes[-1]
        attributes = _attributes(found["rest"]) if found["rest"].strip(" /\t\r\n") else {}
        label = _label(tag, attributes)
        in_article = parent.article or parent.main
        hard = parent.hard or _is_noise(tag, attributes, in_article)
        named = tag not in ("html", "body") and _is_named_noise(attributes, in_article)
        is_main = tag == "main" or attributes.get("role", "").lower() == "main"
        deep = len(open_nodes) > _DEPTH
        above = open_nodes[_DEPTH] if deep else parent
        path = above.path if deep else f"{parent.path}>{label}"
        named = named or deep and parent.named
        node = Node(tag, label, path, above, hard, named, False, parent.article or tag == "article", parent.main or is_main)
        if not hard and (is_main or tag == "article" and not parent.article):
            holder = node
            while holder is not None and not holder.holder:
                holder.holder = True
                holder = holder.parent
        if not deep:
            parent.children.append(label)
        if tag == "br":
            pieces.append((parent, " "))
        if tag in _VOID or found["rest"].endswith("/") and tag not in _BLOCKS and tag not in _RAW:
            continue
        nodes.append(node)
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        open_nodes.append(node)
        open_tags[tag] += 1
    flush()
    return nodes, blocks


def _site_part(blocks: list[Block]) -> list[Block]:
    """The blocks that may be main text: those of the articles, else those of the main part, else all.

    Pieces in branches that are named as menus, forms, notices and the like are left out.
    """
    useful = [Block([p for p in b.pieces if not p[0].noise]) for b in blocks]
    for kind in ("article", "main"):
        inside = [Block([p for p in b.pieces if getattr(p[0], kind)]) for b in useful]
        if any(t.strip() for b in inside for _, t in b.pieces):
            return inside
    return useful


def _plain(pieces: list[tuple[Node, str]]) -> str:
    return " ".join("".join(unescape(text) for _, text in pieces).split())


def _name_chars(nodes: list[Node], blocks: list[Block]) -> dict[str, int]:
    """Characters inside the paths whose class or id says noise, if no name counts; in all at the empty path."""
    _resolve(nodes, None)
    chars = {"": 0}
    around: dict[int, set[str]] = {0: set()}
    for node in nodes:
        own = {node.path} if node.named and not node.holder else set()
        above = around.get(id(node.parent), around[0])
        around[id(node)] = above | own if own else above
    for block in _site_part(blocks):
        for node, text in block.pieces:
            size = len("".join(text.split()))
            chars[""] += size
            for path in around.get(id(node), around[0]):
                chars[path] = chars.get(path, 0) + size
    return chars


def _kept_names(nodes: list[Node], blocks: list[Block]) -> frozenset[str]:
    """Paths of a page by itself whose share of the text overrules their names."""
    if not any(n.named for n in nodes):
        return frozenset()
    chars = _name_chars(nodes, blocks)
    return frozenset(p for p, n in chars.items() if p and n > MAIN_SHARE * chars[""])


def page_features(html: str, kept: frozenset[str] = frozenset()) -> list[tuple[str, bool | None, int, int]]:
    """``path, is_content, feature, chars`` of a page for the style tree of its site, each feature once.

    Every node has one presentation, the labels of its children, and as content the text blocks in it.
    Rows without ``is_content`` have the characters in the paths whose names say noise, which ``kept``
    overrules, and those of the whole page.
    """
    nodes, blocks = parse_page(html)
    names = _name_chars(nodes, blocks)
    _resolve(nodes, kept)
    content: dict[str, dict[int, int]] = {}
    for block in _site_part(blocks):
        text = _plain(block.pieces)
        if not text:
            continue
        feature = xxhash.xxh64_intdigest(text) >> 1
        node = block.pieces[0][0]
        while node is not None:
            content.setdefault(node.path, {})[feature] = len(text)
            node = node.parent
    shown: dict[str, set[str]] = {}
    for node in nodes:
        if not node.noise and node.path in content:
            shown.setdefault(node.path, set()).add(" ".join(node.children))
    features: list[tuple] = [(path, True, f, n) for path, found in content.items() for f, n in found.items()]
    features += [(path, False, xxhash.xxh64_intdigest("\n".join(sorted(s))) >> 1, 0) for path, s in shown.items()]
    return features + [(path, None, 0, n) for path, n in names.items()]


def page_text(html: str, low: frozenset[str], kept: frozenset[str] | None = None) -> str:
    """Main text of a page: its blocks without the branches ``low`` of the site's style tree.

    ``kept`` are the paths whose names the site's text overrules; None takes the page as a site of its own.
    """
    nodes, blocks = parse_page(html)
    _resolve(nodes, _kept_names(nodes, blocks) if kept is None else kept)
    texts = []
    for block in _site_part(blocks):
        pieces = [p for p in block.pieces if not low or not _below(p[0], low)]
        text = _plain(pieces)
        if text:
            texts.append(text)
    return "\n".join(texts)


def _below(node: Node | None, low: frozenset[str]) -> bool:
    while node is not None:
        if node.path in low:
            return True
        node = node.parent
    return False


def site_of(url: Column) -> Column:
    """Host of an address in lower case; null where there is none."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def _paths(text: str | None) -> frozenset[str]:
    return frozenset(text.split("\n")) if text else frozenset()


def _branches(pages: DataFrame) -> DataFrame:
    """What ``style_trees`` has, and ``name_share``, for every path; ``pages`` is null for those named as noise.

    ``pages`` may have ``_kept``, the paths of its site whose names do not count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for site, html, kept in zip(*(batch[c].to_pylist() for c in ("site", "html", "_kept"))):
                out += [(site, *f) for f in page_features(html or "", _paths(kept))]
            columns = list(zip(*out)) or [()] * 5
            kinds = [pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["site", "path", "is_content", "feature", "chars"])

    kept = F.col("_kept") if "_kept" in pages.columns else F.lit(None).cast("string").alias("_kept")
    features = map_batches(
        pages.where("site is not null").select("site", "html", kept), run,
        "site string, path string, is_content boolean, feature bigint, chars bigint",
    )
    counted = features.groupBy("site", "path", "is_content", "feature").agg(
        F.count("*").alias("k"), F.sum("chars").alias("chars")
    )
    shown, text, name = ~F.col("is_content"), F.col("is_content"), F.col("is_content").isNull()
    sums = counted.groupBy("site", "path").agg(
        F.sum(F.when(shown, F.col("k"))).alias("pages"),
        F.sum(F.when(shown, F.col("k") * F.log("k"))).alias("shown"),
        F.avg(F.when(text, F.log("k"))).alias("spread"),
        F.sum(F.when(~name, F.col("chars"))).alias("chars"),
        F.sum(F.when(name, F.col("chars"))).alias("name_chars"),
    )
    # Joined with its own rows below: written, so that the pages are parsed once for both.
    sums = cut_lineage(sums)
    whole = sums.where("path = ''").select("site", F.col("chars").alias("all_chars"), F.col("name_chars").alias("all_name_chars"))
    base = F.log("pages")
    presentation = F.when(F.col("pages") > 1, (base - F.col("shown") / F.col("pages")) / base).otherwise(1.0)
    content = F.when(F.col("pages") > 1, 1 - F.col("spread") / base).otherwise(1.0)
    measured = sums.withColumns({"presentation": presentation, "content": content})
    share = lambda part, all_of: F.when(F.col(all_of) > 0, F.col(part) / F.col(all_of))
    return measured.join(whole, "site").select(
        "site", "path", "pages", "presentation", "content",
        (CONTENT_SHARE * F.col("content") + (1 - CONTENT_SHARE) * F.col("presentation")).alias("importance"),
        share("chars", "all_chars").alias("share"),
        F.when(F.col("path") != "", share("name_chars", "all_name_chars")).alias("name_share"),
    )


def style_trees(pages: DataFrame) -> DataFrame:
    """``site, path, pages, presentation, content, importance, share`` of every branch of every site's tree.

    The pages of a site are merged by the paths of their elements. ``presentation`` is the entropy of the
    ways a node's children are arranged, ``content`` is one less the mean entropy with which its text blocks
    are spread over the pages, both to the base of the number of pages: near 0 for what all pages have alike.
    ``share`` is the branch's share of the site's text.

    Counted by partial sums of (site, path, feature), so a site with a third of all pages is many rows, not
    one group.
    """
    return _branches(pages).where("pages is not null").drop("name_share")


def extract_text(
    pages: DataFrame, least_importance: float = LEAST_IMPORTANCE, least_pages: int = LEAST_PAGES
) -> DataFrame:
    """``pages`` (``page_id, url, html``) with ``text`` and ``n_chars``, the main text and its code points.

    A branch is left out if its tag, role, class or id says what it is (menu, form, advert …), if it stands
    outside the page's article, or if the style tree of the site finds it of low importance and at least
    ``least_pages`` pages have it; unstyled elements of an article are its text and not judged. A class or id
    is not believed of ``html``, ``body``, an article, a main element and what is around them, nor of a branch
    with more than ``MAIN_SHARE`` of the site's text; sites with such a branch are measured once more with it.
    Character references are decoded, white space within a block is one space, blocks are joined by a line end.

    A null html is an empty page; a page without a host has no style tree and is a site of its own. Repeated
    rows count as pages of their own. Other columns pass through; ``text``, ``n_chars`` and ``site`` are
    replaced. An empty table gives an empty result.
    """
    pages = pages.drop("text", "n_chars", "site")
    columns = pages.columns
    sited_name, low_name, kept_name = free_names(columns, "_sited", "_low", "_kept")
    sited = pages.withColumn("site", site_of(F.col("url")))
    spread = F.xxhash64("page_id", "url")
    is_low = (
        ~F.col("path").rlike(_ARTICLE_TEXT) & (F.col("importance") < least_importance)
        & (F.col("pages") >= least_pages) & (F.col("share") <= MAIN_SHARE)
    )
    joined = lambda column: F.array_join(F.array_sort(F.collect_list(column)), "\n")

    def judged(sites: DataFrame) -> DataFrame:
        # The paths of a site's template; what differs from page to page is not in here.
        marked = _branches(sites).select(
            "site", F.when(is_low, F.col("path")).alias("low"),
            F.when(F.col("name_share") > MAIN_SHARE, F.col("path")).alias("kept"),
        )
        marks = marked.where("low is not null or kept is not null").groupBy("site").agg(joined("low").alias("_low"), joined("kept").alias("_kept"))
        return cut_lineage(marks)  # measured and joined

    searched = sited.select("site", "html", spread.alias("spread"))
    marks = judged(searched)
    overruled = marks.where("_kept <> ''").select("site", "_kept")
    if not overruled.isEmpty():
        again = judged(small_side_join(searched, overruled, ["site"], F.col("spread")))
        marks = marks.where("_kept = ''").unionByName(again)
    marks = marks.withColumnsRenamed({"_low": low_name, "_kept": kept_name})
    marked = small_side_join(sited, marks, ["site"], spread, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, tuple[frozenset[str], frozenset[str]]] = {}
        for batch in batches:
            texts = []
            for html, sited, *paths in zip(*(batch[c].to_pylist() for c in ("html", sited_name, low_name, kept_name))):
                key = tuple(paths)
                if key not in known:
                    known.clear()
                    known[key] = tuple(map(_paths, paths))
                low, kept = known[key]
                texts.append(page_text(html or "", low, kept if sited else None))
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            more = [pa.array(texts, pa.string()), pa.array(sizes)]
            yield pa.RecordBatch.from_arrays([batch[c] for c in columns] + more, names=[*columns, "text", "n_chars"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields)
    return map_batches(marked.select(*columns, F.col("site").isNotNull().alias(sited_name), low_name, kept_name), run, schema + ", text string, n_chars bigint")


def op1_html_extract(spark, sf_dir: str) -> DataFrame:
    return extract_text(read_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
