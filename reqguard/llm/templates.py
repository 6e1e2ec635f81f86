"""Main text of web pages by template deduction over the pages of a host.

Tokens are the opening and closing tags of containers, each with the path of containers it stands in.
Tokens that occur equally often on every page of a host share an occurrence vector and form an
equivalence class.  A class is valid when its tokens occur at most once a page and it holds a tag with
its closing tag, so that they nest; valid classes, by their paths, nest into the host's template.  The
slots of the template are what stands between a valid pair of tags; the one with the main text is the
deepest whose slot has most of what the pages say, headings counting for more.

An occurrence vector has a number for every page, so it is kept as two sums over pages of occurrences
times a random number of the page.  Sums add up in any order and before the shuffle, so a host with a
third of all pages costs its tasks a row per token.

What no template tells (menus, adverts, forms, comments within a slot) is told by tag, role and class
names.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

# --- Fixed values: element names and names of what is not main text ------------------------------
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "iframe", "svg", "math", "textarea", "object", "canvas", "title")
CONTAINERS = frozenset("html body main article section div td center".split())
BLOCKS = CONTAINERS | frozenset(
    "p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr th caption figure figcaption"
    " hr address details summary fieldset nav aside header footer form head".split()
)
HEADINGS = frozenset("h1 h2 h3".split())
NOT_MAIN_TAGS = frozenset("nav aside footer form head button select menu dialog label datalist audio video map".split())
NOT_MAIN_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
NOT_MAIN_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored banner promo promotion cookie cookies"
    " consent gdpr notice notices newsletter subscribe subscription signup sidebar aside menu nav navbar navigation"
    " breadcrumb breadcrumbs masthead header topbar footer comment comments respond disqus replies social share"
    " sharing related recommended recommendations popup modal overlay widget widgets toolbar pager pagination login"
    " search skip toc alert".split()
)
COMMENT_NAMES = frozenset("comment comments reply ad ads advert".split())
# A head is no part of the page's frame when it is that of the text.
HEAD_NAMES = frozenset("header masthead banner".split())
TEXT_NAMES = frozenset("entry post article story".split())
# Words that tell where something stands or how it is laid out, and nothing of what it says.
LAYOUT_NAMES = frozenset(
    "a area bar block bottom box button buttons center column container content desktop div entry field fixed float"
    " form grid group holder icon icons inner item items left link links list main mobile outer page panel post posts"
    " article right row section site slot small sticky story text the title top unit view wrap wrapper zone".split()
)
# Opening a block ends an open paragraph; a list item ends the one before it, and so on.
ENDS_SAME = {"li": "li", "dt": "dd", "dd": "dt", "tr": "tr", "td": "th", "th": "td", "option": "option"}
# --- end of fixed values -------------------------------------------------------------------------
HEADING_WEIGHT = 50
MAIN_SHARE = 0.6

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[A-Za-z]+")
_NUMBER = re.compile(r"\d{3,}")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}

TOKEN_SCHEMA = "host string, path string, side int, pages bigint, times bigint, v1 bigint, v2 bigint, weight bigint"


def host_of(url: str | None) -> str:
    """The host of an address, lower-cased; empty when there is none."""
    found = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#\s]*)", url or "")
    return found[1].lower() if found else ""


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(text)} if text.strip() else {}


def told_by(attrs: dict[str, str], telling: frozenset[str]) -> bool:
    """Whether a whole class name, or the id, is a telling name, but for words of layout."""
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        words = {w.lower() for w in _NAME.findall(_CAMEL.sub(" ", name))}
        told = words & telling
        if told and words <= telling | LAYOUT_NAMES and not (words & TEXT_NAMES and told <= HEAD_NAMES):
            return True
    return False


def not_main(tag: str, attrs: dict[str, str], in_article: bool) -> bool:
    if tag in ("html", "body", "main"):
        return False
    if tag in NOT_MAIN_TAGS or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true":
        return True
    if tag == "header":
        # The head of an article has its title.
        return not in_article
    if attrs.get("role", "").lower() in NOT_MAIN_ROLES:
        return True
    if tag in HEADINGS or tag == "p" or not attrs:
        return False
    if tag == "article":
        return told_by(attrs, COMMENT_NAMES)
    return told_by(attrs, NOT_MAIN_NAMES - HEAD_NAMES if in_article else NOT_MAIN_NAMES)


class Page:
    """Blocks of text with the container they stand in, and the containers with their paths.

    A path is the number of containers in it and a hash of them, so that deep pages have short ones.
    """

    def __init__(self, source: str) -> None:
        self.paths: list[str] = [""]
        self.parents: list[int] = [-1]
        self.closed: list[bool] = [True]
        self.seen: dict[tuple[int, str], int] = defaultdict(int)
        # (container, text, is heading, not main)
        self.blocks: list[tuple[int, str, bool, bool]] = []
        self._parse(source)

    def _parse(self, source: str) -> None:
        # Open elements: tag, container it is (or stands in), whether something around it is not main,
        # whether it is or stands in an article.
        stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]
        buffer: list[str] = []

        def flush() -> None:
            if buffer:
                text = " ".join(html_lib.unescape("".join(buffer)).split())
                buffer.clear()
                if text:
                    heading = any(t in HEADINGS for t, *_ in stack[-3:])
                    self.blocks.append((stack[-1][1], text, heading, stack[-1][2]))

        def close_to(depth: int) -> None:
            while len(stack) > depth:
                stack.pop()

        at, n = 0, len(source)
        while at < n:
            m = _TAG.search(source, at)
            if not m:
                buffer.append(source[at:])
                break
            if m.start() > at:
                buffer.append(source[at : m.start()])
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            tag, closing = name.lower(), bool(m[1] or m[4])
            if tag == "br" or tag == "wbr":
                buffer.append(" " if tag == "br" else "")
                continue
            if tag in RAW:
                if not closing and not (m[3] or m[6] or "").rstrip().endswith("/"):
                    end = _RAW_END[tag].search(source, at)
                    at = end.end() if end else n
                continue
            if tag in BLOCKS or tag in NOT_MAIN_TAGS:
                flush()
            if closing:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] == tag:
                        if tag in CONTAINERS:
                            self.closed[stack[depth][1]] = True
                        close_to(depth)
                        break
                    # A stray closing tag does not reach beyond its container.
                    if stack[depth][0] in CONTAINERS and tag not in CONTAINERS:
                        break
                continue
            if tag in VOID:
                continue
            if tag in BLOCKS:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] == "p" or stack[depth][0] in (ENDS_SAME.get(tag), tag if tag in ENDS_SAME else None):
                        close_to(depth)
                        break
                    if stack[depth][0] in BLOCKS:
                        break
            attrs = attributes(m[3] or m[6] or "")
            _, inside, outside, in_article = stack[-1]
            outside = outside or not_main(tag, attrs, in_article)
            if tag in CONTAINERS:
                # Long numbers in class names are those of one page.
                kind = ".".join([tag, *sorted(_NUMBER.sub("#", attrs.get("class", "")).lower().split())])
                # Equal tags in one place are told apart by their number.
                self.seen[inside, kind] += 1
                around = self.paths[inside]
                depth = int(around.partition(">")[0] or 0) + 1
                mark = xxhash.xxh3_128_hexdigest(f"{around}>{kind}[{self.seen[inside, kind]}]")
                self.paths.append(f"{depth}>{mark}")
                self.parents.append(inside)
                self.closed.append(False)
                inside = len(self.paths) - 1
            stack.append((tag, inside, outside, in_article or tag == "article"))
        flush()

    def weights(self) -> list[int]:
        """Characters of main-like text below each container."""
        out = [0] * len(self.paths)
        for container, text, heading, outside in self.blocks:
            if not outside:
                out[container] += len(text) * (HEADING_WEIGHT if heading else 1)
        # A container comes after the one it stands in.
        for k in range(len(out) - 1, 0, -1):
            out[self.parents[k]] += out[k]
        return out

    def text(self, template: list[str]) -> str:
        """Blocks of the main slot: the first path of the template that the page has once, or all."""
        main = 0
        for path in template:
            found = [k for k, p in enumerate(self.paths) if p == path]
            if len(found) == 1:
                main = found[0]
                break
        within = [False] * len(self.paths)
        for k in range(len(self.paths)):
            within[k] = k == main or (self.parents[k] >= 0 and within[self.parents[k]])
        return "\n\n".join(t for k, t, _, outside in self.blocks if within[k] and not outside)


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = [x.split()[0] for x in TOKEN_SCHEMA.split(", ")]
    kinds = (pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 5)
    for batch in batches:
        sums: dict[tuple[str, str, int], list[int]] = defaultdict(lambda: [0] * 5)
        for url, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            page, host = Page(source or ""), host_of(url)
            mark = xxhash.xxh3_64_intdigest(f"{url}\0{source}")
            r1, r2 = mark >> 33, mark & 0x7FFFFFFF
            weights = page.weights()
            opened: dict[tuple[str, int], int] = defaultdict(int)
            weight: dict[str, int] = defaultdict(int)
            for k, path in enumerate(page.paths):
                opened[path, 0] += 1
                opened[path, 1] += page.closed[k]
                weight[path] += weights[k]
            for (path, side), times in opened.items():
                if times:
                    row = sums[host, path, side]
                    for i, x in enumerate((1, times, times * r1, times * r2, weight[path])):
                        row[i] += x
        if sums:
            columns = zip(*[(*key, *row) for key, row in sums.items()], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], fields)


def host_templates(pages: DataFrame) -> DataFrame:
    """host and the paths of its template's slots that hold the main text, deepest first."""
    counted = (
        pages.select("url", "html")
        .mapInArrow(_tokens, TOKEN_SCHEMA)
        .groupBy("host", "path", "side")
        .agg(*[F.sum(c).alias(c) for c in ("pages", "times", "v1", "v2", "weight")])
    )
    counted = stored(counted)
    vector = ["host", "v1", "v2", "pages", "times"]
    # Tokens of one host with one occurrence vector are a class; at most once a page.
    once = counted.where("times = pages")
    classes = once.groupBy(*vector).agg(F.count(F.lit(1)).alias("tokens")).where("tokens >= 2")
    own = once.join(classes, vector, "left_semi")
    # Both tags of a container in one class nest.
    pairs = own.groupBy(*vector, "path").agg(F.count(F.lit(1)).alias("sides"), F.max("weight").alias("weight"))
    pairs = pairs.where("sides = 2")
    # The page itself is the token that all pages of a host have once.
    whole = counted.where("path = '' and side = 0").select("host", F.col("pages").alias("all_pages"), F.col("weight").alias("all_weight"))
    rated = pairs.join(whole, "host").where("path <> ''")
    # A slot's share is taken over the pages that have it.
    share = F.col("weight") * F.col("all_pages") >= MAIN_SHARE * F.col("all_weight") * F.col("pages")
    kept = rated.where(share & (F.col("weight") > 0)).withColumn("depth", F.substring_index("path", ">", 1).cast("int"))
    order = F.struct((-F.col("depth")).alias("d"), (-F.col("pages")).alias("p"), F.col("path").alias("path"))
    # A host has few paths that hold most of its text: those of one nest, and of each of its layouts.
    return kept.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["path"]).alias("template"))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sources, templates = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        texts = [Page(s or "").text(t or []) for s, t in zip(sources, templates, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row for each row of ``pages``.

    A null or empty page has an empty text.  Pages without a host are one host's; a page that has
    no slot of its host's template gives all of its blocks but those told by their names.  Repeated
    rows give a row each; other columns are not read; an empty table gives no rows.
    """
    address = r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#\s]*)"
    templates = stored(host_templates(pages))
    rows = pages.select("page_id", "url", "html", F.coalesce(F.lower(F.regexp_extract("url", address, 1)), F.lit("")).alias("host"))
    joined = rows.join(templates, "host", "left").select("page_id", "url", "html", "template")
    return joined.mapInArrow(_extracted, "page_id bigint, url string, text string, n_chars bigint")
