"""Main text of web pages by deducing the template of each host.

1. Every page is read into tokens: tags told apart by their path, runs of text by path and
   words, and orders (one once-only tag following another).
2. Over the pages of a host each token has an occurrence vector, its count on every page.
   Vectors are compared by two linear hashes, sums over pages of a page's hash times the
   count, so they aggregate before the shuffle and a host of any size is never gathered.
3. Tokens of one vector form an equivalence class.  Classes on enough of a host's pages
   count; a tag stays in its class only if an order token of the same class connects it
   (its place is the same on all pages); the class of the nearest tag above it is its
   class's parent.  These nested classes are the host's template.
   A text belongs to the template if its class is that of the nearest template tag above it.
4. What a page has between the template's tags are its slots.  Runs that belong to the
   template are its fixed text, inside an article too; the other runs are extracted.  Tags
   and class names rank the slots: those of the article without menus, adverts and the like
   are the main text.

A run is the text of one block that stands under the same marks: each piece is judged by the
tags open around it, so an inline advert or button leaves its sentence whole.  A name counts
inside an article if all its words speak of furniture ("comment-list"); one that only
contains such a word ("menu-card", "related-work") says nothing there, and the classes alone
decide.  What a name on an inline tag says ends with the block, unless the tag is closed
further on.

A class counts on LEAST_PAGES pages of different html at least: fewer do not tell fixed text
from shared text.  So a paragraph that only some pages share stays, as no tag has its
vector.  An article of which nothing but fixed text is left is kept as it is.

Defined results: null and empty html give the empty text; a null or odd url is a host of
its own kind (the empty host); broken or cut markup is read as far as it goes; long, deep and
unclosed inline markup loses no text; repeated rows give repeated results; an empty table
gives no rows; other columns stay, but one with the name of the result is replaced.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptoria.llm.common import free_name
from scriptoria.session import checkpointed

#: Tags whose text is never shown or never the article's.
SILENT = frozenset("script style noscript template iframe object svg canvas select textarea button title head".split())
ASIDE = frozenset("nav footer aside form menu dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head"
    " header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Tags within a line of text.
INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark output q s samp small span strike strong sub sup time tt u var".split())
#: Words in class, id or role that mark what is not the article.
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments contentinfo cookie cookies consent dialog disqus"
    " footer login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion related replies"
    " reply search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
#: Words that stand beside those in a name and change nothing.
PLAIN_WORDS = frozenset(
    "area article articles bar block body bottom box button buttons center column container content count entry form group head header heading holder"
    " icon icons inner item items label left line link links list main meta more page panel post posts reader readers right row section site slot"
    " stories story text title top unit user users view wrap wrapper".split())
#: Words in class, id or role that mark a page or article header.
HEADER_WORDS = frozenset(["header"])
#: Words that mark an article where no tag does.
BODY_WORDS = frozenset("article articlebody content entry main post story".split())
#: Least pages of different html in a class.
LEAST_PAGES = 3
#: Length from which on a path is written as its number.
LONG_PATH = 8192
#: Bits of the sketch of repeated pages, a power of two: 2 MB at most, whatever the input.
SKETCH_BITS, SKETCH_PART = 1 << 24, 1 << 15
#: A start of one of these ends an open one of the same kind.
SELF_CLOSING = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)(?:>|\Z)""", re.S)
ATTR = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node(NamedTuple):
    tag: str
    no: int  # the tag's number on the page
    path: str
    aside: bool  # not the article's, by a tag
    body: int  # 2 in an article, 1 in what looks like one
    header: bool  # in a page or article header, by a tag
    named: tuple[int, ...]  # tags above whose names say aside, by their number on the page
    headed: tuple[int, ...]  # tags above whose names say header
    loose: tuple[int, ...]  # inline tags among them that began before the block
    heading: bool


ROOT = Node("", -1, "", False, 0, False, (), (), (), False)


class Run(NamedTuple):
    path: str
    aside: bool
    body: int
    text: str
    block: int  # number of the block on the page
    pieces: tuple[tuple[int, str], ...]  # place in the block and text, white space as it was


def says_aside(names: list[str], article: bool) -> bool:
    """Whether a class, id or role marks furniture; in an article all words of the name must."""
    for name in names:
        words = {w.lower() for w in WORD.findall(name)}
        if words & ASIDE_WORDS and (not article or all(len(w) == 1 or w in ASIDE_WORDS or w in PLAIN_WORDS for w in words)):
            return True
    return False


def node(above: Node, block: Node, tag: str, attrs: str, no: int) -> Node:
    """The tag below *above*, the innermost block there being *block*."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTR.finditer(attrs)} if "=" in attrs else {}
    words = {w.lower() for v in found.values() for w in WORD.findall(v)}
    name = f"{tag}.{found['class']}" if "class" in found else tag
    aside = above.aside or tag in SILENT or tag in ASIDE
    header = above.header or tag == "header"
    body = 2 if strong(tag, found) and not aside else max(above.body, 1 if tag in BLOCKS and words & BODY_WORDS else 0)
    named, headed, loose = above.named, above.headed, above.loose
    if tag in BLOCKS:
        loose = (*loose, *(n for n in named if n not in block.named))
        named, headed = block.named, block.headed
    # the names of the whole page's tags say how it is laid out
    if tag not in ("html", "body") and words:
        if words & ASIDE_WORDS and says_aside([w for v in found.values() for w in v.split()], above.body == 2):
            named = (*named, no)
        if tag in BLOCKS and words & HEADER_WORDS:
            headed = (*headed, no)
    # a very long path starts anew from its number, so that deep nesting stays linear
    start = above.path if len(above.path) < LONG_PATH else f"/{number(above.path)}"
    return Node(tag, no, f"{start}/{name}", aside, body, header, named, headed, loose, above.heading or tag in HEADINGS)


def strong(tag: str, found: dict[str, str]) -> bool:
    return tag in ("article", "main") or found.get("role") == "main" or "articlebody" in found.get("itemprop", "").lower()


def wrappers(articles: list[tuple[tuple[int, ...], bool, int]], lengths: list[tuple[tuple[int, ...], int]]) -> set[int]:
    """Tags whose names hide nothing, as they hold the article or, where none is marked, most of the text.

    Of several articles those in the fewest named tags count, of these the unnamed ones if
    there are any: comments and adverts may be articles too.
    """
    if articles:
        least = min((len(above), own) for above, own, _ in articles)
        return {no for above, own, at in articles if (len(above), own) == least for no in (*above, at)}
    held: dict[int, int] = {}
    for marks, n in lengths:
        for no in marks:
            held[no] = held.get(no, 0) + n
    return {no for no, n in held.items() if 2 * n > sum(n for _, n in lengths)}


def read(html: str) -> tuple[list[str], list[Run]]:
    """Paths of all tags in order, and the runs of text."""
    stack, tags, read_runs, pending = [ROOT], [], [], []
    blocks = [ROOT]  # the stack's blocks
    closed: set[int] = set()  # inline tags ended by an end tag of their own
    articles: list[tuple[tuple[int, ...], bool, int]] = []  # named tags above, whether named itself, number
    flushed = 0

    def add(text: str) -> None:
        n = stack[-1]
        # what an inline tag never shows, as a button, is no piece of the sentence around it
        if text and not (n.aside and not blocks[-1].aside):
            pending.append((n, text))

    def flush() -> None:
        nonlocal flushed
        if not pending:
            return
        parts: dict[tuple, tuple[Node, list[tuple[int, str]]]] = {}
        for i, (n, text) in enumerate(pending):
            parts.setdefault(n[3:], (n, []))[1].append((i, entities.unescape(text)))
        pending.clear()
        for n, pieces in parts.values():
            text = " ".join("".join(t for _, t in pieces).split())
            if text or len(parts) > 1:
                read_runs.append((n, blocks[-1].path, text, flushed, tuple(pieces)))
        flushed += 1

    def close(names: tuple[str, ...], within: frozenset = frozenset()) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                inner = len(blocks)
                while blocks[inner - 1].no >= stack[i].no:
                    inner -= 1
                if inner < len(blocks) and stack[i].tag in INLINE:
                    # an inline tag that ends within a later block leaves that block open
                    del stack[i]
                    return
                if inner < len(blocks):
                    flush()
                    del blocks[inner:]
                closed.add(stack[i].no)
                del stack[i:]
                return
            if stack[i].tag in within:
                return

    at = 0
    while m := MARKUP.search(html, at):
        add(html[at:m.start()])
        at = m.end()
        if m["cdata"] is not None:
            add(m["cdata"])
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        # in a button or drawing there are no blocks of the text
        hidden = stack[-1].aside and not blocks[-1].aside
        if m["end"]:
            if tag in BLOCKS and not hidden:
                flush()
            close((tag,))
            continue
        if tag in BLOCKS and not hidden:
            flush()
        if hidden:
            pass
        elif tag in SELF_CLOSING:
            close(SELF_CLOSING[tag], frozenset("ul ol dl table tbody article section main div body".split()) - {tag})
        elif tag in BLOCKS:
            close(("p",), frozenset("article section main div td li body".split()))
        new = node(stack[-1], blocks[-1], tag, m["attrs"], len(tags))
        tags.append(new.path)
        if new.body == 2 and not new.aside and (stack[-1].body < 2 or tag in ("article", "main")):
            above = (*stack[-1].named, *stack[-1].headed)
            articles.append((above, (*new.named, *new.headed) != above, len(tags) - 1))
        if tag in VOID:
            if tag == "br":
                add(" ")
        elif tag in RAW:
            # raw text belongs to no block: it is passed over up to its own end tag
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
            at = end.end() if end else len(html)
        elif not m["attrs"].endswith("/") or tag in BLOCKS:
            stack.append(new)
            if tag in BLOCKS and not hidden:
                blocks.append(new)
    add(html[at:])
    flush()
    shown = wrappers(articles, [((*n.named, *n.headed), len(text)) for n, _, text, _, _ in read_runs if not n.aside])
    runs = []
    for n, path, text, block, pieces in read_runs:
        header = n.header and not (n.body == 2 and n.heading) or not (n.body and n.heading) and any(no not in shown for no in n.headed)
        named = any(no not in shown for no in n.named) or any(no in closed and no not in shown for no in n.loose)
        runs.append(Run(path, n.aside or header or named, n.body, text, block, pieces))
    return tags, runs


def main_text(runs: list[Run], fixed: set[int]) -> str:
    """The blocks of the best slots in page order, one line each."""
    own = [r for r in runs if not r.aside]
    slots = [r for r in own if not r.text or number("text", r.path, r.text) not in fixed] if fixed else own
    best = max((r.body for r in own if r.text), default=0)
    if best == 2 and all(r.body < 2 for r in slots if r.text):
        slots = own
    best = max((r.body for r in slots if r.text), default=0)
    blocks: dict[int, list[tuple[int, str]]] = {}
    for r in slots:
        if r.body == best:
            blocks.setdefault(r.block, []).extend(r.pieces)
    lines = (" ".join("".join(t for _, t in sorted(pieces)).split()) for pieces in blocks.values())
    return "\n".join(line for line in lines if line)


def number(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(parts)) - (1 << 63)


TAG, TEXT, ORDER = 0, 1, 2
TOKENS = "host string, token long, kind int, path string, above long, after long, v1 long, v2 long, rows long, count long"


def page_tokens(html: str) -> dict[int, list]:
    """token: [kind, path, token of the tag above, token it follows, count]."""
    tags, runs = read(html)
    out: dict[int, list] = {}
    for path in tags:
        token = number("tag", path)
        if token in out:
            out[token][4] += 1
        else:
            out[token] = [TAG, path, number("tag", path.rpartition("/")[0]), 0, 1]
    once = [t for t, v in out.items() if v[4] == 1]
    for before, token in zip(once, once[1:], strict=False):
        out[number("order", str(before), str(token))] = [ORDER, "", token, before, 1]
    for r in runs:
        token = number("text", r.path, r.text)
        if token in out:
            out[token][4] += 1
        else:
            out[token] = [TEXT, r.path, number("tag", r.path), 0, 1]
    return out


def host_of(url: str | Column) -> Column:
    url = F.col(url) if isinstance(url, str) else url
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def keyed(pages: DataFrame, html: str, url: str) -> DataFrame:
    """host, key, html: rows of one host and equal html are one page and have one key."""
    return pages.select(host_of(url).alias("host"), F.xxhash64(F.coalesce(F.col(html), F.lit(""))).alias("key"), F.coalesce(F.col(html), F.lit("")).alias("html"))


def host_pages(rows: DataFrame) -> DataFrame:
    """host, pages: how many pages of different html each host has."""
    return rows.groupBy("host", "key").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("one").alias("pages"))


def repeated_pages(rows: DataFrame) -> np.ndarray | None:
    """A sketch of the keys that several rows have: a set bit for each, others by chance; none: no bits at all.

    The bits are joined on the cluster in parts of 4 KB, SKETCH_BITS in all at most.
    """
    again = rows.groupBy("host", "key").count().where("count > 1").select(F.pmod("key", F.lit(SKETCH_BITS)).alias("bit"))
    place = F.col("bit") % SKETCH_PART
    parts = again.groupBy(F.expr(f"bit div {SKETCH_PART}").alias("part")).agg(F.bitmap_construct_agg(place).alias("bits")).collect()
    if not parts:
        return None
    bits = np.zeros(SKETCH_BITS // 8, np.uint8)
    for r in parts:
        at = r["part"] * SKETCH_PART // 8
        bits[at:at + SKETCH_PART // 8] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return bits


def occurrence(rows: DataFrame) -> DataFrame:
    """One row per host and token with the hashes of its occurrence vector and the number of rows that have it."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in TOKENS.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.string()] + [pa.int64()] * 6
        for batch in batches:
            sums: dict[tuple, list] = {}
            for host, key, page in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                a, b = key & 0x3FFFFFFF, (key >> 32) & 0x3FFFFFFF
                for token, (kind, path, above, after, n) in page_tokens(page).items():
                    s = sums.get((host, token))
                    if s is None:
                        sums[host, token] = [kind, path, above, after, a * n, b * n, 1, n]
                    else:
                        s[4] += a * n
                        s[5] += b * n
                        s[6] += 1
                        s[7] += n
            found = [(h, t, *v) for (h, t), v in sums.items()]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names)

    first = [F.first(c).alias(c) for c in ("kind", "path", "above", "after")]
    return rows.mapInArrow(count, TOKENS).groupBy("host", "token").agg(*first, *(F.sum(c).alias(c) for c in ("v1", "v2", "rows", "count")))


def copies(rows: DataFrame, bits: np.ndarray) -> DataFrame:
    """host, token, extra: how many rows more than pages have a token, from the rows whose page may be repeated."""
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = batch.column(1).to_numpy() & (SKETCH_BITS - 1)
            again = batch.filter(pa.array((shared.value[bit >> 3] >> (bit & 7) & 1).astype(bool)))
            held: dict[tuple, list] = {}
            for host, key, page in zip(*(again.column(i).to_pylist() for i in range(3)), strict=True):
                if (host, key) in held:
                    held[host, key][1] += 1
                else:
                    held[host, key] = [page_tokens(page), 1]
            found = [(h, t, k, n) for (h, k), (tokens, n) in held.items() for t in tokens]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], ["host", "token", "key", "n"])

    each = rows.mapInArrow(count, "host string, token long, key long, n long").groupBy("host", "token", "key").agg(F.sum("n").alias("n"))
    return each.groupBy("host", "token").agg((F.sum("n") - F.count("n")).alias("extra"))


NESTED = T.ArrayType(T.StructType().add("token", T.LongType()).add("kind", T.IntegerType()).add("path", T.StringType())
                     .add("class", T.LongType()).add("parent", T.LongType()))


@F.arrow_udf(NESTED)
def nest(hosts: pa.Array) -> pa.Array:
    """The template tags with the class of the nearest one above, and the texts of that one's class."""
    out = []
    for tokens in hosts.to_pylist():
        orders = {(t[side], t["class"]) for t in tokens if t["kind"] == ORDER for side in ("above", "after")}
        # order tokens of a class connect the tags on both of their sides
        frame = {t["token"]: t["class"] for t in tokens if t["kind"] == TAG and (t["token"], t["class"]) in orders}

        def nearest(path: str, frame: dict[int, int] = frame) -> int | None:
            while path and number("tag", path) not in frame:
                path = path.rpartition("/")[0]
            return frame.get(number("tag", path)) if path else None

        found = []
        for t in tokens:
            if t["kind"] == TAG and t["token"] in frame:
                found.append({c: t[c] for c in ("token", "kind", "path", "class")} | {"parent": nearest(t["path"].rpartition("/")[0])})
            elif t["kind"] == TEXT and nearest(t["path"]) == t["class"]:
                found.append({c: t[c] for c in ("token", "kind", "path", "class")} | {"parent": t["class"]})
        out.append(found)
    return pa.array(out, pa.list_(pa.struct([("token", pa.int64()), ("kind", pa.int32()), ("path", pa.string()), ("class", pa.int64()), ("parent", pa.int64())])))


def templates(pages: DataFrame, html: str = "html", url: str = "url", support: float = 0.5) -> DataFrame:
    """host, tokens: the template's tags and fixed texts with their class and its parent.

    A class counts from LEAST_PAGES different pages and *support* of the host's different
    pages on, so a host's row is about as large as two of its pages at most.
    """
    rows = keyed(pages, html, url)
    often = occurrence(rows).where(F.col("rows") >= LEAST_PAGES)
    bits = repeated_pages(rows)
    if bits is not None:
        # rows count pages, but for the copies
        often = often.join(copies(rows, bits), ["host", "token"], "left").withColumn("rows", F.col("rows") - F.coalesce("extra", F.lit(0)))
    often = often.where(F.col("rows") >= LEAST_PAGES).join(host_pages(rows), "host").where(F.col("rows") >= F.col("pages") * support)
    often = often.withColumn("class", F.xxhash64("v1", "v2"))
    tokens = often.groupBy("host").agg(F.collect_list(F.struct("token", "kind", "path", "above", "after", "class")).alias("all"))
    return tokens.select("host", nest("all").alias("tokens"))


RESULT = pa.struct([("text", pa.string()), ("slots", pa.list_(pa.struct([("slot", pa.string()), ("text", pa.string())])))])


@F.arrow_udf(T.StructType().add("text", T.StringType()).add(
    "slots", T.ArrayType(T.StructType().add("slot", T.StringType()).add("text", T.StringType()))))
def fill(html: pa.Array, tags: pa.Array, texts: pa.Array) -> pa.Array:
    out = []
    for page, frame, fixed in zip(html.to_pylist(), tags.to_pylist(), texts.to_pylist(), strict=True):
        _, runs = read(page)
        frame, fixed = set(frame), set(fixed)
        slots = []
        for r in runs:
            if number("text", r.path, r.text) in fixed:
                continue
            path = r.path
            while path and number("tag", path) not in frame:
                path = path.rpartition("/")[0]
            slots.append({"slot": path, "text": r.text})
        out.append({"text": main_text(runs, fixed), "slots": slots})
    return pa.array(out, RESULT)


def of_kind(tokens: str, kind: int) -> Column:
    return F.transform(F.filter(tokens, lambda t: t["kind"] == kind), lambda t: t["token"])


def extract(pages: DataFrame, html: str = "html", url: str = "url", out: str = "extracted") -> DataFrame:
    """*pages* with (text, slots) in column *out*; a slot is named by the template tag it stands in."""
    host, name, tags, texts = (free_name(pages, n) for n in ("template_host", "template_tokens", "template_tags", "template_texts"))
    found = templates(pages, html, url).select(F.col("host").alias(host), F.col("tokens").alias(name))
    # stored, so that the join deals both sides itself and can split the pages of a large host
    found = checkpointed(found.select(host, of_kind(name, TAG).alias(tags), of_kind(name, TEXT).alias(texts)))
    named = pages.withColumn(name, host_of(url))
    joined = named.join(found, F.col(name) == F.col(host), "left")
    none = F.expr("cast(array() as array<bigint>)")
    filled = fill(F.coalesce(F.col(html), F.lit("")), F.coalesce(F.col(tags), none), F.coalesce(F.col(texts), none))
    return joined.withColumn(out, filled).select(*[c for c in pages.columns if c.lower() != out.lower()], out)
