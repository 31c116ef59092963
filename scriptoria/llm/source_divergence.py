"""How far the sources of a language differ in their words, and in which.

1. Tasks count the terms of their rows by group (language, source); the partial counts are
   shuffled once, by language and term, and summed.  A language keeps the terms that enough of
   its documents hold.
2. A language's kept terms are dealt to blocks by hash; a block is cut into as few tiles of
   sources as needed, and every pair of tiles meets once a block.  Inside a block a term's id is
   its place by falling count, so that rare terms, whose counts agree most, stand together.
3. There the counts of all groups become hash-consed segment trees, and pairs of groups are
   priced by a memoized walk of two trees at once (see ``count_trees``).  Sums over blocks give
   the distance of two sources.  The leaves of a group's and its language's tree tell the terms
   that the group uses more.

Group sizes travel with the groups' rows to every block; nothing is collected or broadcast
(Spark may broadcast a join below its own threshold).  All numbers are exact integers, up to
9e15 terms in a group.

Defined results: null text, language and source are empty strings; terms are runs of ASCII
letters and all characters from U+0080 on, with A-Z alone in lower case; repeated rows count as
often as they stand; a group without terms takes part with counts of nothing; a language without
kept terms has distances of 0 and no terms; an empty table gives no rows; other columns are not
looked at.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.llm.common import stored
from scriptoria.llm.count_trees import Forest, shares
from scriptoria.operators.scan import attach_group_values, spread

LEAST_DOCUMENTS = 30
EXTRA = 5
TOP_TERMS = 50
#: Terms of a block and sources of a tile: bounds of a task's memory only.
BLOCK_TERMS = 256
TILE_SOURCES = 64
#: Parts of a language's terms in a join.
SALTS = 64
#: Entries and bytes of terms a task counts before it hands them on, bytes of a text cut at once.
COUNTED, COUNTED_BYTES, CUT_BYTES = 400_000, 16 << 20, 1 << 20

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: A task's number for a term: occurrences and, above them, documents.
ONE_DOCUMENT = 1 << 40
PARTIAL = "lang string, source string, term string, count long, docs long"
GROUP, TOTAL, COUNT = 0, 1, 2
PRICED = "lang string, source string, part string, item string, value long"


def text_terms(data: bytes) -> Counter:
    """Terms of a text in UTF-8 and how often they occur."""
    data = data.translate(_LETTERS)
    if len(data) <= CUT_BYTES:
        return Counter(data.split())
    out: Counter = Counter()
    at = 0
    while at < len(data):
        end = data.find(b" ", at + CUT_BYTES)
        end = len(data) if end < 0 else end
        out.update(data[at:end].split())
        at = end
    return out


def partial_counts(docs: DataFrame) -> DataFrame:
    """PARTIAL rows of (text, lang, source); each group also gives the empty term with no count."""
    def flushed(held: dict) -> pa.RecordBatch:
        rows = [(lang, source, term.decode(), n % ONE_DOCUMENT, n // ONE_DOCUMENT) for (lang, source), terms in held.items() for term, n in terms.items()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(),) * 3 + (pa.int64(),) * 2, strict=True)], ["lang", "source", "term", "count", "docs"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = defaultdict(dict)
        entries = size = 0
        for batch in batches:
            for text, lang, source in zip(*batch.columns, strict=True):
                mine = held[lang.as_py() or "", source.as_py() or ""]
                before = len(mine)
                mine.setdefault(b"", 0)
                for term, n in text_terms(text.as_buffer().to_pybytes() if text.is_valid else b"").items():
                    have = mine.get(term)
                    if have is None:
                        have, size = 0, size + len(term)
                    mine[term] = have + n + ONE_DOCUMENT
                entries += len(mine) - before
                if entries > COUNTED or size > COUNTED_BYTES:
                    yield flushed(held)
                    held, entries, size = defaultdict(dict), 0, 0
        if held:
            yield flushed(held)

    return docs.mapInArrow(count, PARTIAL)


def kept_counts(docs: DataFrame, least: int = LEAST_DOCUMENTS, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, count, total (of the language), first (once a kept term and language); the empty term stands for the group."""
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source"))
    # one exchange by language and term serves both sums
    dealt = partial_counts(rows).repartition("lang", "term")
    summed = dealt.groupBy("lang", "term", "source").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    placed = summed.select(
        "lang", "source", "term", "count", F.sum("docs").over(of_term).alias("in_docs"), F.sum("count").over(of_term).alias("total"),
        (F.row_number().over(of_term.orderBy("source")) == 1).alias("first"))
    return placed.where((F.col("term") == "") | (F.col("in_docs") >= least)).drop("in_docs")


def sizes(counts: DataFrame, block_terms: int, tile_sources: int) -> DataFrame:
    """lang, source, n (kept terms of the group), v and lang_n (of the language), blocks, tiles: one row a group."""
    groups = counts.groupBy("lang", "source").agg(
        F.sum("count").alias("n"), F.count(F.when(F.col("first") & (F.col("term") != ""), 1)).alias("firsts"))
    langs = groups.groupBy("lang").agg(F.sum("firsts").alias("v"), F.sum("n").alias("lang_n"), F.count("*").alias("groups"))
    langs = langs.select(
        "lang", "v", "lang_n", F.greatest(F.lit(1), F.ceil(F.col("v") / block_terms)).cast("int").alias("blocks"),
        F.ceil(F.col("groups") / tile_sources).cast("int").alias("tiles"))
    return groups.drop("firsts").join(langs, "lang")


def _pairs_of_tiles(tile: Column, tiles: Column) -> Column:
    """All pairs of tiles, lower one first, that a tile is part of."""
    return F.explode(F.transform(F.sequence(F.lit(0), tiles - 1), lambda k: F.struct(F.least(tile, k).alias("i"), F.greatest(tile, k).alias("j"))))


def block_rows(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of every block and pair of tiles: groups with their sizes, totals of terms, counts of terms in groups."""
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")
    tile = F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int")
    # a language's sizes reach all of its terms, spread over tasks, since one language may hold most terms
    langs = groups.groupBy("lang").agg(*(F.first(c).alias(c) for c in ("v", "lang_n", "blocks", "tiles")))
    terms = attach_group_values(counts.where("term <> ''"), langs, ["lang"], SALTS).withColumn("block", block)
    per_group = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "lang", "block", _pairs_of_tiles(tile, F.col("tiles")).alias("at"), F.lit(GROUP).alias("kind"), "source", F.lit(None).cast("string").alias("term"),
        F.col("n").alias("count"), "v", "lang_n", tile.alias("tile"))
    per_term = terms.where("first").select(
        "lang", "block", F.explode(F.expr("flatten(transform(sequence(0, tiles - 1), i -> transform(sequence(i, tiles - 1), j -> struct(i, j))))")).alias("at"),
        F.lit(TOTAL).alias("kind"), F.lit(None).cast("string").alias("source"), "term", F.col("total").alias("count"), "v", "lang_n", F.lit(-1).alias("tile"))
    per_count = terms.select(
        "lang", "block", _pairs_of_tiles(tile, F.col("tiles")).alias("at"), F.lit(COUNT).alias("kind"), "source", "term", "count", "v", "lang_n", tile.alias("tile"))
    return per_group.unionAll(per_term).unionAll(per_count).select("lang", "block", "at.i", "at.j", "kind", "source", "term", "count", "v", "lang_n", "tile")


def price_block(table: pa.Table, extra: int, top: int) -> pa.Table:
    """PRICED rows of a block and pair of tiles."""
    kind, count = table["kind"].to_numpy(), table["count"].to_numpy()
    source, term, tile = (np.array(table[c].to_pylist(), object) for c in ("source", "term", "tile"))
    lang, v, lang_n = (table[c][0].as_py() for c in ("lang", "v", "lang_n"))
    i, j = table["i"][0].as_py(), table["j"][0].as_py()

    g = np.flatnonzero(kind == GROUP)
    names, group_n, side = source[g], count[g], tile[g].astype(np.int64)
    group_at = {s: k for k, s in enumerate(names)}
    t = np.flatnonzero(kind == TOTAL)
    t = t[np.lexsort((term[t].astype(str), -count[t]))]
    terms, totals = term[t], count[t]
    term_at = {s: k for k, s in enumerate(terms)}
    held = np.zeros((len(names) + 1, len(terms)), np.int64)
    c = np.flatnonzero(kind == COUNT)
    held[[group_at[s] for s in source[c]], [term_at[s] for s in term[c]]] = count[c]
    held[-1] = totals  # the language's own tree
    forest = Forest(held)

    a, b = np.triu_indices(len(names), 1)
    meet = (np.minimum(side[a], side[b]) == i) & (np.maximum(side[a], side[b]) == j)
    a, b = a[meet], b[meet]
    value, _ = forest.prices(a, b, np.append(group_n, lang_n), v, extra)
    out = [(names[a], "pair", names[b], value), (names[b], "pair", names[a], value)]
    if i == j:
        over = shares(held[:-1], group_n[:, None], v, extra) - shares(held[-1:], np.full((1, 1), lang_n), v, extra)
        over[held[:-1] == 0] = 0
        utf8 = np.argsort(np.argsort(np.array([s.encode() for s in terms], object), kind="stable"), kind="stable")
        for k, name in enumerate(names):
            best = np.flatnonzero(over[k] > 0)
            best = best[np.lexsort((utf8[best], -over[k][best]))][:top]
            out.append(([name] * len(best), "term", terms[best], over[k][best]))
    sources, items = (np.concatenate([np.asarray(o[n], object) for o in out]) for n in (0, 2))
    parts, values = [o[1] for o in out for _ in range(len(o[0]))], np.concatenate([o[3] for o in out])
    return pa.table({
        "lang": pa.array([lang] * len(sources), pa.string()), "source": pa.array(sources, pa.string()), "part": pa.array(parts, pa.string()),
        "item": pa.array(items, pa.string()), "value": pa.array(values, pa.int64())})


def diverge(docs: DataFrame, least: int = LEAST_DOCUMENTS, extra: int = EXTRA, top: int = TOP_TERMS,
            block_terms: int = BLOCK_TERMS, tile_sources: int = TILE_SOURCES) -> DataFrame:
    """lang, source, part, item, value, rank: the distances of a source from all others, and the terms it uses more than its language."""
    counts = stored(kept_counts(docs, least))
    rows = block_rows(counts, sizes(counts, block_terms, tile_sources))
    # dealt by block, whatever the rows were dealt by before: a language is no task
    rows = spread(rows, "lang", "block", "i", "j")
    priced = stored(rows.groupBy("lang", "block", "i", "j").applyInArrow(lambda table: price_block(table, extra, top), PRICED))
    ranked = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = priced.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    terms = priced.where("part = 'term'")
    rank = F.row_number().over(ranked).alias("rank")
    # Spark cuts each task's rows to the best of a group before they meet
    return pairs.select("*", rank).unionAll(terms.select("*", rank).where(F.col("rank") <= top))
