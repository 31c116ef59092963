"""Similar documents by blocked products of the document by shingle incidence.

Documents with equal shingle sets are one node.  To meet a similarity of t, two sets of size
n and m share at least t / (1 + t) * (n + m) shingles, their sizes differ by at most the
factor t, and in any common order of shingles they share one of the first
n - ceil(t * n) + 1.  The order used here begins with shingles of rare words, which others
have only if they copied them, and ends with shingles that stand out as common, by counts of
words and shingles in sketches of fixed size over all documents.  So neither frequent words
nor passages that many documents share bring unrelated ones together.

1. Nodes most of whose prefix no other node has are alone: a similar set would share more of
   it.  That leaves out documents which only share passages.  The others, while they share a
   shingle, are joined to the least node that has it; the connected parts of that graph hold
   every similar pair.
2. A part becomes one tile, or, if it is large, tiles of two blocks each: nodes are dealt to
   bands of similar size and blocks of bounded size, and only blocks of the same or the next
   band meet, as others cannot be similar.
3. Within a tile the product of the incidence with its transpose counts overlaps; pairs
   below the bound are dropped.  A tile returns a spanning set of links and the number of
   links of every node, so a group of copies costs rows in proportion to its size.
4. The components of those links are the classes.

Shingles are 64-bit hashes, sets are told apart by 128 bits.  Defined results: null and
empty texts and texts without words have no shingles, no links and a class of their own;
repeated rows are linked; null ids come last as a class's least id; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptoria.llm import words
from scriptoria.llm.common import among, forget, keep_marked, stored, whole_text
from scriptoria.llm.components import connected
from scriptoria.operators.scan import spread

#: Counters of a sketch, of which there are two (16 MB in all), and the pieces they are summed in.
SKETCH_BITS, PIECES = 20, 64
#: How many times longer a prefix is than needed to share one shingle.
EXTENDED = 1.6
#: Standard deviations by which a counter of a common shingle exceeds the mean.
STANDS_OUT = 8.0
#: Most nodes and shingles of a block on average: bounds of a task's memory only.
BLOCK_NODES, BLOCK_SHINGLES = 1000, 500_000
#: Shingles that more nodes of a tile have are multiplied densely, others pair by pair.
DENSE = 24
#: Slightly over 10 / 9 for t = 0.9: sizes that may be similar lie in the same or the next band.
BAND_MARGIN = 1.001


class Rarity:
    """Counts of words and of shingles, and the order of shingles that follows from them."""

    def __init__(self, counters: np.ndarray):
        word, shingle = np.split(counters, 2)
        mean = shingle.mean()
        self.word = np.log2(word + 1.0).astype(np.float32)
        common = shingle > mean + STANDS_OUT * np.sqrt(mean) + STANDS_OUT
        self.common = np.where(common, 1e6 + shingle, 0.0).astype(np.float32)

    def __call__(self, hashes: np.ndarray, rolled: np.ndarray, k: int) -> np.ndarray:
        """The place of every shingle in the order: the sum of its words' logarithms, or far behind."""
        logs = self.word[cell(hashes)]
        place = self.common[cell(rolled)]
        for i in range(k):
            place = place + logs[i: i + len(rolled)]
        return place


def cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def sketch(docs: DataFrame, text: str, k: int) -> np.ndarray:
    """How often the words, then the shingles of each counter stand in the documents."""
    size = 1 << SKETCH_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * size, np.int64)
        for batch in batches:
            for hashes, _ in words.hashed(batch.column(0)):
                # shingles over the ends of texts are counted too: noise of a counter's size
                total[:size] += np.bincount(cell(hashes), minlength=size)
                total[size:] += np.bincount(cell(words.rolled(hashes, k)), minlength=size)
        if total.any():
            pack = zstandard.ZstdCompressor(level=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(PIECES), pa.int32()), pa.array([pack.compress(p.tobytes()) for p in np.split(total, PIECES)], pa.binary())], ["piece", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(zstandard.decompress(counts), np.int64)
                sums[piece] = sums[piece] + part if piece in sums else part
        pack = zstandard.ZstdCompressor(level=1)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([pack.compress(p.tobytes()) for p in sums.values()], pa.binary())], ["piece", "counts"])

    schema = "piece int, counts binary"
    parts = docs.select(whole_text(text).alias("text")).mapInArrow(count, schema)
    # the sketches have a fixed size, whatever the documents' number
    rows = parts.repartition(PIECES, "piece").mapInArrow(add, schema).collect()
    total = np.zeros((PIECES, 2 * size // PIECES), np.int64)
    for r in rows:
        total[r["piece"]] += np.frombuffer(zstandard.decompress(bytes(r["counts"])), np.int64)
    return total.ravel()


def set_key(found: np.ndarray) -> bytes:
    """128 bits of a set."""
    spread = words.mix(found + np.uint64(0x5851F42D4C957F2D))
    return np.array([spread.sum(dtype=np.uint64), np.bitwise_xor.reduce(found) ^ np.uint64(len(found))], ">u8").tobytes()


def prefix(found: np.ndarray, place: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles in the order (hash decides ties).

    A set lacks at most n - ceil(t * n) of its n shingles in a similar set.  One more makes
    the prefix of which one is shared; it is taken EXTENDED times as long, so that more of
    it must be shared.
    """
    n = len(found)
    keep = n - -(-percent * n // 100) + 1
    return found[np.lexsort((found, place))[: int(EXTENDED * keep)]]


def signature(text: Column, rare, k: int, percent: int) -> Column:
    """n, node (the set's key) and prefix shingles of a text."""
    kind = pa.struct([("n", pa.int32()), ("node", pa.binary()), ("tokens", pa.list_(pa.int64()))])

    @F.arrow_udf("struct<n:int,node:binary,tokens:array<bigint>>")
    def sign(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        order = Rarity(rare.value)
        for texts in batches:
            n, nodes, tokens = [], [], []
            for hashes, counts in words.hashed(texts):
                for found, place in words.shingles(hashes, counts, k, order):
                    n.append(len(found))
                    nodes.append(set_key(found) if len(found) else b"")
                    tokens.append(prefix(found, place, percent).view(np.int64) if len(found) else np.zeros(0, np.int64))
            ends = np.cumsum([0] + [len(t) for t in tokens]).astype(np.int32)
            lists = pa.ListArray.from_arrays(ends, np.concatenate([*tokens, np.zeros(0, np.int64)]))
            yield pa.StructArray.from_arrays([pa.array(n, pa.int32()), pa.array(nodes, pa.binary()), lists], fields=list(kind))

    return sign(text)


def shingle_sets(text: Column, k: int) -> Column:
    @F.arrow_udf("struct<node:binary,shingles:binary>")
    def sets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = [f for hashes, counts in words.hashed(texts) for f, _ in words.shingles(hashes, counts, k)]
            yield pa.StructArray.from_arrays([pa.array([set_key(f) for f in found], pa.binary()), pa.array([f.tobytes() for f in found], pa.binary())], ["node", "shingles"])

    return sets(text)


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Numbers of common shingles of all pairs of sets: the incidence times its transpose.

    Columns that one set alone has add nothing; columns of few sets add pair by pair, those
    of many are multiplied as dense blocks.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    shingle = np.concatenate(sets)
    row = np.repeat(np.arange(m), sizes)
    order = np.argsort(shingle, kind="stable")
    shingle, row = shingle[order], row[order]
    starts = np.flatnonzero(np.append(True, shingle[1:] != shingle[:-1]))
    count = np.diff(np.append(starts, len(shingle)))
    total = np.zeros(m * m, np.int64)
    pairs: list[np.ndarray] = []

    def add(least: int) -> None:
        if pairs and sum(map(len, pairs)) >= least:
            total[:] += np.bincount(np.concatenate(pairs), minlength=m * m)
            pairs.clear()

    for width in range(2, DENSE + 1):
        members = row[starts[count == width][:, None] + np.arange(width)]
        for i in range(width if len(members) else 0):
            for j in range(i + 1, width):
                pairs.append(members[:, i] * m + members[:, j])
                add(max(m * m, 1 << 20))
    add(1)
    total = total.reshape(m, m).astype(np.float32)
    total += total.T
    many = np.flatnonzero(count > DENSE)
    for a in range(0, len(many), 2048):
        part = many[a:a + 2048]
        block = np.zeros((m, len(part)), np.float32)
        n = count[part]
        at = np.repeat(starts[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        block[row[at], np.repeat(np.arange(len(part)), n)] = 1
        total += block @ block.T
    return total


def spanning(link: np.ndarray) -> np.ndarray:
    """For each node of a link matrix the first node of its component."""
    m = len(link)
    root = np.full(m, -1)
    for start in range(m):
        if root[start] >= 0:
            continue
        front = np.array([start])
        root[start] = start
        while len(front):
            reached = np.flatnonzero(link[front].any(axis=0) & (root < 0))
            root[reached] = start
            front = reached
    return root


LINKS = "node binary, root binary, links bigint"


def product(percent: int):
    """Links of one tile: pairs of its two sides, and those within side 0 unless its name begins with x."""
    def run(table: pa.Table) -> pa.Table:
        seen: dict[bytes, tuple] = {}
        for node, side, copies, found in zip(*(table[c].to_pylist() for c in ("node", "side", "copies", "shingles")), strict=True):
            seen.setdefault(node, (side, copies, np.frombuffer(found, np.uint64)))
        nodes = sorted(seen)
        side, copies = np.array([seen[n][0] for n in nodes]), np.array([seen[n][1] for n in nodes], np.int64)
        sets = [seen[n][2] for n in nodes]
        sizes = np.array([len(s) for s in sets], np.int64)
        common = overlaps(sets).astype(np.int64)
        link = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
        apart = side[:, None] != side[None, :]
        link &= apart if table["tile"][0].as_py().startswith("x") else apart | (side == 0)[:, None] & (side == 0)[None, :]
        np.fill_diagonal(link, False)
        root, links = spanning(link), link @ copies
        some = np.flatnonzero(links)
        return pa.table({
            "node": pa.array([nodes[i] for i in some], pa.binary()), "root": pa.array([nodes[root[i]] for i in some], pa.binary()),
            "links": pa.array(links[some], pa.int64())})

    return run


def tiles(members: DataFrame, percent: int, block_nodes: int, block_shingles: int) -> DataFrame:
    """*members* (node, component, n, ...) with their tiles: array of (tile, side).

    A tile holds one block, a block and another one whose pairs alone count, or all of a
    small band with all of the next.
    """
    wide = F.lit(float(np.log(100 / percent) * BAND_MARGIN))
    members = members.withColumn("band", F.floor(F.ln(F.col("n").cast("double")) / wide).cast("int"))
    blocks = lambda: F.greatest(F.lit(1), F.ceil(F.sum("n") / block_shingles), F.ceil(F.count("*") / block_nodes)).cast("int")
    bands = members.groupBy("component", "band").agg(F.sum("n").alias("n"), F.count("*").alias("nodes"), blocks().alias("blocks"))
    # a component has as many bands as sizes differ by the factor 100 / percent: a few hundred at most
    plan = bands.groupBy("component").agg(
        F.sum("n").alias("all_n"), F.sum("nodes").alias("all_nodes"), F.map_from_entries(F.collect_list(F.struct("band", "blocks"))).alias("blocks"))
    plan = plan.select("component", "blocks", ((F.col("all_n") <= block_shingles) & (F.col("all_nodes") <= block_nodes)).alias("single"))
    dealt = members.join(plan, "component")
    blocks_of = lambda band: F.coalesce(F.try_element_at("blocks", band), F.lit(0))
    named = tile_names("single", "band", F.pmod(F.xxhash64("node"), blocks_of(F.col("band"))).cast("int"), *(blocks_of(F.col("band") + i) for i in (-1, 0, 1)))
    return dealt.withColumn("tiles", named).drop("blocks", "single", "band")


@F.arrow_udf(T.ArrayType(T.StructType().add("tile", T.StringType()).add("side", T.IntegerType())))
def tile_names(single: pa.Array, band: pa.Array, own: pa.Array, below: pa.Array, here: pa.Array, above: pa.Array) -> pa.Array:
    """The tiles of each node: x marks two blocks that are only compared with each other."""
    out = []
    for alone, b, i, down, n, up in zip(*(a.to_pylist() for a in (single, band, own, below, here, above)), strict=True):
        if alone:
            out.append([("", 0)])
            continue
        # a small band and the next share one tile; otherwise blocks meet one by one
        names = [(f"m:{b}", 0)] if n == 1 and up <= 1 else [
            *((f"m:{b}:{j}" if i == j else f"x:{b}:{min(i, j)}:{b}:{max(i, j)}", int(i > j)) for j in range(n)),
            *((f"x:{b}:{i}:{b + 1}:{j}", 0) for j in range(up))]
        names += [(f"m:{b - 1}", 1)] if down == 1 and n == 1 else [(f"x:{b - 1}:{j}:{b}:{i}", 1) for j in range(down)]
        out.append(names)
    return pa.array([[{"tile": t, "side": side} for t, side in names] for names in out], pa.list_(pa.struct([("tile", pa.string()), ("side", pa.int32())])))


def candidates(rows: DataFrame, nodes: DataFrame, percent: int, peelings: int = 3) -> DataFrame:
    """node, component of the nodes (node, n) that may be similar to another one; *rows* have node and tokens.

    Here nodes have 64-bit numbers; two nodes of one number would only be compared in vain.
    """
    # Of two similar sets, take the one whose prefix ends first in the order: what it shares with
    # the other within its prefix lies in both prefixes.  Its size is at least percent of this one's.
    least = F.ceil(F.col("n") * percent / 100)
    missing = least - F.ceil(least * percent / 100)
    needs = stored(nodes.select(F.xxhash64("node").alias("id"), (F.floor(EXTENDED * (missing + 1)) - missing).alias("need")))
    first = left = rows.select(F.xxhash64("node").alias("id"), "tokens")
    for _ in range(peelings):
        # dealt by shingle once, for the counts and for the join with them; rows of one node count once.
        # There are as many tasks as there are millions of shingles: a task's sorts stay in memory.
        many = left.agg(F.sum(F.size("tokens"))).first()[0] or 0
        postings = spread(left.select("id", F.explode("tokens").alias("token")), "token", rows=many).dropDuplicates(["token", "id"])
        shared = postings.groupBy("token").agg(F.count("*").alias("holders")).where("holders > 1").select("token")
        held = postings.join(shared.hint("merge"), "token").groupBy("id").agg(F.collect_list("token").alias("tokens"))
        held = held.join(needs, "id").where(F.size("tokens") >= F.col("need")).select("id", "tokens")
        before, left = left, stored(held)
        if before is not first:
            forget(before)
    postings = left.select("id", F.explode("tokens").alias("token"))
    leaders = postings.groupBy("token").agg(F.min("id").alias("leader"), F.count("*").alias("holders")).where("holders > 1")
    near = postings.join(leaders.select("token", "leader"), "token").where("id != leader").select(F.col("id").alias("a"), F.col("leader").alias("b"))
    parts = connected(near).select(F.col("node").alias("id"), "component")
    forget(needs, *([left] if peelings else []))
    return nodes.select("node", F.xxhash64("node").alias("id")).join(parts, "id").select("node", "component")


def similar(docs: DataFrame, k: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id",
            block_nodes: int = BLOCK_NODES, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, links, first: one row per document.

    *first* marks the class's least row by id (null ids last) and text, and rows equal to it.
    Classes are told apart by their nodes: ids may be null or stand for several texts.
    """
    spark = docs.sparkSession
    rare = spark.sparkContext.broadcast(sketch(docs, text, k))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(whole_text(text)).alias("text_hash"), signature(whole_text(text), rare, k, percent).alias("s"))
    signed = stored(rows.select("doc_id", "text_hash", "s.n", "s.node", "s.tokens"))
    # the prefixes go once the candidates are known; the rest is small
    rows = stored(signed.drop("tokens"))
    some = rows.where("n > 0")
    by_id = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    nodes = stored(some.groupBy("node").agg(F.first("n").alias("n"), F.min(by_id).alias("least"), F.count("*").alias("copies")))

    members = candidates(signed.where("n > 0").select("node", "tokens"), nodes, percent).join(nodes, "node")
    dealt = stored(tiles(members, percent, block_nodes, block_shingles))
    forget(signed)

    # Texts of members only, by id and text: many rows may have one id or none.  Members grow with
    # the documents, so they are merged with the texts at every size and never broadcast; a sketch
    # of them keeps most other texts from being moved.
    wanted = dealt.select("node", "component", "tiles", "copies", F.col("least.doc_id").alias("member_id"), F.col("least.text_hash").alias("member_hash"))
    texts = docs.select(F.col(doc_id).alias("id"), F.xxhash64(whole_text(text)).alias("hash"), whole_text(text).alias("text"))
    texts = texts.where(among(F.xxhash64("id", "hash"), wanted.select(F.xxhash64("member_id", "member_hash").alias("key"))))
    same = F.col("id").eqNullSafe(F.col("member_id")) & (F.col("hash") == F.col("member_hash"))
    sets = texts.join(wanted.hint("merge"), same).select("node", "component", "tiles", "copies", shingle_sets(F.col("text"), k).alias("s"))
    sets = sets.where(F.col("s.node") == F.col("node")).select("node", "component", "copies", "s.shingles", F.explode("tiles").alias("t"))
    links = sets.select("node", "component", "copies", "shingles", "t.tile", "t.side").groupBy("component", "tile").applyInArrow(product(percent), LINKS)
    links = stored(links)

    classes = connected(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.select("node", "least", "copies").join(classes, "node", "left").join(counted, "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least").alias("least"))
    named = named.drop("least").join(least, "component").select("node", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    first = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("text_hash") == F.col("least.text_hash"))
    classed = some.join(named, "node").select(
        "doc_id", "text_hash", F.col("n").cast("long").alias("n_shingles"), F.col("least.doc_id").alias("component_id"), "links", first.alias("first"))
    lone = rows.where("n = 0").select(
        "doc_id", "text_hash", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("links"), F.lit(True).alias("first"))
    return classed.unionByName(lone)


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of each class of similar documents (the least id, then text), with its columns; of equal rows one.

    Documents without words are no one's copy and stay.
    """
    told = similar(docs, k, percent, text, doc_id).select(F.col("doc_id").alias("k0"), F.col("text_hash").alias("k1"), F.col("first").alias("kept"), "n_shingles")
    # of several equal rows only one is kept
    told = told.groupBy("k0", "k1").agg(F.count("*").alias("n"), F.max("kept").alias("kept"), F.max("n_shingles").alias("s"))
    told = told.select("k0", "k1", F.explode(F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda i: F.col("kept") & ((i == 1) | (F.col("s") == 0)))).alias("kept"))
    return keep_marked(docs, [docs[doc_id], F.xxhash64(whole_text(docs[text]))], told)
