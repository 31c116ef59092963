"""Secrets: pattern candidates, told apart by who owns copies of the same value.

Every candidate value is hashed; over the whole corpus the number of distinct documents
(repositories) and sources (owners) that hold a hash is counted.  A value held by several
owners, or by many repositories, is a copied example; a value of one owner looks live.

Only DataFrame functions are used.  The candidates of a document are found in one narrow
step and written once to the checkpoint folder without their text; counting aggregates
(hash, owner) before the shuffle, so a value that a third of the rows hold costs a row for
each task; a row gets its verdicts back by joining on the hash.

Defined results: a null text is the empty text; a null source is an owner of its own;
repeated rows give repeated results and count as one repository each; an empty table
gives no rows; other columns are not returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptoria.llm.common import bound, whole_text
from scriptoria.session import checkpointed

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "vendor")

ASSIGN = (r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
          r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
# Runs are maximal and a rejected run holds no shorter match that passes, so their least
# length can stand in the pattern; an assignment is checked after matching instead.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Fixed formats of keys that name their issuer.
VENDOR = (r"-----BEGIN [A-Z ]*PRIVATE KEY-----|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
          r"|gh[oprsu]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}")
PATTERNS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "vendor": VENDOR}
LEAST_ASSIGNED = 6
#: Matches that are gone through at once.
PIECE = 256

SPAN = "struct<start:int,kind_no:int,kind:string,end:int,hash:binary>"


def matches(text: Column, kind: str) -> Column:
    """Leftmost matches of one kind with code-point offsets.

    What ``split`` leaves between matches gives the offsets: a match begins after the
    pieces and the matches before it.
    """
    pattern = PATTERNS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if kind == "assign" else found
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    steps = F.arrays_zip(gaps.alias("gap"), found.alias("found"), values.alias("value"))
    none = F.expr(f"cast(array() as array<{SPAN}>)")

    def step(acc: Column, s: Column) -> Column:
        start = acc["at"] + s["gap"]
        end = start + F.coalesce(F.length(s["found"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind_no"), F.lit(kind).alias("kind"), end.alias("end"),
                        F.unhex(F.sha2(s["value"], 256)).alias("hash"))
        passes = F.length(s["value"]) >= (LEAST_ASSIGNED if kind == "assign" else 1)
        return F.struct(end.alias("at"), F.when(passes, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    def piece(all_steps: Column, i: Column) -> Column:
        """Spans of PIECE matches, as if the text began with them, and their length."""
        return F.aggregate(F.slice(all_steps, i * PIECE + 1, F.lit(PIECE)), F.struct(F.lit(0).alias("at"), none.alias("spans")), step)

    # Appending to an array copies it: matches are gone through in pieces, which are then moved to their place.
    pieces = bound(steps, lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / PIECE).cast("int")), lambda i: piece(s, i)))
    begins = lambda p: F.aggregate(
        p, F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("all")),
        lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")), lambda acc: acc["all"])
    moved = lambda p: F.transform(p["p"]["spans"], lambda s: F.struct(
        (s["start"] + p["at"]).alias("start"), s["kind_no"].alias("kind_no"), s["kind"].alias("kind"), (s["end"] + p["at"]).alias("end"), s["hash"].alias("hash")))
    spans = bound(pieces, lambda p: F.flatten(F.transform(F.arrays_zip(p.alias("p"), begins(p).alias("at")), moved)))
    return F.when(text.rlike(pattern), spans).otherwise(none)


def candidates(text: str | Column = "text") -> Column:
    """All candidate spans of a text, by start, then kind."""
    whole = whole_text(text)
    return F.array_sort(F.concat(*(matches(whole, kind) for kind in KINDS)))


def ownership(found: DataFrame) -> DataFrame:
    """hash, repositories, owners: from one row per candidate with *repo* and *owner*.

    A repository counts once for a hash: its own candidates are made distinct beforehand.
    """
    by_owner = found.groupBy("hash", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("hash").agg(F.sum("n").alias("repositories"), F.count("*").alias("owners"))


def find_secrets(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", owner: str = "source",
                 copied_owners: int = 2, copied_repositories: int = 4) -> DataFrame:
    """doc_id and secrets: array of (start, kind_no, kind, end, hash, repositories, owners, live).

    A value is copied from *copied_owners* owners or *copied_repositories* repositories on.
    """
    rows = checkpointed(docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.concat(F.lit("="), F.col(owner).cast("string")), F.lit("")).alias("owner"),
        candidates(text).alias("spans")).withColumn("row", F.monotonically_increasing_id()))
    some = rows.where(F.size("spans") > 0)
    stats = ownership(some.select("owner", F.explode(F.array_distinct(F.transform("spans", lambda s: s["hash"]))).alias("hash")))
    live = (F.col("owners") < copied_owners) & (F.col("repositories") < copied_repositories)
    told = some.select("row", "doc_id", F.explode("spans").alias("s")).withColumn("hash", F.col("s.hash")).join(stats, "hash", "left")
    told = told.select("row", "doc_id", F.struct(
        "s.start", "s.kind_no", "s.kind", "s.end", "hash", "repositories", "owners", live.alias("live")).alias("s"))
    # a group is the candidates of one text
    told = told.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list("s")).alias("secrets"))
    none = rows.where(F.size("spans") == 0).select("doc_id", F.expr(f"cast(array() as {dict(told.dtypes)['secrets']})").alias("secrets"))
    return told.select("doc_id", "secrets").unionByName(none)
