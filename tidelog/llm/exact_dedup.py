"""Exact deduplication by deterministic block naming.

A normalised text is cut into blocks of a fixed size. Blocks that occur more than once
are sorted and get integer names, equal content and only equal content having the same
name. Then adjacent names are paired, the pairs that occur more than once are named in
the same way, and so on until each document has one name. A block or pair that occurs
once has no twin, and neither has its document, which leaves at that level. Contents
are compared, never digests, so an identity cannot collide. Hashes of blocks only tell
beforehand which documents may have a twin: the texts of all others are not shuffled.

Skew: naming aggregates before it shuffles, so a block that a third of all rows share
reaches the sort once per task; the join that hands names back has a plain exchange on
both sides, which adaptive execution splits.

Defined results: a null text counts as empty, and empty texts equal one another. Of
equal texts the row with the smallest doc_id stays; a null id is larger than any other;
rows that repeat the same id and text are told apart by their place in the scan, and
the first stays. An empty table gives an empty table. Other columns, of any name, are not read, and
`unique_documents` returns them unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.llm.common import documents, numbered, only, row_key, staged, steady

BLOCK_BYTES = 4096
#: Blocks for each of the ranges in which names are sorted, and ranges at least.
RANGE_BLOCKS, RANGES = 1_000_000, 4096
#: Row ids that may be broadcast (16 bytes each), counted first.
BROADCAST_ROWS = 1_000_000

WHITE = "[\\x20\\x09-\\x0D]+"


def normalised(text: F.Column) -> F.Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def name_repeated(rows: DataFrame, keys: list[str], ranges: int) -> DataFrame:
    """(keys, name) of the contents that occur at least twice: sorted within ranges of
    their hash, named by rank times `ranges` plus the range. The same contents get the
    same names in every run."""
    repeated = rows.groupBy(*keys).agg(F.count("*").alias("__n")).where("__n >= 2").drop("__n")
    place = F.pmod(F.xxhash64(*keys), F.lit(ranges))
    rank = F.row_number().over(Window.partitionBy("__range").orderBy(*keys))
    return repeated.withColumn("__range", place).withColumn("name", rank.cast("long") * ranges + F.col("__range")).drop("__range")


def in_blocks(raw: DataFrame, block_bytes: int, value, *more: str) -> DataFrame:
    """(row, more, n, pos, block) of (row, more, b) rows; value makes a block of bytes."""
    count = F.greatest(F.ceil(F.octet_length("b") / block_bytes), F.lit(1)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), count - 1), lambda i: value(F.substring(F.col("b"), i * block_bytes + 1, F.lit(block_bytes))))
    return raw.select("row", *more, count.alias("n"), F.posexplode(blocks).alias("pos", "block"))


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(row, doc_id, text_sha256, level, name) for each row of docs; level and name
    together are the identity, null where no other row has the same text."""
    texts = only(docs, "doc_id", "text").withColumn("row", row_key())
    text = texts.select("row", F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("t"))
    raw = text.select("row", "doc_id", F.sha2("t", 256).alias("sha"), F.col("t").cast("binary").alias("b"))
    light = in_blocks(raw, block_bytes, F.xxhash64, "doc_id", "sha")
    light = staged(light.withColumn("sha", F.when(F.col("pos") == 0, F.col("sha"))), "hashes")
    again = staged(light.groupBy("block").agg(F.count("*").alias("k")).where("k > 1").select("block"), "again")
    may = light.join(again, "block", "left_semi").groupBy("row").agg(F.count("*").alias("k"), F.first("n").alias("n"))
    may = staged(may.where("k = n").select("row", "n"), "candidates")
    size = may.agg(F.count("*").alias("rows"), F.sum("n").alias("blocks")).first()
    listed = may.select("row")
    chosen = texts.join(F.broadcast(listed) if size.rows <= BROADCAST_ROWS else listed, "row", "left_semi")
    cut = in_blocks(chosen.select("row", normalised(F.col("text")).cast("binary").alias("b")), block_bytes, lambda b: b)
    ranges = max(RANGES, (size.blocks or 0) // RANGE_BLOCKS)
    named = cut.join(staged(name_repeated(cut.select("block"), ["block"], ranges), "blocks"), "block", "left").select("row", "n", "pos", "name")
    named = staged(named, "named")
    whole = light.where("pos = 0").select("row", "doc_id", F.col("sha").alias("text_sha256"))
    done = named.where("n = 1 and name is not null").select("row", F.lit(0).alias("level"), "name")
    open_ = named.where("n > 1").select("row", "n", "pos", "name")
    level = 0
    while not open_.isEmpty():
        level += 1
        open_ = staged(next_level(open_, ranges), f"level{level}")
        done = done.unionByName(open_.where("n = 1").select("row", F.lit(level).alias("level"), "name"))
        open_ = open_.where("n > 1")
    return whole.join(done, "row", "left")


def next_level(names: DataFrame, ranges: int) -> DataFrame:
    """(row, n, pos, name) one level up, of the documents whose names all have twins."""
    twins = F.count("name").over(Window.partitionBy("row"))  # as many rows as the document has blocks
    alive = names.withColumn("__k", twins).where(F.col("__k") == F.col("n"))
    pairs = alive.groupBy("row", F.ceil(F.col("n") / 2).cast("int").alias("n"), F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(
        F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
        F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(0)).alias("b"),
    )
    pairs = staged(pairs, "pairs")
    named = staged(name_repeated(pairs.select("a", "b"), ["a", "b"], ranges), "names")
    return pairs.join(named, ["a", "b"], "left").select("row", "n", "pos", "name").where("n > 1 or name is not null")


def groups(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, row."""
    docs = steady(docs)
    # A text without twins is its own group: its row stands in for the name.
    known = identities(docs, block_bytes).select("row", "doc_id", "text_sha256", F.coalesce("level", F.lit(-1)).alias("level"), F.coalesce("name", "row").alias("name"))
    known = staged(known, "identities")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    size = known.where("level >= 0").groupBy("level", "name").agg(first.alias("first"), F.count("*").alias("size"))
    joined = known.join(staged(size, "groups"), ["level", "name"], "left")
    alone = F.col("size").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("first.row") == F.col("row"))).alias("kept"),
        "text_sha256",
        "row",
    )


def without_rows(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs without the rows whose row_key() is listed; the list is broadcast only if
    it was counted and found small, and else both sides are shuffled."""
    rows = staged(rows.select("row"), "dropped")
    if rows.count() <= BROADCAST_ROWS:
        rows = F.broadcast(rows)
    return numbered(docs).withColumn("row", row_key()).join(rows, "row", "left_anti").drop("row").toDF(*docs.columns)


def unique_documents(docs: DataFrame) -> DataFrame:
    """docs, each text once, with all its columns."""
    docs = steady(docs)
    return without_rows(docs, groups(docs).where("not kept"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(documents(spark, sf_dir)).drop("row")


QUERIES = {"op4_exact_dedup": op4_exact_dedup}
ORACLE = {
    "op4_exact_dedup": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n"""
}
