"""SHA-256 digests of tables of any size: rows are hashed first and only hashes move."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Digests that a node of an ordered tree gathers.
FANOUT = 1024

PREFIX_LEVELS = (6, 3)  # hex digits; a level above the leaves gathers at most 16 ** 3 digests


def line_of(columns: Sequence[str | Column]) -> Column:
    """Tab-joined text of the columns, null as empty text."""
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.concat_ws("\t", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])


def _gather(parts: DataFrame, digits: int) -> DataFrame:
    """Digest the entries that share a prefix of ``digits`` hex digits, in entry order."""
    listed = F.array_join(F.array_sort(F.collect_list("entry")), "\n")
    groups = parts.groupBy(F.substring("prefix", 1, digits).alias("prefix")) if digits else parts.groupBy()
    return groups.agg(F.sum("n").alias("n"), F.sha2(listed, 256).alias("digest"))


def table_digest(df: DataFrame, columns: Sequence[str | Column]) -> DataFrame:
    """One row ``(n_rows, sha256)``, independent of row order.

    A tree of digests over hash prefixes.  Equal rows are counted before anything is
    gathered, so copies cannot make a prefix hot, and the leaf prefix is long enough
    that a leaf stays small however large the table is.
    """
    hashed = df.select(F.sha2(line_of(columns), 256).alias("prefix"))
    parts = hashed.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"))
    parts = parts.withColumn("entry", F.concat_ws(":", "prefix", F.col("n").cast("string")))
    for digits in PREFIX_LEVELS:
        parts = _gather(parts, digits).withColumn("entry", F.concat_ws(":", "prefix", "digest"))
    root = _gather(parts, 0)
    return root.select(F.coalesce("n", F.lit(0)).cast("bigint").alias("n_rows"), F.col("digest").alias("sha256"))


def ordered_digest(leaves: DataFrame, keys: Sequence[str], most: int) -> DataFrame:
    """``(keys, n, sha256)`` of sequences of any length, by an ordered tree of digests.

    ``leaves`` holds ``number`` (0, 1, ... within its keys, ``most`` at the most) and ``hash``, the
    binary SHA-256 of an entry.  A node is the SHA-256 of the hex digests of up to ``FANOUT``
    neighbours, so the digest depends on entries and order alone, not on how they are spread,
    and no task gathers more than one node at a time.
    """
    level = leaves.select(*keys, "number", "hash", F.lit(1).cast("bigint").alias("n"))
    bottom = True
    while True:
        order = F.array_sort(F.collect_list(F.struct("number", "hash")))
        parent = F.expr(f"number div {FANOUT}").alias("number")
        level = level.groupBy(*keys, parent).agg(order.alias("children"), F.sum("n").alias("n"))
        joined = F.array_join(F.transform("children", lambda x: F.lower(F.hex(x["hash"]))), "")
        node = F.unhex(F.sha2(joined.cast("binary"), 256))
        if not bottom:
            # a sequence that one node holds already has its root
            node = F.when((F.col("number") == 0) & (F.size("children") == 1), F.col("children")[0]["hash"]).otherwise(node)
        level = level.select(*keys, "number", node.alias("hash"), "n")
        most, bottom = most // FANOUT, False
        if not most:
            return level.select(*keys, "n", F.lower(F.hex("hash")).alias("sha256"))
