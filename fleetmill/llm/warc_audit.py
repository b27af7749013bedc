"""WARC fixity audit: records and ordered offset ranges are hashed into Merkle trees, replicas compared from the root.

A manifest names the file, offset and length of each record, and its digest. Leaves are byte ranges of a file (RANGE
bytes; the records that start there, in order of offset), each parent joins FANOUT ranges. Both replicas' roots are
compared and only branches that differ are descended, by joins, until the records are found. (A level's table is
scanned for the branches wanted; the rows that are shuffled are theirs alone.)

A record whose bytes differ is corrupt; one whose bytes are alike, but which starts elsewhere, as bytes before it in its
file were lost or added, has moved.

Defined cases: a null payload counts as empty; a record on one side only is missing or extra; records of one id in one
file are compared as sorted lists, equal ones as one with their number; pages without id are dealt to files by their
content; an empty replica gives every record of the other; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import written

RANGE, FANOUT, LEVELS = 1 << 16, 16, 5


def records(pages: DataFrame, per_file: int = 1000) -> DataFrame:
    """(file, offset, length, record_id, digest): pages as WARC response records, per_file of them (by id) to a file."""
    body = F.coalesce(F.col("html"), F.lit(""))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")),
                    F.lit(">\r\nWARC-Target-URI: "), F.coalesce(F.col("url"), F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    payload = F.concat(head, body, F.lit("\r\n\r\n"))
    # Offsets need lengths only; the payload itself is hashed before any shuffle. Equal records are one row with their number.
    rows = pages.select("page_id", F.octet_length(payload).cast("long").alias("length"), F.sha2(payload, 256).alias("digest"))
    file = F.coalesce(F.floor(F.col("page_id") / per_file), -1 - F.conv(F.substring("digest", 1, 8), 16, 10).cast("long"))
    rows = rows.groupBy(file.alias("file"), F.col("page_id").alias("record_id"), "length", "digest").agg(F.count("*").alias("copies"))
    before = Window.partitionBy("file").orderBy("record_id", "digest").rowsBetween(Window.unboundedPreceding, -1)  # per_file rows
    return rows.select("file", F.coalesce(F.sum(F.col("length") * F.col("copies")).over(before), F.lit(0).cast("long")).alias("offset"), "length", "record_id",
                       F.when(F.col("copies") == 1, F.col("digest")).otherwise(F.concat_ws("*", "digest", F.col("copies").cast("string"))).alias("digest"))


def _up(children: DataFrame, width: int, order: str) -> DataFrame:
    """Nodes of the next level; a node has `width` children at most (records of a range: as many as fit its bytes)."""
    return children.groupBy("file", F.floor(F.col(order) / width).alias("node")).agg(
        F.sha2(F.concat_ws("|", F.transform(F.array_sort(F.collect_list(F.struct(order, "digest"))), lambda x: F.concat_ws(":", x[order].cast("string"), x["digest"]))), 256).alias("digest"))


def tree(leaves: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """Level 0 (ranges of records) to the level with one root for each file; (file, node, digest) each."""
    levels_up = [written(_up(leaves, RANGE, "offset"))]
    for _ in range(levels - 1):
        levels_up.append(written(_up(levels_up[-1], FANOUT, "node")))
    return levels_up


def _differs(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    right = b.select(*keys, F.col("digest").alias("other"))
    return a.select(*keys, "digest").join(right, keys, "full_outer").where(~F.col("digest").eqNullSafe(F.col("other")))


def audit(original: DataFrame, replica: DataFrame) -> DataFrame:
    """(file, offset, record_id, status, expected, found): every record that the replica lacks, adds, has changed or moved.

    Each level is compared only below the branches that differed above it: the first is the roots of all files.
    """
    original, replica = (written(x.select("file", "offset", "record_id", "digest")) for x in (original, replica))
    left, right = tree(original), tree(replica)
    # Each level's branches are written: the next level's plan then reads them, and doesn't hold all plans above it.
    bad = written(_differs(left[-1], right[-1], ["file", "node"]).select("file", "node"))
    for a, b in zip(left[-2::-1], right[-2::-1], strict=True):
        parent = F.floor(F.col("node") / FANOUT).alias("up")
        below = lambda x, bad=bad, parent=parent: x.select("file", "node", "digest", parent).join(bad.select("file", F.col("node").alias("up")), ["file", "up"], "left_semi")
        bad = written(_differs(below(a), below(b), ["file", "node"]).select("file", "node"))
    range_of = F.floor(F.col("offset") / RANGE).alias("node")
    one = lambda x: x.select("file", "offset", "record_id", "digest", range_of).join(bad, ["file", "node"], "left_semi").groupBy("file", "record_id").agg(
        F.min("offset").alias("offset"), F.concat_ws(",", F.array_sort(F.collect_list("digest"))).alias("digest"))
    a, b = one(original).alias("a"), one(replica).alias("b")
    same = F.col("a.digest").eqNullSafe(F.col("b.digest"))
    found = a.join(b, (F.col("a.file") == F.col("b.file")) & F.col("a.record_id").eqNullSafe(F.col("b.record_id")), "full_outer")
    return found.where(~same | (F.col("a.offset") != F.col("b.offset"))).select(
        F.coalesce("a.file", "b.file").alias("file"), F.coalesce("a.offset", "b.offset").alias("offset"), F.coalesce("a.record_id", "b.record_id").alias("record_id"),
        F.when(F.col("b.digest").isNull(), "missing").when(F.col("a.digest").isNull(), "extra").when(same, "moved").otherwise("corrupt").alias("status"),
        F.col("a.digest").alias("expected"), F.col("b.digest").alias("found"))
