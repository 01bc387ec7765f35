"""Merkle fixity audit of WARC replicas.

Pages become WARC records, dealt to files and laid out in order of page, so each
record has a file, a number and an offset. A leaf of the tree hashes one record; a
node hashes the ranges of offsets and the hashes of its up to FANOUT children; above
the files, nodes cover ranges of files up to one root. The audit compares the roots
of two replicas and goes down, level by level, only below nodes that differ.
Everything is DataFrame code; a task holds no more than FANOUT hashes of a node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

FANOUT = 16
RECORDS_PER_FILE = 4096
#: Records of one key that go to the same file.
COPIES = 1024


def hex_number(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def warc_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """page_id, key (by which files are dealt), record (a WARC 1.0 resource record). Null
    url or body counts as empty, a null id as no name; repeated rows are records of
    their own; other columns are left out."""
    url, body, page = F.coalesce(F.col(url_col), F.lit("")), F.coalesce(F.col(body_col), F.lit("")), F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    name = F.md5(F.concat(page, F.lit(" "), url))
    uuid = F.concat_ws("-", *(F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:"), uuid, F.lit(">\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    key = F.concat(page, F.lit(" "), url, F.lit(" "), F.substring(F.md5(body), 1, 8))
    return pages.select(F.col(id_col).alias("page_id"), key.alias("key"), F.concat(head, body, F.lit("\r\n\r\n")).alias("record"))


def parse_records(records: DataFrame) -> DataFrame:
    """Reads url and body back out of the record column."""
    url = F.regexp_extract("record", r"(?s)\r\nWARC-Target-URI: (.*?)\r\nContent-Type: ", 1)
    body = F.regexp_extract("record", r"(?s)\r\nContent-Length: [0-9]+\r\n\r\n(.*)\r\n\r\n\z", 1)
    return records.select("page_id", "key", url.alias("url"), body.alias("html"))


def leaves(records: DataFrame, files: int) -> DataFrame:
    """file, no, page_id, offset, n_bytes and hash of each record; files are ordered by
    page and then by the record's hash. Equal records are counted before they are moved,
    and the copies of one key are dealt to files by the thousand, so that a page that
    makes up a third of all rows is spread."""
    row = records.select("page_id", "key", F.octet_length("record").cast("long").alias("n_bytes"), F.sha2(F.col("record").cast("binary"), 256).alias("hash"))
    counted = row.groupBy("page_id", "key", "n_bytes", "hash").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("page_id", "key").orderBy("hash", "n_bytes").rowsBetween(Window.unboundedPreceding, -1))
    each = counted.withColumn("first", F.coalesce(before, F.lit(0))).withColumn("copy", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)))
    salt = F.floor(F.col("copy") / COPIES)
    file = F.pmod(hex_number(F.concat("key", F.when(salt > 0, F.concat(F.lit(" "), salt.cast("string"))).otherwise(F.lit("")))), F.lit(files))
    order = Window.partitionBy("file").orderBy(F.col("page_id").asc_nulls_first(), "hash")
    end = F.sum("n_bytes").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return each.withColumn("file", file).select("file", (F.row_number().over(order) - 1).cast("long").alias("no"), "page_id", (end - F.col("n_bytes")).alias("offset"), "n_bytes", "hash")


def depth(n: int) -> int:
    """Levels that bring n nodes together in one."""
    out, most = 0, 1
    while most < n:
        out, most = out + 1, most * FANOUT
    return out


def levels(leaf: DataFrame, files: int, records: int) -> list[DataFrame]:
    """The trees of both replicas, leaves first, each level written once: replica, file, no,
    hash, offset and end of each node's range; at the levels above the files, `file`
    numbers the ranges of files. A node hashes its children's ranges and hashes."""
    out = [leaf.select("replica", "file", "no", "hash", "offset", (F.col("offset") + F.col("n_bytes")).alias("end"))]
    for i in range(depth(records) + depth(files)):
        of = "no" if i < depth(records) else "file"
        up = out[-1].groupBy("replica", *(F.floor(F.col(c) / FANOUT).alias(c) if c == of else F.col(c) for c in ("file", "no")))
        children = F.array_sort(F.collect_list(F.struct(of, "offset", "end", "hash")))
        told = F.concat_ws("\n", F.transform(children, lambda x: F.concat_ws(" ", *(x[c].cast("string") for c in (of, "offset", "end", "hash")))))
        out.append(materialize(up.agg(F.sha2(told, 256).alias("hash"), F.min("offset").alias("offset"), F.max("end").alias("end"))))
    return out


def audit(leaf: DataFrame, files: int) -> DataFrame:
    """leaf: leaves() of two replicas with a column replica, 'a' or 'b'. One row per record
    whose content differs or that one replica lacks: file, no, page_id, offset and
    n_bytes (of a, or else of b), hash_a, hash_b. None if the roots agree; both may be
    empty. Records are paired by number in the file, so a missing one makes those behind
    it differ too."""
    most = leaf.agg(F.coalesce(F.max("no"), F.lit(-1)) + 1).first()[0]
    tree = levels(leaf, files, most)
    rows = leaf.select("replica", "file", "no", "hash", "offset", (F.col("offset") + F.col("n_bytes")).alias("end"), "page_id", "n_bytes")

    def differ(nodes: DataFrame, *more: str) -> DataFrame:
        """file, no and, of replicas a and b, the node or record where their hashes differ."""
        of = lambda r: F.max(F.when(F.col("replica") == r, F.struct("hash", "offset", *more))).alias(r)
        return nodes.groupBy("file", "no").agg(of("a"), of("b")).filter(~F.col("a.hash").eqNullSafe(F.col("b.hash")))

    bad = None
    for i in range(len(tree) - 1, -1, -1):
        nodes = tree[i] if i else rows
        if bad is not None:
            of = "no" if i < depth(most) else "file"
            up = {f"up_{c}": F.floor(F.col(c) / FANOUT) if c == of else F.col(c) for c in ("file", "no")}
            nodes = nodes.withColumns(up).join(bad, ["up_file", "up_no"], "left_semi")
        if i:
            bad = materialize(differ(nodes).select(F.col("file").alias("up_file"), F.col("no").alias("up_no")))
    found = differ(nodes, "page_id", "n_bytes")
    return found.select("file", "no", *(F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in ("page_id", "offset", "n_bytes")), F.col("a.hash").alias("hash_a"), F.col("b.hash").alias("hash_b"))


def fixity_audit(records_a: DataFrame, records_b: DataFrame, files: int) -> DataFrame:
    """audit() of two replicas, given as records: page_id, key (the same in both for a
    record and its replica) and record."""
    both = leaves(records_a, files).withColumn("replica", F.lit("a")).unionByName(leaves(records_b, files).withColumn("replica", F.lit("b")))
    return audit(materialize(both), files)
