"""WARC archives and their Merkle fixity audit, in DataFrame functions.

Pages become WARC/1.0 resource records, dealt into files by page number; a record's offset
is the sum of the lengths before it in its file. The leaves of a file's hash tree are its
records (digest of offset, length and bytes), and each node above covers the ``FAN`` next
offset ranges. An audit compares the roots of two replicas and then, level by level, only
the children of nodes that differ, down to the records.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch_table

FAN, LEVELS = 16, 3  # FAN ** LEVELS records a file at most
PER_FILE = 1000
# Pages carry no time of capture; records need one.
DATE = "1970-01-01T00:00:00Z"


def record_bytes(url: Column, page_id: Column, body: Column, date: str = DATE) -> Column:
    """A resource record; null url or body counts as empty.

    Carriage returns and line feeds of a url are percent-encoded, so a url stays one header line.
    """
    url, body = F.coalesce(url.cast("string"), F.lit("")), F.coalesce(body.cast("string"), F.lit(""))
    url = F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.concat(F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "), url, F.lit(f"\r\nWARC-Date: {date}"),
                    F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
                    F.lit(">\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body,
                    F.lit("\r\n\r\n")).cast("binary")


def read_record(record: Column) -> Column:
    """The header fields and the block of a record's bytes: struct (headers map, body)."""
    text = record.cast("string")
    head = F.substring_index(text, "\r\n\r\n", 1)
    lines = F.filter(F.split(head, "\r\n"), lambda x: F.contains(x, F.lit(": ")))
    headers = F.map_from_entries(F.transform(lines, lambda x: F.struct(
        F.substring_index(x, ": ", 1).alias("key"), F.regexp_replace(x, "^[^:]*: ", "").alias("value"))))
    length = F.element_at(headers, "Content-Length").cast("int")
    return F.struct(headers.alias("headers"),
                    F.substring(record, F.octet_length(head) + 5, length).cast("string").alias("body"))


def records_at(archives: DataFrame, places: DataFrame) -> DataFrame:
    """``places`` (file, offset, length, ...) with the record found there in ``archives`` (file, content)."""
    content = archives.select("file", "content")
    found = F.substring(F.col("content"), (F.col("offset") + 1).cast("int"), F.col("length").cast("int"))
    return places.join(content, "file").withColumn("record", found).drop("content")


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html",
                 per_file: int = PER_FILE) -> DataFrame:
    """(file, page_id, url, record, length, digest): every page as a record of some file, not yet placed there.

    Files hold ``per_file`` consecutive page numbers; pages without a number are dealt over
    files of their own by a hash, named below zero.
    """
    record = record_bytes(F.col(url_col), F.col(id_col), F.col(body_col))
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), record.alias("record"))
    loose = -1 - F.pmod(F.xxhash64("record"), F.lit(1024))
    return base.select(F.coalesce(F.floor(F.col("page_id") / per_file).cast("long"), loose).alias("file"), "*",
                       F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest"))


def placed(rows: DataFrame) -> DataFrame:
    """``rows(file, page_id, url, length, digest, ...)`` with each record's number and offset in its file.

    Pages that repeat a number lie in the same file, ordered by url and then by digest, so
    equal rows give equal archives. Only the columns that ``rows`` has travel: without
    ``record``, no page's bytes are shuffled.
    """
    in_file = Window.partitionBy("file").orderBy("page_id", "url", "digest")
    before = F.coalesce(F.sum("length").over(in_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("number", F.row_number().over(in_file) - 1).withColumn("offset", before)


def warc_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html",
                 per_file: int = PER_FILE) -> DataFrame:
    """(file, number, offset, length, page_id, url, record): the archive of all pages, with its bytes."""
    return placed(page_records(pages, id_col, url_col, body_col, per_file)).select(
        "file", "number", "offset", "length", "page_id", "url", "record")


def merkle_leaves(records: DataFrame) -> DataFrame:
    """(file, number, offset, length, page_id, hash): the hash binds place and bytes.

    ``records`` hold the bytes (``record``) or, where those were read before, their ``digest``.
    """
    digest = F.sha2("record", 256) if "record" in records.columns else F.col("digest")
    place = F.concat_ws(":", F.col("offset").cast("string"), F.col("length").cast("string"), digest)
    return records.select("file", "number", "offset", "length", "page_id", F.sha2(place.cast("binary"), 256).alias("hash"))


def _above(level: DataFrame, fan: int) -> DataFrame:
    """The next level: node k hashes its children fan*k ... fan*k + fan - 1 in order."""
    children = F.array_sort(F.collect_list(F.struct("number", "hash")))
    return (level.groupBy("file", F.floor(F.col("number") / fan).cast("int").alias("node"))
            .agg(children.alias("children"))
            .select("file", F.col("node").alias("number"),
                    F.sha2(F.array_join(F.transform("children", lambda c: c["hash"]), "").cast("binary"), 256).alias("hash")))


def merkle_tree(leaves: DataFrame, fan: int = FAN, levels: int = LEVELS) -> list[DataFrame]:
    """Levels of every file's tree, leaves first; the last has what is below ``fan`` nodes a file as one root."""
    out = [leaves.select("file", "number", "hash")]
    for _ in range(levels):
        out.append(_above(out[-1], fan))
    top = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "hash"))), lambda c: c["hash"]), "")
    out.append(out[-1].groupBy("file").agg(F.sha2(top.cast("binary"), 256).alias("hash"))
               .select("file", F.lit(0).alias("number"), "hash"))
    return out


def audit(left: DataFrame, right: DataFrame, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """(file, number, status) of every leaf that differs: corrupt, missing (right lacks it) or extra.

    ``left`` and ``right`` are leaves of two replicas. Each step joins only the nodes whose
    parents differ; a node that one side lacks differs. Files that agree are never descended.
    """
    pairs = list(zip(merkle_tree(left, fan, levels), merkle_tree(right, fan, levels)))
    suspects = None
    for depth, (a, b) in enumerate(reversed(pairs)):
        if suspects is not None:
            parent = F.lit(0) if depth == 1 else F.floor(F.col("number") / fan).cast("int")
            a, b = (x.withColumn("parent", parent).join(suspects, ["file", "parent"], "left_semi").drop("parent") for x in (a, b))
        both = a.select("file", "number", F.col("hash").alias("l")).join(
            b.select("file", "number", F.col("hash").alias("r")), ["file", "number"], "full")
        differ = both.where(~F.col("l").eqNullSafe(F.col("r")))
        if depth == len(pairs) - 1:
            status = F.when(F.col("r").isNull(), "missing").when(F.col("l").isNull(), "extra").otherwise("corrupt")
            return differ.select("file", "number", status.alias("status"))
        suspects = scratch_table(differ.select("file", F.col("number").alias("parent")), "audit")
    raise AssertionError("a tree has at least a root")


def fixity_report(records: DataFrame, replica: DataFrame, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """Each record of either replica: (file, number, offset, length, page_id, hash, status).

    status is ok, or what ``audit`` found; null bytes never occur in records, so a record
    that is empty still has a digest. Empty replicas give an empty report.
    """
    left, right = scratch_table(merkle_leaves(records), "leaves"), scratch_table(merkle_leaves(replica), "leaves")
    found = scratch_table(audit(left, right, fan, levels), "audit-leaves")
    known = left.join(found.where("status <> 'extra'"), ["file", "number"], "left")
    extra = right.join(found.where("status = 'extra'"), ["file", "number"])
    both = functools.reduce(DataFrame.unionByName, [known, extra])
    return both.select("file", "number", "offset", "length", "page_id", "hash", F.coalesce("status", F.lit("ok")).alias("status"))
