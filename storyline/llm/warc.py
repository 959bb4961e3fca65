"""WARC records and a Merkle fixity audit of their replicas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from ..operators.durable import durable

#: Children of a tree node, as bits of its number; page numbers in a leaf range and in a volume (file).
FAN_BITS, RANGE_BITS, VOLUME_BITS = 4, 4, 8


def record(page_id: Column, url: Column, html: Column) -> Column:
    """A page as a WARC/1.0 record; nulls are empty."""
    url, html = F.coalesce(url, F.lit("")), F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), url,
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(html).cast("string"),
        F.lit("\r\n\r\n"), html, F.lit("\r\n\r\n"),
    )


def manifest(pages: DataFrame) -> DataFrame:
    """``(leaf, volume, page_id, sha256, length, copies, start)``: one row per distinct record.

    Records lie in volumes of 2**VOLUME_BITS page numbers, by page_id and then
    digest; ``start`` is the record's byte offset in its volume and equal
    records follow each other (``copies``). Records without a page_id lie in
    4096 volumes of negative number by their digest, so that no volume
    gathers them all.
    """
    text = record(F.col("page_id"), F.col("url"), F.col("html"))
    hashed = pages.select(F.col("page_id").cast("long"), text.alias("record")).select(
        "page_id", F.sha2("record", 256).alias("sha256"), F.octet_length("record").cast("long").alias("length")
    )
    rows = hashed.groupBy("page_id", "sha256", "length").agg(F.count("*").alias("copies"))
    unknown = -1 - F.conv(F.substring("sha256", 1, 3), 16, 10).cast("long")
    volume = F.coalesce(F.shiftright("page_id", VOLUME_BITS), unknown)
    leaf = F.coalesce(F.shiftright("page_id", RANGE_BITS), F.shiftleft(unknown, VOLUME_BITS - RANGE_BITS))
    before = Window.partitionBy("volume").orderBy("page_id", "sha256").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(leaf.alias("leaf"), volume.alias("volume"), "*").withColumn(
        "start", F.coalesce(F.sum(F.col("length") * F.col("copies")).over(before), F.lit(0)).cast("long")
    )


def _digest(*columns: str) -> Column:
    rows = F.sort_array(F.collect_list(F.struct(*columns)))
    return F.sha2(F.array_join(F.transform(rows, lambda r: F.concat_ws(":", *(r[c].cast("string") for c in columns))), ","), 256)


def tree(records: DataFrame, levels: int) -> list[DataFrame]:
    """Nodes ``(node, hash)`` of each level: 0 are the leaf ranges over their ordered records, the last the root."""
    nodes = records.groupBy(F.col("leaf").alias("node")).agg(_digest("start", "page_id", "sha256", "copies").alias("hash"))
    out = [durable(nodes)]
    for _ in range(levels):
        up = out[-1].withColumn("up", F.shiftright("node", FAN_BITS)).groupBy("up").agg(_digest("node", "hash").alias("hash"))
        out.append(durable(up.withColumnRenamed("up", "node")))
    root = out[-1].groupBy(F.lit(0).cast("long").alias("node")).agg(_digest("node", "hash").alias("hash"))
    return [*out, root]


def audit(kept: DataFrame, replica: DataFrame) -> DataFrame:
    """``(page_id, volume, start, length, copies, sha256, status)`` of every record of ``kept``, and of
    those only the replica has.

    Roots are compared first; only below differing nodes are children compared,
    down to the leaf ranges, and only in differing ranges records. Status: ok,
    corrupt (the replica has the page with other bytes or another number of
    copies), missing, or extra (the replica has a page that ``kept`` has not;
    volume, start and the like are then the replica's). Equal records count as
    copies; null ids are pages of their own kind; empty tables have no records.
    """
    ours, theirs = durable(manifest(kept)), durable(manifest(replica))
    least, most = ours.select("leaf").unionByName(theirs.select("leaf")).agg(F.min("leaf"), F.max("leaf")).first()
    reach = max(abs(least or 0), abs(most or 0))
    levels = max(1, -(-reach.bit_length() // FAN_BITS))
    left, right = tree(ours, levels), tree(theirs, levels)
    suspects = None
    for level in range(levels + 1, -1, -1):
        a, b = left[level], right[level].withColumnRenamed("hash", "other")
        if suspects is not None and level <= levels:
            parent = F.shiftright("node", FAN_BITS) if level < levels else F.lit(0).cast("long")
            a, b = (x.withColumn("up", parent).join(suspects.withColumnRenamed("node", "up"), "up", "left_semi").drop("up") for x in (a, b))
        suspects = a.join(b, "node", "full").where(~F.col("hash").eqNullSafe(F.col("other"))).select("node")
        if level <= levels:
            suspects = durable(suspects)
    leaves = suspects.select(F.col("node").alias("leaf"), F.lit(True).alias("suspect"))
    same_page = F.col("a.leaf").eqNullSafe(F.col("b.leaf")) & F.col("a.page_id").eqNullSafe(F.col("b.page_id"))
    there = theirs.join(leaves, "leaf", "left_semi")
    pages = there.groupBy("leaf", "page_id").agg(F.lit(True).alias("known"))
    checked = (
        ours.join(leaves, "leaf", "left").alias("a")
        .join(there.alias("b"), same_page & (F.col("a.sha256") == F.col("b.sha256")) & (F.col("a.copies") == F.col("b.copies")), "left")
        .select("a.*", F.col("b.sha256").isNotNull().alias("found")).alias("a")
        .join(pages.alias("b"), same_page, "left")
        .select(
            "a.page_id", "a.volume", "a.start", "a.length", "a.copies", "a.sha256",
            F.when(F.col("a.suspect").isNull() | F.col("a.found"), "ok").when(F.col("b.known"), "corrupt").otherwise("missing").alias("status"),
        )
    )
    own = ours.join(leaves, "leaf", "left_semi").select("leaf", "page_id").distinct()
    extra = there.alias("a").join(own.alias("b"), same_page, "left_anti").select(
        "page_id", "volume", "start", "length", "copies", "sha256", F.lit("extra").alias("status")
    )
    return checked.unionByName(extra)
