"""WARC archives, written from pages and read back by boundary-chain verification.

Writing is one map over the pages: of pages with equal payloads the one with
the smallest id is a ``response``, the others are ``revisit`` records that
refer to it. Reading splits files at the magic of a record, in parallel and
without regard to what lies between; every magic is a candidate that points to
the offset where its record ends by its own headers. Candidates that follow
each other without a gap are joined into segments, and pointer jumping over
the segments, from offset 0 of each file, keeps what the chain of records
reaches. A magic inside a payload is never reached and is given back to the
record that holds it: files with such records are read a second time, into a
table of pieces with their own offsets, so that it doesn't matter how either
reading splits them.

Defined cases: a null html is an empty payload; a null url is an empty target;
pages with equal payloads and equal ids are one response and revisits of that
id; null ids come last; ids of any type come back as they were; an empty table
gives an empty result; further columns are ignored; payloads of any length are
kept whole (a record is one row while it is read).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ampliframe.llm.common import durable, scratch_path, stored

MAGIC = "WARC/1.0\r\n"
RECORD_DATE = "2024-01-01T00:00:00Z"
#: Payloads shorter than this are never replaced by a revisit.
MIN_REVISIT_BYTES = 0
_END = "\r\n\r\n"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: each 5 hexadecimal digits are 4 digits of base 32."""
    digits = F.sha1(data)
    quads = [F.lpad(F.conv(F.substring(digits, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*quads), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_archive(pages: DataFrame, path: str, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Write one record per page of ``page_id, url, html`` under ``path``.

    The pages themselves aren't shuffled unless Spark finds the table of
    repeated payloads too large to broadcast.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select(
        "page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("bytes"), base32_sha1(payload).alias("digest")
    )
    by_page = keyed.where(F.col("bytes") >= min_revisit_bytes).groupBy("digest", "bytes", "page_id").agg(F.count("*").alias("n"))
    order = F.struct(F.col("page_id").isNull(), "page_id")
    repeated = (
        by_page.groupBy("digest", "bytes")
        .agg(F.min_by("page_id", order).alias("first_id"), F.min_by("n", order).alias("n_first"), F.sum("n").alias("n_rows"))
        .where("n_rows > 1")
        .select("digest", "bytes", "first_id", "n_first")
    )
    known = scratch_path(spark, "repeated-payloads")
    repeated.write.parquet(known)  # its size is then known to the planner
    known = spark.read.schema(repeated.schema).parquet(known)
    rows = keyed.join(known, ["digest", "bytes"], "left").withColumn("own", F.col("n_first").isNotNull() & F.col("page_id").eqNullSafe(F.col("first_id")))
    rows = rows.withColumn("revisit", F.col("n_first").isNotNull() & ~F.col("own"))
    tied = F.col("own") & (F.col("n_first") > 1)
    if known.where("n_first > 1").limit(1).count():
        # pages that are equal in id and payload: one of them, whichever, is the response
        same = durable(rows.where(tied).withColumn("_row", F.monotonically_increasing_id()))
        one = same.groupBy("digest", "bytes").agg(F.min("_row").alias("_first"))
        same = same.join(one, ["digest", "bytes"]).withColumn("revisit", F.col("_row") != F.col("_first")).drop("_row", "_first")
        rows = rows.where(~F.coalesce(tied, F.lit(False))).unionByName(same)
    revisit = F.col("revisit")
    clean_url = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\x00-\x1F\x7F]", "%20")
    urn = lambda c: F.concat(F.lit("<urn:page"), F.coalesce(F.concat(F.lit(":"), F.url_encode(c.cast("string"))), F.lit("")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    record = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Date", F.lit(RECORD_DATE)),
        line("WARC-Target-URI", clean_url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("X-Payload-Length", F.col("bytes").cast("string")),
        F.when(
            revisit,
            F.concat(
                line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")),
                line("WARC-Refers-To", urn(F.col("first_id"))),
            ),
        ).otherwise(F.lit("")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
        F.lit("\r\n"),
        body,
        F.lit("\r\n\r"),  # the writer ends each record with the last line feed
    )
    rows.select(record.alias("value")).write.option("lineSep", "\n").text(path)


def _header(value: Column, name: str) -> Column:
    return F.regexp_extract(value, rf"(?i)(?:^|\r\n){name}: *([^\r\n]*)", 1)


def _pieces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """What lies between two magics: ``file, block, piece, value``; pieces of a file are in the order of block and number."""
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("piece"),
        "value",
    )


def _with_offsets(pieces: DataFrame) -> DataFrame:
    """``pieces``, a durable table with ``size``, with the offset ``at`` of the magic before each; the first one of a file has none.

    Bytes are summed within each block, then over the blocks before it, so that a file isn't one task's.
    """
    size = F.col("size") + len(MAGIC)
    blocks = pieces.groupBy("file", "block").agg(F.sum(size).alias("bytes"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("file", "block", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("file", "block").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("start") + F.coalesce(F.sum(size).over(inside), F.lit(0)) - len(MAGIC)
    return pieces.join(starts, ["file", "block"]).withColumn("at", at).drop("start").where("at >= 0")


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every magic of every file: ``file, at, next`` (offsets), and the parsed headers of the piece up to the next magic."""
    pieces = _pieces(spark, path)
    split = F.instr("value", F.lit(_END))
    head = F.when(split > 0, F.substring_index("value", _END, 1)).otherwise(F.lit(""))
    length = _header(F.col("head"), "Content-Length").try_cast("long")
    parsed = pieces.withColumn("head", head).withColumn("content", length).withColumn("size", F.octet_length("value").cast("long"))
    # bytes of the piece: headers, an empty line, content, two line ends
    whole = F.octet_length("head") + 4 + F.col("content") + 4
    content = F.expr("substring(cast(value as binary), octet_length(head) + 5, cast(content as int))")
    narrow = parsed.select(
        "file",
        "block",
        "piece",
        "size",
        F.when(F.col("head") != "", whole).alias("length"),
        (F.octet_length("head") + 4).alias("skip"),
        "content",
        _header(F.col("head"), "WARC-Type").alias("type"),
        _header(F.col("head"), "WARC-Record-ID").alias("id"),
        _header(F.col("head"), "WARC-Target-URI").alias("uri"),
        _header(F.col("head"), "WARC-Refers-To").alias("refers"),
        _header(F.col("head"), "WARC-Payload-Digest").alias("stated"),
        _header(F.col("head"), "X-Payload-Length").try_cast("long").alias("stated_bytes"),
        F.when(whole == F.col("size"), base32_sha1(content)).alias("digest"),
    )
    return _with_offsets(durable(narrow)).withColumn("next", F.col("at") + len(MAGIC) + F.col("length"))


def reachable(found: DataFrame) -> DataFrame:
    """The candidates that the chain of records from offset 0 of their file reaches."""
    order = Window.partitionBy("file").orderBy("at")
    broken = F.coalesce(F.lag("next").over(order) != F.col("at"), F.lit(True))
    marked = found.withColumn("segment", F.sum(F.when(broken, 1).otherwise(0)).over(order))
    marked = durable(marked)
    ends = marked.groupBy("file", "segment").agg(F.min("at").alias("start"), F.max_by("next", "at").alias("exit"))
    most = ends.groupBy("file").count().agg(F.max("count")).collect()[0][0] or 0
    first = marked.where("at = 0").select("file", "segment", F.col("at").alias("entry"))
    if most <= 1:
        return marked.join(first.select("file", "segment"), ["file", "segment"], "left_semi")
    # where each segment's exit leads: a segment and the offset at which it is entered
    landing = marked.select("file", F.col("at").alias("exit"), F.col("segment").alias("to"))
    jump = durable(ends.join(landing, ["file", "exit"]).select("file", "segment", "to", F.col("exit").alias("entry")))
    reached = first
    for _ in range(max(1, most - 1).bit_length()):
        step = reached.select("file", "segment").join(jump, ["file", "segment"]).select("file", F.col("to").alias("segment"), "entry")
        reached = durable(reached.unionByName(step).distinct())
        onward = jump.select("file", F.col("segment").alias("to"), F.col("to").alias("far"), F.col("entry").alias("far_entry"))
        jump = durable(jump.join(onward, ["file", "to"]).select("file", "segment", F.col("far").alias("to"), F.col("far_entry").alias("entry")))
    return marked.join(reached, ["file", "segment"]).where("at >= entry").drop("entry")


def _spanning_digests(spark: SparkSession, kept: DataFrame) -> DataFrame:
    """``file, at, joined``: digests of records whose payload holds a magic, put together from their pieces.

    The files of such records are read again, once, into a table; offsets are taken from that table alone.
    """
    long = durable(kept.where(F.col("digest").isNull()).select("file", F.col("at").alias("owner"), "next", "skip", "content"))
    files = [r["file"] for r in long.select("file").distinct().collect()]
    pieces = stored(_pieces(spark, files).withColumn("size", F.octet_length("value").cast("long")), "pieces")
    offsets = _with_offsets(pieces.drop("value"))
    # records don't overlap, so a piece belongs to the last owner before it, if that reaches so far
    owners = offsets.join(long, (offsets["file"] == long["file"]) & (offsets["at"] == long["owner"]), "left").select(offsets["file"], "piece", "at", "owner", "next", "skip", "content")
    so_far = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.last(c, ignorenulls=True).over(so_far).alias(c)
    parts = owners.select("file", "piece", "at", *[last(c) for c in ("owner", "next", "skip", "content")]).where(F.col("at") < F.col("next"))
    whole = (
        parts.join(pieces.select("file", "piece", "value"), ["file", "piece"])
        .groupBy("file", "owner", "skip", "content")
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]), MAGIC).alias("value"))
    )
    content = F.expr("substring(cast(value as binary), skip + 1, cast(content as int))")
    return whole.select("file", F.col("owner").alias("at"), base32_sha1(content).alias("joined"))


def read_archive(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """One row per record that the chains reach: ``page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri, intact``.

    ``id_type`` is the type of the ids that were written. ``intact``: a response's payload has the digest that its header states.
    """
    found = durable(candidates(spark, path))
    kept = durable(reachable(found))
    if kept.where(F.col("digest").isNull()).limit(1).count():
        kept = kept.join(_spanning_digests(spark, kept), ["file", "at"], "left").withColumn("digest", F.coalesce("digest", "joined"))
    known = r"^<urn:page:([^>]*)>$"
    page = lambda c: F.when(c.rlike(known), F.try_url_decode(F.regexp_extract(c, known, 1)).try_cast(id_type))
    response = F.col("type") == "response"
    return kept.select(
        page(F.col("id")).alias("page_id"),
        F.when(response, F.col("content")).otherwise(F.col("stated_bytes")).alias("payload_bytes"),
        F.when(response, F.col("digest")).otherwise(F.substring_index("stated", ":", -1)).alias("payload_digest"),
        F.col("type").alias("record_type"),
        page(F.col("refers")).alias("refers_to"),
        F.col("uri").alias("target_uri"),
        (~response | (F.col("digest") == F.substring_index("stated", ":", -1))).alias("intact"),
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive ``pages`` in the shared folder and read the archives back."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archive(pages, path)
    return read_archive(pages.sparkSession, path, pages.schema["page_id"].dataType.simpleString())
