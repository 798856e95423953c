"""WARC archives with boundary-chain verification (operator 1).

Writing: one record per row, as uncompressed WARC 1.1 that Spark's text
writer lays out (the blank lines after a record are the line separator), so
archives can be split and can lie in any store Spark reaches.  Equal payloads
are written once; the other rows become ``revisit`` records.

Reading: the magic ``WARC/1.1`` may also stand inside a payload, so a split
of a file can't tell by itself where records begin.  Tasks emit every place
where the magic stands as a candidate, with the offset its Content-Length
leads to.  Pointer jumping from offset 0 of each file, log2(records) rounds of
joins over those pairs of numbers, keeps the candidates that can be reached.
Everything between two kept offsets belongs to the first of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from supplylens.session import scratch_path

from . import common

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE16 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 SHA-1 of a binary column (32 characters, no padding).

    20 bits at a time: 5 hexadecimal digits are 4 base32 digits.
    """
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), BASE16, BASE32)


def _binary(payload: Column, kind: str) -> Column:
    raw = payload if kind == "binary" else F.encode(payload.cast("string"), "UTF-8")
    return F.coalesce(raw, F.lit(b""))


def _field(value: Column) -> Column:
    """A header value on one line; the magic at its end is percent-encoded, as a reader may take it for a record."""
    line = F.regexp_replace(value.cast("string"), r"[\r\n]+", " ")
    return F.regexp_replace(line, r"WARC/1\.1$", "%57ARC/1.1")


def write_warc(spark: SparkSession, rows: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url",
               payload_col: str = "html", min_dedup_bytes: int = 0, date: str = "2000-01-01T00:00:00Z") -> None:
    """Write ``rows`` as WARC archives below ``path``.

    Of rows with equal payloads of at least ``min_dedup_bytes`` bytes, that
    with the largest id is the ``response``; the others are ``revisit``
    records that refer to it.  Null payload: empty.  Null uri: no such field.
    Null id: record id ``urn:x-row:``, always a response.  Rows that share the
    largest id are responses all.  An empty table gives archives without
    records; other columns are ignored.
    """
    kind = dict(rows.dtypes)[payload_col]
    flat = rows.select(F.col(id_col).alias("id"), F.col(uri_col).alias("uri"),
                       _binary(F.col(payload_col), kind).alias("payload"))
    flat = flat.select("*", base32_sha1(F.col("payload")).alias("digest"),
                       F.octet_length("payload").cast("long").alias("n"))
    repeated = (flat.where((F.col("n") >= min_dedup_bytes) & F.col("id").isNotNull())
                .groupBy("digest").agg(F.max("id").alias("first_id"), F.count("*").alias("copies"))
                .where("copies > 1").select(F.col("digest").alias("digest_of"), "first_id"))
    repeated = common.small_side(common.land(spark, repeated, "warc-repeated"), row_bytes=64)
    flat = flat.join(repeated, (F.col("digest") == F.col("digest_of")) & (F.col("n") >= min_dedup_bytes), "left")
    revisit = F.coalesce(F.col("first_id") != F.col("id"), F.lit(False))
    name = lambda c: F.concat(F.lit("<urn:x-row:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "),
                    F.col("n").cast("string"), F.lit(END))
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload").cast("string"))
    block = F.concat(http, body)
    lines = [F.concat(F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
             F.concat(F.lit("WARC-Record-ID: "), name(F.col("id"))),
             F.lit(f"WARC-Date: {date}"),
             F.concat(F.lit("WARC-Target-URI: "), _field(F.col("uri"))),
             F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
             F.when(revisit, F.concat(F.lit(f"WARC-Profile: {REVISIT_PROFILE}\r\nWARC-Refers-To: "),
                                      name(F.col("first_id")))),
             F.lit("Content-Type: application/http; msgtype=response"),
             F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    record = F.concat(F.lit(MAGIC), F.concat_ws("\r\n", *lines), F.lit(END), block)
    flat.select(record.alias("value")).write.option("lineSep", END).text(path)


def _parts(value: Column) -> dict[str, Column]:
    """What a record's text (after the magic) holds, as far as this text reaches."""
    header = F.when(F.contains(value, F.lit(END)), F.substring_index(value, END, 1))
    of = lambda name: F.nullif(F.regexp_extract(header, rf"(?im)^{name}:[ \t]*([^\r\n]*?)[ \t]*$", 1), F.lit(""))
    return {"header": header, "type": of("WARC-Type"), "record_id": of("WARC-Record-ID"),
            "target_uri": of("WARC-Target-URI"), "refers_to": of("WARC-Refers-To"),
            "declared_digest": of("WARC-Payload-Digest"), "content_type": of("Content-Type"),
            "length": F.regexp_extract(header, r"(?im)^Content-Length:[ \t]*(\d{1,18})[ \t]*$", 1).try_cast("long")}


def _with_payload(df: DataFrame, text: str) -> DataFrame:
    """Adds payload (binary), the record's block without the HTTP header if it has one, its bytes and its digest."""
    block = F.substring(F.col(text).cast("binary"), F.octet_length("header") + 5, F.col("length").cast("int"))
    df = df.withColumn("_block", block)
    head = F.substring_index(F.col("_block").cast("string"), END, 1)
    http = F.col("content_type").startswith("application/http")
    body = F.substring(F.col("_block"), F.octet_length(head) + 5, F.lit(2**31 - 1))
    df = df.withColumn("payload", F.when(http, body).otherwise(F.col("_block"))).drop("_block")
    return (df.withColumn("payload_bytes", F.octet_length("payload").cast("long"))
            .withColumn("payload_digest", base32_sha1(F.col("payload"))))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every place where the magic stands, with its absolute offset and where its record would end.

    Columns: file, file_size, offset, bytes (from here to the next magic or
    the end), successor (null without a header), text (from here to the next
    magic), whole (that text holds the whole record), the fields of the
    header and payload.  The text before the first magic of a file, empty in
    a sound archive, has offset -10.  Columns that a caller doesn't use are
    left out before anything is shuffled.
    """
    step = len(MAGIC)
    scan = (spark.read.option("lineSep", MAGIC).text(path)
            .select("value", F.col("_metadata.file_path").alias("file"),
                    F.col("_metadata.file_size").alias("file_size"),
                    F.col("_metadata.file_block_start").alias("block"))
            .withColumn("at", F.monotonically_increasing_id())
            .withColumn("bytes", F.octet_length("value").cast("long")))
    scan = scan.select("*", *[c.alias(k) for k, c in _parts(F.col("value")).items()])
    need = F.octet_length("header") + 4 + F.col("length")
    scan = (scan.withColumn("need", need.cast("long"))
            .withColumn("whole", F.coalesce(F.col("bytes") >= F.col("need"), F.lit(False))))
    scan = _with_payload(scan, "value").withColumnRenamed("value", "text").drop("header")
    # Offsets: a running sum in each split of a file, after the sums of the splits before it.
    split = Window.partitionBy("file", "block").orderBy("at")
    scan = scan.withColumn("start", F.sum(F.col("bytes") + step).over(
        split.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("bytes") - step)
    base = (scan.groupBy("file", "block").agg(F.max(F.col("start") + F.col("bytes") + step).alias("_sum"))
            .withColumn("_base", F.coalesce(F.sum("_sum").over(
                Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            .select(F.col("file").alias("_file"), F.col("block").alias("_block"), "_base"))
    scan = scan.join(base, (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block")))
    return (scan.withColumn("offset", F.col("_base") + F.col("start") - step)
            .withColumn("successor", F.col("offset") + step + F.col("need") + len(END))
            .drop("_file", "_block", "_base", "block", "at", "start", "need"))


def reachable(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(file, offset, successor) of the edges that a walk from offset 0 of each file meets.

    Pointer jumping: after round k the walk's first 2**k steps are known and
    every pointer spans 2**k steps.  Each round's two tables are checkpointed
    in the shared folder.
    """
    edges = edges.where("successor > offset").select("file", "offset", "successor").distinct()
    edges = common.land(spark, edges, "warc-edges")
    known = edges.where("offset = 0").select("file", "offset")
    jump = edges.select(F.col("file").alias("of"), F.col("offset").alias("from"), F.col("successor").alias("to"))
    n = known.count()
    while n:
        ahead = (known.join(jump, (F.col("file") == F.col("of")) & (F.col("offset") == F.col("from")))
                 .select("file", F.col("to").alias("offset")))
        ahead = ahead.join(edges, ["file", "offset"], "left_semi")
        known = common.land(spark, known.unionByName(ahead).distinct(), "warc-known")
        total = known.count()
        if total == n:
            break
        n = total
        a, b = jump.alias("a"), jump.alias("b")
        jump = common.land(spark, a.join(b, (F.col("a.of") == F.col("b.of")) & (F.col("a.to") == F.col("b.from")))
                           .select("a.of", "a.from", "b.to"), "warc-jump")
    return known.join(edges, ["file", "offset"])


RECORD = ["file", "offset", "type", "record_id", "target_uri", "refers_to", "declared_digest", "payload_bytes",
          "payload_digest", "payload"]


def read_warc(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """The records below ``path``, with the columns of ``RECORD``.

    With ``strict`` a file whose chain of records doesn't end at its end (cut
    short, or damaged) raises a ValueError; otherwise its records up to there
    are returned.  A folder without records gives an empty table.
    """
    found = candidates(spark, path)
    places = common.land(spark, found.select("file", "file_size", "offset", "successor", "whole"), "warc-places")
    # a record that the end of its file cuts is none
    chain = common.land(spark, reachable(spark, places.where("successor <= file_size")), "warc-chain")
    if strict:
        sizes = places.groupBy("file").agg(F.max("file_size").alias("size"))
        ends = chain.groupBy("file").agg(F.max("successor").alias("end"))
        bad = sizes.join(ends, "file", "left").where("not size <=> end").select("file").limit(5).collect()
        if bad:
            raise ValueError(f"records don't reach the end of {[r['file'] for r in bad]}")
    kept = chain.select("file", "offset")
    simple = found.where("whole").join(kept, ["file", "offset"], "left_semi").select(*RECORD)
    # A payload that holds the magic reaches over several candidates: join their texts again.
    pieces = common.land(spark, _pieces(places, kept), "warc-pieces")
    if pieces.isEmpty():
        return simple
    return simple.unionByName(_rejoined(found, pieces))


def _pieces(places: DataFrame, kept: DataFrame) -> DataFrame:
    """(file, offset, owner) of the candidates that make up records with the magic in them.

    The owner of a candidate is the last kept offset at or before it.  Only
    files that hold such a record are sorted, and only their offsets.
    """
    kept = kept.withColumn("own", F.col("offset"))
    light = places.where("offset >= 0").join(kept, ["file", "offset"], "left")
    files = light.where("own is not null and not whole").select("file").distinct()
    last = F.last(F.when(F.col("own").isNotNull(), F.struct("own", "whole")), ignorenulls=True).over(
        Window.partitionBy("file").orderBy("offset"))
    return (light.join(files, "file", "left_semi").withColumn("_last", last)
            .where("not _last.whole").select("file", "offset", F.col("_last.own").alias("owner")))


def _rejoined(found: DataFrame, pieces: DataFrame) -> DataFrame:
    """The records whose text several candidates hold; a group is one record."""
    texts = found.select("file", "offset", "text").join(pieces, ["file", "offset"])
    whole = (texts.groupBy("file", F.col("owner").alias("offset"))
             .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "text"))), lambda x: x["text"]),
                               MAGIC).alias("text")))
    whole = whole.select("file", "offset", "text", *[c.alias(k) for k, c in _parts(F.col("text")).items()])
    return _with_payload(whole, "text").select(*RECORD)


def resolve(spark: SparkSession, records: DataFrame) -> DataFrame:
    """Per record: record_id, type, refers_to, payload_bytes and payload_digest of the full payload.

    A revisit takes both from the response that it refers to; if that is not
    in the archives they are null.
    """
    light = common.land(spark, records.select("record_id", "type", "refers_to", "payload_bytes", "payload_digest"),
                        "warc-records")
    revisit = F.col("type") == "revisit"
    first = (light.where(~revisit).groupBy(F.col("record_id").alias("_id"))
             .agg(F.max("payload_bytes").alias("payload_bytes"), F.max("payload_digest").alias("payload_digest")))
    told = (light.where(revisit).select("record_id", "type", "refers_to")
            .join(first, F.col("refers_to") == F.col("_id"), "left").drop("_id"))
    return light.where(~revisit).unionByName(told)


def row_id(record_id: Column) -> Column:
    """The integer id in a record id that :func:`write_warc` made."""
    return F.regexp_extract(record_id, r"^<urn:x-row:(-?\d+)>$", 1).try_cast("long")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_warc(spark, common.table(spark, sf_dir, "pages"), path)
    return resolve(spark, read_warc(spark, path)).select(
        row_id(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest",
        F.col("type").alias("record_type"), row_id(F.col("refers_to")).alias("refers_to"))


OP1_SQL = r"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (
  SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes,
         (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                                   1 + ((('0x' || substr(sha1(payload), 1 + 5 * (i // 4), 5))::BIGINT >> (5 * (3 - i % 4))) & 31)::INT, 1), '' ORDER BY i)
          FROM range(32) t(i)) AS payload_digest
  FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM m
"""
