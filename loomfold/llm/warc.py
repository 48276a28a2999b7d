"""WARC archives: written and read by Spark's own text source, copies turned into revisits.

``write_archive`` writes a record for every row, ``read_archive`` reads any uncompressed or gzipped
archive back, and ``deduplicate`` rewrites an archive: it shuffles the headers by payload digest,
makes every copy a revisit of its first response, and gives all records fresh headers.  ``resolve``
joins revisits to the responses they refer to.  All of it runs in the JVM; payloads are shuffled
only where the revisits are too many to broadcast.
"""

from __future__ import annotations

import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomfold.lineage import keep, salted_lookup, scratch, small

VERSION, BREAK = "WARC/1.1\r\n", "\r\n\r\n"
#: The profile of revisits with equal payloads, and the digits of base 32 as ``conv`` and as digests write them.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CONV_DIGITS, DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Revisits up to this number may be broadcast: at some 200 bytes each, 40 MB.
BROADCAST_ROWS = 200_000

HEADERS = "record_id", "record_type", "key", "uri", "date", "payload_bytes", "payload_digest", "content", "refers_to"


def payload_digest(payload: Column) -> Column:
    """SHA-1 of a binary column in upper-case base 32, without a label."""
    code = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(code, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), CONV_DIGITS, DIGITS)


def fresh_id(seed: Column) -> Column:
    """A record id that depends on ``seed`` alone, so a repeated task gives it again."""
    code = F.md5(seed.cast("binary"))
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *[F.substring(code, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]))


def _safe(value: Column) -> Column:
    """A header value on one line: line breaks and other controls become per cent codes."""
    every = [F.lit(chr(c)) for c in (*range(0x20), 0x7F)]
    return F.when(value.rlike(r"[\x00-\x1F\x7F]"), F.aggregate(F.array(*every), value, lambda v, c: F.replace(v, c, F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))))).otherwise(value)


def _line(name: str, value: Column, shape: str = "{}") -> Column:
    """A header line, null (and so left out) where the value is."""
    before, after = shape.split("{}")
    return F.concat(F.lit(f"{name}: {before}"), value.cast("string"), F.lit(after))


def write_archive(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write ``record_id, record_type, key, uri, date, payload, payload_digest`` and, for revisits,
    ``refers_to, refers_uri, refers_date`` as WARC records, one file a task.

    The payload (binary; null counts as empty) follows a short HTTP head; revisits have the head
    only.  Null values have no header line.  Committed by Spark, so lost tasks leave nothing.
    """
    body = F.coalesce(F.col("payload"), F.lit(b"")).cast("string")
    revisit = F.col("record_type") == "revisit"
    head = F.concat_ws("\r\n", F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=utf-8"),
                       F.when(~revisit, _line("Content-Length", F.octet_length(body))), F.lit("\r\n"))
    block = F.when(revisit, head).otherwise(F.concat(head, body))
    lines = F.concat_ws(
        "\r\n", F.lit(VERSION[:-2]), _line("WARC-Type", F.col("record_type")), _line("WARC-Record-ID", F.col("record_id"), "<{}>"), _line("WARC-Date", F.col("date")),
        _line("WARC-Target-URI", _safe(F.col("uri"))), _line("X-Record-Key", _safe(F.col("key").cast("string"))), _line("WARC-Payload-Digest", F.col("payload_digest"), "sha1:{}"),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")), _line("WARC-Refers-To", F.col("refers_to"), "<{}>"), _line("WARC-Refers-To-Target-URI", _safe(F.col("refers_uri"))),
        _line("WARC-Refers-To-Date", F.col("refers_date")), F.lit("Content-Type: application/http;msgtype=response"), _line("Content-Length", F.octet_length("_block")))
    (records.withColumn("_block", block).select(F.concat(lines, F.lit(BREAK), F.col("_block")).alias("value"))
     .write.option("lineSep", BREAK).option("compression", compression).text(path))


def _field(name: str, kind: str = "string") -> Column:
    found = F.regexp_extract("_head", rf"(?im)^{name}:[ \t]*(.*?)[ \t]*\r?$", 1)
    return F.when(found != "", found).cast(kind)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The text between version lines, its place, and how long the record that starts there says it is."""
    raw = (spark.read.option("lineSep", VERSION).text(path)
           .select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_at")))
    headed = raw.withColumn("_head", F.substring_index("value", BREAK, 1))
    return headed.withColumn("_need", F.octet_length("_head") + 2 * len(BREAK) + _field("Content-Length", "long"))


def _stitched(torn: DataFrame) -> DataFrame:
    """Whole records of files in which a payload holds a version line.  A task reads the lengths of one file's pieces."""
    def number(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_split", "_at"], kind="stable").reset_index(drop=True)
        records, record, left = [], -1, 0
        for size, need in zip(rows["_size"].tolist(), rows["_need"].tolist()):
            if left > 0:
                left -= len(VERSION) + size
            elif size:                                                        # nothing stands before a file's first version line
                record, left = record + 1, (need if need == need else size) - size
            records.append(record)
        return rows[["_file", "_split", "_at"]].assign(_record=records)

    lengths = torn.select("_file", "_split", "_at", F.octet_length("value").alias("_size"), F.col("_need").cast("double"))
    numbers = lengths.groupBy("_file").applyInPandas(number, "_file string, _split long, _at long, _record long")
    parts = F.array_sort(F.collect_list(F.struct("_split", "_at", "value")))
    whole = torn.join(numbers.where("_record >= 0"), ["_file", "_split", "_at"]).groupBy("_file", "_record").agg(F.array_join(F.transform(parts, lambda p: p["value"]), VERSION).alias("value"))
    return whole.withColumn("_head", F.substring_index("value", BREAK, 1))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every record: ``record_id, record_type, key, uri, date, payload, payload_digest`` (as its header says, bare),
    ``refers_to``.

    Files are read by Spark (split where they are not compressed).  A record ends where its length
    says: a payload that holds version lines, or whole records, comes back whole.  Absent header
    lines are null, an archive without records gives no rows.
    """
    pieces = _pieces(spark, path)
    torn = pieces.where("value <> ''").where(~F.col("_need").eqNullSafe(F.octet_length("value").cast("long"))).select("_file").distinct()
    rows = pieces.where("value <> ''").select("value", "_head")
    if not torn.isEmpty():
        rows = pieces.where("value <> ''").join(torn, "_file", "left_anti").select("value", "_head").unionByName(
            _stitched(keep(pieces.drop("_head").join(torn, "_file", "left_semi"))).select("value", "_head"))
    raw = F.col("value").cast("binary")
    size = F.col("_length")
    block = rows.withColumn("_length", _field("Content-Length", "int")).withColumn("_block", F.substring(raw, F.octet_length("_head") + len(BREAK) + 1, size))
    http = F.octet_length(F.substring_index(F.col("_block").cast("string"), BREAK, 1)) + len(BREAK)
    payload = F.when(_field("Content-Type").startswith("application/http"), F.substring(F.col("_block"), http + 1, F.greatest(F.lit(0), size - http))).otherwise(F.col("_block"))
    bare = lambda name: F.regexp_replace(_field(name), "^<|>$", "")
    return block.select(bare("WARC-Record-ID").alias("record_id"), _field("WARC-Type").alias("record_type"), _field("X-Record-Key").alias("key"), _field("WARC-Target-URI").alias("uri"),
                        _field("WARC-Date").alias("date"), payload.alias("payload"), F.regexp_replace(_field("WARC-Payload-Digest"), "^sha1:", "").alias("payload_digest"),
                        bare("WARC-Refers-To").alias("refers_to"))


def headers(records: DataFrame) -> DataFrame:
    """Records without payloads.  Responses get the size, digest and checksum of what they hold; a revisit has no payload."""
    held = F.when(F.col("record_type") != "revisit", F.col("payload"))
    return records.select("record_id", "record_type", "key", "uri", "date", F.octet_length(held).cast("long").alias("payload_bytes"),
                          F.coalesce(payload_digest(held), F.col("payload_digest")).alias("payload_digest"), F.sha2(held, 256).alias("content"), "refers_to")


def _hot(counted: DataFrame, key: str, total: int) -> DataFrame:
    """Keys with at least a 200th of all rows: 200 at most."""
    return counted.where(F.col("n") * 200 >= max(1, total)).select(key)


def resolve(heads: DataFrame) -> DataFrame:
    """``heads`` with ``original`` (the key of the response that a revisit refers to) and that response's payload columns.

    Revisits of records that are not there keep their own digest and nulls.  ``heads`` must be a
    stored table.  A response with very many revisits is spread over tasks.
    """
    revisits, others = heads.where("record_type = 'revisit'"), heads.where("NOT (record_type <=> 'revisit')")
    told = others.where("record_id IS NOT NULL").groupBy(F.col("record_id").alias("refers_to")).agg(
        F.min(F.struct(F.col("key").alias("original"), F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_digest"), F.col("content").alias("_content"))).alias("_o"))
    hot = _hot(revisits.where("refers_to IS NOT NULL").groupBy("refers_to").agg(F.count("*").alias("n")), "refers_to", heads.count())
    found = salted_lookup(revisits, told, "refers_to", hot, "record_id").select(
        "record_id", "record_type", "key", "uri", "date", F.col("_o._bytes").alias("payload_bytes"), F.coalesce("_o._digest", "payload_digest").alias("payload_digest"),
        F.col("_o._content").alias("content"), "refers_to", "_o.original")
    return others.withColumn("original", F.lit(None).cast("string")).unionByName(found)


def copies(heads: DataFrame, least: int = 0, order: tuple[Column, ...] = ()) -> DataFrame:
    """The records that repeat another's payload of at least ``least`` bytes: ``record_id`` and the first record's
    ``refers_to, refers_uri, refers_date``.

    First is what sorts first by ``order`` (the key as it is by default; nulls last), then by
    record id.  Headers are shuffled by digest; digests of very many records are spread over tasks.
    ``heads`` must be a stored table with unique record ids.
    """
    order = order or (F.col("key"),)
    rank = [x for c in order for x in (c.isNull(), c)] + [F.col("record_id")]
    place = F.struct(*[c.alias(f"_{i}") for i, c in enumerate(rank)], "uri", "date")
    same = heads.where(F.col("content").isNotNull() & (F.col("payload_bytes") >= least)).withColumn("_same", F.concat_ws(":", "payload_digest", "content"))
    firsts = same.groupBy("_same").agg(F.min(place).alias("_first"), F.count("*").alias("n")).where("n > 1")
    found = salted_lookup(same, firsts, "_same", _hot(firsts, "_same", heads.count()), "record_id")
    first = F.col("_first")[f"_{len(rank) - 1}"]
    return found.where(first.isNotNull() & (first != F.col("record_id"))).select("record_id", first.alias("refers_to"), F.col("_first.uri").alias("refers_uri"), F.col("_first.date").alias("refers_date"))


def deduplicate(spark: SparkSession, source: str, target: str, least: int = 0, order: tuple[Column, ...] = (), compression: str = "gzip") -> None:
    """Rewrite the archive at ``source`` to ``target``: one response for equal payloads, all others revisits of it.

    Revisits that ``source`` holds already are joined to their originals first, so chains end at a
    response; those whose original is missing stay as they are.  Every record gets a fresh id.
    """
    records = read_archive(spark, source)
    heads = keep(resolve(keep(headers(records))))
    again = keep(copies(heads, least, order))
    # what already was a revisit of a kept response refers to it under its new id
    old = heads.where("record_type = 'revisit' AND content IS NULL").select("record_id", "refers_to", F.lit(None).cast("string").alias("refers_uri"), F.lit(None).cast("string").alias("refers_date"))
    kept = heads.where("record_type = 'revisit' AND content IS NOT NULL").join(again, "record_id", "left_anti").select(
        "record_id", fresh_id(F.col("refers_to")).alias("refers_to"), F.lit(None).cast("string").alias("refers_uri"), F.lit(None).cast("string").alias("refers_date"))
    revisits = again.withColumn("refers_to", fresh_id(F.col("refers_to"))).unionByName(old).unionByName(kept)
    revisits = F.broadcast(revisits) if small(revisits, BROADCAST_ROWS) else revisits
    kind = F.when(F.col("_revisit"), "revisit").otherwise(F.col("record_type"))
    fresh = (records.drop("refers_to").join(revisits.withColumn("_revisit", F.lit(True)), "record_id", "left")
             .withColumn("payload_digest", F.when(F.col("record_type") == "revisit", F.col("payload_digest")).otherwise(payload_digest(F.col("payload"))))
             .withColumn("record_type", kind).withColumn("record_id", fresh_id(F.col("record_id"))))
    write_archive(fresh, target, compression)


def captured(pages: DataFrame, key: str = "page_id", uri: str = "url", payload: str = "html", date: str | None = None) -> DataFrame:
    """A response record for every row: repeated rows are records of their own, a null payload is empty, other columns are left out."""
    when = date or datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    body = F.coalesce(pages[payload].cast("binary"), F.lit(b""))
    rows = pages.select(pages[key].cast("string").alias("key"), pages[uri].cast("string").alias("uri"), body.alias("payload"))
    absent = F.lit(None).cast("string")
    return rows.select(F.concat(F.lit("urn:uuid:"), F.uuid()).alias("record_id"), F.lit("response").alias("record_type"), "key", "uri", F.lit(when).alias("date"), "payload",
                       payload_digest(F.col("payload")).alias("payload_digest"), absent.alias("refers_to"), absent.alias("refers_uri"), absent.alias("refers_date"))


def archived(pages: DataFrame, key: str = "page_id", uri: str = "url", payload: str = "html", least: int = 0, folder: str | None = None) -> DataFrame:
    """Write ``pages`` as an archive, rewrite it without copies, and read the result back.

    One row a page: the key (as text), ``payload_bytes``, ``payload_digest``, ``record_type`` and
    ``original``, the key that a revisit refers to; the archives stay in ``folder`` (a new one in
    the shared checkpoint folder by default) as ``captured`` and ``deduplicated``.  Whole-number
    keys are ordered as numbers.  An empty table gives empty archives and no rows.
    """
    spark = pages.sparkSession
    folder = folder or scratch(spark, "warc")
    write_archive(captured(pages, key, uri, payload), f"{folder}/captured")
    by = F.col("key").cast("long") if dict(pages.dtypes)[key] in ("bigint", "int", "smallint", "tinyint") else F.col("key")
    deduplicate(spark, f"{folder}/captured", f"{folder}/deduplicated", least, (by,))
    return resolve(keep(headers(read_archive(spark, f"{folder}/deduplicated"))))
