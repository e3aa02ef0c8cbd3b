"""WARC archives written from pages and read back by verified chains of record boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from arbormetric.llm.tables import discard, scratch_folder, small, stored, table

#: Fixed values of the WARC 1.1 format.
MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "


def _octets(column: Column) -> Column:
    return F.octet_length(column).cast("long")


def write_warc(
    pages: DataFrame, path: str, key: str, url: str, payload: str, min_bytes: int = 100, compression: str = "gzip"
) -> None:
    """Write one record per row, one archive per task.

    Of rows with equal payloads of at least ``min_bytes`` bytes the one with the smallest key
    becomes a response and the others revisits that refer to it; rows that repeat the smallest key
    are all responses. A null payload counts as empty, a null url as an empty one, and a row
    with a null key is never referred to. Other columns are not read.
    """
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).cast("string")
    rows = pages.select(F.col(key).cast("long").alias("k"), F.col(url).cast("string").alias("u"), body.alias("p"))
    rows = rows.withColumns({"size": _octets(F.col("p")), "digest": F.sha2(F.col("p").cast("binary"), 256)})
    first = (rows.filter(F.col("size") >= min_bytes).groupBy("digest")
             .agg(F.min("k").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first"))
    rows = rows.join(first, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("k").eqNullSafe(F.col("first"))
    identifier = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">\r\n"))
    block = F.concat(F.lit(HTTP), F.col("size").cast("string"), F.lit(END), F.when(revisit, "").otherwise(F.col("p")))
    refers = F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), identifier(F.col("first")))
    record = F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), identifier(F.col("k")),
        F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce("u", F.lit("")), r"[\x00-\x20\x7f]", "%20"),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"), F.lit("\r\n"),
        F.when(revisit, refers).otherwise(""),
        F.lit("Content-Type: application/http;msgtype=response\r\nContent-Length: "),
        _octets(block).cast("string"), F.lit(END), block)
    rows.select(record).write.option("lineSep", END).option("compression", compression).text(path)


def _candidates(segments: DataFrame) -> DataFrame:
    """Every place where the magic stands, with the offset its header gives for the next record."""
    head = F.split_part(F.col("value"), F.lit(END), F.lit(1))
    length = F.regexp_extract(head, r"(?i)(?:^|\r\n)content-length:[ \t]*([0-9]+)", 1).try_cast("long")
    complete = F.instr("value", END) > 0
    rows = segments.select(
        "file", "block", "id", _octets(F.col("value")).alias("bytes"),
        F.when(complete, _octets(head) + length).alias("content"))
    order = Window.partitionBy("file").orderBy("block", "id")
    before = F.sum(F.col("bytes") + len(MAGIC)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({"at": before - len(MAGIC), "end": F.sum(F.col("bytes") + len(MAGIC)).over(
        Window.partitionBy("file")) - len(MAGIC)})
    after = F.col("at") + F.col("content") + len(MAGIC) + 2 * len(END)
    return rows.filter("at is not null").select("file", "id", "at", "end", after.alias("next"))


def record_chain(segments: DataFrame) -> DataFrame:
    """``id, record, place, parts``: the segments of every true record, by the record's first one.

    Records that follow one another without a gap form a run (a window per file); a run has one
    way out, the successor of its last record. Pointer jumping over the runs' ways out, from the
    start of each file, then tells which entries are reached; the candidates before an entry, and
    those in runs never entered, lie inside payloads.
    """
    rows = _candidates(segments)
    order = Window.partitionBy("file").orderBy("at")
    broken = (~F.coalesce(F.lag("next").over(order) == F.col("at"), F.lit(False))).cast("int")
    runs = rows.withColumn("run", F.sum(broken).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("file", "run").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = stored(runs.withColumn("out", F.last("next").over(whole)))
    outs = runs.groupBy("file", "run").agg(F.first("out").alias("at")).select("file", "at")
    entries = runs.join(outs.union(runs.select("file", F.lit(0).cast("long").alias("at"))).distinct(), ["file", "at"])
    jump = stored(entries.select("file", "at", "run", F.col("out").alias("to")))
    reached = stored(jump.filter("at = 0").select("file", "at"))
    size = reached.count()
    while size:
        found = reached.join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))
        found = found.join(jump.select("file", "at"), ["file", "at"], "left_semi")
        grown = stored(reached.union(found).distinct())
        far = stored(jump.join(jump.select("file", F.col("at").alias("to"), F.col("to").alias("far")), ["file", "to"], "left")
                     .select("file", "at", "run", F.col("far").alias("to")))
        if (now := grown.count()) == size:
            break
        discard(reached), discard(jump)
        reached, jump, size = grown, far, now
    entered = (jump.join(reached, ["file", "at"], "left_semi")
               .groupBy("file", "run").agg(F.min("at").alias("entry")))
    # A run can be entered once only by the chain; its smallest reached entry is that one.
    flagged = runs.join(entered, ["file", "run"], "left").withColumn("true", F.coalesce(F.col("at") >= F.col("entry"), F.lit(False)))
    back = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("file").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
    following = F.last(F.when(F.col("true"), F.col("at")), ignorenulls=True).over(ahead)
    # The end of a true record is the start of the next one, or that of the file.
    flagged = flagged.withColumn("whole", F.coalesce(following, F.col("end")) == F.col("next"))
    last = lambda c: F.last(F.when(F.col("true"), F.col(c)), ignorenulls=True).over(back)
    owned = flagged.withColumns({"record": last("id"), "stop": last("next"), "whole": last("whole")}).filter("whole and at < stop")
    place = Window.partitionBy("file", "record").orderBy("at")
    whole = Window.partitionBy("file", "record")
    return stored(owned.select("id", "record", F.row_number().over(place).alias("place"), F.count("*").over(whole).alias("parts")))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``head, block`` (binary) of every record that the chain of boundaries reaches.

    The archives are read in segments between occurrences of the magic. A chain that breaks, for
    a truncated or damaged record, ends there: that record and what follows it in the file are not
    returned.
    """
    segments = (spark.read.option("lineSep", MAGIC).text(path)
                .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                        F.monotonically_increasing_id().alias("id")))
    chain = record_chain(segments)
    pieces = segments.select("id", "value")
    rows = pieces.join(chain.filter("parts = 1").select("id"), "id").select("value")
    split = chain.filter("parts > 1")
    if split.limit(1).count():
        parts = F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x.value)
        joined = pieces.join(small(split), "id").groupBy("record").agg(F.array_join(parts, MAGIC).alias("value"))
        rows = rows.union(joined.select("value"))
    head = F.split_part(F.col("value"), F.lit(END), F.lit(1))
    length = F.regexp_extract(head, r"(?i)(?:^|\r\n)content-length:[ \t]*([0-9]+)", 1).cast("int")
    block = F.substring(F.col("value").cast("binary"), F.octet_length(head) + len(END) + 1, length)
    return rows.select(head.alias("head"), block.alias("block"))


def page_records(records: DataFrame) -> DataFrame:
    """Per record of ``read_warc``: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    Size and digest come from the payload read back; a revisit takes the size from the response that
    it refers to by id and by the digest in its own header, as several pages may share an id. A
    record without such a response keeps nulls.
    """
    header = lambda name: F.regexp_extract("head", rf"(?:^|\r\n){name}: ([^\r]*)", 1)
    page = lambda name: F.regexp_extract("head", rf"(?:^|\r\n){name}: <urn:page:(-?[0-9]*)>", 1).try_cast("long")
    # The HTTP head is ASCII, so its length in characters is its length in bytes.
    payload = F.expr(f"substring(block, {len(END)} + locate('\\r\\n\\r\\n', cast(substring(block, 1, 4096) as string)))")
    rows = records.select(
        page("WARC-Record-ID").alias("page_id"), header("WARC-Type").alias("record_type"),
        page("WARC-Refers-To").alias("refers_to"), header("WARC-Payload-Digest").alias("named"), payload.alias("payload"))
    rows = rows.select("page_id", "record_type", "refers_to", F.substring_index("named", ":", -1).alias("named"), F.octet_length("payload").cast("long").alias("bytes"),
                       F.sha2("payload", 256).alias("digest"))
    rows = stored(rows)
    target = (rows.filter("record_type = 'response'").select(F.col("page_id").alias("refers_to"), F.col("digest").alias("named"), F.col("bytes").alias("of_target"))
              .distinct())
    revisit = F.col("record_type") == "revisit"
    joined = rows.filter(revisit).join(target, ["refers_to", "named"], "left").select(
        "page_id", F.col("of_target").alias("payload_bytes"), F.when(F.col("of_target").isNotNull(), F.col("named")).alias("payload_digest"), "record_type", "refers_to")
    return rows.filter(~revisit).select(
        "page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type",
        F.lit(None).cast("long").alias("refers_to")).union(joined)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive every page and read the archives back."""
    path = scratch_folder(spark)
    write_warc(table(spark, sf_dir, "pages"), path, "page_id", "url", "html")
    return page_records(read_warc(spark, path))


OP7_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages
), f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""
