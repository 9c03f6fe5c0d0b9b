r"""Operator 9: WARC files, written and read back with Spark's text source.

Writing: one record a page, header and payload as one string, the record end
CR LF CR LF as line separator, so every part file is a valid WARC file. Of
pages with equal payloads (100 bytes at least) the one with the smallest
page_id is the response; the others become revisit records that name it.

Reading (boundary-chain verification): the version line is the line separator,
so each row is what follows one candidate magic. A row's place in its file is
the running length of the rows before it: inside a file block by scan order,
over blocks by block totals. Each candidate emits the offset at which its
successor must start (its own, plus header, plus Content-Length, plus the
record end). Inside a block, candidates whose successor is simply the next row
are joined to segments; pointer jumping over the segments, from offset 0 of
each file, keeps the reachable records, in log2(segments) rounds of joins.
Magic inside a payload is a candidate that no chain reaches: its text goes
back to the record it lies in (found again by content, so no payload of the
plain rows is ever shuffled or stored).

Cases: null html is an empty payload; null url leaves the header out; line
breaks in a url are percent-encoded; a null page_id is written without id and
can revisit but not be revisited; repeated rows with the smallest page_id are
all responses; an empty table gives no records; other columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.files import scratch_path
from .common import cut_lineage, small_enough

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
MIN_REVISIT = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def first_of_payload(pages: DataFrame) -> DataFrame:
    """(sha, first): payloads held by several pages and their smallest page_id."""
    return (pages.where(F.col("bytes") >= MIN_REVISIT).groupBy("sha")
            .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
            .where("n > 1 and first is not null").select("sha", "first"))


def write_warc(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z",
               id_col="page_id", url_col="url", html_col="html") -> str:
    """Write ``pages`` as WARC files under ``path``; returns ``path``."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), html.alias("html"))
    p = (p.withColumn("sha", F.unhex(F.sha2(F.col("html").cast("binary"), 256)))
          .withColumn("bytes", F.octet_length("html").cast("long")))
    first = cut_lineage(first_of_payload(p.select("page_id", "sha", "bytes")), "warc-first")
    # digest and id are 40 bytes a row: broadcast behind the check, else AQE splits a hot digest
    p = p.join(F.broadcast(first) if small_enough(first, 64) else first, "sha", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")) \
        & (F.col("bytes") >= MIN_REVISIT)
    line = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(name + ": "), c, F.lit("\r\n"))).otherwise("")
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = F.concat(
        F.lit(MAGIC), line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.col("page_id"))), line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.lower(F.hex("sha")))),
        line("X-Payload-Length", F.col("bytes").cast("string")),
        F.when(again, F.concat(line("WARC-Refers-To", urn(F.col("first"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(again, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
        F.lit("\r\n"))
    rec = F.concat(head, F.when(again, "").otherwise(F.col("html")))
    p.select(rec.alias("value")).write.option("lineSep", END).mode("overwrite").text(path)
    return path


def _field(name: str, pattern: str = r"([^\r\n]*)"):
    got = F.regexp_extract("head", rf"(?i)(?:^|\n){name}: *{pattern}", 1)
    return F.when(got != "", got)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.option("lineSep", MAGIC).text(path)
            .select("value", F.col("_metadata.file_path").alias("file"),
                    F.col("_metadata.file_block_start").alias("block")))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """One row a piece between magics: place, successor, header fields; payload
    digest where the piece holds the whole record."""
    raw = _pieces(spark, path)
    split_at = F.instr(F.col("value"), END) > 0
    d = raw.select(
        "file", "block", F.monotonically_increasing_id().alias("seq"),
        F.octet_length("value").cast("long").alias("len"), F.xxhash64("value").alias("xh"),
        F.when(split_at, F.substring_index("value", END, 1)).alias("head"),
        F.col("value").cast("binary").alias("bin"))
    d = d.withColumn("hlen", F.octet_length("head").cast("long"))
    d = d.withColumn("clen", F.try_to_number(_field("Content-Length", r"([0-9]{1,18})"), F.lit("9" * 18)).cast("long"))
    d = d.withColumn("whole", F.coalesce(F.col("len") == F.col("hlen") + F.col("clen") + 8, F.lit(False)))
    body = F.expr("substring(bin, cast(hlen + 5 as int), cast(clen as int))")
    d = d.select(
        "file", "block", "seq", "len", "xh", "hlen", "clen", "whole",
        F.when(F.col("whole"), F.sha2(body, 256)).alias("sha"),
        _field("WARC-Type").alias("type"),
        _field("WARC-Record-ID", r"<urn:page:(-?[0-9]+)>").cast("long").alias("page_id"),
        _field("WARC-Refers-To", r"<urn:page:(-?[0-9]+)>").cast("long").alias("refers_to"),
        _field("WARC-Payload-Digest", r"sha256:([0-9a-f]+)").alias("digest"),
        _field("X-Payload-Length", r"([0-9]{1,18})").cast("long").alias("full_len"))
    d = cut_lineage(d, "warc-pieces")
    size = F.col("len") + len(MAGIC)
    base = (d.groupBy("file", "block").agg(F.sum(size).alias("n"))
            .withColumn("base", F.coalesce(F.sum("n").over(
                Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            .select("file", "block", "base"))
    before = F.coalesce(F.sum(size).over(Window.partitionBy("file", "block").orderBy("seq")
                                         .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = d.withColumn("rel", before).join(base, ["file", "block"])
    # what stands before the first magic of a file is no candidate
    d = d.withColumn("off", F.col("base") + F.col("rel") - len(MAGIC)).where("off >= 0")
    d = d.withColumn("succ", F.col("off") + len(MAGIC) + F.col("hlen") + F.col("clen") + 8)
    w = Window.partitionBy("file", "block").orderBy("off")
    brk = F.when(F.lag("succ").over(w).eqNullSafe(F.col("off")), None).otherwise(F.col("off"))
    # head of the segment a row belongs to: the last break up to it
    return d.withColumn("brk", brk).withColumn("seg", F.last("brk", True).over(
        w.rowsBetween(Window.unboundedPreceding, 0))).drop("brk", "base", "rel", "seq")


def reachable(rows: DataFrame) -> DataFrame:
    """(file, seg, entry): segments that the chain from offset 0 enters, and where."""
    segs = rows.groupBy("file", "seg").agg(F.max_by("succ", "off").alias("exit"))
    at = rows.select("file", F.col("off").alias("exit"), F.col("seg").alias("to"))
    jump = cut_lineage(segs.join(at, ["file", "exit"])
                       .select("file", "seg", "to", F.col("exit").alias("entry")), "warc-jump")
    reach = cut_lineage(rows.where("off = 0").select("file", "seg", F.lit(0).cast("long").alias("entry")),
                        "warc-reach")
    while True:
        new = cut_lineage(reach.select("file", "seg").join(jump, ["file", "seg"])
                          .select("file", F.col("to").alias("seg"), "entry"), "warc-new")
        if new.isEmpty():
            return reach
        reach = cut_lineage(reach.union(new), "warc-reach")
        nxt = jump.select("file", F.col("seg").alias("to"), F.col("to").alias("to2"), F.col("entry").alias("entry2"))
        jump = cut_lineage(jump.join(nxt, ["file", "to"])
                           .select("file", "seg", F.col("to2").alias("to"), F.col("entry2").alias("entry")),
                           "warc-jump")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The reachable records: file, off, type, page_id, refers_to, payload_bytes,
    payload_digest (computed from the bytes; a revisit's from its header) and
    digest_ok (stated digest = computed digest)."""
    rows = cut_lineage(candidates(spark, path), "warc-rows")
    rows = rows.join(reachable(rows), ["file", "seg"], "left")
    rows = rows.withColumn("real", F.coalesce(F.col("off") >= F.col("entry"), F.lit(False)))
    # records with magic inside, and the pieces of them: usually none or few
    odd = rows.where("not real or not whole").select("file", "off", "real", "xh", "len", "hlen", "clen")
    owner = F.last(F.when(F.col("real"), F.col("off")), True).over(
        Window.partitionBy("file").orderBy("off").rowsBetween(Window.unboundedPreceding, 0))
    odd = cut_lineage(odd.withColumn("rec", owner).where("rec is not null"), "warc-odd")
    need = odd.select("xh", "len").distinct()
    raw = _pieces(spark, path).select("value", F.xxhash64("value").alias("xh"),
                                      F.octet_length("value").cast("long").alias("len"))
    need = F.broadcast(need) if small_enough(need, 32) else need
    texts = raw.join(need, ["xh", "len"], "left_semi").dropDuplicates(["xh", "len"])
    whole = (odd.join(texts, ["xh", "len"]).groupBy("file", "rec")
             .agg(F.sort_array(F.collect_list(F.struct("off", "value"))).alias("ps"),
                  F.max(F.when(F.col("real"), F.col("hlen"))).alias("h"),
                  F.max(F.when(F.col("real"), F.col("clen"))).alias("c"))
             .withColumn("bin", F.array_join(F.transform("ps", lambda x: x["value"]), MAGIC).cast("binary"))
             .select("file", F.col("rec").alias("off"),
                     F.sha2(F.expr("substring(bin, cast(h + 5 as int), cast(c as int))"), 256).alias("sha2")))
    rec = rows.where("real").join(whole, ["file", "off"], "left")
    sha = F.coalesce("sha", "sha2")
    revisit = F.col("type") == "revisit"
    return rec.select(
        "file", "off", "page_id", "type", "refers_to",
        F.when(revisit, F.col("full_len")).otherwise(F.col("clen")).alias("payload_bytes"),
        F.when(revisit, F.col("digest")).otherwise(sha).alias("payload_digest"),
        (revisit | (F.col("digest") == sha)).alias("digest_ok"))


def query(spark, sf_dir):
    from .common import prepare, table
    prepare(spark)
    path = write_warc(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    return read_warc(spark, path).select(
        "page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")


SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha256(coalesce(html, '')) AS sha FROM pages),
f AS (SELECT sha, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY sha HAVING count(*) > 1)
SELECT page_id, n AS payload_bytes, p.sha AS payload_digest,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.sha = f.sha AND p.n >= 100
"""
