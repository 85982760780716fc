"""Registered queries over the test tables, and the SQL that gives the same rows from the plain tables.

Each query encodes table text as gzip, runs an operator, and returns what SQL
can derive from the text itself; compressed sizes are never returned."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gzframe import kernel
from gzframe.functions import columns as C
from gzframe.operators import relations as R
from gzframe.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def zipped(text: Column | str = "text", **options) -> Column:
    return C.gz_compress(text, mtime=0, **options)


LEN = "octet_length(encode(text))"
#: Keys of rows that make one stream: streams grow in number, not in length.
RUN = 5_000


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def roundtrip_documents(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(C.gz_decompress(zipped())).alias("digest"))


@query(f"SELECT doc_id, CAST(1 AS BIGINT) AS member_count, CAST({LEN} AS BIGINT) AS uncompressed_size FROM documents")
def verify_documents(spark, sf_dir):
    rows = R.streams(docs(spark, sf_dir).select("doc_id", zipped().alias("content")), ["doc_id"])
    return rows.select("doc_id", F.col("member_count").cast("long").alias("member_count"), "uncompressed_size")


@query(f"SELECT doc_id, CAST(0 AS BIGINT) AS member_index, CAST(0 AS BIGINT) AS compressed_offset, CAST({LEN} AS BIGINT) AS uncompressed_size, CAST(8 AS BIGINT) AS flags, CAST(doc_id AS BIGINT) AS mtime, 'doc-' || doc_id AS original_filename, CAST({LEN} AS BIGINT) AS trailer_isize FROM documents")
def inspect_documents(spark, sf_dir):
    content = C.gz_compress("text", mtime=F.col("doc_id"), original_filename=F.concat(F.lit("/x/doc-"), F.col("doc_id"), F.lit(".gz")))
    rows = R.members(docs(spark, sf_dir).select("doc_id", content.alias("content")), ["doc_id"])
    return rows.select("doc_id", F.col("index").cast("long").alias("member_index"), "compressed_offset", "uncompressed_size", F.col("flags").cast("long").alias("flags"), "mtime", "original_filename", "trailer_isize")


@query(f"""SELECT source, n - 1 AS member_index, uncompressed_size FROM (
  SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, CAST({LEN} AS BIGINT) AS uncompressed_size FROM documents)""")
def members_by_source(spark, sf_dir):
    each = docs(spark, sf_dir).select("source", "doc_id", zipped().alias("content"))
    rows = R.members(R.concat_members(each, ["source"], "doc_id"), ["source"])
    return rows.select("source", F.col("index").cast("long").alias("member_index"), "uncompressed_size")


@query(f"SELECT lang, count(*) AS members, CAST(sum({LEN}) AS BIGINT) AS uncompressed_size FROM documents GROUP BY lang")
def members_by_lang(spark, sf_dir):
    rows = R.members(docs(spark, sf_dir).select("lang", zipped().alias("content")), ["lang"])
    return rows.groupBy("lang").agg(F.count("*").alias("members"), F.sum("uncompressed_size").alias("uncompressed_size"))


@query("SELECT doc_id, CAST(2 AS BIGINT) AS member_count, md5(text || text) AS digest FROM documents")
def append_two_members(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", C.append_member(zipped(), zipped(level=9)).alias("content"))
    return rows.select("doc_id", C.gz_verify("content").member_count.cast("long").alias("member_count"), F.md5(C.gz_decompress("content")).alias("digest"))


@query(f"SELECT doc_id, CAST(2 AS BIGINT) AS member_count, CAST(2 * {LEN} AS BIGINT) AS uncompressed_size, CAST(39 AS BIGINT) AS padding FROM documents")
def nul_padding_tolerated(spark, sf_dir):
    pad = lambda n: F.unhex(F.lit("00" * n))
    rows = docs(spark, sf_dir).select("doc_id", F.concat(zipped(), pad(7), zipped(), pad(32)).alias("content"))
    found = rows.select("doc_id", C.gz_inspect("content").alias("v"))
    own = F.aggregate("v.members", F.lit(0).cast("long"), lambda a, m: a + m.compressed_size)
    return found.select("doc_id", F.col("v.member_count").cast("long").alias("member_count"), F.col("v.uncompressed_size").alias("uncompressed_size"), (F.col("v.compressed_size") - own).alias("padding"))


def _broken(spark, sf_dir, change) -> DataFrame:
    rows = docs(spark, sf_dir).select("doc_id", change(zipped()).alias("content"))
    return R.streams(rows, ["doc_id"], mode="PERMISSIVE").select("doc_id", "error_class")


BAD = "SELECT doc_id, 'BAD_GZIP' AS error_class FROM documents"


def _cut(c: Column, less: int) -> Column:
    return F.substring(c, F.lit(1), F.octet_length(c) - less)


@query(BAD)
def crc_corruption_detected(spark, sf_dir):
    # a trailer whose checksum is another one
    return _broken(spark, sf_dir, lambda c: F.concat(_cut(c, 8), F.unhex(F.lpad(F.hex(F.lit(1)), 8, "0")), F.substring(c, F.octet_length(c) - 3, F.lit(4))))


@query(BAD)
def truncation_detected(spark, sf_dir):
    return _broken(spark, sf_dir, lambda c: _cut(c, 3))


@query(BAD)
def garbage_detected(spark, sf_dir):
    return _broken(spark, sf_dir, lambda c: F.concat(c, F.lit("garbage").cast("binary")))


@query(BAD)
def reserved_flags_detected(spark, sf_dir):
    return _broken(spark, sf_dir, lambda c: F.concat(F.substring(c, F.lit(1), F.lit(3)), F.unhex(F.lit("20")), F.substring(c, F.lit(5), F.octet_length(c))))


@query("SELECT doc_id, CAST(1 AS BIGINT) AS member_count, 'BAD_GZIP' AS error_class, md5(text) AS digest FROM documents")
def salvage_before_failure(spark, sf_dir):
    broken = F.concat(zipped(), F.lit("garbage").cast("binary"))
    rows = docs(spark, sf_dir).select("doc_id", C.gz_recover(broken).alias("r"))
    return rows.select("doc_id", F.col("r.member_count").cast("long").alias("member_count"), "r.error_class", F.md5("r.payload_prefix").alias("digest"))


@query(f"SELECT doc_id, {LEN} > 1000 AS limit_exceeded, CAST(least({LEN}, 1000) AS BIGINT) AS delivered FROM documents")
def size_limit(spark, sf_dir):
    rows = R.streams(docs(spark, sf_dir).select("doc_id", zipped().alias("content")), ["doc_id"], max_decompressed_size=1000, mode="PERMISSIVE")
    return rows.select("doc_id", F.coalesce(F.col("error_class") == "LIMIT_EXCEEDED", F.lit(False)).alias("limit_exceeded"), F.col("uncompressed_size").alias("delivered"))


def _lines(spark, sf_dir, ending: str, newline: str | None) -> DataFrame:
    text = F.replace(F.col("text"), F.lit("\n"), F.lit(ending))
    rows = docs(spark, sf_dir).select("doc_id", zipped(text).alias("content"))
    return R.gz_lines(rows, ["doc_id"], newline=newline)


def _lines_sql(kept: str) -> str:
    return f"""WITH parts AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents),
  each_line AS (SELECT doc_id, p, unnest(range(len(p))) AS i FROM parts)
SELECT doc_id, CAST(i AS BIGINT) AS line_no, CASE WHEN i + 1 < len(p) THEN p[i + 1] || {kept} ELSE p[i + 1] END AS line
FROM each_line WHERE i + 1 < len(p) OR p[i + 1] <> ''"""


@query(_lines_sql("chr(10)"))
def lines_lf(spark, sf_dir):
    return _lines(spark, sf_dir, "\n", "\n")


@query(_lines_sql("chr(13) || chr(10)"))
def lines_crlf(spark, sf_dir):
    return _lines(spark, sf_dir, "\r\n", "\r\n")


@query(_lines_sql("chr(13)"))
def lines_cr(spark, sf_dir):
    return _lines(spark, sf_dir, "\r", "\r")


@query(_lines_sql("chr(10)"))
def lines_universal(spark, sf_dir):
    return _lines(spark, sf_dir, "\r\n", None)


@query(_lines_sql("chr(13) || chr(10)"))
def lines_preserve(spark, sf_dir):
    return _lines(spark, sf_dir, "\r\n", "")


@query("""SELECT doc_id, contains(text, chr(10)) AND doc_id % 3 = 0 AS has_lf, contains(text, chr(10)) AND doc_id % 3 = 1 AS has_cr, contains(text, chr(10)) AND doc_id % 3 = 2 AS has_crlf FROM documents""")
def newline_kinds(spark, sf_dir):
    ending = F.when(F.col("doc_id") % 3 == 0, "\n").when(F.col("doc_id") % 3 == 1, "\r").otherwise("\r\n")
    text = C.gz_decompress(zipped(F.replace(F.col("text"), F.lit("\n"), ending))).cast("string")
    return docs(spark, sf_dir).select("doc_id", C.newline_kinds(text).alias("k")).select("doc_id", "k.*")


@query(f"""WITH l AS ({_lines_sql("chr(10)")})
SELECT doc_id, line_no, CAST(coalesce(sum(octet_length(encode(line))) OVER w, 0) AS BIGINT) AS byte_offset, CAST(coalesce(sum(length(line)) OVER w, 0) AS BIGINT) AS char_offset
FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def line_offsets(spark, sf_dir):
    return R.with_offsets(_lines(spark, sf_dir, "\n", "\n"), ["doc_id"]).select("doc_id", "line_no", "byte_offset", "char_offset")


PRIORITY = "SELECT o_orderkey, {} AS part FROM orders"


def _orders(spark, sf_dir):
    payload = C.gz_decompress(zipped(F.concat("o_orderpriority", F.lit("|"), "o_orderstatus")))
    return table(spark, sf_dir, "orders").select("o_orderkey", payload.alias("payload"))


@query(PRIORITY.format("substring(o_orderpriority || '|' || o_orderstatus, 3, 5)"))
def byte_range(spark, sf_dir):
    return _orders(spark, sf_dir).select("o_orderkey", C.byte_range("payload", 2, 5).cast("string").alias("part"))


@query(PRIORITY.format("right(o_orderpriority || '|' || o_orderstatus, 4)"))
def seek_from_end(spark, sf_dir):
    return _orders(spark, sf_dir).select("o_orderkey", C.read_from("payload", C.seek_position("payload", -4, 2)).cast("string").alias("part"))


@query("SELECT page_id, left(html, 15) AS part FROM pages")
def peek_prefix(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", C.peek(C.gz_decompress(zipped("html")), 15).cast("string").alias("part"))


@query(f"SELECT doc_id, CAST(ceil({LEN} / 1024.0) AS BIGINT) AS chunks, CAST({LEN} AS BIGINT) AS bytes FROM documents WHERE text <> ''")
def chunk_counts(spark, sf_dir):
    rows = R.chunks(docs(spark, sf_dir).select("doc_id", zipped().alias("content")), ["doc_id"], size=1024)
    return rows.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.octet_length("data").cast("long")).alias("bytes"))


@query(f"""WITH RECURSIVE l AS MATERIALIZED ({_lines_sql("chr(10)")}),
  fold AS (
    SELECT doc_id, line_no, CAST(0 AS BIGINT) AS batch, CAST(length(line) AS BIGINT) AS size FROM l WHERE line_no = 0
    UNION ALL
    SELECT l.doc_id, l.line_no, CASE WHEN f.size >= 400 THEN f.batch + 1 ELSE f.batch END, CASE WHEN f.size >= 400 THEN length(l.line) ELSE f.size + length(l.line) END
    FROM fold f JOIN l ON l.doc_id = f.doc_id AND l.line_no = f.line_no + 1)
SELECT doc_id, batch, count(*) AS lines, CAST(max(size) AS BIGINT) AS chars FROM fold GROUP BY doc_id, batch""")
def line_batches(spark, sf_dir):
    text = C.gz_decompress(zipped()).cast("string")
    rows = R.batches(docs(spark, sf_dir), ["doc_id"], text, 400, "\n")
    chars = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    return rows.select("doc_id", F.col("batch").cast("long").alias("batch"), F.size("lines").cast("long").alias("lines"), chars.alias("chars"))


@query("SELECT event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def jsonl_events(spark, sf_dir):
    record = F.to_json(F.struct("event_id", "event_type", "value"))
    run = F.floor(F.col("event_id") / RUN)
    lines = table(spark, sf_dir, "events").select(run.alias("run"), "event_id", F.concat(record, F.lit("\n")).alias("line"))
    files = R.encode_chunks(lines, ["run"], "event_id", "line", mtime=0)
    rows = R.gz_lines(files, ["run"], newline="\n").select(F.from_json("line", "event_id long, event_type string, value double").alias("e"))
    return rows.groupBy(F.col("e.event_type").alias("event_type")).agg(F.count("*").alias("events"), F.round(F.sum("e.value"), 4).alias("total"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")
def csv_nation(spark, sf_dir):
    t = table(spark, sf_dir, "nation")
    row = F.concat_ws(",", "n_nationkey", "n_name", "n_regionkey")
    files = R.encode_chunks(t.select("n_regionkey", "n_nationkey", F.concat(row, F.lit("\r\n")).alias("line")), ["n_regionkey"], "n_nationkey", "line", mtime=0)
    rows = R.gz_lines(files, ["n_regionkey"]).select(F.from_csv(F.rtrim("line", F.lit("\n")), F.lit("n_nationkey long, n_name string, n_regionkey long")).alias("r"))
    return rows.select("r.*")


@query("SELECT page_id, regexp_replace(regexp_replace(url || '/file' || page_id || '.gz', '^.*/', ''), '[.]gz$', '') AS name FROM pages")
def header_filename(spark, sf_dir):
    path = F.concat("url", F.lit("/file"), "page_id", F.lit(".gz"))
    rows = table(spark, sf_dir, "pages").select("page_id", zipped("html", original_filename=path).alias("content"))
    return R.members(rows, ["page_id"]).select("page_id", F.col("original_filename").alias("name"))


@query("SELECT event_id, CAST(floor(abs(value) * 1000) AS BIGINT) AS mtime FROM events")
def mtime_bounds(spark, sf_dir):
    when = F.abs("value") * 1000
    rows = table(spark, sf_dir, "events").select("event_id", C.gz_compress("event_type", mtime=when).alias("content"))
    return R.last_mtime(R.members(rows, ["event_id"]), ["event_id"])


@query("SELECT doc_id, true AS same FROM documents")
def crc32_text(spark, sf_dir):
    rows = R.members(docs(spark, sf_dir).select("doc_id", "text", zipped().alias("content")), ["doc_id", "text"])
    return rows.select("doc_id", (F.col("crc32") == F.crc32(F.col("text").cast("binary"))).alias("same"))


@query("SELECT doc_id, md5(text) AS digest, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM documents")
def chunked_round_trip(spark, sf_dir):
    blob = docs(spark, sf_dir).select("doc_id", zipped().alias("content"))
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.octet_length("content") - 1) / 700)), lambda i: F.substring(F.col("content"), (i * 700 + 1).cast("int"), F.lit(700)))
    fed = blob.select("doc_id", F.posexplode(pieces).alias("n", "bytes"))
    out = R.decode_chunks(fed, ["doc_id"], "n", "bytes")
    whole = F.aggregate(F.array_sort(F.collect_list(F.struct("seq", "data"))), F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x.data))
    # a stream without payload has no chunk
    joined = blob.select("doc_id").join(out.groupBy("doc_id").agg(whole.alias("p")), "doc_id", "left").withColumn("p", F.coalesce("p", F.lit(b"").cast("binary")))
    return joined.select("doc_id", F.md5("p").alias("digest"), F.octet_length("p").cast("long").alias("size"))


@query(f"SELECT conv_id, count(*) AS members, CAST(sum({LEN}) AS BIGINT) AS uncompressed_size, md5(string_agg(text, '' ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def conversation_streams(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", zipped().alias("content"))
    whole = R.concat_members(turns, ["conv_id"], "turn")
    rows = whole.select("conv_id", C.gz_verify("content").alias("v"), F.md5(C.gz_decompress("content")).alias("digest"))
    return rows.select("conv_id", F.col("v.member_count").cast("long").alias("members"), F.col("v.uncompressed_size").alias("uncompressed_size"), "digest")


@query("SELECT doc_id, replace(text, chr(10), chr(13) || chr(10)) AS text FROM documents")
def newline_translation_on_write(spark, sf_dir):
    content = C.gz_compress(C.encode_text("text", newline="\r\n"), mtime=0)
    return docs(spark, sf_dir).select("doc_id", C.gz_decompress(content).cast("string").alias("text"))


@query("SELECT doc_id, text AS text, CAST(2 * length(text) + 2 AS BIGINT) AS encoded FROM documents")
def utf16_round_trip(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", C.gz_decompress(zipped(C.encode_text("text", "utf-16"))).alias("p"))
    return rows.select("doc_id", C.decode_text("p", "utf-16").alias("text"), F.octet_length("p").cast("long").alias("encoded"))


@query("SELECT doc_id, CAST(greatest(octet_length(encode(text)), 5000) AS BIGINT) AS size FROM documents")
def zero_fill_seek(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", zipped(C.zero_fill(F.col("text").cast("binary"), 5000)).alias("content"))
    return R.streams(rows, ["doc_id"]).select("doc_id", F.col("uncompressed_size").alias("size"))


def _as_members(b: Column) -> Column:
    """The members of a stream, its trailer's fields among them."""
    return C.gz_inspect(b).members


@query("SELECT doc_id, left(text, 7) AS head, substring(text, 4, 9) AS middle, substring(text, 6) AS rest FROM documents")
def text_reads(spark, sf_dir):
    text = C.decode_text(C.gz_decompress(zipped()))
    return docs(spark, sf_dir).select("doc_id", text.alias("t")).select("doc_id", C.read_text("t", 0, 7).alias("head"), C.read_text("t", 3, 9).alias("middle"), C.read_text("t", 5).alias("rest"))


@query(f"""WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents), l AS (SELECT doc_id, p, unnest(range(len(p))) AS i FROM p)
SELECT doc_id, CAST(i AS BIGINT) AS line_no, CAST(octet_length(encode(p[i + 1])) + CASE WHEN i + 1 < len(p) THEN 1 ELSE 0 END AS BIGINT) AS bytes FROM l WHERE i + 1 < len(p) OR p[i + 1] <> ''""")
def binary_lines(spark, sf_dir):
    lines = C.split_binary_lines(C.gz_decompress(zipped()))
    return docs(spark, sf_dir).select("doc_id", F.posexplode(lines).alias("line_no", "line")).select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.octet_length("line").cast("long").alias("bytes"))


@query(PRIORITY.format("substring(o_orderpriority || '|' || o_orderstatus, 4)"))
def seek_from_start(spark, sf_dir):
    return _orders(spark, sf_dir).select("o_orderkey", C.read_from("payload", C.seek_position("payload", 3, 0)).cast("string").alias("part"))


@query("SELECT o_orderkey, substring(o_orderpriority || '|' || o_orderstatus, 5, 3) AS part, CAST(least(4, length(o_orderpriority) + 2) AS BIGINT) AS position FROM orders")
def seek_from_here(spark, sf_dir):
    # two bytes on from the second byte; then three are read
    at = C.seek_position("payload", 2, 1, 2)
    return _orders(spark, sf_dir).select("o_orderkey", C.read_from("payload", at, 3).cast("string").alias("part"), at.cast("long").alias("position"))


@query("SELECT doc_id, md5(text) AS first, md5(text) AS again FROM documents")
def rewind_and_read_again(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", C.gz_decompress(zipped()).alias("p"))
    start = C.seek_position("p", 0, 0)
    return rows.select("doc_id", F.md5("p").alias("first"), F.md5(C.read_from("p", start)).alias("again"))


@query(f"""WITH l AS ({_lines_sql("chr(10)")}), o AS (SELECT doc_id, line_no, line, coalesce(sum(octet_length(encode(line))) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM l)
SELECT doc_id, line_no, line FROM o WHERE place >= 200""")
def text_seek(spark, sf_dir):
    return R.lines_from(R.with_offsets(_lines(spark, sf_dir, "\n", "\n"), ["doc_id"]), 200).select("doc_id", "line_no", "line")


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def flushed_members(spark, sf_dir):
    # a sync flush after every piece
    pieces = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.octet_length("text") - 1, F.lit(0)) / 300)), lambda i: F.substring(F.col("text").cast("binary"), (i * 300 + 1).cast("int"), F.lit(300)))
    fed = docs(spark, sf_dir).select("doc_id", F.posexplode(pieces).alias("n", "data"))
    streams = R.encode_chunks(fed, ["doc_id"], "n", "data", mtime=0, flush_every=1)
    return streams.select("doc_id", F.md5(C.gz_decompress("content")).alias("digest"))


@query(f"SELECT doc_id, CAST({LEN} % 4294967296 AS BIGINT) AS isize FROM documents")
def strict_size(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", _as_members(zipped(strict_size=True)).alias("m"))
    return rows.select("doc_id", F.col("m")[0].trailer_isize.alias("isize"))


def _with_header_checksum(c: Column, change: int) -> Column:
    """The member with its header's checksum, ``change`` added to it."""
    header = F.concat(F.substring(c, F.lit(1), F.lit(3)), F.unhex(F.lit("02")), F.substring(c, F.lit(5), F.lit(6)))
    sum_ = F.lpad(F.hex((F.crc32(header) + change) % 65536), 4, "0")
    return F.concat(header, F.unhex(F.concat(F.substring(sum_, 3, 2), F.substring(sum_, 1, 2))), F.substring(c, F.lit(11), F.octet_length(c)))


@query(f"SELECT doc_id, CAST(2 AS BIGINT) AS flags, CAST({LEN} AS BIGINT) AS size, 'BAD_GZIP' AS error_class FROM documents")
def header_checksum(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", _with_header_checksum(zipped(), 0).alias("good"), _with_header_checksum(zipped(), 1).alias("bad"))
    v = rows.select("doc_id", _as_members("good").alias("m"), C.gz_verify("bad", mode="PERMISSIVE").alias("v"))
    return v.select("doc_id", F.col("m")[0].flags.cast("long").alias("flags"), F.col("m")[0].uncompressed_size.alias("size"), F.col("v.error_class").alias("error_class"))


@query("SELECT doc_id, md5(text) AS digest, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM documents")
def members_decoded_in_parallel(spark, sf_dir):
    from gzframe.sources.reader import member_payloads

    rows = docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("path"), F.concat(zipped(F.lit("first")), zipped()).alias("content"))
    second = member_payloads(rows).where("index = 1")
    return second.select(F.col("path").cast("long").alias("doc_id"), F.md5("payload").alias("digest"), F.octet_length("payload").cast("long").alias("size"))


@query("""SELECT e.event_id, max(d.doc_id) AS doc_id, max_by(octet_length(encode(d.text)), d.doc_id) AS size FROM events e JOIN documents d ON d.doc_id <= e.event_id AND d.doc_id > e.event_id - 50
WHERE e.event_id % 7 = 0 GROUP BY e.event_id""")
def as_of_join(spark, sf_dir):
    # the last stream at or before each event, within 50: equal buckets of 50, this one and the one before
    events = table(spark, sf_dir, "events").where("event_id % 7 = 0").select("event_id", F.explode(F.array(F.floor(F.col("event_id") / 50), F.floor(F.col("event_id") / 50) - 1)).alias("bucket"))
    streams = R.streams(docs(spark, sf_dir).select("doc_id", zipped().alias("content")), ["doc_id"]).select("doc_id", "uncompressed_size", F.floor(F.col("doc_id") / 50).alias("bucket"))
    pairs = events.join(streams, "bucket").where("doc_id <= event_id AND doc_id > event_id - 50")
    return pairs.groupBy("event_id").agg(F.max("doc_id").alias("doc_id"), F.max_by("uncompressed_size", "doc_id").alias("size"))


@query("SELECT mode, operation, is_text, plus FROM (VALUES ('rb', 'r', false, false), ('rt', 'r', true, false), ('wb', 'w', false, false), ('wt', 'w', true, false), ('ab', 'a', false, false), ('xb', 'x', false, false), ('bx+', 'x', false, true), ('rw', NULL, NULL, NULL), ('rbt', NULL, NULL, NULL), ('', NULL, NULL, NULL)) v(mode, operation, is_text, plus)")
def mode_parser(spark, sf_dir):
    from gzframe.sources.reader import parse_mode

    rows = []
    for mode in ("rb", "rt", "wb", "wt", "ab", "xb", "bx+", "rw", "rbt", ""):
        try:
            rows.append((mode, *parse_mode(mode)))
        except ValueError:
            rows.append((mode, None, None, None))
    return spark.createDataFrame(rows, "mode string, operation string, is_text boolean, plus boolean")


@query(f"""WITH l AS ({_lines_sql("chr(10)")}) SELECT doc_id, CAST(sum(ceil(length(line) / 50.0)) AS BIGINT) AS reads FROM l GROUP BY doc_id""")
def limited_readline(spark, sf_dir):
    text = C.gz_decompress(zipped()).cast("string")
    return docs(spark, sf_dir).select("doc_id", F.size(C.limited_lines(text, 50, "\n")).cast("long").alias("reads")).where("reads > 0")


@query("SELECT doc_id, md5(text) AS digest FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def manifest_anti_join(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", zipped().alias("content"))
    _, unexpected = R.against_manifest(rows, table(spark, sf_dir, "labels").select("doc_id"), ["doc_id"])
    return unexpected.select("doc_id", F.md5(C.gz_decompress("content")).alias("digest"))


@query(f"SELECT source, doc_id, CAST({LEN} AS BIGINT) AS size FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY {LEN} DESC, doc_id) <= 3")
def top_k_by_size(spark, sf_dir):
    from pyspark.sql.window import Window

    rows = R.streams(docs(spark, sf_dir).select("source", "doc_id", zipped().alias("content")), ["source", "doc_id"])
    w = Window.partitionBy("source").orderBy(F.desc("uncompressed_size"), "doc_id")
    return rows.withColumn("n", F.row_number().over(w)).where("n <= 3").select("source", "doc_id", F.col("uncompressed_size").alias("size"))


@query(f"SELECT source, doc_id, CAST(sum({LEN}) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM documents")
def window_running_bytes(spark, sf_dir):
    from pyspark.sql.window import Window

    rows = R.streams(docs(spark, sf_dir).select("source", "doc_id", zipped().alias("content")), ["source", "doc_id"])
    w = Window.partitionBy("source").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("source", "doc_id", F.sum("uncompressed_size").over(w).alias("running"))


@query(f"SELECT lang, source, count(*) AS streams, CAST(sum({LEN}) AS BIGINT) AS bytes FROM documents GROUP BY ROLLUP (lang, source)")
def lang_rollup(spark, sf_dir):
    rows = R.streams(docs(spark, sf_dir).select("lang", "source", zipped().alias("content")), ["lang", "source"])
    return rows.rollup("lang", "source").agg(F.count("*").alias("streams"), F.sum("uncompressed_size").alias("bytes"))


@query("SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS quantity, count(*) AS items FROM lineitem GROUP BY l_returnflag, l_linestatus")
def bulk_csv_lineitem(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    line = F.concat(F.concat_ws(",", "l_returnflag", "l_linestatus", F.col("l_quantity").cast("string")), F.lit("\n"))
    files = R.encode_chunks(t.select((F.floor(F.col("l_orderkey") / RUN)).alias("run"), F.xxhash64("l_orderkey", "l_linenumber").alias("n"), line.alias("line")), ["run"], "n", "line", mtime=0)
    rows = R.gz_lines(files, ["run"], newline="\n").select(F.from_csv("line", F.lit("flag string, status string, quantity double")).alias("r"))
    return rows.groupBy(F.col("r.flag").alias("l_returnflag"), F.col("r.status").alias("l_linestatus")).agg(F.sum("r.quantity").alias("quantity"), F.count("*").alias("items"))


@query("SELECT 'zlib' AS compression, 'zlib' AS decompression, 'zlib' AS crc32")
def engine_report(spark, sf_dir):
    info = kernel.engine_info()
    return spark.createDataFrame([(info["compression"], info["decompression"], info["crc32"])], "compression string, decompression string, crc32 string")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from gzframe.plans import files

    return QUERIES | files.QUERIES


def oracle_sql() -> dict[str, str]:
    from gzframe.plans import files

    return SQL | files.SQL
