"""Landed payloads of unknown quality to text tables.

Kind and encoding are decided where a body lies; its records are rows from then
on.  A bad payload gives a typed error row and never fails a job.  Delimited files
of any size are read as splits by ``parse_files``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import vocab
from plumbline.functions.text import let, strip, strip_front
from plumbline.sources.delimited import decoded, parse_delimited, parse_files

__all__ = ["parse_delimited", "parse_files"]


def read_files(spark: SparkSession, path: str, pattern: str = "*", stream: bool = False, max_bytes: int | None = None) -> DataFrame:
    """Files as payloads: rid is the file path; bodies are whole unless ``max_bytes`` cuts them."""
    reader = (spark.readStream.schema("path string, modificationTime timestamp, length long, content binary") if stream else spark.read)
    files = reader.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    if max_bytes is None:
        return files.select(F.col("path").alias("rid"), "content", F.lit(True).alias("body_complete"))
    return files.select(F.col("path").alias("rid"), F.substring("content", 1, max_bytes).alias("content"), (F.col("length") <= max_bytes).alias("body_complete"))


# --- kind -------------------------------------------------------------------------

LONGEST_MARKER = max(map(len, (*vocab.HTML_MARKERS, *vocab.XML_MARKERS)))


def payload_kind(content: Column, content_type: Column | None = None) -> Column:
    """Coarse kind of a body: whether it holds anything, its first bytes, the first mark behind blanks, NUL bytes anywhere.

    Only blanks in front are looked for, since looking for those behind costs as much as the body is long.
    """
    said_html = F.lit(False) if content_type is None else F.coalesce(F.contains(F.lower(content_type), F.lit("html")), F.lit(False))

    def of(prefix: Column, start: Column) -> Column:
        kind = F.when(prefix == "", F.lit("empty"))
        for signature, name in vocab.MAGIC_HEX:
            kind = kind.when(F.startswith(start, F.lit(signature)), F.lit(name))

        def opens_with(markers):
            found = F.lit(False)
            for marker in markers:
                found = found | F.startswith(prefix, F.lit(marker))
            return found

        return (
            kind.when(said_html, F.lit("html"))
            .when(opens_with(vocab.HTML_MARKERS), F.lit("html")).when(opens_with(vocab.XML_MARKERS), F.lit("xml"))
            .when(opens_with(("{", "[")), F.lit("json")).when(F.contains(content.cast("string"), F.lit("\x00")), F.lit("binary"))
            .otherwise(F.lit("csv")))

    def opened(text: Column) -> Column:
        return F.when(F.startswith(text, F.lit("\ufeff")), strip_front(F.regexp_replace(text, "^\ufeff", ""))).otherwise(text)

    facts = let(strip_front(F.make_valid_utf8(content.cast("string"))), lambda text: F.struct(
        F.lower(F.left(opened(text), F.lit(LONGEST_MARKER))).alias("prefix"), F.hex(F.substring(content, 1, 16)).alias("start")))
    return let(facts, lambda f: of(f["prefix"], f["start"]))


def kind_error(kind: Column, declared: Column) -> Column:
    """Why a body is not read; null when it is a table kind."""
    said = F.coalesce(F.nullif(F.lower(strip(declared)), F.lit("")), F.lit("unknown"))
    return F.when(kind == "empty", F.lit("resource returned an empty body")).when(
        ~kind.isin("csv", "json"), F.format_string("resource declared %s but the body looks like %s", said, kind))


def encoding_audit(content: Column, content_type: Column) -> list[Column]:
    """Declared and actual charset facts of a body."""
    text = F.make_valid_utf8(content.cast("string"))
    return [
        F.nullif(F.lower(F.regexp_extract(content_type, "(?i)charset=[\"']?([\\w.-]+)", 1)), F.lit("")).alias("declared_charset"),
        F.is_valid_utf8(content.cast("string")).alias("valid_utf8"),
        F.contains(text, F.lit("\ufffd")).alias("replacement_chars"),
        text.rlike("Ã[\\u0080-\\u00bf]|Î[\\u0080-\\u00bf]|Ï[\\u0080-\\u00bf]").alias("mojibake"),
    ]


# --- JSON records -----------------------------------------------------------------------


def parse_records(payloads: DataFrame, max_rows: int | None = None) -> DataFrame:
    """JSON arrays of objects, or objects with exactly one list, as rows of cells.

    ``payloads``: rid, content, in any of the known encodings.  All records are given
    unless ``max_rows`` is passed.  Gives rid, row_idx, record (name to text,
    in written order), truncated, error_kind; nested values stay JSON text.
    """
    text = strip(decoded(F.col("content"))["text"])
    opened = payloads.select("rid", text.alias("t")).withColumn("is_list", F.startswith("t", F.lit("[")))
    entries = F.map_entries(F.from_json("t", "map<string,string>"))
    lists = F.filter(entries, lambda e: F.startswith(e["value"], F.lit("[")) & F.try_parse_json(e["value"]).isNotNull())
    chosen = opened.withColumn("lists", F.when(~F.col("is_list"), F.transform(lists, lambda e: e["value"]))).withColumn(
        "body", F.when(F.col("is_list"), F.col("t")).when(F.size("lists") == 1, F.get("lists", F.lit(0))))
    records = chosen.withColumn("records", F.from_json("body", "array<map<string,string>>")).withColumn(
        "error_kind",
        F.when(F.col("body").isNull() | F.col("records").isNull() | F.exists("records", lambda r: r.isNull()), F.lit("malformed")))
    kept = F.col("records") if max_rows is None else F.slice("records", 1, max_rows)
    rows = records.select(
        "rid", "error_kind", (F.size("records") > F.size(kept)).alias("truncated"),
        F.posexplode_outer(F.when(F.col("error_kind").isNull(), kept)).alias("row_idx", "record"))
    return rows.select("rid", F.col("row_idx").cast("long").alias("row_idx"), "record", "truncated", "error_kind")


def record_header(rows: DataFrame) -> DataFrame:
    """Columns of record tables: the union of keys, in the order first seen."""
    keys = rows.select("rid", "row_idx", F.posexplode(F.map_keys("record")).alias("key_pos", "col_name"))
    firsts = keys.groupBy("rid", "col_name").agg(F.min(F.struct("row_idx", "key_pos")).alias("seen"))
    return firsts.select(
        "rid", "col_name", (F.row_number().over(W.partitionBy("rid").orderBy("seen")) - 1).alias("col_idx"))


def record_cells(rows: DataFrame, header: DataFrame) -> DataFrame:
    """Cells of record tables; a key a record lacks gives a null cell."""
    written = rows.filter("row_idx is not null").select("rid", "row_idx", "record").join(header, "rid")
    return written.select("rid", "row_idx", "col_idx", "col_name", F.try_element_at("record", F.col("col_name")).alias("cell"))


# --- paged records of a typed store -----------------------------------------------------


PAGES = "rid string, offset long, total long, fields array<struct<id:string,type:string>>, records array<map<string,string>>"


def paged_tables(pages: DataFrame) -> DataFrame:
    """One row per paged table: rows landed, completeness and why not complete."""
    landed = pages.groupBy("rid").agg(F.sum(F.size("records")).alias("row_count"), F.max("total").alias("upstream_total"))
    reason = F.when(F.col("row_count") < F.col("upstream_total"), F.lit("page_stop"))
    return landed.select("rid", "row_count", "upstream_total", reason.isNull().alias("complete"), reason.alias("incomplete_reason"))


def paged_columns(pages: DataFrame) -> DataFrame:
    """Field names and source types, without the store's own row number."""
    table_types = F.create_map(*[F.lit(x) for pair in vocab.STORE_TYPES.items() for x in pair])
    first = pages.groupBy("rid").agg(F.min_by("fields", "offset").alias("fields"))
    kept = F.filter("fields", lambda f: f["id"] != "_id")
    return first.select("rid", F.posexplode(kept).alias("col_idx", "f")).select(
        "rid", "col_idx", F.col("f.id").alias("col_name"),
        F.coalesce(F.try_element_at(table_types, F.lower("f.type")), F.lit("text")).alias("source_type"))


def paged_cells(pages: DataFrame, columns: DataFrame) -> DataFrame:
    rows = pages.select("rid", "offset", F.posexplode("records").alias("i", "record")).select(
        "rid", (F.col("offset") + F.col("i")).alias("row_idx"), "record")
    return rows.join(columns.select("rid", "col_idx", "col_name"), "rid").select(
        "rid", "row_idx", "col_idx", "col_name", F.try_element_at("record", F.col("col_name")).alias("cell"))


# --- tables and checks ------------------------------------------------------------------


def payload_tables(parsed: DataFrame, payloads: DataFrame) -> DataFrame:
    """One row per parsed payload: completeness with its reason, header facts, error.

    A table without rows, or one column that still looks delimited, is an error.
    """
    width = F.size("names")
    looks = F.col("cells")[0].rlike("[,;\t|]")
    rows = parsed.filter("row_idx >= 0").groupBy("rid").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(F.coalesce(looks, F.lit(False))).alias("delimited"))
    head = parsed.filter("row_idx = -1").select(
        "rid", "names", "delimiter", "confident", "encoding", "truncated", "header_trusted", "dropped_rows", "error_kind", "error_detail")
    joined = head.join(rows, "rid", "left").join(payloads.select("rid", "body_complete"), "rid")
    reason = F.when(F.col("truncated"), F.lit("row_cap")).when(~F.col("body_complete"), F.lit("byte_cap"))
    problem = (
        F.when(F.exists("names", lambda n: n.rlike("[<>]")), F.lit("header looks like markup, not column names"))
        .when(F.col("row_count").isNull(), F.lit("no data rows parsed"))
        .when(~F.col("confident") & (width == 1) & (F.col("delimited") > F.floor(F.coalesce("row_count", F.lit(0)) / 2)),
              F.lit("delimiter could not be sniffed and the single column still looks delimited"))
    )
    return joined.select(
        "rid", F.coalesce("row_count", F.lit(0)).alias("row_count"), "names", "delimiter", "encoding", "header_trusted", "dropped_rows",
        F.when(F.col("error_kind").isNull() & problem.isNull(), reason.isNull()).alias("complete"),
        F.when(F.col("error_kind").isNull() & problem.isNull(), reason).alias("incomplete_reason"),
        F.coalesce("error_kind", F.when(problem.isNotNull(), F.lit("malformed"))).alias("error_kind"),
        F.coalesce("error_detail", problem).alias("error_detail"))


def payload_cells(parsed: DataFrame) -> DataFrame:
    zipped = F.arrays_zip(F.col("names").alias("names"), F.col("cells").alias("cells"))
    return parsed.filter("row_idx >= 0").select("rid", "row_idx", F.posexplode(zipped).alias("col_idx", "z")).select(
        "rid", "row_idx", "col_idx", F.col("z.names").alias("col_name"), F.col("z.cells").alias("cell"))


def source_types(cells: DataFrame) -> DataFrame:
    """Narrowest type that every cell of a column satisfies; ``text`` without any."""
    value = strip(F.col("cell"))
    words = [w for w in (*vocab.TRUE_WORDS, *vocab.FALSE_WORDS) if w not in ("0", "1")]
    present = F.coalesce(value != "", F.lit(False))

    def every(test: Column) -> Column:
        return F.coalesce(F.min(F.when(present, test)), F.lit(False))

    checks = cells.groupBy("rid", "col_idx", "col_name").agg(
        every(F.lower(value).isin(*words)).alias("b"), every(value.rlike("^[+-]?[0-9]+$")).alias("i"),
        every(value.rlike("^[+-]?([0-9]+\\.[0-9]*|\\.[0-9]+|[0-9]+)([eE][+-]?[0-9]+)?$")).alias("n"),
        every(value.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")).alias("d"),
        every(value.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}")).alias("t"))
    kind = (
        F.when(F.col("b"), F.lit("boolean")).when(F.col("i"), F.lit("integer")).when(F.col("n"), F.lit("number"))
        .when(F.col("d"), F.lit("date")).when(F.col("t"), F.lit("timestamp")).otherwise(F.lit("text")))
    return checks.select("rid", "col_idx", "col_name", kind.alias("source_type"))
