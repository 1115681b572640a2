"""Payloads made by Spark from the tables, read back as tables of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.plans.registry import query, spread, table
from plumbline.session import materialise, new_folder
from plumbline.sources import loading, payloads


@query("payload_kind", """
    with b as (select 'page' as src, page_id as id, html as body from pages union all select 'event', event_id, props from events
               union all select 'document', doc_id, case doc_id % 5 when 0 then '%PDF-1.7 ' || text when 1 then '  ' when 2 then '<?xml version="1.0"?>' || text else text end from documents),
    k as (select *, lower(trim(body, ' ' || chr(10) || chr(9) || chr(13))) as p from b),
    n as (select *, case when p = '' then 'empty' when starts_with(body, '%PDF') then 'pdf' when starts_with(p, '<!doctype html') or starts_with(p, '<html') then 'html'
                         when starts_with(p, '<?xml') then 'xml' when starts_with(p, '{') or starts_with(p, '[') then 'json' else 'csv' end as kind from k)
    select src, id, kind, case when kind = 'empty' then 'resource returned an empty body'
        when kind not in ('csv', 'json') then 'resource declared csv but the body looks like ' || kind end as error from n
""")
def payload_kind(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    body = (
        F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("%PDF-1.7 "), "text")).when(F.col("doc_id") % 5 == 1, F.lit("  "))
        .when(F.col("doc_id") % 5 == 2, F.concat(F.lit('<?xml version="1.0"?>'), "text")).otherwise(F.col("text")))
    bodies = (
        table(spark, folder, "pages").select(F.lit("page").alias("src"), F.col("page_id").alias("id"), F.col("html").cast("binary").alias("content"))
        .unionByName(table(spark, folder, "events").select(F.lit("event").alias("src"), F.col("event_id").alias("id"), F.col("props").cast("binary").alias("content")))
        .unionByName(docs.select(F.lit("document").alias("src"), F.col("doc_id").alias("id"), body.cast("binary").alias("content"))))
    kinds = bodies.select("src", "id", payloads.payload_kind(F.col("content")).alias("kind"))
    return kinds.select("src", "id", "kind", payloads.kind_error(F.col("kind"), F.lit(" CSV ")).alias("error"))


@query("encoding_audit", """
    select doc_id, case when doc_id % 2 = 0 then 'utf-8' end as declared_charset, doc_id % 3 <> 0 as valid_utf8,
           doc_id % 3 = 0 or contains(text, chr(65533)) as replacement_chars
    from documents
""")
def encoding_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as bodies, some with a broken byte, some without a declared charset."""
    text = F.col("text").cast("binary")
    bodies = table(spark, folder, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(text, F.unhex(F.lit("FF")))).otherwise(text).alias("content"),
        F.when(F.col("doc_id") % 2 == 0, "text/csv; charset=UTF-8").otherwise("text/csv").alias("content_type"))
    audit = payloads.encoding_audit(F.col("content"), F.col("content_type"))
    return bodies.select("doc_id", *audit).select("doc_id", "declared_charset", "valid_utf8", "replacement_chars")


def customer_files(spark: SparkSession, folder: str) -> DataFrame:
    """One small file per customer, in the shapes publishers use."""
    shape, name = F.col("c_custkey") % 6, F.col("c_name")
    cents = F.round(F.col("c_acctbal") * 100).cast("long").cast("string")
    rows = F.concat(name, F.lit(";"), cents, F.lit(";"), "c_mktsegment", F.lit("\n"), name, F.lit(" b;7;\n"))
    header = F.lit("name;cents;segment\n")
    body = (
        F.when(shape == 0, F.concat(header, rows))
        .when(shape == 1, F.concat(F.lit("sep=;\r\n"), header, rows))
        .when(shape == 2, F.concat(F.lit(";;\nCustomers;;\n"), header, rows))
        .when(shape == 3, F.concat(header, rows, F.lit("* provisional;;\n")))
        .when(shape == 4, F.concat(F.lit("﻿"), header, rows, F.lit("broken;lin")))
        .otherwise(F.lit("no table\n")))
    return spread(table(spark, folder, "customer")).select(
        F.concat(F.lit("c"), "c_custkey").alias("rid"), body.cast("binary").alias("content"), (shape != 4).alias("body_complete"))


SQL_CUSTOMER = """
    c as (select 'c' || c_custkey as rid, c_custkey % 6 as shape, c_name, cast(round(c_acctbal * 100) as bigint) as cents, c_mktsegment from customer)
"""


@query("csv_payload_tables", f"""
    with {SQL_CUSTOMER}
    select rid, cast(case when shape = 5 then 0 else 2 end as bigint) as row_count, case when shape < 5 then shape <> 4 end as complete,
           case when shape = 4 then 'byte_cap' end as incomplete_reason,
           cast(case shape when 2 then 2 when 3 then 1 else 0 end as bigint) as dropped_rows, case when shape < 5 then ';' else ',' end as delimiter,
           case when shape = 5 then 'malformed' end as error_kind from c
""")
def csv_payload_tables(spark: SparkSession, folder: str) -> DataFrame:
    files = customer_files(spark, folder)
    parsed = materialise(payloads.parse_delimited(files), "parsed")
    found = payloads.payload_tables(parsed, files)
    return found.select(
        "rid", F.col("row_count").cast("long").alias("row_count"), F.when(F.col("error_kind").isNull(), F.col("complete")).alias("complete"),
        "incomplete_reason", F.col("dropped_rows").cast("long").alias("dropped_rows"), "delimiter", "error_kind")


@query("csv_payload_cells", f"""
    with {SQL_CUSTOMER}
    select rid, cast(0 as bigint) as row_idx, unnest(['name', 'cents', 'segment']) as col_name, unnest([c_name, cast(cents as varchar), c_mktsegment]) as cell from c where shape < 5
    union all select rid, 1, unnest(['name', 'cents', 'segment']), unnest([c_name || ' b', '7', '']) from c where shape < 5
""")
def csv_payload_cells(spark: SparkSession, folder: str) -> DataFrame:
    parsed = payloads.parse_delimited(customer_files(spark, folder))
    return payloads.payload_cells(parsed).select("rid", "row_idx", "col_name", "cell")


@query("csv_split_files", """
    select cast(conv_id as varchar) as conv_id, cast(turn as varchar) as turn, role, replace(text, chr(13), ' ') as text, true as complete from conversations
""")
def csv_split_files(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as delimited files with texts over several lines, read as splits."""
    path = new_folder(spark, "landed")
    rows = table(spark, folder, "conversations").select(
        F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("string").alias("turn"), "role", F.replace("text", F.lit("\r"), F.lit(" ")).alias("text"))
    rows.write.options(header=True, sep=";", quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    parsed = materialise(payloads.parse_files(spark, path, "*.csv"), "parsed")
    files = parsed.filter("row_idx = -1").select("rid", F.lit(True).alias("body_complete"))
    whole = payloads.payload_tables(parsed, files).select("rid", "complete")
    return parsed.filter("row_idx >= 0").join(whole, "rid").select(*[F.col("cells")[k].alias(n) for k, n in enumerate(("conv_id", "turn", "role", "text"))], "complete")


@query("header_collisions", """
    select 'n' || n_nationkey as rid, unnest(['a', 'a_2', 'a_3', 'col_4', n_name, n_name || '_2']) as col_name, cast(unnest([0, 1, 2, 3, 4, 5]) as bigint) as col_idx from nation
""")
def header_collisions(spark: SparkSession, folder: str) -> DataFrame:
    """Headers whose repeated name, once numbered, is a name that is there already."""
    body = F.concat(F.lit("a,a_2,a,,"), "n_name", F.lit(","), "n_name", F.lit("\n1,2,3,4,5,6\n"))
    files = table(spark, folder, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("rid"), body.cast("binary").alias("content"), F.lit(True).alias("body_complete"))
    cells = payloads.payload_cells(payloads.parse_delimited(files))
    return cells.select("rid", "col_name", F.col("col_idx").cast("long").alias("col_idx"))


@query("late_type_change", f"""
    with o as (select o_custkey, count(*) as n from orders group by 1)
    select cast(o_custkey as varchar) as rid, cast(n as bigint) as row_count, unnest(['id', 'cents']) as col_name,
           unnest(['integer', case when n = 1 then 'text' when o_custkey % 2 = 0 then 'text' else 'integer' end]) as source_type from o
""")
def late_type_change(spark: SparkSession, folder: str) -> DataFrame:
    """A file per customer with all orders, fields in quotes now and then; only the last row of every other file is no number."""
    orders = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("k"), "o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").cast("string").alias("cents"))
    last = orders.groupBy("k").agg(F.max("o_orderkey").alias("last"), F.count(F.lit(1)).alias("n"))
    text = F.when((F.col("o_orderkey") == F.col("last")) & ((F.col("k") % 2 == 0) | (F.col("n") == 1)), "x;\n\"x").otherwise(F.col("cents"))
    line = F.concat(F.col("o_orderkey").cast("string"), F.lit(';"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"\n'))
    files = orders.join(last, "k").groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("line")))), lambda r: r["line"]), "").alias("body")).select(
        F.col("k").cast("string").alias("rid"), F.concat(F.lit("id;cents\n"), "body").cast("binary").alias("content"), F.lit(True).alias("body_complete"))
    parsed = materialise(payloads.parse_delimited(files), "parsed")
    counts = payloads.payload_tables(parsed, files).select("rid", F.col("row_count").cast("long").alias("row_count"))
    return payloads.source_types(payloads.payload_cells(parsed)).join(counts, "rid").select("rid", "row_count", "col_name", "source_type")


@query("json_with_mark", """
    select event_id as rid, cast(0 as bigint) as row_idx, case when event_id % 2 = 0 then 'Ωμέγα' else 'x' end as cell from events
""")
def json_with_mark(spark: SparkSession, folder: str) -> DataFrame:
    """JSON bodies behind a byte-order mark, and in an encoding of one byte a letter."""
    mark = F.concat(F.lit(b"\xef\xbb\xbf"), F.lit('[{"a":"x"}]'.encode()))
    bodies = table(spark, folder, "events").select(
        F.col("event_id").alias("rid"), F.when(F.col("event_id") % 2 == 0, F.lit('[{"a":"Ωμέγα"}]'.encode("cp1253"))).otherwise(mark).alias("content"))
    rows = payloads.parse_records(bodies)
    return rows.select("rid", "row_idx", F.try_element_at("record", F.lit("a")).alias("cell"))


@query("source_types", f"""
    select 'c' || c_custkey as rid, unnest(['name', 'cents', 'segment']) as col_name, unnest(['text', 'integer', 'text']) as source_type from customer where c_custkey % 6 < 5
""")
def source_types(spark: SparkSession, folder: str) -> DataFrame:
    parsed = payloads.parse_delimited(customer_files(spark, folder))
    return payloads.source_types(payloads.payload_cells(parsed)).select("rid", "col_name", "source_type")


def event_records(spark: SparkSession, folder: str) -> DataFrame:
    """Events as JSON payloads: a list, an object with one list, or no table at all."""
    props, kind = F.col("props"), F.to_json(F.struct("event_type", F.struct("user_id").alias("who")))
    records = F.concat(F.lit("["), props, F.lit(","), kind, F.lit("]"))
    body = (
        F.when(F.col("event_id") % 3 == 0, records)
        .when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"count": 2, "rows": '), records, F.lit("}")))
        .otherwise(props))
    return spread(table(spark, folder, "events")).select(F.col("event_id").alias("rid"), body.alias("content"))


SQL_K = "cast(json_extract_string(props, '$.k') as varchar)"


@query("json_records_union_header", f"""
    select event_id as rid, cast(r as bigint) as row_idx, unnest(['k', 'event_type', 'who']) as col_name, cast(unnest([0, 1, 2]) as bigint) as col_idx,
           unnest(case r when 0 then [{SQL_K}, null, null] else [null, event_type, '{{"user_id":' || user_id || '}}'] end) as cell
    from events, (select unnest([0, 1]) as r) where event_id % 3 < 2
""")
def json_records_union_header(spark: SparkSession, folder: str) -> DataFrame:
    rows = materialise(payloads.parse_records(event_records(spark, folder)), "records")
    cells = payloads.record_cells(rows, payloads.record_header(rows))
    return cells.select("rid", "row_idx", "col_name", F.col("col_idx").cast("long").alias("col_idx"), "cell")


@query("json_record_errors", "select event_id as rid, 'malformed' as error_kind from events where event_id % 3 = 2")
def json_record_errors(spark: SparkSession, folder: str) -> DataFrame:
    return payloads.parse_records(event_records(spark, folder)).filter("error_kind is not null").select("rid", "error_kind")


def order_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as landed pages of a paged store, one page per line."""
    lines = table(spark, folder, "lineitem")
    record = F.create_map(
        F.lit("_id"), F.col("l_linenumber").cast("string"), F.lit("part"), F.col("l_partkey").cast("string"), F.lit("flag"), F.col("l_returnflag"))
    fields = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(t).alias("type")) for i, t in (("_id", "int"), ("part", "int8"), ("flag", "citext"))])
    return lines.select(
        F.col("l_orderkey").cast("string").alias("rid"), F.col("l_linenumber").cast("long").alias("offset"),
        F.when(F.col("l_orderkey") % 2 == 0, 1).otherwise(5).cast("long").alias("total"), fields.alias("fields"), F.array(record).alias("records"))


@query("paged_records", """
    select cast(l_orderkey as varchar) as rid, cast(count(*) as bigint) as row_count, count(*) >= case when l_orderkey % 2 = 0 then 1 else 5 end as complete,
           case when count(*) < case when l_orderkey % 2 = 0 then 1 else 5 end then 'page_stop' end as incomplete_reason
    from lineitem group by l_orderkey
""")
def paged_records(spark: SparkSession, folder: str) -> DataFrame:
    return payloads.paged_tables(order_pages(spark, folder)).select("rid", "row_count", "complete", "incomplete_reason")


@query("paged_record_cells", """
    select cast(l_orderkey as varchar) as rid, cast(l_linenumber as bigint) as row_idx, unnest(['part', 'flag']) as col_name,
           unnest([cast(l_partkey as varchar), l_returnflag]) as cell from lineitem
""")
def paged_record_cells(spark: SparkSession, folder: str) -> DataFrame:
    pages = order_pages(spark, folder)
    return payloads.paged_cells(pages, payloads.paged_columns(pages)).select("rid", "row_idx", "col_name", "cell")


SQL_LOADED = f"""
    {SQL_CUSTOMER},
    t as (select rid, cast(case when shape < 5 then 2 else 0 end as bigint) as row_count, case when shape < 5 then shape <> 4 end as complete,
                 case when shape = 5 then 'malformed' end as error_kind from c
          union all select 'e' || event_id, case when event_id % 3 < 2 then 2 else 0 end, case when event_id % 3 < 2 then true end, case when event_id % 3 = 2 then 'malformed' end from events
          union all select 'p' || page_id, 0, null, 'malformed' from pages
          union all select 'o' || l_doc, 0, null, 'unavailable' from (select doc_id as l_doc from labels))
"""


@query("loaded_tables", f"with {SQL_LOADED} select * from t")
def loaded_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Resources of all kinds at once: CSV, JSON, web pages, and some that never arrived."""
    files = customer_files(spark, folder)
    records = event_records(spark, folder).select(F.concat(F.lit("e"), "rid").alias("rid"), F.col("content").cast("binary").alias("content"), F.lit(True).alias("body_complete"))
    pages = table(spark, folder, "pages").select(F.concat(F.lit("p"), "page_id").alias("rid"), F.col("html").cast("binary").alias("content"), F.lit(True).alias("body_complete"))
    landed = files.unionByName(records).unionByName(pages)
    lost = table(spark, folder, "labels").select(F.concat(F.lit("o"), "doc_id").alias("id"))
    resources = landed.select(F.col("rid").alias("id")).unionByName(lost).withColumn("format", F.lit("CSV"))
    found = loading.load_tables(resources, landed)
    return found.tables.select("rid", F.col("row_count").cast("long").alias("row_count"), "complete", "error_kind")
