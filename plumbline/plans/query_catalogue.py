"""Catalogue work: normalising, upserts, resource choice and browse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import web
from plumbline.operators import catalogue
from plumbline.operators.retrieval import signature
from plumbline.plans.registry import query, table
from plumbline.session import new_folder
from plumbline.sources import packages, snapshots


def datasets(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as datasets: their source publishes them, their language is a theme."""
    return table(spark, folder, "documents").select(
        F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("id"), "doc_id",
        F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"),
        F.when(F.col("source") != "src0", F.concat(F.lit("Publisher "), F.col("source"))).alias("org_title"),
        F.array(
            F.concat(F.lit("http://themes.example.org/data-theme/"), F.upper("lang")),
            F.concat(F.lit("http://themes.example.org/data-theme/ENVI"), F.when(F.col("n_chars") % 2 == 0, "/").otherwise("")),
        ).alias("theme"),
        F.lpad((F.col("n_chars") % 1000).cast("string"), 6, "0").alias("last_updated"),
    )


def resources(spark: SparkSession, folder: str) -> DataFrame:
    """Labels as resources of the documents: quality picks the format, toxicity the store."""
    return table(spark, folder, "labels").select(
        F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("id"),
        F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("dataset_id"),
        F.when(F.col("quality") == 1, F.lit("csv ")).otherwise(F.lit("PDF")).alias("format"),
        (F.col("toxic") == 1).alias("datastore_active"), F.col("quality").alias("position"), F.col("doc_id").alias("size"),
        F.lit("active").alias("state"), (F.col("quality") == 1).alias("is_tabular"),
    )


SQL_SETS = """
    ds as (select 'd' || lpad(cast(doc_id as varchar), 9, '0') as id, 'Document ' || doc_id as title,
                  case when source <> 'src0' then 'Publisher ' || source end as org_title, upper(lang) as theme,
                  lpad(cast(n_chars % 1000 as varchar), 6, '0') as last_updated, doc_id from documents),
    tab as (select * from ds where doc_id in (select doc_id from labels where quality = 1))
"""


@query("publisher_counts", f"""
    with {SQL_SETS}
    select org_title, cast(count(*) as bigint) as dataset_count, 'national' as kind from tab where org_title is not null group by all
""")
def publisher_counts(spark: SparkSession, folder: str) -> DataFrame:
    return catalogue.list_publishers(datasets(spark, folder), resources(spark, folder))


@query("theme_counts", f"""
    with {SQL_SETS}, t as (select theme as code from tab union all select 'ENVI' from tab)
    select code, cast(count(*) as bigint) as dataset_count, case code when 'ENVI' then 'Environment' else code end as label from t group by all
""")
def theme_counts(spark: SparkSession, folder: str) -> DataFrame:
    return catalogue.list_themes(datasets(spark, folder), resources(spark, folder))


@query("paged_listing", f"""
    with {SQL_SETS}
    select id, title, org_title as publisher, last_updated, ['CSV'] as formats, 'r' || doc_id as resource_id
    from tab where org_title = 'Publisher src3' order by last_updated desc, id limit 10 offset 5
""")
def paged_listing(spark: SparkSession, folder: str) -> DataFrame:
    return catalogue.list_datasets(
        datasets(spark, folder), resources(spark, folder), publisher="Publisher src3", theme="ENVI", limit=10, offset=5)


@query("dataset_count", f"with {SQL_SETS} select cast(count(*) as bigint) as n from tab where theme = 'EN'")
def dataset_count(spark: SparkSession, folder: str) -> DataFrame:
    return catalogue.count_datasets(datasets(spark, folder), resources(spark, folder), theme="EN")


@query("best_resource_per_key", """
    with r as (select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by (l_returnflag = 'R') desc,
        case l_linestatus when 'O' then 0 else 1 end, l_suppkey, case when l_quantity > 25 then l_quantity end nulls last, l_partkey, l_linenumber) as rn from lineitem)
    select l_orderkey as dataset_id, cast(l_linenumber as bigint) as id from r where rn = 1
""")
def best_resource_per_key(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as resources of their order; the same order of preference."""
    lines = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("dataset_id"), F.col("l_linenumber").cast("long").alias("id"), (F.col("l_returnflag") == "R").alias("datastore_active"),
        F.when(F.col("l_linestatus") == "O", "csv").otherwise("JSON").alias("format"), F.col("l_suppkey").alias("position"),
        F.when(F.col("l_quantity") > 25, F.col("l_quantity")).alias("size"), "l_partkey",
        F.lit(None).cast("string").alias("state"), F.lit(True).alias("is_tabular"))
    best = catalogue.best_per_key(
        catalogue.eligible_resources(lines), ["dataset_id"], [*catalogue.resource_order()[:-1], F.asc("l_partkey"), F.asc("id")])
    return best.select("dataset_id", "id")


@query("offered_formats", """
    select l_orderkey as dataset_id, list_sort(list(distinct upper(l_returnflag))) as formats from lineitem group by all
""")
def offered_formats(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("dataset_id"), F.lower("l_returnflag").alias("format"))
    return catalogue.offered_formats(lines)


@query("upsert_snapshot", """
    select c_custkey, c_name, case when c_custkey % 3 = 0 then 'CHANGED' else c_mktsegment end as c_mktsegment,
           round(case when c_custkey % 3 = 0 then c_acctbal + 2 else c_acctbal end, 2) as c_acctbal from customer
    union all select c_custkey + 1000000000, c_name, 'NEW', round(c_acctbal, 2) from customer where c_custkey % 5 = 0
""")
def upsert_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with a batch that changes some twice and adds others."""
    target = table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment", F.round("c_acctbal", 2).alias("c_acctbal"))
    third = target.filter(F.col("c_custkey") % 3 == 0)
    once = third.select("c_custkey", "c_name", F.lit("STALE").alias("c_mktsegment"), F.round(F.col("c_acctbal") + 1, 2).alias("c_acctbal"), F.lit(1).alias("seq"))
    twice = third.select("c_custkey", "c_name", F.lit("CHANGED").alias("c_mktsegment"), F.round(F.col("c_acctbal") + 2, 2).alias("c_acctbal"), F.lit(2).alias("seq"))
    new = target.filter(F.col("c_custkey") % 5 == 0).select(
        (F.col("c_custkey") + 1_000_000_000).alias("c_custkey"), "c_name", F.lit("NEW").alias("c_mktsegment"), "c_acctbal", F.lit(1).alias("seq"))
    return snapshots.upsert(target, once.unionByName(twice).unionByName(new), ["c_custkey"], ["seq"])


@query("incremental_changed_removed", """
    select doc_id, case when doc_id % 7 = 0 then 'removed' when doc_id % 5 = 0 then 'changed' else 'same' end as change, sha1(text) as signature from documents
    union all select doc_id + 1000000000, 'added', null from documents where doc_id % 11 = 0
""")
def incremental_changed_removed(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    old = docs.select("doc_id", signature(F.col("text")).alias("sig"))
    kept = docs.filter(F.col("doc_id") % 7 != 0).select(
        "doc_id", signature(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("sig"))
    added = docs.filter(F.col("doc_id") % 11 == 0).select((F.col("doc_id") + 1_000_000_000).alias("doc_id"), signature(F.col("text")).alias("sig"))
    found = snapshots.changes(old, kept.unionByName(added), "doc_id", "sig")
    return found.join(old, "doc_id", "left").select("doc_id", "change", F.col("sig").alias("signature"))


def _land_pages(spark: SparkSession, folder: str) -> str:
    """Write documents as catalogue pages, one JSON page per row, to the shared folder."""
    docs = table(spark, folder, "documents")
    none = F.lit(None).cast("string")
    resource = F.struct(
        F.concat(F.lit("r"), F.col("doc_id")).alias("id"), F.col("source").alias("name"), none.alias("description"),
        F.when(F.col("doc_id") % 2 == 0, "csv").otherwise("PDF").alias("format"), F.lit("").alias("mimetype"), F.lit("text/x").alias("mimetype_inner"),
        F.concat(F.lit("https://files.example.org/"), F.col("doc_id")).alias("url"),
        F.when(F.col("doc_id") % 3 == 0, F.lit(" n/a ")).otherwise(F.col("n_chars").cast("string")).alias("size"),
        (F.col("doc_id") % 4 == 0).alias("datastore_active"), F.lit(0).alias("position"), none.alias("last_modified"),
        F.lit("2026-01-01").alias("metadata_modified"), F.lit("active").alias("state"))
    package = F.struct(
        F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("set-"), F.col("doc_id")).alias("name"),
        F.when(F.col("doc_id") % 10 == 9, "harvest").otherwise("dataset").alias("type"),
        F.when(F.col("doc_id") % 10 == 8, "deleted").otherwise("active").alias("state"),
        F.concat(F.lit(" "), F.col("source"), F.lit(" ")).alias("title"), F.col("text").alias("notes"),
        F.struct(F.lit("").alias("en")).alias("title_translated"), F.struct(F.col("lang").alias("en")).alias("notes_translated"),
        F.array(F.struct(F.lit("tag").alias("name"), ), F.struct(F.col("lang").alias("name"))).alias("tags"), F.array(resource).alias("resources"))
    path = new_folder(spark, "pages")
    docs.select(F.lit(1).cast("long").alias("count"), F.array(package).alias("results")).write.json(path)
    return path


@query("normalised_datasets", """
    select cast(doc_id as varchar) as id, 'set-' || doc_id as name, cast(1 as bigint) as num_resources, ['tag', lang] as tags,
           md5(source || chr(10) || 'tag ' || lang || chr(10) || trim(text, ' ' || chr(10) || chr(9) || chr(13)) || chr(10) || lang) as text_md5
    from documents where doc_id % 10 < 8
""")
def normalised_datasets(spark: SparkSession, folder: str) -> DataFrame:
    found = packages.normalise_datasets(read_landed(spark, _land_pages(spark, folder)), F.lit("2026-01-01"))
    return found.select("id", "name", F.col("num_resources").cast("long").alias("num_resources"), "tags", F.md5(F.col("search_text").cast("binary")).alias("text_md5"))


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    """Pages written one per line can be split inside a file."""
    return spark.read.schema(packages.PAGE_SCHEMA).json(path).select(F.explode("results").alias("p")).select("p.*")


@query("normalised_resources", """
    select 'r' || doc_id as id, cast(doc_id as varchar) as dataset_id, 'text/x' as mimetype,
           case when doc_id % 3 <> 0 then cast(n_chars as bigint) end as size, doc_id % 4 = 0 as datastore_active, doc_id % 2 = 0 as is_tabular
    from documents where doc_id % 10 < 8
""")
def normalised_resources(spark: SparkSession, folder: str) -> DataFrame:
    found = packages.normalise_resources(read_landed(spark, _land_pages(spark, folder)))
    return found.select("id", "dataset_id", "mimetype", "size", "datastore_active", "is_tabular")


@query("harvest_counts", """
    select cast(count(*) as bigint) as seen, cast(count(*) filter (doc_id % 10 >= 8) as bigint) as skipped,
           cast(count(*) filter (doc_id % 10 < 8) as bigint) as datasets, cast(count(*) filter (doc_id % 10 < 8) as bigint) as resources
    from documents
""")
def harvest_counts(spark: SparkSession, folder: str) -> DataFrame:
    return packages.harvest_counts(read_landed(spark, _land_pages(spark, folder)))


@query("url_policy_redact", """
    with u as (select page_id, url, lower(regexp_extract(url, '^([a-z]+):', 1)) as scheme, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) as host from pages)
    select page_id, host, case when scheme not in ('http', 'https') then 'scheme' when host = '' then 'no_host' when scheme = 'http' then 'plain_http'
             when not (host = 'example.org' or host like '%.example.org') then 'off_portal' else 'ok' end as verdict,
           regexp_replace(url || '&token=abc&sig=x#f', '(?i)([?&](?:token|sig)=)[^&\\s''"]*', '\\1REDACTED', 'g') as redacted
    from u
""")
def url_policy_redact(spark: SparkSession, folder: str) -> DataFrame:
    url = F.col("url")
    return table(spark, folder, "pages").select(
        "page_id", web.url_host(url).alias("host"), web.url_verdict(url, "example.org", False, False).alias("verdict"),
        web.redact_secrets(F.concat(url, F.lit("&token=abc&sig=x#f"))).alias("redacted"))


@query("provenance_lookup", """
    select d.doc_id, l.doc_id is null as missing, coalesce(cast(l.quality as varchar), '') as publisher
    from documents d left join labels l on l.doc_id = d.doc_id
""")
def provenance_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with what is known about it; blanks when nothing is."""
    known = table(spark, folder, "labels").select(
        F.col("doc_id").alias("id"), F.lit("t").alias("title"), F.col("quality").cast("string").alias("org_title"), F.lit("u").alias("last_updated"))
    rows = table(spark, folder, "documents").select(F.col("doc_id").alias("dataset_id"))
    return catalogue.with_provenance(rows, known).select(
        F.col("dataset_id").alias("doc_id"), F.col("dataset_title").isNull().alias("missing"), F.coalesce("publisher", F.lit("")).alias("publisher"))


@query("orphan_resources", "select l.doc_id as id from labels l where l.doc_id not in (select doc_id from documents where n_chars > 1000)")
def orphan_resources(spark: SparkSession, folder: str) -> DataFrame:
    known = table(spark, folder, "documents").filter("n_chars > 1000").select(F.col("doc_id").alias("id"))
    found = table(spark, folder, "labels").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("dataset_id"))
    return snapshots.orphans(found, known).select("id")
