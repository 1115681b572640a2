"""Plans, answers and claim checks over conversations, documents and sales."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.numbers import CELL_DECIMAL
from plumbline.operators import claims
from plumbline.plans import answers
from plumbline.plans.registry import query, spread, table

SQL_FIGURES = r"""
    tok as (select doc_id, unnest(regexp_extract_all(text, '[A-Za-zΑ-Ωα-ω_]*\p{Nd}[\p{L}\p{M}\p{Nd}\p{Pc}.,]*')) as token,
                   generate_subscripts(regexp_extract_all(text, '[A-Za-zΑ-Ωα-ω_]*\p{Nd}[\p{L}\p{M}\p{Nd}\p{Pc}.,]*'), 1) as pos from documents),
    fig as (select *, replace(regexp_replace(token, '[.,]+$', ''), ',', '') as plain from tok where regexp_full_match(token, '[+-]?[0-9][0-9.,]*')),
    num as (select *, case when regexp_full_match(plain, '-?([0-9]{1,26}(\.[0-9]{0,12})?|\.[0-9]{1,12})') then cast(plain as decimal(38,12)) end as v from fig)
"""


@query("claim_guard_figures", f"""
    with {SQL_FIGURES},
    lic as (select doc_id, cast(quality as decimal(38,12)) as v from labels union select doc_id, toxic from labels union select doc_id, n_chars from documents
            union select doc_id, 2 from documents where source = 'src1'),
    bad as (select num.* from num where not exists (select 1 from lic where lic.doc_id = num.doc_id and lic.v = num.v))
    select doc_id, cast(count(*) as bigint) as n_rejected, arg_min(token, pos) as first_rejected from bad group by doc_id
""")
def claim_guard_figures(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as texts: numbers that neither labels nor sizes license."""
    docs = table(spark, folder, "documents")
    texts = spread(docs).select(F.col("doc_id").alias("text_id"), F.col("doc_id").alias("answer_id"), "text", F.lit("en").alias("language"))
    labels = table(spark, folder, "labels")
    facts = labels.select(F.col("doc_id").alias("answer_id"), F.col("quality").alias("value"), F.col("toxic").alias("n_used"))
    none = F.lit(None).cast("string")
    headers = docs.select(
        F.col("doc_id").alias("answer_id"), F.lit("en").alias("language"), F.col("n_chars").alias("row_basis"), none.cast(CELL_DECIMAL).alias("stated_total"),
        F.when(F.col("source") == "src1", F.lit("2 rows")).alias("row_coverage"), none.alias("observed_from"), none.alias("observed_to"), none.alias("limitation"))
    bad = claims.unlicensed_figures(claims.figures(texts), claims.allowed_values(facts, headers))
    return claims.rejected_tokens(bad).select(F.col("text_id").alias("doc_id"), "n_rejected", "first_rejected")


@query("claim_guard_words", """
    with t as (select doc_id, lower(strip_accents(text)) as f, text, doc_id % 2 = 0 as ok from documents),
    w as (select doc_id, case when trim(text) = '' then 'empty narration' when length(text) > 1200 then 'narration far longer than a summary'
      when regexp_matches(text, '(?i)https?://|www\\.|[\\p{L}\\p{M}\\p{Nd}\\p{Pc}.+-]+@[\\p{L}\\p{M}\\p{Nd}\\p{Pc}-]+\\.[\\p{L}\\p{M}\\p{Nd}\\p{Pc}.]+|</?[a-zA-Z][^>]*>|\\]\\([^)]*\\)|```|<\\|') then 'narration contains markup or a link'
      when regexp_matches(f, 'million|billion|thousand|hundred|half|double|twice|triple|third|quarter|dozens') then 'magnitude written as a word'
      when not ok and regexp_matches(f, 'highest|lowest|largest|smallest|most|least|top|maximum|minimum|first|leading') then 'superlative not licensed by the facts'
      when regexp_matches(f, 'rose|increase|fell|decrease|decline|growth|trend|stable|surge') then 'trend claim not licensed by the facts' end as reason from t)
    select * from w
""")
def claim_guard_words(spark: SparkSession, folder: str) -> DataFrame:
    docs = spread(table(spark, folder, "documents"))
    texts = docs.select(F.col("doc_id").alias("text_id"), F.col("doc_id").alias("answer_id"), "text", F.lit("en").alias("language"), F.lit(None).cast("string").alias("limitation"))
    headers = docs.select(
        F.col("doc_id").alias("answer_id"), F.when(F.col("doc_id") % 2 == 0, "sum").otherwise("listing").alias("operation"), F.lit(True).alias("complete"),
        F.lit(False).alias("truncated_range"), F.lit(False).alias("categorical_truncation"), F.lit(0).alias("omitted"), F.lit(1).alias("n_series"), F.lit(9).alias("n_points"))
    return claims.text_rules(texts, claims.licences(headers)).select(F.col("text_id").alias("doc_id"), F.col("text_reason").alias("reason"))


@query("figure_label_binding", """
    with f as (select l_orderkey as a, 'item p' || l_partkey as label, cast(l_quantity as bigint) as v, l_linenumber as n from lineitem),
    m as (select a, max(v) as top from f group by a),
    s as (select f.a, f.n, f.label as said, case when f.n % 3 = 0 then top else v end as shown from f join m using (a)),
    one as (select s.a, s.n, s.said, s.shown, max(g.label) as label from s join (select distinct a, label from f) g on g.a = s.a and contains(s.said, g.label)
            group by all having count(distinct g.label) = 1),
    own as (select one.a, one.n, one.label, one.shown, bool_or(f.label = one.label) as mine from one join f on f.a = one.a and f.v = one.shown group by all)
    select distinct a * 10 + n as text_id, label, cast(shown as varchar) as token from own where not mine
""")
def figure_label_binding(spark: SparkSession, folder: str) -> DataFrame:
    """One sentence per line item; every third quotes the order's largest quantity."""
    lines = spread(table(spark, folder, "lineitem")).select(
        F.col("l_orderkey").alias("answer_id"), F.col("l_linenumber").alias("n"), F.concat(F.lit("Item p"), "l_partkey").alias("label"),
        F.col("l_quantity").cast("long").alias("value"))
    top = lines.groupBy("answer_id").agg(F.max("value").alias("top"))
    shown = F.when(F.col("n") % 3 == 0, F.col("top")).otherwise(F.col("value")).cast("string")
    texts = lines.join(top, "answer_id").select(
        (F.col("answer_id") * 10 + F.col("n")).alias("text_id"), "answer_id", F.lit("en").alias("language"),
        F.concat(F.lit("As published. The "), F.lower("label"), F.lit(" stands at "), shown, F.lit("; nothing else is known.")).alias("text"))
    return claims.mislabelled_figures(texts, lines.select("answer_id", "label", "value")).distinct()


def _questions(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    return turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), F.when(F.col("turn") == 3, F.lit(" ?")).otherwise(F.col("text")).alias("question"), "conv_id", "turn")


def _hits(spark: SparkSession, folder: str) -> DataFrame:
    """Ranked candidates by a fixed rule: document conv_id first, then conv_id + 1."""
    asked = _questions(spark, folder).filter("turn <> 4")
    return asked.select("qid", F.explode(F.array(*[
        F.struct((F.col("conv_id") + i).alias("doc_id"), F.lit(i).alias("rank"), (F.lit(1.0) / (60 + i) / (F.col("turn") + 1) / 2).alias("score")) for i in (0, 1)
    ])).alias("h")).select("qid", "h.doc_id", "h.rank", "h.score")


def conversation_plans(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    datasets = docs.filter("n_chars > 300").select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.col("source").alias("name"), F.col("lang").alias("last_updated"))
    resources = docs.filter("doc_id % 3 <> 0").select(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("dataset_id"), F.lit("CSV").alias("format"), F.lit(True).alias("datastore_active"),
        F.lit(0).alias("position"), F.lit(0).alias("size"), F.lit("active").alias("state"), F.lit(True).alias("is_tabular"))
    asked = _questions(spark, folder)
    verdicts = asked.join(labels.select(F.col("doc_id").alias("conv_id"), (F.col("quality") == 1).alias("relevant")), "conv_id").select(
        "qid", "relevant", F.concat(F.lit('{"date_from":"2024-01-0'), F.pmod("conv_id", F.lit(9)) + 1, F.lit('","date_to":"2024-01-05","aggregation":"SUM","limit":99999,"metrics":[" a ",""]}')).alias("params"),
        F.lit("").alias("reason"))
    choices = asked.filter("turn >= 2").select("qid", F.when(F.col("turn") == 2, 1).when(F.col("turn") == 5, -1).otherwise(7).alias("choice"))
    return answers.make_plans(asked.select("qid", "question"), _hits(spark, folder), datasets, resources, verdicts, choices)


SQL_PLANS = """
    q as (select conv_id * 1000 + turn as qid, case when turn = 3 then ' ?' else text end as question, conv_id, turn from conversations),
    c as (select *, case when turn = 4 then null else conv_id + case when turn = 2 then 1 else 0 end end as ds from q),
    j as (select c.*, l.quality, d.doc_id as known, ds % 3 <> 0 as readable, least(1.0, 1.0 / 60 / (turn + 1) / 2 * 30) as conf
          from c left join labels l on l.doc_id = c.conv_id left join documents d on d.doc_id = c.ds and d.n_chars > 300),
    p as (select *, case when length(trim(question)) < 3 then 'no_match' when ds is null then 'no_match' when turn = 5 then 'no_match' when known is null then 'no_match'
            when quality is null and conf < 0.15 then 'no_match' when quality = 0 then 'no_match' when not readable then 'unsupported' else 'matched' end as status,
            case when length(trim(question)) < 3 or ds is null or turn = 5 then false when known is null then true else quality is null end as degraded from j)
"""


@query("plan_status", f"""
    with {SQL_PLANS}
    select qid, status, degraded, round(case when turn in (3, 4) then 0 else conf end, 6) as confidence, case when turn <> 3 then ds end as dataset_id,
           case when status = 'matched' and not degraded and conv_id % 9 + 1 <= 5 then '2024-01-0' || (conv_id % 9 + 1) end as date_from,
           case when status = 'matched' and not degraded then cast(32000 as bigint) end as "limit"
    from p
""")
def plan_status(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_plans(spark, folder).select(
        "qid", "status", "degraded", F.round("confidence", 6).alias("confidence"), "dataset_id",
        F.col("params.date_from").alias("date_from"), F.col("params.limit").alias("limit"))


@query("near_misses", f"""
    with {SQL_PLANS},
    h as (select p.qid, unnest([conv_id, conv_id + 1]) as doc_id, unnest([0, 1]) as rank from p where status = 'no_match' and turn <> 4)
    select qid, list(source order by rank) as near_misses from h join documents d using (doc_id) group by qid
""")
def near_misses(spark: SparkSession, folder: str) -> DataFrame:
    datasets = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.col("source").alias("name"), F.lit("").alias("last_updated"))
    return answers.near_misses(conversation_plans(spark, folder), _hits(spark, folder), datasets)


@query("answer_status", f"""
    with {SQL_PLANS},
    h as (select doc_id, case doc_id % 5 when 0 then 'listing' when 1 then 'sum' else 'none' end as op, doc_id % 7 <> 0 as complete, doc_id % 11 <> 0 as has_facts,
                 case when doc_id % 13 = 0 then 'malformed' end as err,
                 case when doc_id % 5 in (2, 3) then '2024-01-03' end as f, case when doc_id % 5 in (2, 3) then '2024-02-01' end as t, doc_id % 4 = 0 as merged from documents),
    a as (select p.qid, p.status, h.*, case when p.status = 'matched' and not degraded and conv_id % 9 + 1 <= 5 then '2024-01-0' || (conv_id % 9 + 1) end as df,
                 case when p.status = 'matched' and not degraded and conv_id % 9 + 1 <= 5 then '2024-01-05' end as dt from p left join h on p.status = 'matched' and h.doc_id = p.ds),
    s as (select *, case when err is not null or status <> 'matched' or (f is not null and dt is not null and dt < f) or not has_facts then 'refused'
             when op = 'listing' or not complete or merged or (f is not null and ((df > f) or (dt < t))) then 'partial' else 'answered' end as answer_status from a)
    select qid, answer_status, case when answer_status = 'refused' then case status when 'matched' then 'matched_but_refused' else status end end as refusal_shape,
           cast(case when answer_status = 'refused' then 0 else cast(not complete as int) + cast(merged as int) + cast(f is not null and coalesce(df > f or dt < t, false) as int) end as bigint) as n_caveats
    from s
""")
def answer_status(spark: SparkSession, folder: str) -> DataFrame:
    plans = conversation_plans(spark, folder)
    doc = F.col("doc_id")
    dated = (doc % 5).isin(2, 3)
    headers = table(spark, folder, "documents").select(
        doc.alias("rid"), F.when(doc % 5 == 0, "listing").when(doc % 5 == 1, "sum").otherwise("none").alias("operation"), (doc % 7 != 0).alias("complete"),
        (doc % 11 != 0).alias("has_facts"), F.when(dated, F.lit("2024-01-03").cast("date")).alias("observed_from"), F.when(dated, F.lit("2024-02-01").cast("date")).alias("observed_to"),
        F.when(doc % 4 == 0, 2).otherwise(0).alias("merged_spellings"), F.lit(True).alias("header_trusted"), F.lit(False).alias("truncated_range"),
        F.lit(False).alias("categorical_truncation"), F.lit("measure").alias("measure_role"), F.lit(0).alias("omitted"), F.lit("").alias("title"), F.lit("").alias("unit"))
    errors = table(spark, folder, "documents").filter("doc_id % 13 = 0").select(doc.alias("resource_id"), F.lit("malformed").alias("error_kind"))
    none = F.array().cast("array<string>")
    asked = plans.select("qid")
    unbound = asked.select("qid", none.alias("unbound"), none.alias("notes"))
    context = asked.select("qid", F.lit("p").alias("publisher"), none.alias("formats"), none.alias("near_misses"))
    return answers.answer_rows(plans, headers, unbound, errors, context).select(
        "qid", "answer_status", "refusal_shape", F.size("caveats").cast("long").alias("n_caveats"))


@query("answer_footer", """
    select c_custkey, coalesce(nullif(trim(case when c_custkey % 3 = 0 then ' ' else c_mktsegment end), ''), 'untitled in the catalogue') as dataset_title,
      case when c_custkey % 2 = 0 then 'all ' || format('{:,}', c_custkey) || ' rows' when c_custkey % 5 = 0 then format('{:,}', c_custkey) || ' rows; the full size is not known'
           else format('{:,}', c_custkey) || ' of ' || format('{:,}', c_custkey * 2) || ' rows (50%)' end as row_coverage,
      cast(case when days is null then 0 when days < 30 then 1 when days < 365 then 2 when days < 1095 then 3 else 4 end as bigint) as staleness_step,
      case when days is null then 'update date unknown' when days < 30 then 'updated within the last month' when days < 365 then 'updated within the last year'
           when days < 1095 then 'not updated for ' || days // 365 || ' years' else 'not updated for ' || days // 365 || ' years — possibly abandoned' end as staleness
    from customer left join (select o_custkey, date_diff('day', max(o_orderdate), timestamp '2001-08-15') as days from orders group by all) o on o_custkey = c_custkey
""")
def answer_footer(spark: SparkSession, folder: str) -> DataFrame:
    """Provenance of one table per customer, last updated at the latest order."""
    last = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.date_format(F.max("o_orderdate"), "yyyy-MM-dd'T'HH:mm:ss").alias("last_updated"))
    key = F.col("c_custkey")
    rows = table(spark, folder, "customer").join(last, "c_custkey", "left").select(
        "c_custkey", F.when(key % 3 == 0, " ").otherwise(F.col("c_mktsegment")).alias("dataset_title"), F.lit("p").alias("publisher"), "last_updated",
        key.cast("string").alias("dataset_id"), F.lit("https://x.example.org/?token=1").alias("source_url"), key.alias("row_count"), (key % 2 == 0).alias("complete"),
        F.when(key % 5 != 0, key * 2).alias("upstream_total"))
    foot = answers.footer(F.lit("en"), F.lit("2001-08-15").cast("date"), "https://catalogue.example.org")
    return rows.select("c_custkey", foot.alias("f")).select(
        "c_custkey", "f.dataset_title", "f.row_coverage", F.col("f.staleness_step").cast("long").alias("staleness_step"), "f.staleness")


@query("answer_texts", """
    with g as (select l_suppkey as rid, l_returnflag as label, sum(cast(l_quantity as bigint)) as v, count(*) as n from lineitem group by all),
    r as (select *, row_number() over (partition by rid order by v desc, label) as p, sum(n) over (partition by rid) as used from g)
    select rid, 'Across ' || max(used) || ' rows, the largest categories are — ' || string_agg(label || ': ' || format('{:,}', cast(v as bigint)), ', ' order by p)
       || '. Source: S' || rid || ' — p. Coverage: all ' || format('{:,}', cast(max(used) as bigint)) || ' rows. updated within the last month.' as text
    from r group by rid
""")
def answer_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Plain-sentence answers, one per supplier."""
    sums = table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("rid"), F.col("l_returnflag").alias("label")).agg(
        F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("value"), F.count(F.lit(1)).alias("n"))
    placed = sums.withColumn("pos", F.row_number().over(W.partitionBy("rid").orderBy(F.desc("value"), "label"))).withColumns({
        "unit": F.lit(None).cast("string"), "basis": F.lit("")})
    heads = sums.groupBy("rid").agg(F.sum("n").alias("row_basis")).select(
        "rid", "row_basis", F.lit("sum").alias("operation"), F.lit("q").alias("measure"), F.lit(None).cast(CELL_DECIMAL).alias("stated_total"), F.lit(False).alias("total_confirmed"),
        F.lit(None).cast("string").alias("limitation"), F.concat(F.lit("S"), "rid").alias("dataset_title"), F.lit("p").alias("publisher"), F.lit("2026-01-10").alias("last_updated"),
        F.col("rid").cast("string").alias("dataset_id"), F.lit("").alias("source_url"), F.col("row_basis").alias("row_count"), F.lit(True).alias("complete"), F.lit(None).cast("long").alias("upstream_total"))
    told = heads.withColumn("footer", answers.footer(F.lit("en"), F.lit("2026-01-15").cast("date"), "https://catalogue.example.org")).join(answers.top_figures(placed), "rid")
    return told.select("rid", answers.answer_text(F.lit("en")).alias("text"))


@query("chart_matrix", """
    with v as (select l_shipyear as rid, l_returnflag as series, l_linestatus as dim, sum(q) as value from (
                 select year(l_shipdate) as l_shipyear, l_returnflag, l_linestatus, cast(l_quantity as bigint) as q from lineitem) group by all),
    c as (select rid, dim, row_number() over (partition by rid order by sum(value) desc, dim) - 1 as pos from v group by rid, dim),
    s as (select distinct rid, series from v)
    select cast(c.rid as bigint) as rid, case when (select count(*) from s s2 where s2.rid = c.rid) > 1 then 'grouped_bar' else 'bar' end as kind, s.series, cast(pos as bigint) as pos, c.dim, cast(v.value as double) as value
    from c join s on s.rid = c.rid left join v on v.rid = c.rid and v.dim = c.dim and v.series = s.series
    where (select count(*) from v v2 where v2.rid = c.rid) >= 2
""")
def chart_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """Quantities by return flag and line status, one chart per year."""
    points = table(spark, folder, "lineitem").groupBy(
        F.year("l_shipdate").cast("long").alias("rid"), F.col("l_returnflag").alias("series"), F.col("l_linestatus").alias("dim")).agg(
        F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("value")).withColumn("pos", F.lit(None).cast("long"))
    headers = points.select("rid").distinct().select(
        "rid", F.lit("sum").alias("operation"), F.lit(True).alias("complete"), F.lit(False).alias("temporal"), F.lit(False).alias("categorical_truncation"))
    return answers.chart_series(points, headers).select("rid", "kind", "series", F.col("pos").cast("long").alias("pos"), "dim", "value")


@query("chart_other_category", """
    with g as (select case when l_linenumber < 3 then l_linenumber else 3 end as k, cast(sum(cast(l_quantity as bigint)) as double) as v from lineitem group by 1),
    r as (select *, row_number() over (order by v desc, k) - 1 as p from g)
    select cast(p as bigint) as pos, case when k = 1 then 'first' else 'Other' end as dim, v as value from r
""")
def chart_other_category(spark: SparkSession, folder: str) -> DataFrame:
    """A category that is called like the remainder keeps a bar of its own."""
    kind = F.least("l_linenumber", F.lit(3))
    points = table(spark, folder, "lineitem").groupBy(kind.alias("k")).agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("value")).select(
        F.lit("t").alias("rid"), F.lit("").alias("series"), F.when(F.col("k") == 1, "first").otherwise("Other").alias("dim"), "value", F.col("k").cast("long").alias("pos"),
        F.col("k").cast("string").alias("key"))
    headers = points.select("rid").distinct().select(
        "rid", F.lit("sum").alias("operation"), F.lit(True).alias("complete"), F.lit(False).alias("temporal"), F.lit(False).alias("categorical_truncation"))
    return answers.chart_series(points, headers).select(F.col("pos").cast("long").alias("pos"), "dim", "value")


@query("chart_lines", """
    with v as (select o_orderstatus as rid, o_orderpriority as series, strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d') as dim, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as value from orders group by all)
    select rid, 'line' as kind, series, row_number() over (partition by rid, series order by dim) - 1 as pos, dim, value from v
""")
def chart_lines(spark: SparkSession, folder: str) -> DataFrame:
    points = table(spark, folder, "orders").groupBy(
        F.col("o_orderstatus").alias("rid"), F.col("o_orderpriority").alias("series"), F.trunc(F.col("o_orderdate").cast("date"), "quarter").cast("string").alias("dim")).agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("value")).withColumn("pos", F.lit(None).cast("long"))
    headers = points.select("rid").distinct().select(
        "rid", F.lit("none").alias("operation"), F.lit(True).alias("complete"), F.lit(True).alias("temporal"), F.lit(False).alias("categorical_truncation"))
    return answers.chart_series(points, headers).select("rid", "kind", "series", F.col("pos").cast("long").alias("pos"), "dim", "value")


@query("filled_placeholders", """
    select o_orderkey, 'Status ' || o_orderstatus || ' at ' || o_orderpriority || ', again ' || o_orderstatus || '.' as text from orders
""")
def filled_placeholders(spark: SparkSession, folder: str) -> DataFrame:
    values = F.create_map(F.lit("{LABEL_1}"), F.col("o_orderstatus"), F.lit("{FACT_1}"), F.col("o_orderpriority"))
    return table(spark, folder, "orders").select(
        "o_orderkey", answers.fill_placeholders(F.lit("Status {LABEL_1} at {FACT_1}, again {LABEL_1}."), values).alias("text"))


@query("direct_plans", """
    select conv_id * 1000 + turn as qid, 'matched' as status, 1.0::double as confidence, doc_id as resource_id from conversations join documents on doc_id = conv_id where doc_id % 2 = 0
""")
def direct_plans(spark: SparkSession, folder: str) -> DataFrame:
    pairs = _questions(spark, folder).select("qid", "question", F.col("conv_id").alias("resource_id"))
    resources = table(spark, folder, "documents").filter("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.col("source").alias("dataset_id"), F.lit("CSV").alias("format"))
    return answers.direct_plans(pairs, resources).select("qid", "status", "confidence", "resource_id")
