"""Column profiles, roles and readings over text copies of the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import dates, numbers
from plumbline.operators import coercion, roles
from plumbline.operators.cells import cells_from_table
from plumbline.operators.sizes import broadcast_if_small
from plumbline.plans import questions as asked
from plumbline.plans import tables as plan
from plumbline.plans.registry import query, spread, table
from plumbline.session import materialise
from plumbline.sources.tables import read_in_order


def money(column: str) -> Column:
    """A price as text, ``1.234,56``."""
    return F.translate(F.format_number(F.col(column).cast("decimal(18,2)"), 2), ",.", ".,")


def fixed(column: str) -> Column:
    return F.col(column).cast("decimal(18,2)").cast("string")


def day(column: str) -> Column:
    return F.col(column).cast("date").cast("string")


def lineitem_texts(spark: SparkSession, folder: str) -> DataFrame:
    return spread(read_in_order(spark, f"{folder}/lineitem.parquet")).select(
        "row_idx",
        F.col("l_orderkey").cast("string").alias("order_id"), F.col("l_partkey").cast("string").alias("part_id"),
        F.col("l_suppkey").cast("string").alias("l_suppkey"), F.col("l_linenumber").cast("string").alias("l_linenumber"),
        fixed("l_quantity").alias("l_quantity"), money("l_extendedprice").alias("l_extendedprice"),
        F.when(F.col("l_discount") == 0, F.lit(":")).otherwise(F.concat(fixed("l_discount"), F.lit("%"))).alias("l_discount"),
        F.when(F.col("l_tax") == 0, F.lit("")).otherwise(fixed("l_tax")).alias("l_tax"),
        "l_returnflag", "l_linestatus", F.date_format("l_shipdate", "dd/MM/yyyy").alias("l_shipdate"),
    )


LINEITEM_COLUMNS = [
    "order_id", "part_id", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
]


def lineitem_cells(spark: SparkSession, folder: str) -> DataFrame:
    return cells_from_table(lineitem_texts(spark, folder), F.lit("lineitem"), F.col("row_idx"), LINEITEM_COLUMNS)


def orders_cells(spark: SparkSession, folder: str) -> DataFrame:
    texts = spread(table(spark, folder, "orders")).select(
        F.col("o_orderkey").alias("row_idx"), F.col("o_orderkey").cast("string").alias("order_id"),
        F.col("o_custkey").cast("string").alias("o_custkey"), "o_orderstatus", fixed("o_totalprice").alias("o_totalprice"),
        day("o_orderdate").alias("o_orderdate"), "o_orderpriority")
    return cells_from_table(texts, F.lit("orders"), F.col("row_idx"), texts.columns[1:])


def part_cells(spark: SparkSession, folder: str) -> DataFrame:
    texts = spread(table(spark, folder, "part")).select(
        F.col("p_partkey").alias("row_idx"), F.col("p_partkey").cast("string").alias("part_id"), "p_name", "p_brand", "p_type",
        F.col("p_size").cast("string").alias("p_size"), fixed("p_retailprice").alias("p_retailprice"))
    return cells_from_table(texts, F.lit("part"), F.col("row_idx"), texts.columns[1:])


SQL_MONEY = "translate(format('{{:,.2f}}', {0}), ',.', '.,')"
SQL_FIXED = "cast(cast({0} as decimal(18,2)) as varchar)"

SQL_CELLS = f"""
    li as (select l_orderkey * 8 + l_linenumber as r, cast(l_orderkey as varchar) as c0, cast(l_partkey as varchar) as c1,
                  cast(l_suppkey as varchar) as c2, cast(l_linenumber as varchar) as c3, {SQL_FIXED.format('l_quantity')} as c4,
                  {SQL_MONEY.format('l_extendedprice')} as c5,
                  case when l_discount = 0 then ':' else {SQL_FIXED.format('l_discount')} || '%' end as c6,
                  case when l_tax = 0 then '' else {SQL_FIXED.format('l_tax')} end as c7,
                  l_returnflag as c8, l_linestatus as c9, strftime(l_shipdate, '%d/%m/%Y') as c10 from lineitem),
    od as (select o_orderkey as r, cast(o_orderkey as varchar) as c0, cast(o_custkey as varchar) as c1, o_orderstatus as c2,
                  {SQL_FIXED.format('o_totalprice')} as c3, strftime(o_orderdate, '%Y-%m-%d') as c4, o_orderpriority as c5 from orders),
    pt as (select p_partkey as r, cast(p_partkey as varchar) as c0, p_name as c1, p_brand as c2, p_type as c3,
                  cast(p_size as varchar) as c4, {SQL_FIXED.format('p_retailprice')} as c5 from part),
    names as (select 'li' as t, 'lineitem' as rid, unnest(range(11)) as i, unnest({LINEITEM_COLUMNS}) as name
              union all select 'od', 'orders', unnest(range(6)), unnest(['order_id','o_custkey','o_orderstatus','o_totalprice','o_orderdate','o_orderpriority'])
              union all select 'pt', 'part', unnest(range(6)), unnest(['part_id','p_name','p_brand','p_type','p_size','p_retailprice'])),
    cells as ({" union all ".join(f"select 'lineitem' as rid, r, {i} as i, c{i} as cell from li" for i in range(11))}
              union all {" union all ".join(f"select 'orders', r, {i}, c{i} from od" for i in range(6))}
              union all {" union all ".join(f"select 'part', r, {i}, c{i} from pt" for i in range(6))}),
    marked as (select *, coalesce(cell, '') = '' as is_null, lower(cell) in ('-',':','..','.','n/a','na','x','c','w','z','null','none') as is_sent from cells),
    shaped as (select *, case when not is_null and not is_sent then replace(cell, '%', '') end as bare from marked),
    kinds as (select *, case when bare is null then null
        when regexp_full_match(bare, '[+-]?[0-9]+') then 'int'
        when not regexp_full_match(bare, '[+-]?[0-9.,]+') then 'other'
        when contains(bare, ',') and contains(bare, '.') then case when regexp_matches(bare, ',[^.]*$') then 'comma' else 'point' end
        when regexp_matches(bare, '[.,].*[.,]') then 'int' when regexp_matches(bare, '[.,][0-9]{{3}}$') then 'amb'
        when contains(bare, ',') then 'comma' else 'point' end as k from shaped),
    prof as (select rid, i, count(*) as n_rows, count(*) filter (is_null) as null_count, count(*) filter (is_sent and not is_null) as sentinel_count,
        count(bare) as non_null, bool_or(k = 'other') as other, bool_or(k = 'comma') as comma, bool_or(k = 'point') as point, bool_or(k = 'amb') as amb,
        bool_or(contains(cell, '%')) as pct,
        bool_and(k <> 'other' or regexp_full_match(bare, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') or regexp_full_match(bare, '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}')) as datey,
        bool_or(case when regexp_full_match(bare, '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}') then cast(substr(bare, 1, 2) as int) > 12 end) as df,
        max(case when contains(bare, ',') and (k = 'comma') then length(bare) - instr(bare, ',') when k = 'point' then length(bare) - instr(bare, '.') else 0 end) as sc
        from kinds group by all),
    verdict as (select *, case when non_null = 0 then 'text' when not other and not (comma and point) and (comma or point or not amb) then 'decimal'
                               when datey then 'temporal' else 'text' end as kind from prof)
"""


@query("column_profile", f"""
    with {SQL_CELLS}
    select v.rid, name as col_name, cast(n_rows as bigint) as n_rows, cast(null_count as bigint) as null_count,
           cast(sentinel_count as bigint) as sentinel_count, cast(non_null as bigint) as non_null, kind,
           case when kind = 'decimal' then comma end as comma_decimal, case when kind = 'decimal' then cast(sc as bigint) end as scale,
           case when kind = 'decimal' and pct then '%' end as unit,
           case when kind = 'temporal' then case when df is null then 'none' when df then 'day_first' end end as day_rule
    from verdict v join names n on n.rid = v.rid and n.i = v.i
""")
def column_profile(spark: SparkSession, folder: str) -> DataFrame:
    cells = lineitem_cells(spark, folder).unionByName(orders_cells(spark, folder)).unionByName(part_cells(spark, folder))
    return coercion.column_profile(coercion.alike_cells(cells)).select(
        "rid", "col_name", "n_rows", "null_count", "sentinel_count", "non_null", "kind", "comma_decimal",
        F.col("scale").cast("long").alias("scale"), "unit", "day_rule")


@query("role_classification", f"""
    with {SQL_CELLS},
    vals as (select k.*, v.kind, v.n_rows, v.non_null, v.sentinel_count, n.name,
               case when v.kind = 'decimal' then case when v.comma then cast(replace(replace(bare, '.', ''), ',', '.') as decimal(24,6)) else cast(bare as decimal(24,6)) end end as num,
               case when v.kind = 'temporal' then coalesce(try_cast(bare as date), try_strptime(bare, '%d/%m/%Y')::date) end as d
             from kinds k join verdict v on v.rid = k.rid and v.i = k.i join names n on n.rid = k.rid and n.i = k.i where bare is not null),
    st as (select rid, i, name, kind, any_value(n_rows) as n_rows, any_value(non_null) as non_null, any_value(sentinel_count) as sent,
             count(distinct bare) as dis, max(length(bare)) as ml, bool_and(num = r + 1) as dense, bool_and(num = floor(num)) as integral,
             avg(case when (upper(bare) = bare and lower(bare) <> bare) or regexp_full_match(bare, '[0-9]+') then 1.0 else 0.0 end) as up
           from vals group by all),
    falls as (select rid, i, bool_or(num < p) as falls from (
                select v.rid, v.i, v.num, lag(v.num) over (partition by v.rid, v.i, g.bare order by t.d, v.r) as p
                from vals v join vals t on t.rid = v.rid and t.r = v.r and t.name = 'o_orderdate'
                join vals g on g.rid = v.rid and g.r = v.r and g.name = 'o_orderpriority' where v.name = 'o_totalprice') group by all)
    select st.rid, name as col_name, cast(dis as bigint) as distinct_count,
      case when kind = 'decimal' and ((dense and non_null = n_rows) or (integral and (name like '%id'))) then 'identifier'
           when kind = 'temporal' then 'temporal'
           when kind = 'text' and ml <= 8 and dis <= non_null * 0.1 and up >= 0.9 then 'code'
           when kind <> 'decimal' then 'dimension'
           when sent > n_rows * 0.2 then 'unknown'
           when regexp_matches(name, 'total|cum') then case when falls then 'measure' else 'running_cumulative' end
           else 'measure' end as role
    from st left join falls on falls.rid = st.rid and falls.i = st.i
""")
def role_classification(spark: SparkSession, folder: str) -> DataFrame:
    """Roles of all columns of three tables at once."""
    cells = lineitem_cells(spark, folder).unionByName(orders_cells(spark, folder)).unionByName(part_cells(spark, folder))
    distinct = materialise(coercion.distinct_cells(cells), "distinct")
    profile = materialise(coercion.column_profile(distinct), "profile")
    values = materialise(roles.value_counts(coercion.typed_cells(distinct, profile)), "values")
    return roles.column_roles(cells, profile, values, keep=materialise).select(
        "rid", "col_name", F.col("distinct_count").cast("long").alias("distinct_count"), "role")


@query("row_total_columns", """
    with r as (select l_returnflag as rid, l_orderkey * 8 + l_linenumber as r, cast(l_quantity as decimal(18,2)) as a,
                      cast(l_linenumber as decimal(18,2)) as b, case when l_tax > 0 then cast(l_tax as decimal(18,2)) end as c from lineitem),
    w as (select *, a + b + c as t, row_number() over (partition by rid order by r) as rn from r where c is not null)
    select rid, 'total' as col_name from w where rn <= 50 group by rid having count(*) >= 3 and bool_and(t = a + b + c)
""")
def row_total_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Columns that add up the other numeric columns of their row."""
    tax = F.when(F.col("l_tax") > 0, F.col("l_tax").cast("decimal(18,2)"))
    texts = spread(read_in_order(spark, f"{folder}/lineitem.parquet")).select(
        F.col("l_returnflag").alias("rid"), "row_idx",
        fixed("l_quantity").alias("quantity"), fixed("l_linenumber").alias("lines"), tax.cast("string").alias("tax"),
        (F.col("l_quantity").cast("decimal(18,2)") + F.col("l_linenumber").cast("decimal(18,2)") + tax).cast("string").alias("total"))
    cells = cells_from_table(texts, F.col("rid"), F.col("row_idx"), ["quantity", "lines", "tax", "total"])
    profile = materialise(coercion.column_profile(coercion.alike_cells(cells)), "profile")
    names = profile.select("rid", "col_idx", "col_name")
    return roles.row_totals(cells, profile).join(names, ["rid", "col_idx"]).select("rid", "col_name")


@query("late_total_break", """
    with r as (select l_returnflag as rid, cast(l_quantity as decimal(18,2)) as a, cast(l_linenumber as decimal(18,2)) as b, l_orderkey * 8 + l_linenumber as k,
                      max(l_orderkey * 8 + l_linenumber) over (partition by l_returnflag) as last from lineitem),
    w as (select rid, a, b, a + b + case when k = last and rid = 'N' then 1 else 0 end as t from r)
    select rid, 'total' as col_name from w group by rid having bool_and(t = a + b)
""")
def late_total_break(spark: SparkSession, folder: str) -> DataFrame:
    """A total that fails in its table's last row alone is no total."""
    key = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    lines = table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("rid"), key.alias("k"), "l_quantity", "l_linenumber")
    last = broadcast_if_small(lines.groupBy("rid").agg(F.max("k").alias("last")))  # three flags: a join by key would be three tasks
    off = F.when((F.col("k") == F.col("last")) & (F.col("rid") == "N"), 1).otherwise(0)
    texts = lines.join(last, "rid").select(
        "rid", F.col("k").alias("row_idx"), fixed("l_quantity").alias("quantity"), fixed("l_linenumber").alias("lines"),
        (F.col("l_quantity").cast("decimal(18,2)") + F.col("l_linenumber").cast("decimal(18,2)") + off).cast("string").alias("total"))
    cells = cells_from_table(texts, F.col("rid"), F.col("row_idx"), ["quantity", "lines", "total"])
    profile = materialise(coercion.column_profile(coercion.alike_cells(cells)), "profile")
    return roles.row_totals(cells, profile).join(profile.select("rid", "col_idx", "col_name"), ["rid", "col_idx"]).select("rid", "col_name")


@query("locale_decimal_roundtrip", """
    with p as (select l_returnflag, cast(l_extendedprice as decimal(18,2)) as v,
                      format('{:,.2f}', l_extendedprice) as en, translate(format('{:,.2f}', l_extendedprice), ',.', '.,') as el from lineitem)
    select l_returnflag as rid, cast(sum(v) as double) as total, cast(count(*) as bigint) as n,
           cast(count(*) filter (contains(en, ',')) as bigint) as grouped, cast(sum(length(el)) as bigint) as chars,
           cast(0 as bigint) as differing
    from p group by all
""")
def locale_decimal_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Prices written in two locales, read back and written again."""
    rows = spread(table(spark, folder, "lineitem")).select(
        "l_returnflag", F.col("l_extendedprice").cast("decimal(18,2)").alias("v"),
        F.format_number(F.col("l_extendedprice").cast("decimal(18,2)"), 2).alias("en"), money("l_extendedprice").alias("el"))
    read = rows.select(
        "l_returnflag", "v", "en", "el",
        numbers.to_decimal(numbers.number_text(F.col("en"), False)).alias("from_en"),
        numbers.to_decimal(numbers.number_text(F.col("el"), True)).alias("from_el"))
    again = F.length(numbers.format_number(F.col("from_el"), F.lit("el")))
    short = F.length(numbers.format_number(F.col("from_en"), F.lit("en")))
    return read.groupBy(F.col("l_returnflag").alias("rid")).agg(
        F.round(F.sum("from_el"), 2).cast("double").alias("total"), F.count(F.lit(1)).alias("n"),
        F.count_if(F.contains("en", F.lit(","))).alias("grouped"), F.sum(F.length("el")).alias("chars"),
        F.count_if((F.col("from_en") != F.col("v")) | (F.col("from_el") != F.col("v")) | (again != short)).alias("differing"))


@query("temporal_parse", """
    with f as (select o_orderkey, o_orderdate, case o_orderkey % 4
        when 0 then strftime(o_orderdate, '%Y-%m-%d') when 1 then strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+03:00'
        when 2 then strftime(o_orderdate, '%Y-%m') else year(o_orderdate) || '-Q' || quarter(o_orderdate) end as cell from orders),
    d as (select o_orderkey % 4 as shape, case o_orderkey % 4 when 2 then date_trunc('month', o_orderdate) when 3 then date_trunc('quarter', o_orderdate) else o_orderdate end as d from f)
    select cast(shape as bigint) as shape, cast(count(*) as bigint) as n, cast(count(d) as bigint) as parsed,
           strftime(min(d), '%Y-%m-%d') as first_date, strftime(max(d), '%Y-%m-%d') as last_date, cast(count(distinct d) as bigint) as periods
    from d group by shape
""")
def temporal_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Order dates written in four shapes and read back."""
    moment, shape = F.col("o_orderdate"), F.pmod(F.col("o_orderkey"), F.lit(4))
    cell = (
        F.when(shape == 0, F.date_format(moment, "yyyy-MM-dd"))
        .when(shape == 1, F.concat(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+03:00")))
        .when(shape == 2, F.date_format(moment, "yyyy-MM"))
        .otherwise(F.concat(F.year(moment).cast("string"), F.lit("-Q"), F.quarter(moment).cast("string")))
    )
    read = table(spark, folder, "orders").select(shape.alias("shape"), cell.alias("cell")).select(
        "shape", dates.unslashed_date(F.col("cell")).alias("d"))
    return read.groupBy("shape").agg(
        F.count(F.lit(1)).alias("n"), F.count("d").alias("parsed"), F.min("d").cast("string").alias("first_date"),
        F.max("d").cast("string").alias("last_date"), F.count_distinct("d").alias("periods"))


@query("range_overlap", """
    with o as (select o_custkey, strftime(min(o_orderdate), '%Y-%m-%d') as s, strftime(max(o_orderdate), '%Y-%m-%d') as e from orders group by all),
    c as (select c_custkey, case c_mktsegment when 'BUILDING' then '1995-01-01' when 'MACHINERY' then '2001-01-01' when 'FURNITURE' then '1996-06-01' end as f,
                 case c_mktsegment when 'BUILDING' then '1996-12-31' when 'HOUSEHOLD' then '1994-12-31' when 'FURNITURE' then '1997-01-01' end as t from customer)
    select c_custkey, case when s is null or (f is null and t is null) then 'full' when coalesce(t < s, false) or coalesce(f > e, false) then 'none'
                           when coalesce(f > s, false) or coalesce(t < e, false) then 'partial' else 'full' end as overlap
    from c left join o on o_custkey = c_custkey
""")
def range_overlap(spark: SparkSession, folder: str) -> DataFrame:
    observed = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        day_text(F.min("o_orderdate")).alias("s"), day_text(F.max("o_orderdate")).alias("e"))
    segment = F.col("c_mktsegment")
    asked = table(spark, folder, "customer").select(
        "c_custkey",
        F.when(segment == "BUILDING", "1995-01-01").when(segment == "MACHINERY", "2001-01-01").when(segment == "FURNITURE", "1996-06-01").alias("f"),
        F.when(segment == "BUILDING", "1996-12-31").when(segment == "HOUSEHOLD", "1994-12-31").when(segment == "FURNITURE", "1997-01-01").alias("t"))
    return asked.join(observed, "c_custkey", "left").select(
        "c_custkey", dates.range_overlap(F.col("s"), F.col("e"), F.col("f"), F.col("t")).alias("overlap"))


def day_text(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd")


@query("constant_columns", """
    with c as (select l_returnflag as rid, unnest(['flag', 'status', 'line']) as col_name,
                      unnest([l_returnflag, l_linestatus, cast(l_linenumber as varchar)]) as v from lineitem)
    select rid, col_name, case max(v) when 'N' then 'False' else max(v) end as value from c group by rid, col_name having count(distinct v) = 1
""")
def constant_columns(spark: SparkSession, folder: str) -> DataFrame:
    texts = spread(read_in_order(spark, f"{folder}/lineitem.parquet")).select(
        F.col("l_returnflag").alias("rid"), "row_idx",
        F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_linenumber").cast("string").alias("line"))
    cells = cells_from_table(texts, F.col("rid"), F.col("row_idx"), ["flag", "status", "line"])
    profile = coercion.column_profile(cells)
    values = materialise(roles.value_counts(coercion.typed_cells(coercion.distinct_cells(cells), profile)), "values")
    found = roles.constant_columns(values, roles.column_stats(values))
    return found.join(profile.select("rid", "col_idx", "col_name"), ["rid", "col_idx"]).select("rid", "col_name", "value")


@query("unpivot_measures", """
    select 'part' as rid, p_brand as label, unnest(['p_size', 'p_retailprice']) as measure,
           unnest([cast(p_size as double), round(p_retailprice, 2)]) as value, cast(p_partkey as bigint) as row_idx
    from part
""")
def unpivot_measures(spark: SparkSession, folder: str) -> DataFrame:
    """Parts have no time axis and two measures, so the measures become rows."""
    analysis = part_analysis(spark, folder)
    return plan.unpivot_measures(analysis).select(
        "rid", "label", "measure", F.round("value", 2).cast("double").alias("value"), "row_idx")


def part_analysis(spark: SparkSession, folder: str) -> plan.TableAnalysis:
    cells = part_cells(spark, folder)
    tables = spark.createDataFrame([("part", None, True, True)], "rid string, title string, complete boolean, header_trusted boolean")
    return plan.analyse_tables(cells, tables)


@query("table_facts", """
    with g as (select p_brand as label, sum(cast(p_size as decimal(18,2))) as s, count(*) as n, min(p_partkey) as f from part group by all),
    r as (select *, row_number() over (order by s desc, f) as p, sum(n) over () as used from g)
    select 'part' as rid, 'sum' as operation, cast(p as bigint) as pos, label, cast(s as double) as value, cast(n as bigint) as n, cast(used as bigint) as n_used,
           format('sum of ''p_size'' over {} rows', cast(used as bigint)) as basis
    from r
""")
def table_facts(spark: SparkSession, folder: str) -> DataFrame:
    """The whole way from cells to facts for a table nothing is known about."""
    return plan.table_facts(part_analysis(spark, folder)).select(
        "rid", "operation", F.col("pos").cast("long").alias("pos"), "label", F.round("value", 2).cast("double").alias("value"),
        F.col("n").cast("long").alias("n"), F.col("n_used").cast("long").alias("n_used"), "basis")


@query("question_facts", """
    with a as (select p_brand, count(*) as n, cast(sum(p_size) as double) as s, cast(max(p_size) as double) as m, cast(regexp_extract(p_brand, '[0-9]+') as int) % 4 as o from part group by all)
    select p_brand as qid, case o when 0 then 'sum' when 1 then 'avg' when 2 then 'max' else 'count' end as operation, p_brand as label, cast(n as bigint) as n,
           round(case o when 0 then s when 1 then s / n when 2 then m else n end, 4) as value from a
""")
def question_facts(spark: SparkSession, folder: str) -> DataFrame:
    """One question per brand about the part table, with an aggregate of its own."""
    return _brand_questions(spark, folder, None)


def _brand_questions(spark: SparkSession, folder: str, date_from: str | None) -> DataFrame:
    analysis = part_analysis(spark, folder)
    number = F.regexp_extract("p_brand", "[0-9]+", 0).cast("int") % 4
    wanted = F.when(number == 0, "sum").when(number == 1, "avg").when(number == 2, "max").otherwise("count")
    none = F.lit(None).cast("string")
    plans = table(spark, folder, "part").select("p_brand").distinct().select(
        F.col("p_brand").alias("qid"), F.lit("part").alias("resource_id"), F.lit("matched").alias("status"),
        F.struct(F.lit(date_from).cast("string").alias("date_from"), none.alias("date_to"), F.concat(F.lit(" "), "p_brand").alias("region"), wanted.alias("aggregation"), none.alias("group_by"),
                 F.lit(5).cast("long").alias("limit")).alias("params"))
    return asked.question_facts(plans, analysis).select(
        "qid", "operation", "label", "n", F.round("value", 4).cast("double").alias("value"))


@query("question_unbound_date", """
    with a as (select p_brand, count(*) as n, cast(sum(p_size) as double) as s, cast(max(p_size) as double) as m, cast(regexp_extract(p_brand, '[0-9]+') as int) % 4 as o from part group by all)
    select p_brand as qid, case o when 0 then 'sum' when 1 then 'avg' when 2 then 'max' else 'count' end as operation, p_brand as label, cast(n as bigint) as n,
           round(case o when 0 then s when 1 then s / n when 2 then m else n end, 4) as value from a
""")
def question_unbound_date(spark: SparkSession, folder: str) -> DataFrame:
    """The same questions with a date, which the part table has no column for: not applied, not refused."""
    return _brand_questions(spark, folder, "2020-01-01")
