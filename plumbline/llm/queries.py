"""One query per operator over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import best_fit, content_sort, line_edits, line_frequency, merge_automaton, paragraph_minhash, preference_quality, qd_whitening, secret_lexer, separator_scan, simhash_blocks, turn_tables, window_packing

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op10_line_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return line_frequency.quality_rules(table(spark, folder, "documents"))


SQL["op10_line_frequency"] = r"""
with docs as (
  select doc_id, coalesce(source, '') as host, coalesce(text, '') as text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
grams as (
  select doc_id, g, count(*) as n, list(i) as places
  from (select doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: {'i': i, 'g': w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]}), recursive := true) from docs where len(w) >= 3)
  group by 1, 2 having count(*) > 1),
repeats as (
  select doc_id, count(distinct i + k) as n
  from (select doc_id, unnest(places) as i from grams), (values (0), (1), (2)) v(k) group by 1),
lines as (
  select doc_id, host, text, line, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) as norm
  from (select doc_id, host, text, unnest(string_split(text, chr(10))) as line from docs)
  where regexp_matches(line, '[^\x20\x09-\x0D]')),
dups as (select doc_id, count(*) - count(distinct line) as n from lines group by 1),
held as (select distinct host, text, norm, len(string_split(norm, ' ')) as words from lines),
sizes as (select host, count(distinct text) as texts from held group by 1),
frequent as (
  select host, norm from (select host, norm, count(*) as n from held group by 1, 2) join sizes using (host)
  where n >= 3 and (n > 0.1 * texts or n > 10000)),
depleted as (
  select h.host, h.text from held h left join frequent f on h.host = f.host and h.norm = f.norm
  group by 1, 2 having sum(case when f.norm is null then words else 0 end) < 0.3 * sum(words)),
judged as (
  select d.doc_id, d.host, d.text, len(d.w) as n_words, length(array_to_string(d.w, '')) as word_chars,
         length(regexp_replace(d.text, '[^#*$%&|<>]+', '', 'g')) as n_symbols,
         coalesce(u.n, 0) as n_dup_lines, coalesce(r.n, 0) as n_repeat_words
  from docs d left join dups u using (doc_id) left join repeats r using (doc_id))
select j.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed,
       not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and g.text is null as kept
from judged j left join depleted g on j.host = g.host and j.text = g.text
"""


@query
def op6_content_sort(spark: SparkSession, folder: str) -> DataFrame:
    return content_sort.content_groups(table(spark, folder, "documents"))


SQL["op6_content_sort"] = """
with n as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents)
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256 from n
"""


@query
def op5_simhash_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_blocks.near_duplicates(table(spark, folder, "documents"))


@query
def op3_secret_lexer(spark: SparkSession, folder: str) -> DataFrame:
    return secret_lexer.find_secrets(table(spark, folder, "documents"))


@query
def op7_best_fit(spark: SparkSession, folder: str) -> DataFrame:
    return best_fit.pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op1_preference_quality(spark: SparkSession, folder: str) -> DataFrame:
    return preference_quality.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op9_merge_automaton(spark: SparkSession, folder: str) -> DataFrame:
    return merge_automaton.round_trips(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op4_paragraph_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return paragraph_minhash.by_document(table(spark, folder, "documents"), min_passage=20)


@query
def op8_separator_scan(spark: SparkSession, folder: str) -> DataFrame:
    return separator_scan.count_documents(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op2_line_edits(spark: SparkSession, folder: str) -> DataFrame:
    return line_edits.by_document(table(spark, folder, "documents"))


@query
def op11_turn_tables(spark: SparkSession, folder: str) -> DataFrame:
    return turn_tables.repair(turn_tables.damage(table(spark, folder, "conversations")), copies="copies")


@query
def op12_window_packing(spark: SparkSession, folder: str) -> DataFrame:
    return window_packing.pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op13_qd_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return qd_whitening.whiten(table(spark, folder, "embeddings"))
