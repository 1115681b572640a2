"""Search queries: benchmark passages as questions over the documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text as tx
from plumbline.operators import dense, retrieval
from plumbline.operators.sizes import broadcast_if_small
from plumbline.plans.registry import query, spread, table
from plumbline.session import materialise

DIM = 64

SQL_TOKENS = "regexp_extract_all(lower(strip_accents({0})), '[\\p{{L}}\\p{{N}}]+')"
SQL_INDEX = f"""
    doc as (select doc_id, {SQL_TOKENS.format('text')} as toks from documents),
    stats as (select count(*) as n, avg(len(toks)) as a from doc),
    post as (select doc_id, term, count(*) as tf, any_value(dl) as dl from (select doc_id, unnest(toks) as term, len(toks) as dl from doc) group by all),
    terms as (select term, greatest(ln((n - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) as idf from post, stats group by term, n),
    q as (select item_id as qid, term, count(*) as qtf from (select item_id, unnest({SQL_TOKENS.format('text')}) as term from benchmark) group by all),
    bm as (select qid, doc_id, round(sum(qtf * idf * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / a))), 6) as score
           from q join terms using (term) join post using (term), stats group by all)
"""


def questions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents").select("doc_id", "text"))


def written_index(spark: SparkSession, folder: str) -> retrieval.LexicalIndex:
    return retrieval.build_index(documents(spark, folder), write=materialise)


@query("lexical_index", f"""
    with {SQL_INDEX.split('q as')[0].rstrip().rstrip(',')}
    select post.term, cast(count(*) as bigint) as df, cast(sum(tf) as bigint) as tf, round(max(idf), 6) as idf from post join terms using (term) group by post.term
""")
def lexical_index(spark: SparkSession, folder: str) -> DataFrame:
    return written_index(spark, folder).terms.select("term", "df", "tf", F.round("idf", 6).alias("idf"))


@query("bm25_topk", f"""
    with {SQL_INDEX},
    r as (select *, row_number() over (partition by qid order by score desc, doc_id) - 1 as rank from bm)
    select qid, doc_id, score, cast(rank as bigint) as rank from r where rank < 10
""")
def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    hits = retrieval.bm25_topk(written_index(spark, folder), questions(spark, folder), 10, write=materialise)
    return hits.select("qid", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query("dense_topk", """
    with c as (select label, unnest(range(64)) as i, unnest(embedding) as v from embeddings),
    m as (select label as qid, list(m order by i) as e from (select label, i, avg(cast(v as double)) as m from c group by all) group by label),
    s as (select qid, vec_id as doc_id, round(list_cosine_similarity(m.e, cast(embedding as double[])), 6) as score from m, embeddings),
    r as (select *, row_number() over (partition by qid order by score desc, doc_id) - 1 as rank from s)
    select cast(qid as bigint) as qid, doc_id, score, cast(rank as bigint) as rank from r where rank < 10
""")
def dense_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Nearest passages of every label's mean vector."""
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    spots = vectors.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    means = spots.groupBy(F.col("label").cast("long").alias("qid")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("embedding"))
    hits = dense.exact_topk(vectors, means, 10)
    return hits.select("qid", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query("dense_self_topk", """
    with v as (select vec_id, cast(embedding as double[]) as e from embeddings),
    s as (select q.vec_id as qid, d.vec_id as doc_id, round(list_cosine_similarity(q.e, d.e), 6) as score from v q, v d where q.vec_id % 20 = 0),
    r as (select *, row_number() over (partition by qid order by score desc, doc_id) - 1 as rank from s)
    select qid, doc_id, score, cast(rank as bigint) as rank from r where rank < 5
""")
def dense_self_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Nearest passages of every twentieth passage, over a grid of blocks."""
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    hits = dense.exact_topk(vectors, vectors.filter("doc_id % 20 = 0").withColumnRenamed("doc_id", "qid"), 5)
    return hits.select("qid", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query("dense_probed_recall", """
    select count(*) as questions, true as recall_reached from embeddings where vec_id % 20 = 0
""")
def dense_probed_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the inverted file finds nine tenths of the exact lists of every twentieth passage."""
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    asked = vectors.filter("doc_id % 20 = 0").withColumnRenamed("doc_id", "qid")
    exact = dense.exact_topk(vectors, asked, 10)
    found = dense.probed_topk(vectors, asked, 10).select("qid", "doc_id", F.lit(1).alias("hit"))
    return exact.join(found, ["qid", "doc_id"], "left").agg(
        F.count_distinct("qid").alias("questions"), (F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("recall_reached"))


def token_bucket(term: Column) -> Column:
    """Cheap bucket of a token, the same in SQL."""
    return F.pmod(F.length(term) * 31 + F.ascii(term) * 17 + F.ascii(F.substring(term, -1, 1)) * 7, F.lit(DIM))


def token_vectors(rows: DataFrame, key: str, text: str) -> DataFrame:
    tokens = rows.select(key, F.transform(tx.search_tokens(F.col(text)), token_bucket).alias("buckets"))
    return retrieval.hashed_vectors(tokens, F.col("buckets"), DIM, [key])


SQL_VECTORS = f"""
    bk as (select 'd' as t, doc_id as id, unnest(toks) as w from doc union all
           select 'q', item_id, unnest({SQL_TOKENS.format('text')}) from benchmark),
    vec as (select t, id, (length(w) * 31 + ascii(w) * 17 + ascii(right(w, 1)) * 7) % {DIM} as b, count(*) as c from bk group by all),
    single as (select t, id, b, cast(cast(c / sqrt(sum(c * c) over (partition by t, id)) as float) as double) as x from vec),
    unit as (select t, id, b, x / sqrt(sum(x * x) over (partition by t, id)) as x from single),
    hit as (select q.id as qid, d.id as doc_id, round(sum(q.x * d.x), 6) as score from unit q join unit d using (b) where q.t = 'q' and d.t = 'd' group by all),
    dn as (select qid, doc_id, score from hit union all
           select item_id, doc_id, 0.0 from benchmark, doc where len(toks) = 0)
"""
SQL_FUSED = """
    lex as (select qid, doc_id, row_number() over (partition by qid order by score desc, doc_id) - 1 as rank from bm),
    den as (select qid, doc_id, row_number() over (partition by qid order by score desc, doc_id) - 1 as rank from dn),
    arms as (select qid, doc_id, rank, 0 as arm from den where rank < 50 union all select qid, doc_id, rank, 1 from lex where rank < 50),
    fused as (select qid, doc_id, round(sum(1.0::double / (60 + rank)), 9) as score, min(arm * 1000 + rank) as seen from arms group by all),
    fr as (select *, row_number() over (partition by qid order by score desc, seen, doc_id) - 1 as rank from fused)
"""


def fused_hits(spark: SparkSession, folder: str, top_k: int) -> DataFrame:
    docs, asked = documents(spark, folder), questions(spark, folder)
    near = dense.exact_topk(token_vectors(docs, "doc_id", "text"), token_vectors(asked, "qid", "question"), 50)
    lexical = retrieval.bm25_topk(written_index(spark, folder), asked, 50, write=materialise)
    return retrieval.rrf_fuse([near, lexical], top_k=top_k)


@query("rrf_hybrid", f"""
    with {SQL_INDEX}, {SQL_VECTORS}, {SQL_FUSED}
    select qid, doc_id, score, cast(rank as bigint) as rank from fr where rank < 10
""")
def rrf_hybrid(spark: SparkSession, folder: str) -> DataFrame:
    """Hybrid search: token vectors and BM25, fused."""
    return fused_hits(spark, folder, 10).select("qid", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query("rrf_fusion", f"""
    with {SQL_INDEX},
    sh as (select item_id as qid, d.doc_id, row_number() over (partition by item_id order by n_chars desc, d.doc_id) - 1 as rank
           from benchmark b, (select doc_id, n_chars from documents order by n_chars desc, doc_id limit 50) d),
    dn as (select qid, doc_id, -rank as score from sh), {SQL_FUSED}
    select qid, doc_id, score, cast(rank as bigint) as rank, round(least(1.0, score * 30), 6) as confidence from fr where rank < 20
""")
def rrf_fusion(spark: SparkSession, folder: str) -> DataFrame:
    """BM25 fused with a second ranking (the longest documents)."""
    asked = questions(spark, folder)
    longest = table(spark, folder, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(50)
    packed = longest.groupBy().agg(F.array_sort(F.collect_list(F.struct((-F.col("n_chars")).alias("c"), "doc_id"))).alias("top"))  # 50 rows
    second = asked.select("qid", F.posexplode(packed.scalar()).alias("rank", "d")).select("qid", F.col("d.doc_id").alias("doc_id"), "rank")
    lexical = retrieval.bm25_topk(written_index(spark, folder), asked, 50, write=materialise)
    fused = retrieval.rrf_fuse([second, lexical], top_k=20)
    return fused.select("qid", "doc_id", "score", F.col("rank").cast("long").alias("rank"), F.round(retrieval.confidence(F.col("score")), 6).alias("confidence"))


@query("rerank_pool", f"""
    with {SQL_INDEX},
    r as (select *, row_number() over (partition by qid order by score desc, doc_id) - 1 as rank from bm),
    pool as (select * from r where rank < 20),
    w as (select item_id as qid, list_distinct({SQL_TOKENS.format('text')}) as words from benchmark),
    s as (select pool.qid, pool.doc_id, pool.score, pool.rank as fused_rank, len(list_intersect(words, toks)) / len(words)::double as pair from pool join w using (qid) join doc using (doc_id)),
    p as (select *, row_number() over (partition by qid order by pair desc, fused_rank) - 1 as rank from s)
    select qid, doc_id, score, cast(fused_rank as bigint) as fused_rank, round(pair, 6) as pair_score, cast(rank as bigint) as rank from p where rank < 10
""")
def rerank_pool(spark: SparkSession, folder: str) -> DataFrame:
    asked = questions(spark, folder)
    pool = retrieval.bm25_topk(written_index(spark, folder), asked, 20, write=materialise)
    ranked = retrieval.rerank(broadcast_if_small(pool), asked, documents(spark, folder), retrieval.overlap_score)
    return ranked.select(
        "qid", "doc_id", "score", F.col("fused_rank").cast("long").alias("fused_rank"), F.round("pair_score", 6).alias("pair_score"),
        F.col("rank").cast("long").alias("rank"))


def golden_questions(spark: SparkSession, folder: str, index: retrieval.LexicalIndex) -> DataFrame:
    """Passages found in documents, with the first document that holds each.

    A document holding a passage holds the passage's inner words, so its rarest
    inner word narrows the documents before the texts are compared.
    """
    asked = questions(spark, folder).select("qid", "question", tx.search_tokens(F.col("question")).alias("words"))
    inner = asked.select("qid", F.explode(F.slice("words", 2, F.greatest(F.size("words") - 2, F.lit(0)))).alias("term")).distinct()
    rarest = inner.join(index.terms.select("term", "df"), "term").groupBy("qid").agg(F.min_by("term", F.struct("df", "term")).alias("term"))
    pairs = materialise(index.postings.select("term", "doc_id").join(broadcast_if_small(materialise(rarest, "rarest")), "term").select("qid", "doc_id"), "pairs")
    texts = documents(spark, folder).join(broadcast_if_small(pairs), "doc_id").join(asked.select("qid", "question"), "qid")
    return texts.filter(F.contains("text", F.col("question"))).groupBy("qid").agg(F.min("doc_id").alias("expected_id"))


@query("retrieval_eval", f"""
    with {SQL_INDEX},
    r as (select *, row_number() over (partition by qid order by score desc, doc_id) - 1 as rank from bm),
    gold as (select item_id as qid, min(doc_id) as expected_id, case when item_id % 2 = 0 then 'even' else 'odd' end as lang
             from benchmark b join documents d on contains(d.text, b.text) group by all),
    f as (select g.qid, g.lang, r.rank from gold g left join r on r.qid = g.qid and r.doc_id = g.expected_id and r.rank < 10)
    select coalesce(lang, 'OVERALL') as lang, cast(count(*) as bigint) as n, round(avg(coalesce(1.0::double / (rank + 1), 0)), 6) as mrr,
           round(avg(case when rank < 1 then 1.0::double else 0 end), 6) as recall_at_1, round(avg(case when rank < 3 then 1.0::double else 0 end), 6) as recall_at_3,
           round(avg(case when rank < 5 then 1.0::double else 0 end), 6) as recall_at_5, round(avg(case when rank < 10 then 1.0::double else 0 end), 6) as recall_at_10
    from f group by rollup(lang)
""")
def retrieval_eval(spark: SparkSession, folder: str) -> DataFrame:
    index = written_index(spark, folder)
    gold = golden_questions(spark, folder, index).withColumn("lang", F.when(F.col("qid") % 2 == 0, "even").otherwise("odd"))
    hits = retrieval.bm25_topk(index, questions(spark, folder), 10, write=materialise)
    return retrieval.evaluate(gold, hits)


@query("hydrated_hits", f"""
    with {SQL_INDEX},
    r as (select *, row_number() over (partition by qid order by score desc, doc_id) - 1 as rank from bm)
    select r.qid, r.doc_id, r.score, cast(rank as bigint) as rank, source as name, lang as title
    from r join documents d on d.doc_id = r.doc_id and d.n_chars % 2 = 0 where rank < 10
""")
def hydrated_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Hits with catalogue fields; those whose dataset is unknown drop out."""
    known = table(spark, folder, "documents").filter("n_chars % 2 = 0").select(
        F.col("doc_id").alias("id"), F.col("source").alias("name"), F.col("lang").alias("title"), F.lit("").alias("last_updated"))
    hits = retrieval.bm25_topk(written_index(spark, folder), questions(spark, folder), 10, write=materialise)
    return retrieval.hydrate(broadcast_if_small(hits), known).select("qid", "doc_id", "score", F.col("rank").cast("long").alias("rank"), "name", "title")


@query("refreshed_vectors", """
    select doc_id, sha1(case when doc_id % 5 = 0 then text || ' changed' else text end) as sig, doc_id % 5 = 0 or doc_id % 13 = 0 as embedded
    from documents where doc_id % 7 <> 0
""")
def refreshed_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Only new and changed texts are embedded again; removed ones are gone."""
    docs = documents(spark, folder)
    current = token_vectors(docs.filter("doc_id % 13 <> 0"), "doc_id", "text").join(
        docs.select("doc_id", retrieval.signature(F.col("text")).alias("sig")), "doc_id")
    incoming = docs.filter("doc_id % 7 <> 0").select(
        "doc_id", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" changed"))).otherwise(F.col("text")).alias("text"))

    def embed(rows: DataFrame) -> DataFrame:
        return retrieval.hashed_vectors(
            rows.select("doc_id", "sig", F.transform(tx.search_tokens(F.col("text")), token_bucket).alias("buckets")), F.col("buckets"), DIM, ["doc_id", "sig"])

    snapshot, done = retrieval.refresh_vectors(current, incoming, embed)
    return snapshot.select("doc_id", "sig").join(done.withColumn("_e", F.lit(True)), "doc_id", "left").select(
        "doc_id", "sig", F.coalesce("_e", F.lit(False)).alias("embedded"))


@query("language_label", """
    with t as (select 'd' as kind, doc_id as id, lower(text) as s from documents union all select 'c', conv_id * 100000 + turn, lower(text) from conversations),
    w as (select kind, id, s, regexp_extract_all(s, '[a-zͰ-Ͽἀ-῿]+') as ws from t)
    select kind, id, case when regexp_matches(s, '[Ͱ-Ͽἀ-῿]') then 'el'
        when len(list_filter(ws, lambda x: list_contains(['pos', 'sto', 'tou', 'ton', 'tis', 'kai', 'ana', 'gia', 'apo', 'tha', 'que', 'le', 'de', 'la'], x)))
           > len(list_filter(ws, lambda x: list_contains(['the', 'is', 'of', 'and', 'for', 'with', 'by', 'on', 'at', 'an', 'that', 'was'], x))) then 'greeklish' else 'en' end as label
    from w
""")
def language_label(spark: SparkSession, folder: str) -> DataFrame:
    """Marker-count labels with marker lists given as parameters."""
    rows = table(spark, folder, "documents").select(F.lit("d").alias("kind"), F.col("doc_id").alias("id"), "text").unionByName(
        table(spark, folder, "conversations").select(F.lit("c").alias("kind"), (F.col("conv_id") * 100000 + F.col("turn")).alias("id"), "text"))
    label = tx.detect_language(
        F.col("text"), ("pos", "sto", "tou", "ton", "tis", "kai", "ana", "gia", "apo", "tha", "que", "le", "de", "la"),
        ("the", "is", "of", "and", "for", "with", "by", "on", "at", "an", "that", "was"))
    return spread(rows).select("kind", "id", label.alias("label"))


@query("transliterate_pass")
def transliterate_pass(spark: SparkSession, folder: str) -> DataFrame:
    rows = spread(table(spark, folder, "conversations"))
    return rows.select("conv_id", "turn", tx.transliterate_greeklish(F.col("text")).alias("greek"))
