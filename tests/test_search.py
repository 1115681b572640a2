"""Search against brute force, with words that most documents share."""

import dataclasses
import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.functions.text import search_tokens
from plumbline.operators import dense, retrieval
from plumbline.session import materialise


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(11)
    common, rare = ["the", "of", "and"], [f"w{i}" for i in range(120)]
    docs = []
    for i in range(300):
        words = [w for w in common if rng.random() < 0.9] * rng.randrange(1, 6) + rng.choices(rare, k=rng.randrange(0, 25))
        rng.shuffle(words)
        docs.append((i, " ".join(words)))
    questions = [(0, "the w1 w2"), (1, "the of and"), (2, "w5 w5 w6 of"), (3, "nothing here matches"), (4, "!!"), (5, "w7 the the and of w8 w9")]
    return docs, questions, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(questions, "qid long, question string")


def bm25(docs, question):
    tokens = {i: re.findall(r"\w+", t) for i, t in docs}
    mean = sum(map(len, tokens.values())) / len(docs)
    df = Counter(w for words in tokens.values() for w in set(words))
    scores = Counter()
    for word, qtf in Counter(re.findall(r"\w+", question)).items():
        if word not in df:
            continue
        idf = max(math.log((len(docs) - df[word] + 0.5) / (df[word] + 0.5)), 1e-6)
        for i, words in tokens.items():
            tf = words.count(word)
            if tf:
                scores[i] += qtf * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / mean))
    return sorted(((round(s, 6), i) for i, s in scores.items()), key=lambda r: (-r[0], r[1]))


@pytest.mark.parametrize("k", [1, 10, 250])
def test_bm25_is_exact(corpus, k):
    docs, questions, df, asked = corpus
    index = retrieval.build_index(df, write=materialise, block_docs=8)
    got = {}
    for r in retrieval.bm25_topk(index, asked, k, write=materialise).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append((r["score"], r["doc_id"]))
    want = {q: [(s, i) for s, i in bm25(docs, text)[:k]] for q, text in questions}
    assert got == {q: rows for q, rows in want.items() if rows}


def test_common_words_alone_stop_at_the_kth_score(spark):
    rng = random.Random(3)
    docs = [(i, " ".join((["the"] * rng.randrange(1, 3) + ["of"]) * (i % 9 < 4) + [f"x{rng.randrange(9)}"] * (10 + i))) for i in range(400)]
    index = retrieval.build_index(spark.createDataFrame(docs, "doc_id long, text string"), write=materialise, block_docs=8)
    scored = []

    def write(df, name):
        out = materialise(df, name)
        if name == "scored":
            scored.append(out.count())
        return out

    asked = spark.createDataFrame([(0, "the of")], "qid long, question string")
    got = [(r["score"], r["doc_id"]) for r in retrieval.bm25_topk(index, asked, 5, write=write).orderBy("rank").collect()]
    assert got == bm25(docs, "the of")[:5]
    assert sum(scored) < 60  # of 178 documents that hold both words


def test_dense_is_exact(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(200, 8))
    asked = rng.normal(size=(5, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "doc_id long, embedding array<double>").repartition(3)
    qs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "qid long, embedding array<double>")
    cosine = np.round((vectors / np.linalg.norm(vectors, axis=1, keepdims=True)) @ (asked / np.linalg.norm(asked, axis=1, keepdims=True)).T, 6)
    want = [(q, int(i)) for q in range(5) for i in sorted(range(200), key=lambda i: (-cosine[i, q], i))[:7]]
    for block in (10**6, 40):  # one block of each kind, and many
        got = [(r["qid"], r["doc_id"]) for r in dense.exact_topk(df, qs, 7, block=block).orderBy("qid", "rank").collect()]
        assert got == want
    every = dense.probed_topk(df, qs, 7, cells=(dense.fitted_cells(df, 7)[0], dense.CENTRES), block=20).orderBy("qid", "rank").collect()
    assert [(r["qid"], r["doc_id"]) for r in every] == want
    assert dense.probed_topk(df.limit(0), qs, 7).count() == dense.exact_topk(df, qs.limit(0), 7).count() == 0


def test_probed_cells_find_most(spark):
    rng = np.random.default_rng(6)
    middles = rng.normal(size=(20, 16))
    vectors = middles[rng.integers(0, 20, 3000)] + 0.4 * rng.normal(size=(3000, 16))
    vectors[:1000] = middles[0] + 0.3 * rng.normal(size=(1000, 16))  # a third of all rows in one place
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "doc_id long, embedding array<double>").repartition(3)
    asked = df.filter("doc_id % 20 = 0").withColumnRenamed("doc_id", "qid")
    exact = {(r["qid"], r["doc_id"]) for r in dense.exact_topk(df, asked, 10).collect()}
    found = {(r["qid"], r["doc_id"]) for r in dense.probed_topk(df, asked, 10, block=200).collect()}
    assert len(exact) == 1500 and len(exact & found) >= 0.9 * len(exact)


def ranking(spark, *lists):
    return [spark.createDataFrame([(1, d, r) for r, d in enumerate(items)], "qid long, doc_id string, rank int") for items in lists]


def test_rrf(spark):
    fused = retrieval.rrf_fuse(ranking(spark, ["a", "b"], ["b", "c"])).orderBy("rank").collect()
    assert fused[0]["doc_id"] == "b"
    both = retrieval.rrf_fuse(ranking(spark, ["x", "y"], ["x", "z"])).orderBy("rank").collect()
    assert (both[0]["doc_id"], both[0]["score"]) == ("x", round(2 / 60, 9))
    assert [r["doc_id"] for r in both] == ["x", "y", "z"]
    score = spark.range(1).select(retrieval.confidence(F.lit(2 / 60)), retrieval.confidence(F.lit(1 / 60))).first()
    assert tuple(round(s, 9) for s in score) == (1.0, 0.5)


def test_rerank_orders_by_the_pair_score(spark):
    pool = spark.createDataFrame([(1, d, r, 0.5) for r, d in enumerate("abc")], "qid long, doc_id string, rank int, score double")
    docs = spark.createDataFrame([("a", "0.1"), ("b", "0.9"), ("c", "0.5")], "doc_id string, text string")
    asked = spark.createDataFrame([(1, "q")], "qid long, question string")
    scorer = retrieval.pair_scorer(lambda pairs: [float(t) for _, t in pairs])
    got = retrieval.rerank(pool, asked, docs, scorer).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == ["b", "c", "a"] and {r["score"] for r in got} == {0.5}


def test_encode_uses_the_prefix_and_unit_length(spark):
    rows = spark.createDataFrame([(1, "abc")], "id long, text string")
    model = lambda texts: np.array([[3.0 * len(t), 4.0 * len(t)] for t in texts])
    got = retrieval.encode(rows, F.col("text"), model, "query: ", ["id"]).first()["embedding"]
    assert [round(x, 6) for x in got] == [0.6, 0.8]


def test_evaluation(spark):
    golden = spark.createDataFrame([(1, "el", "a"), (2, "en", "b"), (3, "en", "z")], "qid long, lang string, expected_id string")
    hits = spark.createDataFrame([(1, "x", 0), (1, "a", 1), (2, "b", 0)], "qid long, doc_id string, rank int")
    got = {r["lang"]: r.asDict() for r in retrieval.evaluate(golden, hits).collect()}
    assert got["OVERALL"]["mrr"] == 0.5 and got["el"]["mrr"] == 0.5 and got["en"]["recall_at_1"] == 0.5
    assert got["OVERALL"]["recall_at_3"] == round(2 / 3, 6)


def test_refresh_embeds_only_changes(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "doc_id long, text string")
    current = spark.createDataFrame([(1, "a"), (2, "old"), (9, "gone")], "doc_id long, text string").select(
        "doc_id", retrieval.signature(F.col("text")).alias("sig"), F.array(F.lit(0.0)).alias("embedding"))
    embed = lambda rows: rows.withColumn("embedding", F.array(F.lit(1.0)))
    snapshot, done = retrieval.refresh_vectors(current, docs, embed)
    assert sorted(r["doc_id"] for r in done.collect()) == [2, 3]
    assert sorted((r["doc_id"], r["embedding"][0]) for r in snapshot.collect()) == [(1, 0.0), (2, 1.0), (3, 1.0)]


def test_accents_do_not_matter(spark):
    docs = spark.createDataFrame([("fires", "Πυρκαγιές στα δάση"), ("traffic", "Κυκλοφορία οχημάτων")], "doc_id string, text string")
    asked = spark.createDataFrame([(1, "πυρκαγιες"), (2, "ΟΧΗΜΆΤΩΝ")], "qid long, question string")
    got = {r["qid"]: r["doc_id"] for r in retrieval.bm25_topk(retrieval.build_index(docs), asked, 5).collect()}
    assert got == {1: "fires", 2: "traffic"}
    assert docs.select(search_tokens(F.lit("a_b"))).first()[0] == ["a", "b"]


def test_a_group_of_vectors_is_scored_in_slices():
    rng = np.random.default_rng(8)
    def group(name, n):
        return pa.table({name: np.arange(n), "v": pa.FixedSizeListArray.from_arrays(rng.normal(size=n * 8), 8).cast(pa.list_(pa.float64()))})
    passages, questions = group("doc_id", 2048), group("qid", 2048)
    tracemalloc.start()
    got = dense._best(3)(passages, questions)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.num_rows == 3 * 2048 and peak < 2048 * 2048 * 8  # less than all scores once
    assert [r["doc_id"] for r in got.to_pylist()[3 * 700:3 * 701]] == [r["doc_id"] for r in dense._best(3)(passages, questions.slice(700, 1)).to_pylist()]


def test_the_index_shuffles_no_postings(corpus):
    _, _, df, asked = corpus
    index = retrieval.build_index(df)
    assert "Exchange" not in index.postings._jdf.queryExecution().executedPlan().toString()
    for group_docs in (7, 10**6):  # many groups of documents, and one
        split = dataclasses.replace(index, group_docs=group_docs)
        assert retrieval.bm25_topk(split, asked, 10).orderBy("qid", "rank").collect() == retrieval.bm25_topk(index, asked, 10).orderBy("qid", "rank").collect()


def test_words_are_counted_in_parts_of_bounded_size():
    words = [["a", "b", "a"], [], ["b"], ["c"] * 5, ["a"]]
    batch = pa.record_batch([pa.array(range(5)), pa.array(words, pa.list_(pa.string()))], ["doc_id", "tokens"])
    want = [(i, w, n, len(words[i])) for i in range(5) for w, n in sorted(Counter(words[i]).items())]
    for tokens in (1, 4, 1 << 19):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(retrieval, "TOKENS", tokens)
            got = [tuple(r.values()) for b in retrieval._counted("doc_id")([batch]) for r in b.to_pylist()]
        assert sorted(got) == want
