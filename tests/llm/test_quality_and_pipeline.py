"""The classifier's held-out accuracy and what it must not look at; the pipeline against a brute-force version."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from plumbline.llm import preference_quality, secret_lexer
from plumbline.session import materialise
from tests.llm.test_near_copies import Forest, fingerprint
from tests.llm.test_rules_and_copies import ascii_lower, depleted, frequent, statistics
from tests.llm.texts import awkward, frame, split, words


def labelled(n=240):
    rng = random.Random(8)
    docs, labels = [], []
    for k in range(n):
        good = k % 3 != 0
        ws = words(rng, rng.randint(60, 200))
        docs.append((k, " ".join(ws if good else [w.upper() + rng.choice("!#$%") * 2 for w in ws]), f"s{k % 5}"))
        labels.append((k, int(good), 0))
    return docs, labels


def test_held_out_accuracy_on_driver_tables(spark, data_dir):
    folder = data_dir.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = preference_quality.classify(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    right = sum(r["predicted"] == r["quality"] for r in got)
    assert len(got) > 50 and right >= 0.95 * len(got)


def test_scores(spark):
    docs, labels = labelled()
    told = spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0), (6, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")
    rows = docs + awkward()
    got = preference_quality.classify(frame(spark, rows), told).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _, _ in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    text = {i: t for i, t, _ in rows[:len(docs)]}
    held = [r for r in got if r["held_out"] and r["doc_id"] in text and r["doc_id"] > 20]
    assert sum(r["predicted"] == int(r["doc_id"] % 3 != 0) for r in held) >= 0.95 * len(held)


def test_a_score_depends_on_the_text_alone(spark):
    docs, labels = labelled(90)
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    strength = preference_quality.learn(frame(spark, docs), told)
    score = preference_quality.scored(strength)
    one = {r["text"]: r["s"] for r in frame(spark, docs).withColumn("s", score("text")).collect()}
    other = {r["text"]: r["s"] for r in frame(spark, [(900 - i, t, "x") for i, t, _ in docs]).withColumn("s", score("text")).collect()}
    assert one == other


def test_nothing_to_learn_from(spark):
    docs = frame(spark, awkward())
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in preference_quality.classify(docs, none).collect()} == {0.5}
    assert preference_quality.classify(docs.limit(0), none).count() == 0


def brute(rows):
    """Ids with their final texts."""
    gone, often = depleted(rows, 0.1, 3, 0.3), frequent(rows, 0.1, 3)
    rows = [(i, t, s) for i, t, s in rows if (st := statistics(t))[0] >= 50 and 100 * st[-1] <= 50 * st[0] and (s or "", t or "") not in gone]
    rows = [(i, "\n".join(x for x in t.split("\n") if (s or "", " ".join(split(x.lower()))) not in often), s) for i, t, s in rows]
    largest = {}
    for i, t, _ in rows:
        largest[ascii_lower(t)] = max(largest.get(ascii_lower(t), i), i, key=lambda x: (x is not None, x or 0))
    rows = list({ascii_lower(t): (i, t) for i, t, _ in rows if largest[ascii_lower(t)] == i}.values())
    prints, forest = {(i, t): fingerprint(t) for i, t in rows}, Forest()
    values = list(dict.fromkeys(prints.values()))
    for k, a in enumerate(values):
        for b in values[k:]:
            if (a ^ b).bit_count() <= 4:
                forest.join(a, b)
    least = {}
    for (i, _), v in prints.items():
        if i is not None:
            least[forest.top(v)] = min(least.get(forest.top(v), i), i)
    return {i: secret_lexer.masked(t) for (i, t), v in prints.items() if least.get(forest.top(v)) == i}


def test_pipeline_matches_brute_force(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()] + [(1000 + (i or 0), t, s) for i, t, s in awkward()]
    docs = frame(spark, rows)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, data_dir), "stage")
        assert docs.columns == columns, name
    want = brute(rows)
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == want and docs.count() == len(want)
    got, library = defaultdict(list), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, data_dir).collect():
        got[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"]))
    for i, text in want.items():
        ids = library.encode(text, add_special_tokens=False).ids + [0]
        assert sum(n for _, n, _ in got[i]) == len(ids)
        assert all(zlib.crc32(np.array(ids[s:s + n], "<u4").tobytes()) == c for s, n, c in got[i])


def test_pipeline_of_nothing(spark):
    docs = frame(spark, awkward()).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, ""), "stage")
    assert docs.count() == 0
