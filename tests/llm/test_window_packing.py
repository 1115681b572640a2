"""Packing into windows: ids against the tokenizers library, cuts against plain dynamic programming."""

import random
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import queries, window_packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@lru_cache
def library():
    words = Tokenizer.from_file(PATH)
    words.no_truncation()
    words.no_padding()
    return words


def library_ids(text):
    return library().encode(text or "", add_special_tokens=False).ids


def check(pieces, texts, capacity):
    """``pieces`` cover every id of ``texts`` (id -> text) once; gives tokens and padding."""
    docs, windows = defaultdict(list), defaultdict(list)
    for p in pieces:
        docs[p["doc_id"]].append(p)
        windows[p["sequence_id"]].append((p["offset"], p["length"]))
    assert set(docs) == set(texts)
    for key, parts in docs.items():
        ids, at = [*library_ids(texts[key]), 1], 0
        for p in sorted(parts, key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[at:at + p["length"]], dtype="<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    padding = 0
    for places in windows.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert 0 < at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return sum(p["length"] for p in pieces), padding


def test_query_over_all_documents(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    tokens, padding = check(queries.op12_window_packing(spark, data_dir).collect(), {r["doc_id"]: r["text"] for r in docs.collect()}, 2048)
    assert padding < 0.02 * tokens


@pytest.mark.parametrize("capacity", [64, 100])
def test_odd_texts_over_several_segments(spark, capacity):
    dice = random.Random(3)
    texts = [None, "", " ", "\n\n", "<|endoftext|> a <|ENDOFTEXT|> b", "Déjà VU, İstanbul?! 3.14 é  x\ty", "don't I'LL we've", "word " * 5000,
             "x" * 3000, "One. Two! Three? " * 40] + [" ".join(dice.choice(["alpha", "Beta.", "gamma,", "δ", "e."]) for _ in range(dice.randrange(60))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("id", F.lit("other")).withColumn("start", F.lit(0)).coalesce(1)
    packed = window_packing.pack(df, PATH, capacity=capacity, segment=500, with_ids=True).collect()
    tokens, padding = check(packed, dict(enumerate(texts)), capacity)
    assert padding < 0.1 * tokens
    order = [p["doc_id"] for p in sorted(packed, key=lambda p: (p["sequence_id"], p["offset"]))]
    assert order == sorted(order)
    assert all(len(p["ids"]) == 4 * p["length"] for p in packed)


def test_null_ids_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a b."), (None, "a b."), (1, None)], "doc_id long, text string")
    packed = window_packing.pack(df, PATH).collect()
    assert sum(p["length"] for p in packed) == 2 * (len(library_ids("a b.")) + 1) + 1
    assert window_packing.pack(df.limit(0), PATH).collect() == []


def test_cuts_are_the_cheapest():
    dice = random.Random(5)
    for _ in range(60):
        capacity = dice.choice([16, 20])
        total = dice.randrange(20, 150)
        documents = np.array(sorted({*dice.sample(range(1, total), 5), total}))
        sentences = np.array(sorted(dice.sample(range(1, total), 8)))
        places, costs = window_packing.possible_cuts(documents, sentences, longest=6)
        assert np.diff(places).max() <= 6 and places[-1] == total

        def price(begin, end):
            size = places[end] - places[begin]
            return costs[end] + window_packing.WINDOW + (0 if size & (size - 1) == 0 else capacity - size)

        least = [0.0]
        for j in range(1, len(places)):
            least.append(min(least[i] + price(i, j) for i in range(j) if places[j] - places[i] <= capacity))
        chosen = [0, *np.searchsorted(places, window_packing.windows(places, costs, capacity))]
        assert sum(price(a, b) for a, b in zip(chosen, chosen[1:])) == pytest.approx(least[-1])
        assert chosen[-1] == len(places) - 1 and all(places[b] - places[a] <= capacity for a, b in zip(chosen, chosen[1:]))
