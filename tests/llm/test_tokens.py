"""Token ids, packing and separator scans against the tokenizers library."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from plumbline.llm import best_fit, byte_bpe, merge_automaton, separator_scan
from tests.llm.texts import awkward, frame

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def odd_texts():
    rng = random.Random(1)
    fixed = ["a<|endoftext|>b <|startoftext|> c", " lead", "tail ", "a   b", "a \n b", "a\n\nb", "x\ty", "it's we'll 'S", "x y　z", "é1½² x", "", "\n",
             "a\x1cb  c", "don't  stop\n\n\n 12 34", "🙂🙂 áb É é", "ΣΑΣ İstanbul Straße ŁÓDŹ ŉ ſ", "a" * 300, "aaab" * 50, "漢字かな ﬁ"]
    menus = ["ab 1'\n\t .é½sTHΣ", "aehinrst", "ab!", "the of. ,ing\n"]
    return fixed + ["".join(rng.choice(menu) for _ in range(rng.randint(1, 40))) for menu in menus for _ in range(300)]


def test_byte_ids():
    library, plain = Tokenizer.from_file(BYTES), Tokenizer.from_file(BYTES)
    plain.encode_special_tokens = True
    for text in odd_texts():
        for specials, own in ((True, library), (False, plain)):
            got = np.frombuffer(byte_bpe.encoder(BYTES, specials).packed_ids(text), "<u4").tolist()
            assert got == own.encode(text, add_special_tokens=False).ids, text


def test_word_ids_and_decoding():
    library, own = Tokenizer.from_file(WORDS), merge_automaton.encoder(WORDS)
    for text in odd_texts():
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids, text
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_automaton_of_a_small_vocabulary_accepts_what_merging_gives():
    merges = [("a", "a"), ("a", "b"), ("aa", "ab"), ("b", "a</w>"), ("aa", "aa"), ("b", "b"), ("bb", "a</w>"), ("a", "a</w>")]
    labels = ["a", "b", "a</w>", "b</w>", *dict.fromkeys(x + y for x, y in merges)]
    own = merge_automaton.Automaton({label: k for k, label in enumerate(labels)}, merges, "</w>")
    ranks = {m: k for k, m in enumerate(merges)}
    rng = random.Random(2)
    for _ in range(3000):
        word = "".join(rng.choice("aab") for _ in range(rng.randint(1, 14)))
        parts = [*word[:-1], word[-1] + "</w>"]
        while (best := min((ranks.get(p, 99), k) for k, p in enumerate(zip(parts, parts[1:])))if len(parts) > 1 else (99, 0))[0] < 99:
            parts[best[1]:best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        assert [own.labels[i] for i in own.encode_word(word)] == parts, word


def test_round_trips(spark):
    library = Tokenizer.from_file(WORDS)
    rows = awkward()
    got = sorted(merge_automaton.round_trips(frame(spark, rows), WORDS).collect(), key=str)
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        shown = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(shown.encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    docs = frame(spark, rows[:12])
    out = docs.select("text", merge_automaton.encode(WORDS)("text").alias("ids")).select("text", "ids", merge_automaton.decode(WORDS)("ids").alias("back")).collect()
    assert all(r["ids"] == library.encode(r["text"] or "", add_special_tokens=False).ids and r["back"] == library.decode(r["ids"], skip_special_tokens=False) for r in out)
    assert merge_automaton.round_trips(docs.limit(0), WORDS).count() == 0


def test_plan_is_best_fit():
    rng = random.Random(4)
    for capacity in (7, 50, 2048):
        for _ in range(20):
            counts = {rng.randint(1, capacity): rng.randint(1, 40) for _ in range(rng.randint(1, 30))}
            rooms = []
            for length in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
                fitting = [r for r in rooms if r >= length]
                if fitting:
                    rooms.remove(min(fitting))
                rooms.append((min(fitting) if fitting else capacity) - length)
            runs = best_fit.plan(counts, capacity)
            used = defaultdict(list)
            for r in runs.sort_values(["length", "rank"]).itertuples():
                after = runs[(runs.length == r.length) & (runs["rank"] > r.rank)]["rank"].min()
                for k in range(r.rank, int(after) if after == after else counts[r.length]):
                    used[r.sequence + (k - r.rank) // r.each].append((r.offset + (k - r.rank) % r.each * r.length, r.length))
            assert len(used) == len(rooms)
            for slots in used.values():
                slots.sort()
                assert slots[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(slots, slots[1:])) and sum(slots[-1]) <= capacity


def test_packing(spark):
    library, rows = Tokenizer.from_file(BYTES), awkward()
    packed = best_fit.pack(frame(spark, rows), BYTES, with_ids=True)
    got, want = packed.collect(), []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        first = len(ids) % 2048 or 2048
        cuts = [(0, len(ids))] if len(ids) <= 2048 else [(0, first), *((s, s + 2048) for s in range(first, len(ids), 2048))]
        want += [(i, k, s, e - s, zlib.crc32(np.array(ids[s:e], "<u4").tobytes())) for k, (s, e) in enumerate(cuts)]
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    slots = defaultdict(list)
    for r in got:
        slots[r["sequence_id"]].append((r["offset"], r["length"], r["ids"]))
    for own in slots.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n, _), (b, _, _) in zip(own, own[1:])) and own[-1][0] + own[-1][1] <= 2048
    whole = {r["sequence_id"]: bytes(r["ids"]) for r in best_fit.sequences(packed).collect()}
    assert {k: len(v) // 4 for k, v in whole.items()} == {k: sum(n for _, n, _ in own) for k, own in slots.items()}
    assert best_fit.pack(frame(spark, rows).limit(0), BYTES).count() == 0


@pytest.mark.parametrize("block", [1 << 18, 5, 64])
def test_separator_scan(spark, monkeypatch, block):
    monkeypatch.setattr(separator_scan, "GROUP", 3)
    library = Tokenizer.from_file(BYTES)
    library.encode_special_tokens = True
    rows = [r for r in awkward() if len(r[1] or "") < 5000]
    blocks = separator_scan.write_token_files(frame(spark, rows).repartition(2), BYTES, block=block)
    got = separator_scan.token_counts(blocks, names="ids").collect()
    want = sorted(((i, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows), key=str)
    assert sorted(((r["id"], r["n_tokens"]) for r in got), key=str) == want and all(r["closed"] for r in got)
    after = {}
    for r in sorted(got, key=lambda r: (r["file"], r["ordinal"])):
        assert (r["ordinal"], r["start"]) == after.get(r["file"], (0, 0))
        after[r["file"]] = (r["ordinal"] + 1, r["start"] + r["n_tokens"] + 1)


def test_plain_files(spark, tmp_path):
    files = {"a": [5, 9, 9, 1, 2, 3, 9, 4, 4], "b": [9], "c": [7, 7], "d": [], "e": [1, 2, 9]}
    for name, ids in files.items():
        (tmp_path / name).write_bytes(np.array(ids, "<u4").tobytes())
    got = separator_scan.token_counts(separator_scan.read_token_files(spark, str(tmp_path), width=4, block=2), separator=9, width=4).collect()
    told = sorted((r["file"][-1], r["ordinal"], r["start"], r["n_tokens"], r["closed"]) for r in got)
    assert told == [("a", 0, 0, 1, True), ("a", 1, 2, 0, True), ("a", 2, 3, 3, True), ("a", 3, 7, 2, False), ("b", 0, 0, 0, True), ("c", 0, 0, 2, False), ("e", 0, 0, 2, True)]
    assert separator_scan.count_documents(frame(spark, awkward()).limit(0), BYTES).count() == 0
