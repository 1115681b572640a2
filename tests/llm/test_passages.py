"""Passages inside other lines, found by pieces, against comparing words."""

import random

import numpy as np

from plumbline.llm import paragraph_minhash as minhash
from tests.llm.texts import awkward, frame, split, words


def test_pieces_are_cut_at_least_hashes():
    rng = random.Random(3)
    for n in (1, 2, 5, 40, 700):
        hashed = minhash.word_hashes([w.encode() for w in words(rng, n)])
        pairs = [*(minhash._runs(hashed, 2).tolist() if n > 1 else []), 2 ** 64 - 1]
        want = [0] + [k for k in range(1, n) if all(pairs[k] < x for x in pairs[max(0, k - minhash.REACH):k])
                      and all(pairs[k] <= x for x in pairs[k + 1:k + 1 + minhash.REACH]) and pairs[k] < 2 ** 64 - 1]
        at, keys = minhash.pieces(hashed)
        assert at.tolist() == want and len(keys) == len(want)
    same = minhash.word_hashes([b"a"] * 5000)
    assert len(minhash.pieces(same)[0]) <= 2
    one, two = (minhash.word_hashes(t.encode().split()) for t in ("a b", "b a"))
    assert minhash.pieces(one)[1][0] != minhash.pieces(two)[1][0]


def test_bands_of_a_range_do_not_depend_on_its_place(monkeypatch):
    shingles = np.random.default_rng(2).integers(0, 1 << 62, 300, dtype=np.uint64)
    whole = minhash.bands(shingles, np.array([10, 100]), np.array([100, 300]))
    alone = minhash.bands(shingles[100:], np.array([0]), np.array([200]))
    assert (whole[1] == alone[0]).all()
    monkeypatch.setattr(minhash, "_WORK", 1)
    assert (minhash.bands(shingles, np.array([10, 100]), np.array([100, 300])) == whole).all()


def test_ranges_of_words_against_sets_of_words():
    rng = random.Random(8)
    for _ in range(400):
        cuts = sorted(rng.sample(range(1, 60), 12))
        repeated = [p for p in zip([0, *cuts], [*cuts, 60]) if rng.random() < 0.6]
        breaks = sorted(rng.sample(range(1, 60), 4))
        lines = [p for p in zip([0, *breaks], [*breaks, 60]) if rng.random() < 0.4]
        left = {k for a, b in repeated for k in range(a, b)} - {k for a, b in lines for k in range(a, b)}
        runs, last = [], None
        for k in sorted(left):
            if last == k - 1:
                runs[-1][1] = k + 1
            else:
                runs.append([k, k + 1])
            last = k
        got = minhash.passages([a for a, _ in repeated], [b for _, b in repeated], [a for a, _ in lines], [b for _, b in lines], 5)
        assert got == [(a, b) for a, b in runs if b - a >= 5]


def test_words_and_lines_are_cut_from_a_text():
    assert minhash.without("a b  c d\ne f\n\ng h", [1], [(1, 3)]) == "a d\n\ng h".replace("a d", "a  d")
    assert minhash.without("a b\nc d\ne", [], [(1, 4)]) == "a \ne"
    assert minhash.without("a b\nc", [0], []) == "c" and minhash.without("", [], []) == ""
    rng = random.Random(5)
    for _ in range(200):
        lines = [[str(rng.random()) for _ in range(rng.randint(0, 6))] for _ in range(6)]
        text = "\n".join(rng.choice([" ", "\t "]).join(line) for line in lines)
        flat = [w for line in lines for w in line]
        spans = [(a, min(a + 3, len(flat))) for a in range(rng.randint(0, 4), len(flat), 7)]
        cut = {k for a, b in spans for k in range(a, b)}
        assert split(minhash.without(text, [], spans)) == [w for k, w in enumerate(flat) if k not in cut]


def test_passages_that_repeat_inside_lines(spark):
    rng = random.Random(17)
    shared = [words(rng, rng.randint(51, 90)) for _ in range(60)]
    rows, held = [], {}
    for k in range(180):
        passage, before, after = shared[k % 60], words(rng, rng.randint(0, 80)), words(rng, rng.randint(0, 80))
        if k >= 120:  # the same passage over lines of 20 words
            passage = [w + ("\n" if n % 20 == 19 else "") for n, w in enumerate(passage)]
        rows.append((k, " ".join([*before, *passage, *after]), "a"))
        held[k] = (len(before), len(before) + len(passage))
    rows += [(1000 + k, "\n".join(" ".join(words(rng, 40)) for _ in range(3)), "b") for k in range(40)]
    rows += [(2000, "one two three four five six\n" * 3, "c"), (None, rows[0][1], "a"), (None, None, "a"), (2001, "", None)]
    got = {r["doc_id"]: r for r in minhash.by_document(frame(spark, rows), min_passage=20).collect() if r["doc_id"] is not None}
    late = [k for k in range(180) if k >= 60 or k == 0]
    found = [k for k in late if got[k]["n_removed"]]
    assert len(found) >= 0.97 * len(late)
    assert not any(got[i]["n_removed"] for i in got if i >= 1000 or 0 < i < 60)
    for k in found:
        for a, b in zip(got[k]["starts"], got[k]["ends"]):
            assert b - a >= 20 and (k == 0 or held[k][0] <= a and b <= held[k][1])
        assert k == 0 or set(got[k]["repeats_of"]) <= {k % 60, k % 60 + 60}
    left = {r["doc_id"]: split(r["text"]) for r in minhash.without_repeats(frame(spark, rows), min_passage=20).collect()}
    for k in found[1:]:
        text = split(rows[k][1])
        gone = {x for a, b in zip(got[k]["starts"], got[k]["ends"]) for x in range(a, b)}
        if not got[k]["lines"]:
            assert left[k] == [w for x, w in enumerate(text) if x not in gone]
    assert all(left[k] == split(rows[k][1]) for k in range(1, 60))


def test_awkward_texts_keep_their_columns(spark):
    docs = frame(spark, awkward())
    out = minhash.without_repeats(docs, min_passage=20)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert minhash.by_document(docs.limit(0), min_passage=20).count() == 0
