"""Quality rules and exact dedup against plain Python."""

import hashlib
from collections import Counter, defaultdict

import pytest

from plumbline.llm import content_sort, line_frequency
from tests.llm.texts import awkward, frame, split, words


def ascii_lower(text):
    return "".join(c.lower() if c < "\x80" else c for c in text or "")


def statistics(text):
    text, ws = text or "", split(text)
    grams = Counter(zip(ws, ws[1:], ws[2:]))
    covered = {i + k for i, g in enumerate(zip(ws, ws[1:], ws[2:])) if grams[g] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if split(line)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def _held(rows):
    texts = {(s or "", t or "") for _, t, s in rows}
    lines = {key: {" ".join(split(line.lower())) for line in key[1].split("\n") if split(line)} for key in texts}
    hosts = Counter(host for host, text in texts if lines[host, text])
    return lines, hosts, Counter((key[0], line) for key, own in lines.items() for line in own)


def frequent(rows, max_share, min_docs, max_docs=10_000):
    """(host, line) pairs above the limits."""
    _, hosts, held = _held(rows)
    return {(h, line) for (h, line), n in held.items() if n >= min_docs and (n > max_share * hosts[h] or n > max_docs)}


def depleted(rows, max_share, min_docs, least_left, max_docs=10_000):
    """(host, text) pairs that lose too many lines."""
    out, gone = set(), frequent(rows, max_share, min_docs, max_docs)
    for key, own in _held(rows)[0].items():
        size = {line: len(line.split(" ")) for line in own}
        left = sum(n for line, n in size.items() if (key[0], line) not in gone)
        if own and left < least_left * sum(size.values()):
            out.add(key)
    return out


def judged(rows, **limits):
    gone = depleted(rows, **limits)
    out = []
    for i, t, s in rows:
        n, *rest = statistics(t)
        failed = n < 50 or 100 * rest[-1] > 50 * n
        out.append((i, n, *rest, failed, not failed and (s or "", t or "") not in gone))
    return Counter(out)


LIMITS = {"max_share": 0.1, "min_docs": 3, "least_left": 0.3}


def boilerplate(rng_rows=40):
    import random
    rng = random.Random(3)
    menu = [" ".join(words(rng, 40)) for _ in range(3)]
    rows = [(100 + k, "\n".join([*menu, " ".join(words(rng, 8 if k % 2 else 300))]), "shop") for k in range(rng_rows)]
    return rows + [(200, "\n".join(menu), "else")] + rows[:2]


def test_rules_match_plain_python(spark):
    for rows in (awkward(), boilerplate(), awkward() + boilerplate()):
        got = line_frequency.quality_rules(frame(spark, rows), **LIMITS).collect()
        assert Counter(map(tuple, got)) == judged(rows, **LIMITS)


def test_depleted_documents_go_and_copies_do_not_count(spark):
    rows = boilerplate()
    kept = {r["doc_id"] for r in line_frequency.without_rejected(frame(spark, rows), **LIMITS).collect()}
    assert kept == {i for i, t, s in rows if len(split(t)) > 200 or s == "else"}
    copies = [(k, rows[0][1], "shop") for k in range(50)]
    assert line_frequency.without_rejected(frame(spark, copies), **LIMITS).count() == 50


def test_frequent_lines_are_cut_from_what_stays(spark):
    rows = [(i, t + "\n\n end", s) for i, t, s in boilerplate()]
    menu = {x.lower() for x in rows[0][1].split("\n")[:3]}
    rows[1] = (rows[1][0], rows[1][1][:9].upper().replace(" ", "\t ") + rows[1][1][9:], "shop")
    docs = frame(spark, rows)
    out = line_frequency.without_frequent_lines(docs, **LIMITS)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r for r in out.collect()}
    assert set(got) == {r["doc_id"] for r in line_frequency.without_rejected(docs, **LIMITS).collect()} and len(got) > 10
    for i, t, s in rows:
        if i in got:
            lines = t.split("\n")
            want = "\n".join(lines if s == "else" else [x for x in lines if " ".join(split(x.lower())) not in menu | {"end"}])
            assert (got[i]["text"], got[i]["n_chars"]) == (want, len(want))


def test_pipeline_cuts_frequent_lines(spark):
    import random

    import corpus_pipeline
    menu = " ".join(words(random.Random(1), 60))
    rows = [(k, menu + "\n" + " ".join(words(random.Random(10 + k), 90)), "shop") for k in range(120)]
    out = corpus_pipeline.STAGES[0][1](spark, frame(spark, rows), "").collect()
    assert {(r["doc_id"], r["text"]) for r in out} == {(i, t.split("\n")[1]) for i, t, _ in rows}


def test_limits_bite_in_small_and_in_hot_hosts(spark):
    import random
    text = lambda k, *more: "\n".join([*more, " ".join(words(random.Random(k), 60))])
    small = [(k, text(k, *["shared by three"] * (k < 3), *["shared by two"] * (k < 2)), "small") for k in range(20)]
    hot = [(100 + k, text(100 + k, *["in some"] * (k < 41), *["in few"] * (k < 12)), "hot") for k in range(400)]
    for most, cut in ((10_000, {"shared by three", "in some"}), (11, {"shared by three", "in some", "in few"})):
        got = line_frequency.without_frequent_lines(frame(spark, small + hot), max_docs=most).collect()
        assert len(got) == 420
        assert {line for r in got for line in r["text"].split("\n") if len(line) < 20} == {"shared by three", "shared by two", "in some", "in few"} - cut


def content(rows):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[ascii_lower(t)].append(i)
    largest = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return Counter((i, largest[ascii_lower(t)], len(groups[ascii_lower(t)]), hashlib.sha256(ascii_lower(t).encode()).hexdigest()) for i, t, _ in rows)


@pytest.mark.parametrize("pieces", [1000, 20])
def test_content_groups(spark, pieces):
    rows = awkward() + [(1000 + k, "copy Copy COPY " * 9, "a") for k in range(300)] + [(2000 + k, f"head {'x' * 60}{k:04d}{'y' * 60}", "a") for k in range(300)]
    got = content_sort.content_groups(frame(spark, rows), pieces=pieces).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == content(rows)
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len({ascii_lower(t) for _, t, _ in rows})
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_without_copies_keeps_rows_whole(spark):
    docs = frame(spark, awkward())
    out = content_sort.without_copies(docs)
    assert out.columns == docs.columns
    assert Counter(ascii_lower(r["text"]) for r in out.collect()) == Counter({ascii_lower(t) for _, t, _ in awkward()})


def test_empty_tables(spark):
    none = frame(spark, awkward()).limit(0)
    assert line_frequency.quality_rules(none).count() == content_sort.content_groups(none).count() == 0
    assert line_frequency.without_rejected(none).columns == content_sort.without_copies(none).columns == none.columns
