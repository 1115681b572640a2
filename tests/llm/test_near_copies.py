"""SimHash groups, near paragraphs and near lines against comparing everything with everything."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from plumbline.llm import line_edits, paragraph_minhash, simhash_blocks
from plumbline.llm.components import components
from tests.llm.texts import awkward, frame, split, words


class Forest(dict):
    def top(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        p, q = self.top(a), self.top(b)
        self[max(p, q)] = min(p, q)


def fingerprint(text):
    ws = split("".join(c.lower() if c < "\x80" else c for c in text or ""))
    hashes = [xxhash.xxh64_intdigest(" ".join(ws[i:i + 4]).encode(), 42) for i in range(max(1, len(ws) - 3))] if ws else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def varied(seed, n, size, changes):
    rng = random.Random(seed)
    base = words(rng, size)
    out = []
    for _ in range(n):
        own = base[:]
        for _ in range(rng.randint(0, changes)):
            own[rng.randrange(size)] = words(rng, 1)[0]
        out.append(" ".join(own))
    return out


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, k) for k in range(4000, 4100)]
    forest = Forest()
    for a, b in edges:
        if a != b:
            forest.join(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame([*edges, (None, 3), (7, None)], "a long, b long")).collect()}
    assert got == {x: forest.top(x) for x in list(forest)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("cell", [2048, 8])
def test_close_links_connect_like_all_pairs(spark, cell):
    rng = np.random.default_rng(5)
    values = set(rng.integers(0, 1 << 63, 60).tolist())
    for v in list(values)[:8]:
        near = v
        for _ in range(40):
            near ^= sum(1 << int(b) for b in rng.choice(63, rng.integers(1, 6), replace=False))
            values.add(near)
    values |= {0, 1, -1, -2, (1 << 62)}
    links = simhash_blocks.close_links(spark.createDataFrame([(v,) for v in values], "value long"), "value", cell=cell).collect()
    want, got = Forest(), Forest()
    for a in values:
        for b in values:
            if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 4:
                want.join(a, b)
    for r in links:
        assert bin((r["a"] ^ r["b"]) & (1 << 64) - 1).count("1") <= 4
        got.join(r["a"], r["b"])
    assert {v: want.top(v) for v in values} == {v: got.top(v) for v in values}


def test_near_duplicates(spark):
    rows = awkward() + [(300 + k, t, "a") for k, t in enumerate(varied(2, 40, 400, 3))]
    got = simhash_blocks.near_duplicates(frame(spark, rows)).collect()
    prints = Counter((i, f"{fingerprint(t):016x}") for i, t, _ in rows)
    assert Counter((r["doc_id"], r["fingerprint"]) for r in got) == prints
    values, forest = {int(p, 16) for _, p in prints}, Forest()
    for a in values:
        for b in values:
            if (a ^ b).bit_count() <= 4:
                forest.join(a, b)
    least = {}
    for i, p in prints:
        if i is not None:
            root = forest.top(int(p, 16))
            least[root] = min(least.get(root, i), i)
    assert all(r["component_id"] == least.get(forest.top(int(r["fingerprint"], 16))) for r in got)
    docs = frame(spark, rows)
    left = simhash_blocks.one_of_each_group(docs)
    assert left.columns == docs.columns
    roots = Counter(forest.top(fingerprint(r["text"])) for r in left.dropDuplicates(["doc_id", "text"]).collect())
    assert set(roots) == {forest.top(v) for v in values} and set(roots.values()) <= {1, 2}
    assert {r["doc_id"] for r in left.collect()} <= {*least.values(), None}


def test_groups_without_an_id_of_their_own_are_not_one_group(spark):
    rng = random.Random(21)
    far = [" ".join(words(rng, 200)) for _ in range(9)]
    assert all((fingerprint(a) ^ fingerprint(b)).bit_count() > 4 for k, a in enumerate(far) for b in far[:k])
    close = far[0] + "\n"
    rows = [(None, t, "a") for t in far[:6]] + [(7, far[6], "a"), (7, far[7], "b"), (None, far[8], "a"), (9, far[8], "a"), (None, close, "a")]
    left = Counter((r["doc_id"], split(r["text"])[0]) for r in simhash_blocks.one_of_each_group(frame(spark, rows)).collect())
    assert left == Counter([*((None, split(t)[0]) for t in far[:6]), (7, split(far[6])[0]), (7, split(far[7])[0]), (9, split(far[8])[0])])


def all_paragraphs(rows, least):
    return sorted({(i, n, " ".join(split(line.lower()))) for i, t, _ in rows for n, line in enumerate((t or "").split("\n")) if len(split(line)) >= least},
                  key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


def removed(found, forest):
    first, gone = {}, defaultdict(list)
    for i, n, t in found:
        if first.setdefault(forest.top(t), (i, n)) != (i, n):
            gone[i].append(n)
    return first, gone


def test_repeated_paragraphs(spark):
    family = varied(4, 60, 80, 2)
    rows = awkward() + [(400 + k, "start\n" + t + "\n" + " ".join(words(random.Random(k), 30)), "a") for k, t in enumerate(family)]
    found = all_paragraphs(rows, 25)
    sets = {t: {tuple(t.split(" ")[k:k + 5]) for k in range(len(t.split(" ")) - 4)} for _, _, t in found}
    forest = Forest()
    for a in sets:
        for b in sets:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                forest.join(a, b)
    first, gone = removed(found, forest)
    got = {r["doc_id"]: r for r in paragraph_minhash.by_document(frame(spark, rows)).collect()}
    assert set(got) == {i for i, _, _ in rows}
    assert {i: r["lines"] for i, r in got.items() if r["n_removed"]} == gone
    place = {(i, n): t for i, n, t in found}
    for i, lines in gone.items():
        assert set(got[i]["repeats_of"]) == {first[forest.top(place[i, n])][0] for n in lines} - {None}
    assert len(gone) > 10
    text = {r["doc_id"]: r["text"] for r in paragraph_minhash.without_repeats(frame(spark, rows)).collect()}
    assert text[1] is None and family[0] in text[400]
    assert all(text[i].split("\n") == [x for n, x in enumerate(t.split("\n")) if n not in gone.get(i, [])] for i, t, _ in rows if i and i >= 400)


@pytest.mark.parametrize("cut", [paragraph_minhash.without_repeats, line_edits.without_near_lines])
def test_texts_that_share_an_id_are_cut_each_for_itself(spark, cut):
    rng = random.Random(33)
    a, b, c, d, e, f, g, h, i, k, m, n, o = (" ".join(words(rng, 30)) for _ in range(13))
    texts = [[a, b], [c, d, e, a], [f, g, h, i], [k, m], [k, n], [o]]
    for ids in ([None] * 6, [5] * 6):
        left = [r["text"].split("\n") for r in cut(frame(spark, [(x, "\n".join(t), "a") for x, t in zip(ids, texts)])).collect()]
        assert Counter(x for t in left for x in t) == Counter({x for t in texts for x in t})
        assert [f, g, h, i] in left and [o] in left


def test_small_cells_lose_no_paragraph(spark, monkeypatch):
    monkeypatch.setattr(paragraph_minhash, "CELL", 4)
    rows = [(k, t, "a") for k, t in enumerate(dict.fromkeys(varied(9, 50, 120, 1)))]
    got = paragraph_minhash.by_document(frame(spark, rows)).collect()
    assert sum(r["n_removed"] for r in got) == len(rows) - 1


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("edits", [1, 2])
def test_near_lines(spark, edits):
    rng = random.Random(11)
    lines = [" ".join(words(rng, 6)) for _ in range(6)] + ["tiny line", "tiny lime"]
    for line in lines[:6]:
        for _ in range(6):
            own = list(line)
            for _ in range(rng.randint(1, 3)):
                at = rng.randrange(len(own))
                own[at:at + 1] = rng.choice(["", own[at] + "q", "é"])
            lines.append("".join(own).strip())
    rows = [(k, "\n".join(rng.sample(lines, 3)), "a") for k in range(25)] + [(1, None, "a"), (99, "", "a"), (98, lines[0] + "\n" + lines[0], "a")]
    rows = list({i: (i, t, s) for i, t, s in rows}.values())
    found = all_paragraphs(rows, 1)
    first = {}
    for i, n, t in found:
        first.setdefault(t, (i, n))
    links = {(a, b) for a in first for b in first if a < b and min(len(a), len(b)) >= 16 and abs(len(a) - len(b)) <= edits and edit_distance(a, b) <= edits}
    late = {a if first[a] > first[b] else b for a, b in links}
    n_links = Counter(t for link in links for t in link)
    want = defaultdict(lambda: [0, 0, []])
    for i, n, t in found:
        want[i][0] += 1
        want[i][1] += n_links[t]
        want[i][2] += [n] if t in late or first[t] != (i, n) else []
    got = line_edits.by_document(frame(spark, rows), edits=edits).collect()
    assert {r["doc_id"]: [r["n_lines"], r["n_links"], r["lines"]] for r in got} == {i: want[i] for i, _, _ in rows}
    assert links and late


def test_awkward_lines_and_empty_tables(spark):
    docs = frame(spark, awkward())
    got = {r["doc_id"]: r for r in line_edits.by_document(docs).collect()}
    assert set(got) == {i for i, _, _ in awkward()} and got[2]["n_lines"] == got[1]["n_lines"] == 0
    out = line_edits.without_near_lines(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    none = docs.limit(0)
    assert simhash_blocks.near_duplicates(none).count() == simhash_blocks.one_of_each_group(none).count() == 0
    assert paragraph_minhash.by_document(none).count() == line_edits.by_document(none).count() == 0


def test_keys_of_lines_are_code_that_the_jvm_compiles(spark, tmp_path):
    """A method of over 8,000 bytes stays interpreted; the probes of a line were such a one."""
    spark.createDataFrame([(1, 0, "a line of some words", 20)], "key long, letters long, line string, chars int").write.parquet(str(tmp_path / "l"))
    keys = line_edits._keys(spark.read.parquet(str(tmp_path / "l")), line_edits._probe_places(2), 2, "b", "lb")
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", keys._jdf.queryExecution().explainString(mode))]
    assert sizes and max(sizes) < 8000
    assert keys.count() == 12


@pytest.mark.parametrize("edits, least", [(1, 16), (2, 5), (2, 16), (3, 24)])
def test_every_line_shares_a_piece_with_the_lines_near_it(spark, edits, least):
    rng = random.Random(edits * 100 + least)
    lines = []
    for chars in [*range(least, least + 40), 95, 96, 97, 400]:
        own = "".join(rng.choice("abé ος") for _ in range(chars)).strip().replace("  ", "x ")
        for _ in range(6):
            near = list(own)
            for _ in range(rng.randint(1, edits)):
                at = rng.choice([0, len(near) - 1, rng.randrange(len(near))])
                near[at:at + 1] = rng.choice([[], [near[at], "z"], ["z", near[at]], ["Σ"]])
            lines += [own, "".join(near)]
    docs = frame(spark, [(k, line, "a") for k, line in enumerate(lines)])
    pieces = {r["doc_id"]: set(r["pieces"]) for r in line_edits._read(docs, "doc_id", "text", edits, least).groupBy(F.col("id").alias("doc_id")).agg(
        F.flatten(F.collect_list("at")).alias("pieces")).collect()}
    normal = [" ".join(line.lower().split()) for line in lines]
    near = [(k, k + 1) for k in range(0, len(lines), 2) if min(len(normal[k]), len(normal[k + 1])) >= least and edit_distance(normal[k], normal[k + 1]) <= edits]
    assert len(near) > 150 and all(pieces[a] & pieces[b] for a, b in near)
    assert max(map(len, pieces.values())) <= 2 * (edits + 1 + sum(line_edits._slack(edits)))


def test_lines_near_no_other_are_shuffled_without_their_text(spark):
    rng = random.Random(5)
    rows = [(k, "\n".join(bytes(rng.choices(range(97, 123), k=300)).decode() for _ in range(20)), "a") for k in range(60)]
    rows[7] = (7, rows[5][1].replace("a", "", 1), "a")
    store = spark.sparkContext._jsc.sc().statusStore()

    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), None)
        return {(stages.apply(k).stageId(), stages.apply(k).attemptId()): stages.apply(k).shuffleWriteBytes() for k in range(stages.size())}

    docs, before = frame(spark, rows).localCheckpoint(), set(shuffled())
    got = {r["doc_id"]: r for r in line_edits.by_document(docs).collect()}
    assert got[7]["n_removed"] == 20 and got[7]["n_links"] == 1 and sum(r["n_removed"] for r in got.values()) == 20
    assert sum(n for k, n in shuffled().items() if k not in before) < 0.8 * sum(len(t) for _, t, _ in rows)


def test_copies_of_a_document_count_once_and_blank_ones_stay(spark):
    near = "a line of several plain words"
    docs = frame(spark, [(1, f"\n \n{near}\n{near}s", "a")] * 3 + [(2, " \n\t", "a"), (2, None, "a"), (None, near, "a"), (None, near, "a")])
    got = sorted((str(r["doc_id"]), r["n_lines"], r["n_links"], r["n_removed"], r["lines"]) for r in line_edits.by_document(docs).collect())
    assert got == [("1", 2, 2, 2, [2, 3]), ("2", 0, 0, 0, []), ("2", 0, 0, 0, []), ("None", 1, 1, 0, [])]
