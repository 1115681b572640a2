"""Substring dedup: paragraphs and passages that repeat across documents, nearly word for word.

Two kinds of paragraph are looked at, both in lower case.  The first is a line of at
least ``min_words`` words.  Its MinHash over shingles of ``shingle`` words is cut into
bands; with 10 bands of 3 a pair at the similarity asked for, 0.8, shares a band in
99.92 % of cases.  Lines that share a band are compared by the exact Jaccard
similarity of their shingles, and linked lines form components.  The first occurrence
of a component (smallest document, then line) stays, all others are removed.

The second kind, looked for if ``min_passage`` is given, finds passages whatever lies around them and however they are broken
into lines.  A text is cut where the hash of two neighbouring words is the least within
``REACH`` words on both sides, so that a passage is cut alike wherever it stands; a
piece (9 words on average) is one band of its own, as pieces so short are as good as
equal at that similarity.  A piece with an earlier occurrence is repeated, and
neighbouring repeated pieces make a passage, which is removed where ``min_passage`` or
more words of it lie outside removed lines.  Of a verbatim passage the pieces at its two
ends, which reach over its edge, stay: 9 words or so on either side.  Passages of under
``min_passage`` words between changed words are not removed.

Only different lines are compared, bands shared by the same lines count
once, and a band shared by very many is cut into cells by hash, each pair of cells
being compared in its own task.  A comparison passes on only links that join what is not joined yet.
Pieces met by more than a thousandth of all are joined by broadcast (there are under
a thousand of them), all others by key.

Edge cases: null and empty texts have no paragraphs.  Rows with one id
and one text are one document (null is an id, before all others; of one id's texts the
smallest hash comes first); an empty table gives an empty result.  A very long text is
read as a whole in one task, in memory of some hundred bytes a word; further columns,
whatever their names, are carried.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.columns import BLANKS, narrow
from plumbline.llm.components import components
from plumbline.session import materialise

BANDS, ROWS, CELL = 10, 3, 1024
REACH = 4
SLOTS = 1 << 21
_random = np.random.default_rng(42)
_FACTORS = _random.integers(1, 1 << 62, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _random.integers(0, 1 << 62, BANDS * ROWS, dtype=np.uint64)
_POWERS = _random.integers(1, 1 << 62, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(ROWS)], dtype=np.uint64)
_WORK = 1 << 20


def _stirred(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(32))


def word_hashes(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, found), dtype=np.uint64, count=len(found))


def _runs(hashed: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` neighbouring words."""
    n = len(hashed) - width + 1
    return _stirred(sum(hashed[k:k + n] * _POWERS[k] for k in range(width)))


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """Hashes of the different shingles of a text whose words are parted by single blanks; a shorter text is one shingle."""
    hashed = word_hashes(text.encode("utf-8", "surrogatepass").split(b" "))
    return np.unique(_runs(hashed, min(shingle, len(hashed))))


def bands(shingles: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bands of each range of ``shingles``, one row a range; ranges are not empty and follow each other."""
    borders = np.stack([starts, ends], axis=1).ravel()
    borders = borders[:-1] if borders[-1] == len(shingles) else borders
    step, least = max(1, _WORK // len(shingles)), []
    for at in range(0, BANDS * ROWS, step):
        hashed = shingles * _FACTORS[at:at + step, None] + _TERMS[at:at + step, None]
        hashed ^= hashed >> np.uint64(29)
        least.append(np.minimum.reduceat(hashed * _FACTORS[::-1][at:at + step, None], borders, axis=1)[:, ::2])
    least = np.concatenate(least).T.reshape(len(starts), BANDS, ROWS)
    return (least * _MIX).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)


def pieces(hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each piece of a text begins, and the hash of its words."""
    n = len(hashed)
    pairs = np.full(n + 2 * REACH, np.iinfo(np.uint64).max, dtype=np.uint64)
    pairs[REACH:REACH + n - 1] = _runs(hashed, 2) if n > 1 else 0
    own = pairs[REACH:REACH + n]
    least = np.ones(n, dtype=bool)
    for k in range(1, REACH + 1):
        least &= (own < pairs[REACH - k:REACH - k + n]) & (own <= pairs[REACH + k:REACH + k + n])
    least[:1] = True
    at = np.flatnonzero(least)
    sizes = np.diff(np.append(at, n))
    place = np.arange(n) - np.repeat(at, sizes)
    return at, _stirred(np.add.reduceat(hashed * _POWERS[place % len(_POWERS)], at) + sizes.astype(np.uint64))


_READ = ("line array<int>, para array<long>, line_from array<int>, line_to array<int>, bands array<array<long>>, "
         "piece array<long>, piece_from array<int>, piece_to array<int>")


def _read(min_words: int, shingle: int):
    """Lines with their bands, and pieces, of every text, which is in lower case."""
    def lists(parts: list, kind: type) -> pa.Array:
        flat = np.concatenate([np.zeros(0, dtype=kind), *[np.asarray(p, dtype=kind) for p in parts]])
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(p) for p in parts]), pa.int32()), pa.array(flat.view(np.int64) if kind is np.uint64 else flat))

    def one(text: str | None) -> tuple:
        numbers, keys, starts, ends, found = [], [], [], [], []
        for number, line in enumerate((text or "").encode("utf-8", "surrogatepass").split(b"\n")):
            own = line.split()
            if len(own) >= min_words:
                numbers.append(number)
                keys.append(xxhash.xxh64_intdigest(b" ".join(own), 42))
                starts.append(len(found))
                ends.append(len(found) + len(own))
            found += own
        if not found:
            return ([],) * 8
        hashed = word_hashes(found)
        marks = np.zeros((0, BANDS), dtype=np.uint64)
        if numbers:
            width = min(shingle, min_words)
            marks = bands(_runs(hashed, width), np.array(starts), np.array(ends) - width + 1)
        at, piece = pieces(hashed)
        return numbers, np.array(keys, dtype=np.uint64), starts, ends, marks, piece, at, np.append(at[1:], len(found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*[one(t) for t in batch.column("text").to_pylist()])) or [()] * 8
            marks = [m for m in columns[4] if len(m)]
            flat = np.concatenate(marks).ravel().view(np.int64) if marks else np.zeros(0, dtype=np.int64)
            each = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) // BANDS + 1) * BANDS, pa.int32()), pa.array(flat, pa.int64()))
            banded = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(m) for m in columns[4]]), pa.int32()), each)
            arrays = [banded if k == 4 else lists(list(columns[k]), np.uint64 if k in (1, 5) else np.int32) for k in range(8)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("doc"), *arrays],
                                             ["id", "doc", *(part.split()[0] for part in _READ.split(", "))])
    return run


def paragraphs(docs: DataFrame, id_col: str, text: str, min_words: int) -> DataFrame:
    """``id``, ``doc`` (a key of the text), ``line``, ``para`` (a key of the wording) and ``words`` of every line."""
    def wording(raw: Column, line: Column) -> Column:
        return F.struct(line.alias("line"), F.trim(F.regexp_replace(F.lower(raw), BLANKS, " ")).alias("words"))

    # no filter passes below a generator, where the wording would be computed once for each of its uses
    own = narrow(docs, id=id_col, text=text).select(
        "id", F.xxhash64("text").alias("doc"), F.explode_outer(F.transform(F.split("text", "\n"), wording)).alias("p")).select("id", "doc", "p.*")
    enough = F.length("words") - F.length(F.replace("words", F.lit(" "), F.lit(""))) + 1 >= min_words
    return own.filter((F.col("words") != "") & enough).select("id", "doc", "line", F.xxhash64("words").alias("para"), "words")


def _compare(rows: pd.DataFrame, shingle: int, similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``rows``, all of one pair of cells."""
    rows = rows.drop_duplicates("para")
    sets = [shingle_hashes(t, shingle) for t in rows["words"]]
    sizes, keys = np.array([len(s) for s in sets]), rows["para"].tolist()
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    parent = list(range(len(sets)))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    links = []
    for i, own in enumerate(sets):
        low, high = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
        common = np.bincount(np.concatenate([owner[a:b] for a, b in zip(low.tolist(), high.tolist())]), minlength=len(sets))[:i]
        for j in np.flatnonzero(common >= similarity * (sizes[i] + sizes[:i] - common) - 1e-9).tolist():
            p, q = top(i), top(j)
            if p != q:
                parent[max(p, q)] = min(p, q)
                links.append((keys[i], keys[j]))
    return links


def _verified(shingle: int, similarity: float):
    names = ["bucket", "one", "two"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch])
            if rows.empty:
                continue
            tail = (rows[names] == rows[names].iloc[-1]).all(axis=1)
            links = [link for _, group in rows[~tail].groupby(names, sort=False) if len(group) > 1 for link in _compare(group, shingle, similarity)]
            held = rows[tail]
            yield pd.DataFrame(links, columns=["a", "b"], dtype="int64")
        if held is not None and len(held) > 1:
            yield pd.DataFrame(_compare(held, shingle, similarity), columns=["a", "b"], dtype="int64")
    return run


def similar_paragraphs(found: DataFrame, keyed: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links ``a``, ``b`` between paragraphs; ``keyed`` has ``para`` and its ``bands``, ``found`` the wording."""
    banded = keyed.select("para", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = materialise(banded.join(shared, "bucket"), "members")
    contents = members.groupBy("bucket").agg(F.first("n").alias("n"), F.bit_xor(F.xxhash64("para")).alias("x"), F.bit_xor(F.xxhash64("para", F.lit(1))).alias("s"))
    once = contents.groupBy("n", "x", "s").agg(F.min("bucket").alias("bucket")).select("bucket")
    ways = F.ceil(F.col("n") / CELL).cast("int")
    cells = (
        members.join(once, "bucket")
        .withColumn("cell", F.pmod(F.xxhash64("para"), ways).cast("int"))
        .select("bucket", "para", "cell", F.explode(F.sequence(F.lit(0), ways - 1)).alias("other"))
        .select("bucket", "para", F.least("cell", "other").alias("one"), F.greatest("cell", "other").alias("two"))
    )
    wanted = materialise(members.select("para").distinct(), "wanted")
    # most paragraphs are not wanted: short hashes, of which there are SLOTS at most, turn them away where they lie
    slot = F.pmod(F.xxhash64("para"), F.lit(SLOTS)).cast("int").alias("slot")
    near = found.select("para", "words", slot).join(F.broadcast(wanted.select(slot).distinct()), "slot", "left_semi")
    wordings = near.join(wanted, "para", "left_semi").groupBy("para").agg(F.min("words").alias("words"))
    return (
        cells.join(wordings, "para").repartition("bucket", "one", "two").sortWithinPartitions("bucket", "one", "two", "para")
        .select("bucket", "one", "two", "para", "words").mapInPandas(_verified(shingle, similarity), "a long, b long")
    )


def read_texts(docs: DataFrame, id_col: str, text: str, min_words: int, shingle: int) -> DataFrame:
    """``id``, ``doc``, and the lines and pieces of every document, written once."""
    own = narrow(docs, id=id_col, text=text).select("id", F.xxhash64("text").alias("doc"), F.lower("text").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return materialise(own.mapInArrow(_read(min_words, shingle), f"id {kind}, doc long, {_READ}"), "read")


def _repeated_lines(found: DataFrame, read: DataFrame, shingle: int, similarity: float) -> DataFrame:
    lines = read.select("id", "doc", F.explode(F.arrays_zip("line", "para", "line_from", "line_to", "bands")).alias("p")).select("id", "doc", "p.*")
    links = similar_paragraphs(found, lines.groupBy("para").agg(F.first("bands").alias("bands")), shingle, similarity)
    roots = components(links).withColumnRenamed("node", "para")
    places = lines.select("id", "doc", "line", "para", "line_from", "line_to").distinct()
    classed = places.join(roots, "para", "left").withColumn("class", F.coalesce("root", "para")).drop("root", "para")
    return _later(classed, "class", "line")


def _later(places: DataFrame, key: str, at: str) -> DataFrame:
    """``places`` but the first of each ``key``, with ``first``: its ``id``, ``doc`` and ``at``.

    Keys with over a thousandth of all places, fewer than a thousand, are sent to the places; the others meet them by key.
    """
    firsts = materialise(
        places.groupBy(key).agg(F.min(F.struct("id", "doc", at)).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "firsts")
    hot_from = (firsts.agg(F.sum("n")).first()[0] or 0) / 1000
    hot = F.broadcast(firsts.filter(F.col("n") > hot_from).drop("n"))
    cold = firsts.filter(F.col("n") <= hot_from).drop("n")
    joined = places.join(hot, key).unionByName(places.join(hot.select(key), key, "left_anti").join(cold, key))
    stays = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("doc") == F.col("first.doc")) & (F.col(at) == F.col(f"first.{at}"))
    return joined.filter(~stays)


def repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", *, min_words: int = 25, shingle: int = 5,
            similarity: float = 0.8) -> DataFrame:
    """Every line that goes: ``id``, ``doc``, ``line``, and ``first_id``, ``first_line`` of the occurrence that stays."""
    gone = _repeated_lines(paragraphs(docs, id_col, text, min_words), read_texts(docs, id_col, text, min_words, shingle), shingle, similarity)
    return gone.select("id", "doc", "line", F.col("first.id").alias("first_id"), F.col("first.line").alias("first_line"))


def passages(pieces_from: list[int], pieces_to: list[int], lines_from: list[int], lines_to: list[int], least: int) -> list[tuple[int, int]]:
    """Ranges of words in neighbouring repeated pieces, without the removed lines, of ``least`` words or more."""
    marks = sorted([(a, 0, b) for a, b in zip(pieces_from, pieces_to)] + [(a, 1, b) for a, b in zip(lines_from, lines_to)])
    out: list[list[int]] = []
    gone = 0
    for a, line, b in marks:
        if line:
            if out and out[-1][1] > a:
                end, out[-1][1] = out[-1][1], a
                if end > b:
                    out.append([b, end])
            gone = max(gone, b)
        else:
            a = max(a, gone)
            if a < b:
                if out and out[-1][1] == a:
                    out[-1][1] = b
                else:
                    out.append([a, b])
    return [(a, b) for a, b in out if b - a >= least]


def _passages(least: int):
    @F.pandas_udf("array<struct<start:int,end:int>>")
    def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([[{"start": int(x), "end": int(y)} for x, y in passages(*map(list, row), least)] for row in zip(a, b, c, d)], dtype=object)
    return run


def _by_text(docs: DataFrame, id_col: str, text: str, *, min_words: int = 25, shingle: int = 5, similarity: float = 0.8,
             min_passage: int | None = None) -> DataFrame:
    """``id``, ``doc``, ``n_removed``, ``lines``, ``passages`` and ``repeats_of`` of every document that loses anything."""
    read = read_texts(docs, id_col, text, min_words, shingle)
    lines = _repeated_lines(paragraphs(docs, id_col, text, min_words), read, shingle, similarity)
    marks = lines.select("id", "doc", "line", F.col("line_from").alias("a"), F.col("line_to").alias("b"), F.col("first.id").alias("first_id"))
    if min_passage:
        every = read.select("id", "doc", F.explode(F.arrays_zip("piece", "piece_from", "piece_to")).alias("p")).select("id", "doc", "p.*")
        marks = marks.unionByName(_later(every, "piece", "piece_from").select(
            "id", "doc", F.lit(None).cast("int").alias("line"), F.col("piece_from").alias("a"), F.col("piece_to").alias("b"), F.col("first.id").alias("first_id")))
    held = marks.groupBy("id", "doc").agg(F.array_sort(F.collect_set(F.struct("a", "b", "line", "first_id"))).alias("marks"))
    whole, part = F.filter("marks", lambda m: m["line"].isNotNull()), F.filter("marks", lambda m: m["line"].isNull())
    cut = held.select("id", "doc", whole.alias("whole"), part.alias("part")).withColumn(
        "passages", _passages(min_passage or 1)("part.a", "part.b", "whole.a", "whole.b"))
    from_part = F.filter("part", lambda m: F.exists("passages", lambda p: (p["start"] < m["b"]) & (m["a"] < p["end"])))
    sources = F.concat("whole", from_part)["first_id"]
    return cut.filter((F.size("whole") > 0) | (F.size("passages") > 0)).select(
        "id", "doc", (F.size("whole") + F.size("passages")).cast("long").alias("n_removed"), F.array_sort("whole.line").alias("lines"), "passages",
        F.array_sort(F.array_distinct(F.filter(sources, lambda x: x.isNotNull()))).alias("repeats_of"))


def by_document(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """One row per different id and text: ``n_removed`` paragraphs, the ``lines`` and the ranges of words (``starts``, ``ends``)
    that go, and ``repeats_of``, the ids where what was removed stays."""
    gone = _by_text(docs, id_col, text, **limits)
    every = docs.select(docs[id_col].alias("own"), F.xxhash64(docs[text]).alias("own_doc")).distinct()
    none = F.array().cast("array<int>")
    return every.join(gone, every["own"].eqNullSafe(gone["id"]) & (every["own_doc"] == gone["doc"]), "left").select(
        F.col("own").alias(id_col), F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("lines", none).alias("lines"),
        F.coalesce("passages.start", none).alias("starts"), F.coalesce("passages.end", none).alias("ends"),
        F.coalesce("repeats_of", F.array().cast(T.ArrayType(docs.schema[id_col].dataType))).alias("repeats_of"))


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def without(text: str, lines: list[int], spans: list[tuple[int, int]]) -> str:
    """``text`` without whole ``lines`` and without the words in ``spans``; a line that loses all its words goes."""
    gone, kept, n, k = set(lines), [], 0, 0
    for number, line in enumerate(text.split("\n")):
        found = [(m.start(), m.end()) for m in _WORD.finditer(line)]
        first, n = n, n + len(found)
        if number in gone:
            continue
        while k < len(spans) and spans[k][1] <= first:
            k += 1
        at, left, hit = 0, [], False
        for start, end in (spans[j] for j in range(k, len(spans))):
            if start >= n or not found:
                break
            hit = True
            left.append(line[at:found[max(start, first) - first][0]])
            at = found[min(end, n) - first - 1][1]
        line = "".join(left) + line[at:]
        if not hit or _WORD.search(line):
            kept.append(line)
    return "\n".join(kept)


@F.pandas_udf(T.StringType())
def _without(texts: pd.Series, lines: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
    return pd.Series([t if a is None or t is None else without(t, list(a), list(zip(b, c))) for t, a, b, c in zip(texts, lines, starts, ends)], dtype=object)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """``docs`` with the repeated paragraphs cut out of ``text``."""
    mark = "-" * (1 + max(len(c) for c in docs.columns))
    gone = _by_text(docs, id_col, text, **limits).select(
        F.col("id").alias(f"{mark}id"), F.col("doc").alias(f"{mark}doc"), F.col("lines").alias(f"{mark}lines"),
        F.col("passages.start").alias(f"{mark}starts"), F.col("passages.end").alias(f"{mark}ends"))
    own = docs[id_col].eqNullSafe(F.col(f"{mark}id")) & (F.xxhash64(docs[text]) == F.col(f"{mark}doc"))
    left = _without(docs[text], F.col(f"{mark}lines"), F.col(f"{mark}starts"), F.col(f"{mark}ends"))
    return docs.join(gone, own, "left").select(*[(left if c == text else docs[c]).alias(c) for c in docs.columns])
