"""Line dedup: lines that differ from an earlier line by at most ``edits`` edits.

A line is compared in its normal form (lower case, runs of blanks as one, ends
trimmed).  A few pieces of each line come first: hashes of its start, its end and of what lies
between, so many characters long that lines within ``edits`` edits share one of them (see
``_pieces``).  Only lines that share a piece with a different line, few of all, go on;
the others are written once, without their text, and are not looked at again.

Cut into ``edits + 1`` segments, a line keeps at least one segment whole
under ``edits`` edits, so each line is indexed by its segments and probes the
segments of lines up to ``edits`` shorter, at the few places where they can lie
(a place that needs too many edits before or behind the segment is left out).  Meetings must also agree in letter counts,
as an edit changes at most two of them by one, before the texts are fetched and
their edit distance is computed inside a band of ``edits``.

Lines below ``min_chars`` characters are compared as a whole only.  A line goes when
its first occurrence (smallest document, then line) comes after that of a line
linked to it, and so do all occurrences of a line but the first.

Edge cases: null and empty texts have no lines.  Rows with one id and one text
are one document (null is an id, before all others; of one id's texts the smallest
hash comes first); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.columns import narrow
from plumbline.session import materialise

EDITS, MIN_CHARS = 2, 16
#: Lengths of pieces are multiples of it, so that most lines have one length of pieces with all lines that may be near.
GRAIN = 4
#: Words of 64 bits in a set of short hashes.
WORDS = 1 << 19
#: Blanks inside a line that are not one space already.
RUNS = r"[\x09\x0B-\x0D][\x20\x09\x0B-\x0D]*|\x20[\x20\x09\x0B-\x0D]+"
#: Frequent letters; the order has no meaning.
COUNTED = "etaoinshrdlucmfw"


def _letters(line: Column) -> Column:
    """Counts of the counted letters modulo 4, in a code where counts that differ by one differ in one bit."""
    packed = F.lit(0).cast("long")
    for k, letter in enumerate(COUNTED):
        n = (F.octet_length(line) - F.octet_length(F.replace(line, F.lit(letter), F.lit("")))).bitwiseAND(3).cast("long")
        packed = packed.bitwiseOR(F.shiftleft(n.bitwiseXOR(F.shiftright(n, 1)), 2 * k))
    return packed


def _index_places(edits: int) -> list[tuple[int, int, int]]:
    """Segments of a line: how much shorter the line is that they are cut of, their number, and how far they lie off."""
    return [(0, i, 0) for i in range(edits + 1)]


def _probe_places(edits: int) -> list[tuple[int, int, int]]:
    return [
        (shorter, i, shift) for shorter in range(edits + 1) for i in range(edits + 1)
        for shift in range(max(-i, shorter - (edits - i)), min(i, shorter + edits - i) + 1)]


def _keys(lines: DataFrame, places: list[tuple[int, int, int]], edits: int, key: str, letters: str) -> DataFrame:
    """One row per line and place: the hash ``at`` of the segment that would lie there.

    One row's expression is short; all places of a line in one expression are more code than the JVM compiles.
    """
    k = edits + 1
    cut = F.explode(F.array(*[F.struct(F.lit(a).alias("shorter"), F.lit(i).alias("i"), F.lit(b).alias("shift")) for a, i, b in places])).alias("p")
    spread = lines.select("key", "letters", "line", "chars", cut).select(
        "key", "letters", "line", F.col("p.i").alias("i"), F.col("p.shift").alias("shift"), (F.col("chars") - F.col("p.shorter")).alias("chars"))
    # the last segments take what does not divide
    sized = spread.select("*", F.floor(F.col("chars") / k).cast("int").alias("size"), (k - F.col("chars") % k).alias("short"))
    first = F.col("i") * F.col("size") + F.greatest(F.lit(0), F.col("i") - F.col("short")) + 1
    piece = F.substring("line", first + F.col("shift"), F.col("size") + (F.col("i") >= F.col("short")).cast("int"))
    return sized.select(F.xxhash64("chars", "i", piece).alias("at"), F.col("key").alias(key), F.col("letters").alias(letters))


def _even(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), RUNS, " ")


def _slack(edits: int) -> list[int]:
    """How far the segments of a line can lie off in a line near it, counted from the nearer end."""
    return [min(i, edits - i) for i in range(edits + 1)]


def _size(chars: Column, edits: int) -> Column:
    size = F.floor((chars - sum(_slack(edits))) / (edits + 1)).cast("int")
    return F.when(size < GRAIN, size).otherwise(size - size % GRAIN)


def _pieces(line: Column, chars: Column, size: Column, edits: int) -> list[Column]:
    """Hashes of the pieces of ``size`` characters of a line.

    Let a line be cut into ``edits + 1`` segments, segment i being longer than ``size`` by its slack.  Of ``edits`` edits there is an i
    such that i lie before segment i, none inside and the rest behind it.  So another line has it whole and off by its slack at most,
    from the start or the end; a piece at each of the places 0 to slack inside it meets one of the other line.
    """
    slack, found = _slack(edits), []
    for i, off in enumerate(slack):
        before = size * i + sum(slack[:i])
        if i > edits - i:
            before = chars - size * (edits + 1 - i) - sum(slack[i:])
        found += [F.xxhash64(size, F.lit(i), F.substring(line, before + place + 1, size)) for place in range(off + 1)]
    return found


def _read(docs: DataFrame, id_col: str, text: str, edits: int, min_chars: int) -> DataFrame:
    """``id``, ``doc``, ``n`` and ``key`` of every line that is not blank, with its pieces ``at``; the first line is always there, its key null if blank.

    A line has a second row, not ``own``, if lines that are shorter by ``edits`` have shorter pieces.
    """
    # blanks are made one per text, and generators keep empty lists: filters on what they make would make it twice
    own = narrow(docs, id=id_col, text=text).select("id", F.xxhash64("text").alias("doc"), F.posexplode_outer(F.split(_even(F.col("text")), "\n")).alias("n", "raw"))
    lines = own.select("id", "doc", "n", F.trim("raw").alias("line")).filter((F.col("line") != "") | (F.coalesce("n", F.lit(0)) == 0))
    chars = F.col("chars")
    sizes = F.array_distinct(F.array(_size(chars, edits), _size(chars - edits, edits)))
    sized = lines.select("*", F.length("line").alias("chars")).select("*", F.posexplode_outer(sizes).alias("turn", "size"))
    at = F.when(chars >= min_chars, F.array(*_pieces(F.col("line"), chars, F.col("size"), edits)))
    return sized.select("id", "doc", "n", F.when(F.col("line") != "", F.xxhash64("line")).alias("key"), (F.col("turn") == 0).alias("own"), at.alias("at"))


def _among(rows: DataFrame, key: str, few: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``key`` is none of ``few``: short hashes turn them away where they lie."""
    short = F.xxhash64(key)
    word, bit = F.pmod(short, F.lit(WORDS)).cast("int"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64({key}), 58) as int))")
    words = few.select(word.alias("-word"), bit.alias("bit")).groupBy("-word").agg(F.bit_or("bit").alias("-bits"))
    return rows.withColumn("-word", word).join(F.broadcast(words), "-word").filter(bit.bitwiseAND(F.col("-bits")) != 0).drop("-word", "-bits")


def _different(read: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """The different lines that share a piece with another: ``key``, ``first``, ``line`` and ``letters``."""
    pieces = read.select("id", "doc", "n", "key", F.explode("at").alias("at"))
    shared = materialise(pieces.groupBy("at").agg(F.min("key").alias("a"), F.max("key").alias("b")).filter("a <> b").select("at"), "shared")
    holders = _among(pieces, "at", shared).groupBy("at", "key").agg(F.min(F.struct("id", "doc", "n")).alias("first")).join(shared, "at")
    first = holders.groupBy("key").agg(F.min("first").alias("first"))
    wanted = materialise(first.withColumn("place", F.xxhash64("first.doc", "first.n")), "wanted")
    raw = narrow(docs, text=text).select(F.xxhash64("text").alias("doc"), F.posexplode_outer(F.split("text", "\n")).alias("n", "raw")).select(
        F.xxhash64("doc", "n").alias("place"), "raw")
    texts = _among(raw, "place", wanted).groupBy("place").agg(F.min("raw").alias("raw"))
    lines = wanted.join(texts, "place").select("key", "first", F.trim(_even(F.col("raw"))).alias("line"))
    return materialise(lines.withColumn("letters", _letters(F.col("line"))), "lines")


def line_links(lines: DataFrame, edits: int, min_chars: int) -> DataFrame:
    """Links between the different ``lines`` (key, line, letters, first): ``a``, ``b`` and which of them, ``later``, comes second."""
    sized = lines.withColumn("chars", F.length("line")).filter(F.col("chars") >= min_chars)
    index, probe = _keys(sized, _index_places(edits), edits, "a", "la"), _keys(sized, _probe_places(edits), edits, "b", "lb")
    agree = (F.col("a") != F.col("b")) & (F.bit_count(F.col("la").bitwiseXOR(F.col("lb"))) <= 2 * edits)
    met = materialise(
        index.join(probe, (index["at"] == probe["at"]) & agree).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "met")
    near_lines = _among(lines.select("key", "line", "first"), "key", met.select(F.explode(F.array("a", "b")).alias("key")))
    one, two = (near_lines.select(F.col("key").alias(k), F.col("line").alias(f"line_{k}"), F.col("first").alias(f"first_{k}")) for k in "ab")
    near = F.expr(f"levenshtein(line_a, line_b, {edits}) >= 0")
    return met.join(one, "a").join(two, "b").filter(near).select(
        "a", "b", F.when(F.col("first_a") < F.col("first_b"), F.col("b")).otherwise(F.col("a")).alias("later"))


def _by_text(docs: DataFrame, id_col: str, text: str, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``id``, ``doc``, ``n_lines``, ``n_links``, ``n_removed`` and ``lines`` of every document."""
    read = materialise(_read(docs, id_col, text, edits, min_chars), "read")
    links = materialise(line_links(_different(read, docs, text), edits, min_chars), "links")
    ends = links.select(F.explode(F.array("a", "b")).alias("key"), "later")
    linked = ends.groupBy("key").agg(F.count(F.lit(1)).alias("links"), F.max(F.col("key") == F.col("later")).alias("late"))
    found = read.filter("own").select("id", "doc", "n", "key")
    times = found.filter("key is not null").groupBy("key").agg(F.min(F.struct("id", "doc", "n")).alias("first"), F.count(F.lit(1)).alias("times"))
    again = materialise(times.filter("times > 1").select("key", "first"), "again")
    stays = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("doc") == F.col("first.doc")) & (F.col("n") == F.col("first.n"))
    repeated = _among(found, "key", again).join(again, "key").select("id", "doc", F.lit(0).cast("long").alias("links"), F.when(~stays, F.col("n")).alias("n"))
    near = _among(found, "key", linked).join(linked, "key").select("id", "doc", "links", F.when(F.col("late"), F.col("n")).alias("n"))
    marks = repeated.unionByName(near).groupBy("id", "doc").agg(F.sum("links").alias("links"), F.array_sort(F.collect_set("n")).alias("lines")).select(
        F.col("id").alias("own"), F.col("doc").alias("own_doc"), "links", "lines")
    # rows with one id and one text have the same lines, and each has a first one
    every = found.groupBy("id", "doc").agg(F.count("key").alias("n"), F.count_if(F.coalesce("n", F.lit(0)) == 0).alias("copies"))
    return every.join(marks, every["id"].eqNullSafe(marks["own"]) & (every["doc"] == marks["own_doc"]), "left").select(
        "id", "doc", F.expr("n div copies").alias("n_lines"), F.expr("coalesce(links, 0) div copies").alias("n_links"),
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("lines", F.array().cast("array<int>")).alias("lines"))


def by_document(docs: DataFrame, id_col: str = "doc_id", text: str = "text", *, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per different id and text: ``n_lines``, ``n_links`` of its different lines to other lines, ``n_removed`` and the numbers of the ``lines`` that go."""
    return _by_text(docs, id_col, text, edits, min_chars).select(F.col("id").alias(id_col), "n_lines", "n_links", "n_removed", "lines")


def without_near_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """``docs`` with the lines that go cut out of ``text``."""
    gone = _by_text(docs, id_col, text, **limits).filter("n_removed > 0").select(
        F.col("id").alias("-id"), F.col("doc").alias("-doc"), F.col("lines").alias("-lines"))
    left = F.array_join(F.filter(F.split(docs[text], "\n"), lambda line, at: ~F.array_contains("-lines", at)), "\n")
    own = docs[id_col].eqNullSafe(F.col("-id")) & (F.xxhash64(docs[text]) == F.col("-doc"))
    return docs.join(gone, own, "left").select(
        *[(F.when(F.col("-lines").isNull(), docs[c]).otherwise(left) if c == text else docs[c]).alias(c) for c in docs.columns])
