"""Delimited text of unknown shape to rows, with columns and aggregates alone.

A body that lies in a row is read where it lies: records, delimiter, header and
footnotes are array functions of that row, and only its table rows are spread.

Files are read as splits, so that one large file is work for many tasks.  Whether a
line feed ends a record depends on the quotes before it, back to the start of the
file.  Every line is therefore a function of the state before it (outside or inside quotes);
a split composes its lines for both states, the splits of a file are composed in
order, and then each line knows its state and the number of its record.  Records over
several lines, also over the edge of a split, are put together by number.  What a table
has to know about itself is an aggregate over its records.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import vocab
from plumbline.functions.text import strip, strip_front
from plumbline.session import materialise

MARK = b"\xef\xbb\xbf"
#: A quote opens a field where it stands first in it; a later one is a letter like others.
_OPENS, _STRAY, _INNER = r'(?<![^,;\t|\r\n])"', r'(?<=[^,;\t|\r\n])"', r'(?:[^"]++|"")*+'
QUOTED = rf'{_OPENS}{_INNER}(?:"|\z)'
RECORD = rf'(?:[^"\r\n]++|{QUOTED}|{_STRAY})++'
#: Lines that leave the state outside quotes as it is, and lines that end in it when begun inside.
_STAYS_OUT = rf'\A(?:[^"]++|{_OPENS}{_INNER}"|{_STRAY})*+\z'
_GETS_OUT = rf'\A{_INNER}"(?:[^"]++|{_OPENS}{_INNER}"|{_STRAY})*+\z'
_TAIL = r"[\r\n]+\z"
PREAMBLE = r"(?i)^\s*sep=(.)\s*$"
#: Fixed value: characters that a record over several lines may hold; more means a quote that nobody closed.
LONGEST_FIELD = 131_072
#: Share of a table's records that must have one number of delimiters.
STEADY = 0.9
TOP_ROWS = vocab.BANNER_ROWS + 3
FIELDS = ("rid", "row_idx", "names", "cells", "delimiter", "confident", "encoding", "truncated", "header_trusted", "dropped_rows", "error_kind", "error_detail")


def _codecs() -> list[tuple[str, Column, str, str]]:
    """Known codecs of one byte a letter: name, a pattern of bytes (as Latin letters) that they lack, their letters and what these mean."""
    out = []
    for codec in vocab.CODECS:
        if codec != "utf-8":
            letters = {chr(b): bytes([b]).decode(codec, "ignore") for b in range(128, 256)}
            known = {k: v for k, v in letters.items() if v}
            foreign = "".join(k for k in letters if k not in known)
            out.append((codec, f"[{foreign}]" if foreign else "", "".join(known), "".join(known.values())))
    return out


def decoded(content: Column) -> Column:
    """``text`` and ``encoding`` of a body under the first known codec that takes all its bytes; both null if none does."""
    body = content.cast("binary")
    marked = F.substring(body, F.lit(1), F.lit(3)) == F.lit(MARK)
    as_is, latin = body.cast("string"), F.decode(body, "ISO-8859-1")
    found = F.when(F.is_valid_utf8(as_is), F.struct(F.regexp_replace(as_is, "^\ufeff", "").alias("text"), F.when(marked, "utf-8-sig").otherwise("utf-8").alias("encoding")))
    for codec, foreign, letters, meant in _codecs():
        takes = ~latin.rlike(foreign) if foreign else F.lit(True)
        found = found.when(takes, F.struct(F.translate(latin, letters, meant).alias("text"), F.lit(codec).alias("encoding")))
    return found


def _whole_lines(content: Column, complete: Column) -> Column:
    """A cut body without what follows its last line feed."""
    rest = F.octet_length(F.substring_index(content.cast("string"), "\n", -1))
    return F.when(complete, content).otherwise(F.substring(content, F.lit(1), F.octet_length(content) - rest))


def _delimiters(records: DataFrame) -> DataFrame:
    """``rid``, ``delimiter``, ``confident`` and whether the first record declares it, from counters over all records."""
    bare = F.regexp_replace("line", QUOTED, "")
    counts = [(F.length(bare) - F.length(F.replace(bare, F.lit(d), F.lit("")))).alias(f"d{k}") for k, d in enumerate(vocab.DELIMITERS)]
    filled = records.filter((strip(F.col("line")) != "") & ~((F.col("at") == 0) & F.col("line").rlike(PREAMBLE)))
    shapes = filled.select("rid", F.array(*counts).alias("shape")).groupBy("rid", "shape").agg(F.count(F.lit(1)).alias("n"))
    held = shapes.select("rid", "n", F.posexplode("shape").alias("d", "times")).groupBy("rid", "d", "times").agg(F.sum("n").alias("n"))
    steady = held.groupBy("rid", "d").agg(F.sum("n").alias("all"), F.max(F.when(F.col("times") > 0, F.struct("n", "times"))).alias("best"))
    chosen = steady.filter(F.col("best.n") >= STEADY * F.col("all")).groupBy("rid").agg(F.max(F.struct("best.times", (-F.col("d")).alias("d"))).alias("c"))
    said = records.groupBy("rid").agg(F.max(F.when(F.col("at") == 0, F.regexp_extract("line", PREAMBLE, 1))).alias("said"))
    known = F.array(*[F.lit(d) for d in vocab.DELIMITERS])
    declared = F.coalesce(F.col("said") != "", F.lit(False))
    return said.join(chosen, "rid", "left").select(
        "rid", F.when(declared, F.col("said")).otherwise(F.coalesce(F.get(known, -F.col("c.d")), F.lit(","))).alias("delimiter"),
        (declared | F.col("c").isNotNull()).alias("confident"), declared.cast("int").alias("declared"))


def _fields(line: Column, delimiter: Column) -> Column:
    quoted = F.concat(F.lit("\\Q"), delimiter, F.lit("\\E"))
    pattern = F.concat(quoted, F.lit('("(?:[^"]++|"")*+"(?='), quoted, F.lit("|$)|[^"), quoted, F.lit("]*+)"))
    raw = F.regexp_extract_all(F.concat(delimiter, line), pattern, 1)
    return F.transform(raw, lambda c: F.when(
        (F.length(c) >= 2) & F.startswith(c, F.lit('"')) & F.endswith(c, F.lit('"')),
        F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))


def _blank(cell: Column) -> Column:
    return strip_front(cell) == ""


def unique_names(cells: Column) -> Column:
    """Column names: cells without blanks around, by place if empty, with the first free number behind a name in use."""
    plain = F.transform(cells, lambda c, at: F.coalesce(
        F.nullif(strip(F.regexp_replace(strip(c), "^﻿+", "")), F.lit("")), F.concat(F.lit("col_"), (at + 1).cast("string"))))

    def add(taken: Column, name: Column) -> Column:
        tries = F.transform(F.sequence(F.lit(2), F.size(taken) + 2), lambda k: F.concat(name, F.lit("_"), k.cast("string")))
        free = F.get(F.filter(tries, lambda t: ~F.array_contains(taken, t)), F.lit(0))
        return F.array_append(taken, F.when(F.array_contains(taken, name), free).otherwise(name))

    return F.aggregate(plain, F.array().cast("array<string>"), add)


def _headers(rows: DataFrame) -> DataFrame:
    """Per table its ``names``, where its data start (``first``), what stood before, and whether the header is one row."""
    order = F.row_number().over(W.partitionBy("rid").orderBy("at"))
    top = rows.filter("filled > 0").withColumn("place", order).filter(F.col("place") <= TOP_ROWS).groupBy("rid").agg(
        F.array_sort(F.collect_list(F.struct("at", "cells", "filled"))).alias("top"), F.max("declared").alias("declared"))
    return _header_facts(top).select("rid", "names", "header_trusted", "first", "above")


def _header_facts(top: DataFrame) -> DataFrame:
    """``top`` (the first filled rows) and ``declared`` -> ``names``, ``header_trusted``, ``first``, ``above``, beside all other columns."""
    row = lambda k: F.get("top", k if isinstance(k, Column) else F.lit(k))

    def title(k: int) -> Column:
        here, below = row(k), row(k + 1)
        roomy = (here["filled"] <= 2) & (here["filled"] < F.size(here["cells"]))
        return F.coalesce(roomy & (below["filled"] >= F.greatest(F.lit(2), 2 * here["filled"])), F.lit(False))

    titles = F.lit(0)
    for k in reversed(range(vocab.BANNER_ROWS)):
        titles = F.when(title(k), titles + 1).otherwise(0)
    placed = top.withColumn("titles", titles).withColumns({"header": row(F.col("titles")), "below": row(F.col("titles") + 1)})
    both = F.filter(F.arrays_zip(F.col("header.cells").alias("h"), F.col("below.cells").alias("b")), lambda z: z["h"].isNotNull() & z["b"].isNotNull())
    second = F.exists(both, lambda z: _blank(z["h"]) & ~_blank(z["b"])) & F.exists(both, lambda z: ~_blank(z["h"]) & _blank(z["b"]))
    trusted = ~F.coalesce(second, F.lit(False))
    return placed.withColumn("header_trusted", trusted).withColumns({
        "names": F.when(F.col("header").isNotNull(), unique_names(F.col("header.cells"))),
        "header_trusted": F.when(F.col("header").isNotNull(), F.col("header_trusted")),
        "first": F.when(F.col("header_trusted"), F.col("header.at")).otherwise(F.col("below.at")) + 1,
        "above": F.col("header.at") - F.col("declared") + (~F.col("header_trusted")).cast("int"),
    }).drop("titles", "header", "below")


def _dialect(records: Column) -> Column:
    """``delimiter``, ``confident`` and ``declared`` of one body's records."""
    said = F.coalesce(F.regexp_extract(F.get(records, F.lit(0)), PREAMBLE, 1), F.lit(""))
    filled = F.filter(records, lambda line, at: ~_blank(line) & ~((at == 0) & line.rlike(PREAMBLE)))

    def of(bare: Column, k: int, mark: str) -> Column:
        times = F.array_sort(F.transform(bare, lambda b: F.length(b) - F.length(F.replace(b, F.lit(mark), F.lit("")))))
        # what nine records of ten have is also what the middle one has
        return F.transform(F.array(times), lambda t: F.struct(F.get(t, (F.size(t) / 2).cast("int")).alias("times"), F.lit(-k).alias("d"), t.alias("all")))[0]

    def steady(bare: Column) -> Column:
        kinds = F.array(*[of(bare, k, mark) for k, mark in enumerate(vocab.DELIMITERS)])
        good = F.filter(kinds, lambda c: (c["times"] > 0) & (F.size(F.filter(c["all"], lambda t: t == c["times"])) >= STEADY * F.size(c["all"])))
        return F.array_max(F.transform(good, lambda c: F.struct(c["times"].alias("times"), c["d"].alias("d"))))

    chosen = F.transform(F.array(F.transform(filled, lambda line: F.regexp_replace(line, QUOTED, ""))), steady)[0]
    known = F.array(*[F.lit(d) for d in vocab.DELIMITERS])
    return F.transform(F.array(F.struct(said.alias("said"), chosen.alias("c"))), lambda v: F.struct(
        F.when(v["said"] != "", v["said"]).otherwise(F.coalesce(F.get(known, -v["c"]["d"]), F.lit(","))).alias("delimiter"),
        ((v["said"] != "") | v["c"].isNotNull()).alias("confident"), (v["said"] != "").cast("int").alias("declared")))[0]


def parse_delimited(payloads: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Every payload's rows; row -1 carries the header and facts, or the error.

    ``payloads``: rid, content, body_complete.  All rows are given unless
    ``max_rows`` is passed.  A row is padded or cut to the header's width; rows with
    one filled cell behind the last other row of a table of three columns or more are footnotes.
    No row is shuffled; large files are better read by ``parse_files``.
    """
    body = payloads.select("rid", decoded(_whole_lines(F.col("content"), F.col("body_complete"))).alias("d"))
    cut = body.select("rid", F.col("d.encoding").alias("encoding"), _unreadable(F.col("d.text")).alias("problem"), F.col("d.text").alias("text")).select(
        "rid", "encoding", "problem", F.when(
            F.col("problem").isNull(), F.transform(F.regexp_extract_all("text", F.lit(RECORD), 0), lambda r: F.regexp_replace(r, _TAIL, ""))).alias("records"))
    long = F.exists("records", lambda r: (F.length(r) > LONGEST_FIELD) & r.rlike("[\r\n]"))
    known = cut.withColumn("problem", F.coalesce("problem", F.when(long, F.lit(_UNCLOSED)))).withColumn("dialect", F.when(F.col("problem").isNull(), _dialect(F.col("records"))))
    rows = F.transform("records", lambda line, at: F.struct(at.alias("at"), _fields(line, F.col("dialect.delimiter")).alias("cells")))
    filled = F.transform(F.filter("rows", lambda r: r["at"] >= F.col("dialect.declared")), lambda r: F.struct(
        r["at"].alias("at"), r["cells"].alias("cells"), F.size(F.filter(r["cells"], lambda c: ~_blank(c))).alias("filled")))
    topped = known.withColumn("rows", F.when(F.col("problem").isNull(), rows)).withColumn("rows", filled).withColumns({
        "top": F.slice(F.filter("rows", lambda r: r["filled"] > 0), 1, TOP_ROWS), "declared": F.col("dialect.declared")})
    headed = _header_facts(topped)
    width, cap = F.size("names"), F.lit(max_rows).cast("long")
    data = headed.withColumn("rows", F.filter("rows", lambda r: r["at"] >= F.col("first")))
    ends = data.withColumns({
        "end": F.array_max(F.transform("rows", lambda r: r["at"])),
        "full": F.coalesce(F.array_max(F.transform(F.filter("rows", lambda r: (r["filled"] != 1) | (width < 3)), lambda r: r["at"])), F.col("first") - 1)})
    facts = _until(ends, cap).withColumn("why", F.coalesce("problem", F.when(F.col("names").isNull(), F.lit("no header row"))))
    empty = F.lit(None)
    head = F.struct(
        F.lit(-1).cast("long").alias("row_idx"), F.col("names"), empty.cast("array<string>").alias("cells"), F.col("dialect.delimiter").alias("delimiter"),
        F.col("dialect.confident").alias("confident"), F.col("encoding"), F.coalesce("truncated", F.lit(False)).alias("truncated"), F.col("header_trusted"),
        F.coalesce("dropped_rows", F.lit(0)).cast("int").alias("dropped_rows"), F.when(F.col("why").isNotNull(), F.lit("malformed")).alias("error_kind"), F.col("why").alias("error_detail"))
    kept = F.transform(F.filter("rows", lambda r: r["at"] <= F.col("until")), lambda r: F.struct(
        (r["at"] - F.col("first")).cast("long").alias("row_idx"), F.col("names"), _padded(r["cells"], width).alias("cells"), empty.cast("string").alias("delimiter"),
        empty.cast("boolean").alias("confident"), empty.cast("string").alias("encoding"), empty.cast("boolean").alias("truncated"), empty.cast("boolean").alias("header_trusted"),
        F.lit(0).alias("dropped_rows"), empty.cast("string").alias("error_kind"), empty.cast("string").alias("error_detail")))
    return facts.select("rid", F.inline(F.concat(F.array(head), F.coalesce(kept, F.array())))).select(*FIELDS)


_UNCLOSED = "a quoted field is longer than any field may be"


def _unreadable(text: Column) -> Column:
    return F.when(text.isNull(), F.lit("body is in none of the known encodings")).when(F.contains(text, F.lit("\x00")), F.lit("payload contains NUL bytes; not text"))


def _padded(cells: Column, width: Column) -> Column:
    return F.slice(F.concat(cells, F.array_repeat(F.lit(None).cast("string"), width)), F.lit(1), width)


def _until(ends: DataFrame, cap: Column) -> DataFrame:
    """Where the rows that stay end, and how many were dropped on both sides, from ``first``, ``end``, ``full``, ``above``."""
    return ends.withColumn("truncated", F.coalesce(F.col("end") - F.col("first") + 1 > cap, F.lit(False))).withColumns({
        "until": F.when(F.col("truncated"), F.col("first") + cap - 1).otherwise(F.col("full")),
        "dropped_rows": F.col("above") + F.when(F.col("truncated"), 0).otherwise(F.coalesce(F.col("end") - F.col("full"), F.lit(0)))})


# --- files, as splits -------------------------------------------------------------------


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines in reading order, with the state after each and the number of records begun, in their split, for both states before the split."""
    split, state, begun, at = None, np.array([0, 1]), np.zeros(2, dtype=np.int64), 0
    for batch in batches:
        if not len(batch):
            continue
        names, splits = batch.column("rid"), batch.column("split").to_numpy()
        codes = names.dictionary_encode().indices.to_numpy()
        out, inn, filled = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("from_out", "from_in", "filled"))
        after, numbers, places = np.zeros((2, len(out)), dtype=bool), np.zeros((2, len(out)), dtype=np.int64), np.zeros(len(out), dtype=np.int64)
        earlier = after.copy()
        edges = [0, *(np.flatnonzero((np.diff(codes) != 0) | (np.diff(splits) != 0)) + 1).tolist(), len(codes)]
        for a, b in zip(edges, edges[1:]):
            if (names[a].as_py(), splits[a]) != split:
                split, state, begun, at = (names[a].as_py(), splits[a]), np.array([0, 1]), np.zeros(2, dtype=np.int64), 0
            same, fixed = (out[a:b] == 0) & (inn[a:b] == 1), out[a:b] == inn[a:b]
            turns = np.cumsum(~same & ~fixed)
            last = np.maximum.accumulate(np.where(fixed, np.arange(b - a), -1))
            for s in (0, 1):
                base = np.where(last >= 0, out[a:b][last], state[s])
                now = base ^ ((turns - np.where(last >= 0, turns[last], 0)) & 1)
                before = np.concatenate([[state[s]], now[:-1]])
                count = begun[s] + np.cumsum((before == 0) & (filled[a:b] == 1))
                earlier[s, a:b], after[s, a:b], numbers[s, a:b] = before, now, count
                state[s], begun[s] = now[-1], count[-1]
            places[a:b] = np.arange(at, at + b - a)
            at += b - a
        told = {c: batch.column(c) for c in ("rid", "split", "value", "filled")} | {"place": pa.array(places)}
        for s in (0, 1):
            told |= {f"in{s}": pa.array(earlier[s]), f"out{s}": pa.array(after[s]), f"n{s}": pa.array(numbers[s])}
        yield pa.record_batch(list(told.values()), list(told))


def _file_records(spark: SparkSession, path: str, pattern: str) -> tuple[DataFrame, DataFrame]:
    """Records (``rid``, ``at``, ``line``) and bodies (``rid``, ``encoding``, ``problem``) of files read as splits."""
    text = spark.read.format("text").option("lineSep", "\n").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    raw, alone = F.col("value").cast("binary"), r"\r(?!\z)"
    # cut as Latin letters, so that bytes of any encoding stay what they are
    cut = F.transform(F.split(F.decode(raw, "ISO-8859-1"), alone), lambda v: F.encode(v, "ISO-8859-1"))
    parts = text.select(F.col("_metadata.file_path").alias("rid"), F.col("_metadata.file_block_start").alias("split"), F.explode(
        F.when(F.contains("value", F.lit("\r")), cut).otherwise(F.array(raw))).alias("raw")).withColumn("value", F.col("raw").cast("string"))
    quoted = F.contains("value", F.lit('"'))
    told = parts.select("rid", "split", F.col("raw").alias("value"), (~F.col("value").isin("", "\r")).alias("filled"),
                        (quoted & ~F.col("value").rlike(_STAYS_OUT)).alias("from_out"), (~(quoted & F.col("value").rlike(_GETS_OUT))).alias("from_in"))
    states = ", ".join(f"in{s} boolean, out{s} boolean, n{s} bigint" for s in (0, 1))
    lines = materialise(told.mapInArrow(_states, f"rid string, split bigint, value binary, filled boolean, place bigint, {states}"), "lines")
    latin = F.decode("value", "ISO-8859-1")
    takes = {c: F.bool_and(~latin.rlike(foreign) if foreign else F.lit(True)) for c, foreign, *_ in _codecs()}
    splits = lines.groupBy("rid", "split").agg(
        F.max_by(F.struct("out0", "out1", "n0", "n1"), "place").alias("e"), F.bool_and(F.is_valid_utf8(F.col("value").cast("string"))).alias("utf8"),
        F.bool_or(F.contains("value", F.lit(b"\x00"))).alias("nul"), *[t.alias(c) for c, t in takes.items()])
    before = W.partitionBy("rid").orderBy("split")
    up_to, earlier = before.rowsBetween(W.unboundedPreceding, 0), before.rowsBetween(W.unboundedPreceding, -1)
    turns = F.sum((F.col("e.out0") & ~F.col("e.out1")).cast("int"))
    counted = splits.withColumn("turns", turns.over(up_to)).withColumn("fixed", F.when(F.col("e.out0") == F.col("e.out1"), F.struct(F.col("e.out0").alias("s"), F.col("turns").alias("t"))))
    held = F.last("fixed", ignorenulls=True).over(earlier)
    odd = (F.coalesce(F.lag("turns").over(before), F.lit(0)) - F.coalesce(held["t"], F.lit(0))) % 2 == 1
    entered = counted.withColumn("inside", F.coalesce(held["s"], F.lit(False)) != odd)
    whole = W.partitionBy("rid")
    begun = F.when(F.col("inside"), F.col("e.n1")).otherwise(F.col("e.n0"))
    codec = F.when(F.bool_and("utf8").over(whole), "utf-8")
    for name in takes:
        codec = codec.when(F.bool_and(name).over(whole), name)
    known = materialise(entered.select("rid", "split", "inside", F.coalesce(F.sum(begun).over(earlier), F.lit(0)).alias("before"), codec.alias("encoding"), F.bool_or("nul").over(whole).alias("nul")), "splits")
    own = lambda name: F.when(F.col("inside"), F.col(f"{name}1")).otherwise(F.col(f"{name}0"))
    as_text = F.when(F.col("encoding") == "utf-8", F.col("value").cast("string"))
    for name, _, letters, meant in _codecs():
        as_text = as_text.when(F.col("encoding") == name, F.translate(latin, letters, meant))
    placed = lines.join(known.where("encoding is not null and not nul"), ["rid", "split"]).select(
        "rid", "split", "place", "filled", own("in").alias("goes_on"), own("out").alias("open"), (F.col("before") + own("n") - 1).alias("at"), as_text.alias("line"))
    whole_lines = placed.where("not goes_on and not open and filled").select("rid", "at", "line")
    pieces = placed.where("goes_on or open and filled").select("rid", "at", "split", "place", "line")
    sizes = materialise(pieces.groupBy("rid", "at").agg(F.sum(F.length("line") + 1).alias("size")), "sizes")
    joined = pieces.join(sizes.where(F.col("size") <= LONGEST_FIELD).select("rid", "at"), ["rid", "at"]).groupBy("rid", "at").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split", "place", "line"))), lambda r: r["line"]), "\n").alias("line"))
    records = whole_lines.unionByName(joined).withColumn("line", F.regexp_replace("line", _TAIL, ""))
    long = sizes.where(F.col("size") > LONGEST_FIELD).select("rid").distinct().withColumn("long", F.lit(True))
    why = F.when(F.col("encoding").isNull(), _unreadable(F.lit(None))).when(F.col("nul"), _unreadable(F.lit("\x00"))).when(F.col("long"), F.lit(_UNCLOSED))
    bodies = known.groupBy("rid").agg(F.first("encoding").alias("encoding"), F.first("nul").alias("nul")).join(long, "rid", "left").select(
        "rid", "encoding", why.alias("problem"))
    return records, bodies


def parse_files(spark: SparkSession, path: str, pattern: str = "*", max_rows: int | None = None) -> DataFrame:
    """What ``parse_delimited`` gives, for files of any size below ``path``; ``rid`` is a file's path.

    A record over several lines has line feeds between them, and a byte-order mark, which the
    reader takes off, leaves no trace in ``encoding``.  A file without bytes has no rows.
    """
    records, bodies = _file_records(spark, path, pattern)
    fit = bodies.where("problem is null").select("rid")
    lines = materialise(records.join(fit, "rid", "left_semi"), "records")
    dialects = _delimiters(lines)
    cells = lines.join(dialects, "rid").filter("at >= declared").select(
        "rid", "at", "declared", _fields(F.col("line"), F.col("delimiter")).alias("cells"))
    rows = cells.withColumn("filled", F.size(F.filter("cells", lambda c: ~_blank(c))))
    headers = _headers(rows)
    width = F.size("names")
    data = rows.join(headers, "rid").filter(F.col("at") >= F.col("first"))
    spans = data.groupBy("rid").agg(
        F.max("at").alias("end"), F.coalesce(F.max(F.when((F.col("filled") != 1) | (width < 3), F.col("at"))), F.min("first") - 1).alias("full"))
    cap = F.lit(max_rows).cast("long")
    facts = _until(headers.join(spans, "rid", "left"), cap)
    heads = bodies.join(dialects, "rid", "left").join(facts, "rid", "left")
    why = F.coalesce("problem", F.when(F.col("names").isNull(), F.lit("no header row")))
    head = heads.select(
        "rid", F.lit(-1).cast("long").alias("row_idx"), "names", F.lit(None).cast("array<string>").alias("cells"),
        F.when(F.col("problem").isNull(), F.coalesce("delimiter", F.lit(","))).alias("delimiter"), F.when(F.col("problem").isNull(), F.coalesce("confident", F.lit(False))).alias("confident"),
        "encoding", F.coalesce("truncated", F.lit(False)).alias("truncated"), "header_trusted", F.coalesce("dropped_rows", F.lit(0)).cast("int").alias("dropped_rows"),
        F.when(why.isNotNull(), F.lit("malformed")).alias("error_kind"), why.alias("error_detail"))
    kept = data.join(facts.select("rid", "until"), "rid").filter(F.col("at") <= F.col("until"))
    written = kept.select(
        "rid", (F.col("at") - F.col("first")).cast("long").alias("row_idx"), "names", _padded(F.col("cells"), width).alias("cells"), F.lit(0).alias("dropped_rows"))
    return head.unionByName(written, allowMissingColumns=True).select(*FIELDS)
