"""Quality rules: text statistics of a document, and lines that a host repeats in many documents.

A line is compared by the hash of its normal form (lower case, runs of blanks as
one, ends trimmed).  Per host the documents holding a line are counted, copies of
one text as one document, since a copied document is not boilerplate.  A line in
more than ``max_share`` of a host's documents, but in ``min_docs`` at least, or in more than
``max_docs`` of them however large the host, is
removed; a document is depleted when its lines that stay hold less than
``least_left`` of the words of all its lines, each different line counted once.
Statistics and verdicts are those of the text as it came; ``without_frequent_lines``
gives the kept documents with the lines cut.

Edge cases: a null or empty text has no words, so it fails the base rule.  A null
host is a host of its own.  Repeated rows and null ids are judged row by row, as a
verdict depends on host and text alone.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.columns import BLANKS, let, narrow, words
from plumbline.session import materialise

SYMBOLS = "#*$%&|<>"
#: Short hashes of texts that lose lines: so many numbers are broadcast at most.
SLOTS = 1 << 21


def _repeated(ws: Column) -> Column:
    """Words in three-word windows that occur twice or more.

    A window's hash gives its lowest bits to its place in the text, so that plain
    sorting of longs brings equal windows together; neighbours are then compared word by word.
    """
    def among(mask: Column) -> Column:
        hashes = F.transform(
            F.sequence(F.lit(0).cast("long"), F.size(ws).cast("long") - 3),
            lambda i: F.xxhash64(*[F.get(ws, (i + k).cast("int")) for k in range(3)]).bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i),
        )

        def same(x: Column, y: Column) -> Column:
            at, other = x.bitwiseAND(mask).cast("int"), y.bitwiseAND(mask).cast("int")
            equal = x.bitwiseXOR(y).between(F.lit(0), mask)
            for k in range(3):
                equal = equal & (F.get(ws, at + k) == F.get(ws, other + k))
            return equal

        def covered(s: Column) -> Column:
            twins = F.filter(s, lambda x, j: same(x, F.get(s, j + 1)) | same(x, F.get(s, j - 1)))
            return F.size(F.array_distinct(F.flatten(F.transform(
                twins, lambda x: F.transform(F.array(*map(F.lit, range(3))), lambda k: x.bitwiseAND(mask).cast("int") + k)))))

        return let(F.sort_array(hashes), covered)

    places = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(F.size(ws)))) - 1
    return F.when(F.size(ws) >= 4, let(places, among)).otherwise(0).cast("long")


def _lines(text: Column) -> Column:
    """A text's lines that hold a word, as written."""
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def _normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), BLANKS, " "))


def statistics(text: Column) -> Column:
    """``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines`` and ``n_repeat_words`` of a text without nulls."""
    symbols = F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", ""))
    repeats = let(_lines(text), lambda ls: F.size(ls) - F.size(F.array_distinct(ls)))
    return let(words(text), lambda ws: F.struct(
        F.size(ws).cast("long").alias("n_words"),
        F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        repeats.cast("long").alias("n_dup_lines"),
        _repeated(ws).alias("n_repeat_words"),
    ))


def _distinct_lines(text: Column) -> Column:
    """Each different line of a text once: the hash of its normal form and its words."""
    def one(line: Column) -> Column:
        return let(_normal(line), lambda n: F.struct(
            F.xxhash64(n).alias("line"),
            (F.length(n) - F.length(F.replace(n, F.lit(" "), F.lit(""))) + 1).alias("words")))

    return F.array_distinct(F.transform(_lines(text), one))


def lessened_texts(docs: DataFrame, host: str, text: str, max_share: float, min_docs: int, max_docs: int, least_left: float) -> DataFrame:
    """``host`` and ``text_key`` of the texts that lose lines, the hashes of the lines ``cut``, and whether too many go: ``depleted``."""
    own = narrow(docs, host=F.coalesce(docs[host].cast("string"), F.lit("")), text=F.coalesce(docs[text], F.lit("")))
    keyed = own.select("host", F.unhex(F.md5("text")).alias("text_key"), "text")
    lines = (
        keyed.select("host", "text_key", F.inline(_distinct_lines(F.col("text"))))
        .groupBy("host", "text_key", "line").agg(F.max("words").alias("words"))
    )
    sizes = lines.select("host", "text_key").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("texts"))
    frequent = (
        lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= min_docs)
        .join(sizes, "host")
        .filter((F.col("n") > max_share * F.col("texts")) | (F.col("n") > max_docs))
        .select("host", "line", F.lit(True).alias("frequent"))
    )
    left = F.sum(F.when(F.col("frequent").isNull(), F.col("words")).otherwise(0))
    return (
        lines.join(frequent, ["host", "line"], "left")
        .groupBy("host", "text_key").agg(left.alias("left"), F.sum("words").alias("all"), F.collect_list(F.when(F.col("frequent"), F.col("line"))).alias("cut"))
        .filter(F.col("left") < F.col("all"))
        .select("host", "text_key", "cut", (F.col("left") < least_left * F.col("all")).alias("depleted"))
    )


def quality_rules(docs: DataFrame, id_col: str = "doc_id", host: str = "source", text: str = "text", *, min_words: int = 50,
                  max_repeated: float = 0.5, max_share: float = 0.1, min_docs: int = 3, max_docs: int = 10_000, least_left: float = 0.3,
                  keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: its id, the statistics, ``base_failed`` and ``kept``, then, if ``keep`` names columns, these and the lines to ``cut``."""
    body = F.coalesce(docs[text], F.lit(""))
    rows = docs.select(
        docs[id_col].alias("id"), F.coalesce(docs[host].cast("string"), F.lit("")).alias("host"), F.unhex(F.md5(body)).alias("text_key"), body.alias("body"),
        *([F.struct(*[docs[c] for c in keep]).alias("carried")] if keep else []),
    )
    lessened = lessened_texts(docs, host, text, max_share, min_docs, max_docs, least_left)
    # written first, so that the planner knows how few texts it joins
    gone = materialise(lessened if keep else lessened.filter("depleted").select("host", "text_key", "depleted"), "lessened")
    slot = F.xxhash64("host", "text_key").bitwiseAND(SLOTS - 1).alias("slot")
    marked = F.broadcast(gone.select(slot).distinct())  # at most SLOTS numbers
    told = ["id", statistics(F.col("body")).alias("s"), *(["carried"] if keep else [])]
    slotted = rows.withColumn("slot", slot)
    # only rows that may lose lines are shuffled with their texts
    changed = slotted.join(marked, "slot", "left_semi").select("host", "text_key", *told).join(gone, ["host", "text_key"], "left")
    same = slotted.join(marked, "slot", "left_anti").select(*told).withColumns(
        {"depleted": F.lit(False), **({"cut": F.lit(None).cast("array<bigint>")} if keep else {})})
    judged = changed.select(*same.columns).unionByName(same).withColumn(
        "base_failed", (F.col("s.n_words") < min_words) | (100 * F.col("s.n_repeat_words") > 100 * max_repeated * F.col("s.n_words")))
    return judged.select(
        F.col("id").alias(id_col), "s.*", "base_failed", (~F.col("base_failed") & ~F.coalesce("depleted", F.lit(False))).alias("kept"),
        *(["carried", "cut"] if keep else []))


def without_rejected(docs: DataFrame, id_col: str = "doc_id", host: str = "source", text: str = "text", **limits) -> DataFrame:
    """The rows of ``docs`` that the rules keep, as they are."""
    return quality_rules(docs, id_col, host, text, keep=tuple(docs.columns), **limits).filter("kept").select("carried.*")


def without_frequent_lines(docs: DataFrame, id_col: str = "doc_id", host: str = "source", text: str = "text", **limits) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their host's frequent lines cut out of ``text``; a column ``n_chars`` follows it."""
    kept = quality_rules(docs, id_col, host, text, keep=tuple(docs.columns), **limits).filter("kept")
    own = F.col("carried").getField(text)
    left = F.array_join(F.filter(F.split(own, "\n"), lambda line: ~F.array_contains("cut", F.xxhash64(_normal(line)))), "\n")
    told = kept.select("cut", F.when(F.col("cut").isNull(), own).otherwise(left).alias("left"), "carried")
    size = F.when(F.col("cut").isNull(), F.col("carried.n_chars")).otherwise(F.length("left")) if "n_chars" in docs.columns else None
    return told.select(*[
        (F.col("left") if c == text else size.cast(docs.schema[c].dataType) if c == "n_chars" else F.col("carried").getField(c)).alias(c)
        for c in docs.columns])
