"""Exact dedup by sorting content: equal texts become neighbours, and neighbours are compared in full.

Texts are equal when they match after lower-casing A-Z.  Rows go to ranges of
(first characters, bytes, last characters) of their normal form, cut at sampled splitters; each range is
sorted by the whole normal form (spilling as needed), and a row joins its
neighbour's run when all bytes match.

Hot content: a head, size and tail with over 1/``pieces`` of all bytes is also cut
by digest; a single text with that share is known from a map-side aggregation and
dealt over several ranges by id.  At most ``pieces`` keys of either sort exist, so
both lists may be broadcast at any size of the input.

Edge cases: a null text counts as empty; a null id is smaller than any other; of
repeated rows with the largest id exactly one is kept; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.columns import ascii_lower

EDGE = 32


def content_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", *, pieces: int = 1000,
                   keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: its id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``, and ``carried`` with the columns in ``keep``."""
    body, others = F.coalesce(docs[text], F.lit("")), [c for c in keep if c != text]
    rows = docs.select(
        docs[id_col].alias("id"), docs[text].alias("text"), ascii_lower(F.left(body, F.lit(EDGE))).alias("head"),
        F.octet_length(body).cast("long").alias("size"), ascii_lower(F.right(body, F.lit(EDGE))).alias("tail"),
        F.struct(F.lit(0).alias("none"), *[docs[c].alias(f"c{k}") for k, c in enumerate(others)]).alias("carried"),
    )
    edges = ["head", "size", "tail"]
    weights = rows.groupBy(*edges).agg(F.sum(F.col("size") + 1).alias("bytes"), F.count(F.lit(1)).alias("n"))
    total = weights.agg((F.sum("bytes") / pieces).alias("share"))
    share = total.first()["share"] or 0.0
    heavy = F.broadcast(weights.filter((F.col("bytes") > share) & (F.col("n") > 1)).select(*edges, F.lit(True).alias("heavy")))
    content = F.sha2(ascii_lower(F.coalesce("text", F.lit(""))), 256)
    rows = rows.join(heavy, edges, "left").withColumn("digest", F.when(F.col("heavy"), content))
    hot = F.broadcast(
        rows.filter("heavy").groupBy("digest")
        .agg(F.max("id").alias("hot_id"), F.count(F.lit(1)).alias("hot_n"), F.sum(F.col("size") + 1).alias("bytes"))
        .filter(F.col("bytes") > share)
        .select("digest", "hot_id", "hot_n", F.ceil(F.col("bytes") / share).alias("ways"))
    )
    rows = rows.join(hot, "digest", "left").withColumn("way", F.pmod(F.xxhash64("id"), "ways"))
    place = [*edges, "digest", "way"]
    sorted_rows = rows.repartitionByRange(*place).withColumn("norm", ascii_lower(F.coalesce("text", F.lit(""))))
    near = Window.partitionBy(*place).orderBy("norm", "id")
    runs = sorted_rows.select(
        *place, "id", "text", "carried", "hot_id", "hot_n", F.sha2("norm", 256).alias("text_sha256"),
        F.sum(F.when(F.lag("norm").over(near).eqNullSafe(F.col("norm")), 0).otherwise(1)).over(near).alias("run"),
        (~F.lead("norm").over(near).eqNullSafe(F.col("norm"))).alias("last"),
    )
    run = Window.partitionBy(*place, "run")
    return runs.withColumns({
        "keep_id": F.when(F.col("hot_n").isNull(), F.max("id").over(run)).otherwise(F.col("hot_id")),
        "group_size": F.when(F.col("hot_n").isNull(), F.count(F.lit(1)).over(run)).otherwise(F.col("hot_n")),
    }).select(
        F.col("id").alias(id_col), "keep_id", "group_size",
        (F.col("last") & F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"), "text_sha256",
        *([F.struct(*[F.col("text" if c == text else f"carried.c{others.index(c)}").alias(c) for c in keep]).alias("carried")] if keep else []))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", *, pieces: int = 1000) -> DataFrame:
    """``docs`` with one row of each group of equal texts: the one with the largest id."""
    return content_groups(docs, id_col, text, pieces=pieces, keep=tuple(docs.columns)).filter("kept").select("carried.*")
