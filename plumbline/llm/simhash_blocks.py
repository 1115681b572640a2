"""SimHash near-dedup: 64-bit fingerprints, linked when few bits differ.

Fingerprints are cut into blocks.  When at most ``distance`` of ``blocks`` blocks
can differ, a close pair agrees on all the other blocks, so fingerprints that share
the bits of some choice of ``blocks - distance`` blocks are compared, and no other.
More blocks make longer shared bits and fewer chance meetings, for more copies of
a fingerprint: with 6 blocks 15 copies of 21 shared bits, with 8 blocks 70 of 32.

Only different fingerprints are compared.  A choice shared by very many is cut into
cells by hash, and each pair of cells is compared in a task of its own; of the
links found, those that join what is not joined yet are passed on, so a large group
of near copies gives about one link for each member and choice, not all its pairs.

Edge cases: null and empty texts and texts of blanks alone have fingerprint zero
and link like any other.  Null ids belong to a component but never name it (null
when all its ids are null).  Repeated rows stay rows.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.columns import narrow
from plumbline.llm.components import components
from plumbline.session import materialise

CELL = 2048
_STEP = 1 << 14


def simhash(text: str, shingle: int = 4, seed: int = 42) -> int:
    """The fingerprint of one text, unsigned."""
    ws = text.encode("utf-8", "surrogatepass").lower().split()
    if not ws:
        return 0
    width = min(shingle, len(ws))
    joined = b" ".join(ws)
    ends = np.cumsum([len(w) + 1 for w in ws]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    total, count = np.zeros(64, np.int64), len(ws) - width + 1
    for at in range(0, count, _STEP):
        spans = zip(starts[at:min(at + _STEP, count)].tolist(), ends[at + width - 1:min(at + _STEP, count) + width - 1].tolist())
        hashes = np.array([xxhash.xxh64_intdigest(joined[s:e], seed) for s, e in spans], dtype="<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * total > count, bitorder="little").view("<u8")[0])


@F.pandas_udf(T.LongType())
def fingerprint(texts: pd.Series) -> pd.Series:
    found = np.fromiter((simhash(t or "") for t in texts), dtype=np.uint64, count=len(texts))
    return pd.Series(found.view(np.int64))


def _masks(distance: int, blocks: int) -> list[int]:
    """For every choice of blocks that a close pair must share, the bits of its blocks, as a signed long."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    bits = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    return [int(np.uint64(sum(c)).astype(np.int64)) for c in combinations(bits, blocks - distance)]


def _joining(a: np.ndarray, b: np.ndarray, parent: list[int]) -> list[tuple[int, int]]:
    """Those of the links (a, b) that join two trees of ``parent``, which takes them in."""
    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = top(x), top(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            kept.append((x, y))
    return kept


def _links(rows: pd.DataFrame, distance: int) -> pd.DataFrame:
    """A spanning forest of the links in each group of ``rows``, which are sorted by group."""
    keys = rows[["mask", "shared", "one", "two"]].to_numpy()
    new = np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1)))
    start = np.flatnonzero(new)
    last = np.repeat(np.append(start[1:], len(rows)), np.diff(np.append(start, len(rows))))
    values, cell = rows["value"].to_numpy().view(np.uint64), rows["cell"].to_numpy()
    across = (rows["one"] != rows["two"]).to_numpy()
    parent, tree, found = list(range(len(rows))), np.arange(len(rows)), []
    live, k = np.arange(len(rows)), 1
    while len(live := live[live + k < last[live]]):
        other = live + k
        near = np.bitwise_count(values[live] ^ values[other]) <= distance
        near &= (tree[live] != tree[other]) & ~(across[live] & (cell[live] == cell[other]))
        if near.any():
            found += _joining(live[near], other[near], parent)
            tree = np.array(parent)
        k += 1
    at = np.array(found, dtype=np.int64).reshape(-1, 2)
    values = values.view(np.int64)
    return pd.DataFrame({"a": values[at[:, 0]], "b": values[at[:, 1]]})


def _group_links(distance: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["mask", "shared", "one", "two"]
        held: list[pd.DataFrame] = []
        for batch in batches:
            if batch.empty:
                continue
            # the last group may go on in the next batch
            tail = (batch[names] == batch[names].iloc[-1]).all(axis=1).to_numpy()
            whole, rest = batch[~tail], batch[tail]
            if len(whole):
                yield _links(pd.concat([*held, whole]), distance)
                held = []
            elif held and not (held[-1][names].iloc[-1] == batch[names].iloc[-1]).all():
                yield _links(pd.concat(held), distance)
                held = []
            held.append(rest)
        if held:
            yield _links(pd.concat(held), distance)
    return run


def close_links(values: DataFrame, value: str, *, distance: int = 4, blocks: int = 6, cell: int = CELL) -> DataFrame:
    """Links ``a``, ``b`` that connect the distinct longs in ``values`` as all pairs within ``distance`` bits would."""
    masks = _masks(distance, blocks)
    keyed = narrow(values, value=value).select("value", F.posexplode(F.array(*[F.col("value").bitwiseAND(F.lit(m)) for m in masks])).alias("mask", "shared"))
    sizes = keyed.groupBy("mask", "shared").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    ways = F.ceil(F.col("n") / cell).cast("int")
    cells = (
        keyed.join(sizes, ["mask", "shared"])
        .withColumn("cell", F.pmod(F.xxhash64("value"), ways).cast("int"))
        .select("mask", "shared", "value", "cell", F.explode(F.sequence(F.lit(0), ways - 1)).alias("other"))
        .select("mask", "shared", "value", "cell", F.least("cell", "other").alias("one"), F.greatest("cell", "other").alias("two"))
    )
    group = ["mask", "shared", "one", "two"]
    return cells.repartition(*group).sortWithinPartitions(*group, "value").mapInPandas(_group_links(distance), "a long, b long")


def _roots(values: DataFrame, distance: int, blocks: int) -> DataFrame:
    """``value`` and ``root`` for every fingerprint in ``values`` that has a link."""
    return materialise(components(close_links(values, "value", distance=distance, blocks=blocks)), "roots").withColumnRenamed("node", "value")


def _component_of(prints: DataFrame, distance: int, blocks: int) -> DataFrame:
    """``value`` and ``component_id`` for every fingerprint in ``prints`` (id, value)."""
    values = prints.groupBy("value").agg(F.min("id").alias("id"))
    roots = _roots(values, distance, blocks)
    # written, so that the rows of a large component may be split when they meet its smallest id
    smallest = materialise(values.join(roots, "value").groupBy("root").agg(F.min("id").alias("least")), "least")
    linked = roots.join(smallest, "root").select("value", "least", F.lit(True).alias("linked"))
    return values.join(linked, "value", "left").select("value", F.when(F.col("linked"), F.col("least")).otherwise(F.col("id")).alias("component_id"))


def _hex(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", *, distance: int = 4, blocks: int = 6) -> DataFrame:
    """One row per row of ``docs``: its id, ``fingerprint`` in hex and ``component_id``, the smallest id that it reaches by links."""
    prints = materialise(docs.select(docs[id_col].alias("id"), fingerprint(docs[text]).alias("value")), "fingerprints")
    return prints.join(_component_of(prints, distance, blocks), "value").select(
        F.col("id").alias(id_col), _hex(F.col("value")).alias("fingerprint"), "component_id")


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text: str = "text", *, distance: int = 4, blocks: int = 6) -> DataFrame:
    """One of each group of linked rows: smallest id (null only if all are), then fingerprint, then text hash.  Rows of one id and text stay or go together."""
    marked = materialise(docs.select(
        docs[id_col].alias("id"), fingerprint(docs[text]).alias("value"), F.xxhash64(docs[text]).alias("wording"),
        F.struct(*[docs[c] for c in docs.columns]).alias("carried")), "marked")
    best = F.struct(F.col("id").isNull().alias("unnamed"), "id", "value", "wording")
    values = marked.groupBy("value").agg(F.min(best).alias("best"))
    roots = _roots(values, distance, blocks)
    stays = values.join(roots, "value", "left").groupBy(F.coalesce("root", "value").alias("root")).agg(F.min("best").alias("best")).select("best.id", "best.value", "best.wording")

    def same(a: DataFrame, b: DataFrame) -> Column:
        return (a["value"] == b["value"]) & (a["wording"] == b["wording"]) & a["id"].eqNullSafe(b["id"])

    members = marked.select("id", "value", "wording").distinct()
    # few rows go: written first, so that the planner knows it and need not move the texts
    others = materialise(members.join(stays, same(members, stays), "left_anti"), "near-copies")
    return marked.join(others, same(marked, others), "left_anti").select("carried.*")
