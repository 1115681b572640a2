"""Repair of conversations against a search over all edits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from plumbline.llm import queries, turn_tables

BLANK = " \t\n\v\f\r"


def damaged(rows):
    """(conv, turn, role, text) rows -> the same after damage, and all conversations."""
    out = []
    for conv, turn, role, text in rows:
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [(conv, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out, {r[0] for r in rows}


def cheapest(turns):
    """The least (cost, audit) over all edits, and the lines that it gives; ``turns`` are (role, text, fault)."""
    heap, seen = [(0, "", 0, ())], set()
    while True:
        cost, audit, at, lines = heapq.heappop(heap)
        roles = "".join(r[:1] or "?" for r, _ in lines)
        if at == len(turns) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, lines
        if (at, roles) in seen or not re.fullmatch("s?(ua)*u?", roles):
            continue
        seen.add((at, roles))
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 2, audit + "I", at, (*lines, (role, ""))))
        if at < len(turns):
            role, text, fault = turns[at]
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, lines))
            if fault not in ("blank", "duplicate"):
                late = int(fault == "truncated")
                heapq.heappush(heap, (cost + late, audit + "K", at + 1, (*lines, (role, text))))
                for other in ("user", "assistant"):
                    heapq.heappush(heap, (cost + late + 2, audit + "R", at + 1, (*lines, (other, text))))


def expected(rows, names):
    out = {}
    for conv in names:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, turns = set(), []
        for _, _, role, text in own:
            end = text.rstrip(BLANK)
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else ""
            seen.add((role, text))
            turns.append((role, text, fault))
        told = [r[1] for r in own if r[1] is not None]
        cost, audit, lines = cheapest(turns)
        out[conv] = (
            max(told) - min(told) + 1 - len(set(told)) if told else 0, *(sum(t[2] == f for t in turns) for f in ("blank", "duplicate", "truncated")),
            sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:])),
            cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest())
    return out


FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def results(df):
    got = [(r["conv_id"], tuple(r[f] for f in FIELDS)) for r in df.collect()]
    assert len(got) == len({k for k, _ in got})
    return dict(got)


def test_query_against_search(spark, data_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{data_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert results(queries.op11_turn_tables(spark, data_dir)) == expected(*damaged(rows))


@pytest.mark.parametrize("size", [3, 4096])
def test_odd_rows_in_parts_of_any_size(spark, size):
    dice = random.Random(size)
    words = ["Yes.", "No", "", " \n", None, "Well!", "Why? ", "so\v", "é."]
    rows = [(dice.choice([None, 1, 2, 3, 4, 5]), dice.choice([None, 0, 1, 2, 3, 4, 9]), dice.choice(["system", "user", "assistant", "tool", "", None]), dice.choice(words))
            for _ in range(60)]
    rows += [(7, 0, "user", "Again.")] * 5 + [(8, k, "user", "Same.") for k in range(8)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("id", F.lit(1)).withColumn("symbol", F.lit("x")).repartition(3)
    plain = turn_tables.repair(df, rows=size)
    assert results(plain) == expected([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows], {r[0] for r in rows})
    worse = turn_tables.repair(turn_tables.damage(df), copies="copies", rows=size)
    assert results(worse) == expected(*damaged(rows))


def test_one_conversation_of_many_turns_is_cut_into_parts(spark):
    rows = [(1, k, "user" if k % 3 else "assistant", f"turn {k}.") for k in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    one, many = (results(turn_tables.repair(df, rows=n))[1] for n in (4096, 100))
    assert one == many and one[5] > 0 and len(one[6].replace("I", "")) == 3000


def test_no_rows(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert turn_tables.repair(df).collect() == []


def test_every_block_equals_its_symbols_one_by_one():
    tables, dice = turn_tables.tables(), random.Random(1)
    for _ in range(500):
        symbols = bytes(dice.randrange(9) for _ in range(dice.randrange(1, 12)))
        at, grown = 0, 0
        for symbol in reversed(symbols):
            grown, at = grown + tables.growth[at, symbol], tables.before[at, symbol]
        edits, state, cost = tables.edits(symbols, 0, turn_tables.START)
        assert cost == grown and tables.before_all(symbols)[0][0] == at
        assert 2 * edits.count("I") + 3 * edits.count("D") + 2 * edits.count("R") <= cost
