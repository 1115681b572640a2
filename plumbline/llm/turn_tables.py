"""Repair of the structure of conversations, by Four-Russians block tables.

A turn is one of nine symbols: a role's initial (s, u, a, another), clean or truncated,
or one that must go.  The least cost still to come from each state (start, system,
user, assistant) is a vector of four numbers; less its first number only a few different
vectors exist.  Tables hold, for each of them and every block of ``BLOCK`` symbols, the
vector before the block and what the costs grow by, so turns are read a block at a time from
the last to the first.  Blocks are then expanded in the other direction: from each state the
edit of least initial that lies on a cheapest way is taken, and as an initial leads to one
place only, that gives the least string of all cheapest ones.

Turns are sorted over all tasks by range.  A conversation that lies inside a task is done there,
at most ``ROWS`` turns at a time; one that goes on elsewhere or is longer is kept as parts,
each with its own table row (the vector before it for each vector behind it).  Parts
meet only as such rows: vectors pass from the last part to the first, states from the first to
the last.  Their texts are read once more, in order, for the digest.

Edge cases: null roles and texts count as one blank, null turns come first, and null ids are
one conversation.  Equal turns of one place are ordered by role and text; equal rows lie
side by side, and all but the first are duplicates.  An empty role is neither kind and never kept.
A conversation without turns has no edits and costs nothing.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.session import materialise

#: Symbols of a block; at most so many rows and characters in a part.
BLOCK, ROWS, CHARS = 4, 4096, 4_000_000
START, SYSTEM, USER, ASSISTANT = range(4)
TRUNCATED, GONE, NOTHING, SYMBOLS = 4, 8, 9, 10
RETURN, DELETE, INSERT = 2, 3, 2
#: By state: where an inserted or renamed turn leads, and where a kept one of each kind leads.
NEXT = (USER, USER, ASSISTANT, USER)
KEPT = ((SYSTEM, USER, None, None), (None, USER, None, None), (None, None, ASSISTANT, None), (None, USER, None, None))
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
LAWFUL = {"su", "ua", "au"}
_BLANK = "\x20\x09\x0a\x0b\x0c\x0d"


def _with_inserts(costs: list[int]) -> tuple[int, ...]:
    for _ in range(3):
        costs = [min(c, INSERT + costs[NEXT[q]]) for q, c in enumerate(costs)]
    return tuple(costs)


def _edits(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(initial, cost, next state) of what can be done with a turn, apart from inserts before it."""
    found = [("D", DELETE, state)]
    if symbol < GONE:
        late, kind = symbol >= TRUNCATED, symbol % TRUNCATED
        if KEPT[state][kind] is not None:
            found.append(("K", int(late), KEPT[state][kind]))
        found.append(("R", RETURN + late, NEXT[state]))
    return found


class Tables:
    """Vectors of costs to come, what each symbol and block makes of them, and the edits on cheapest ways."""

    def __init__(self) -> None:
        #: The first is the one behind the last turn.
        self.vectors = [_with_inserts([0, 99, 99, 0])]
        known, before, growth, at = {self.vectors[0]: 0}, [], [], 0
        while at < len(self.vectors):
            before.append([])
            growth.append([])
            for symbol in range(SYMBOLS):
                costs = self._costs(at, symbol)
                normal = tuple(c - costs[0] for c in costs)
                if normal not in known:
                    known[normal] = len(self.vectors)
                    self.vectors.append(normal)
                before[at].append(known[normal])
                growth[at].append(costs[0])
            at += 1
        self.before, self.growth = np.array(before), np.array(growth)
        #: By vector behind and block, a block being a number whose digits are its symbols.
        self.block_before, self.block_growth = self.before, self.growth
        for _ in range(BLOCK - 1):  # one more symbol in front
            behind = self.block_before
            self.block_growth = (self.block_growth[:, None, :] + self.growth[behind].transpose(0, 2, 1)).reshape(at, -1)
            self.block_before = self.before[behind].transpose(0, 2, 1).reshape(at, -1)
        self._ways: dict[tuple[int, int, int], tuple[str, int]] = {}

    def _costs(self, behind: int, symbol: int) -> tuple[int, ...]:
        """The least costs before a turn from each state, where the vector ``behind`` holds after it."""
        after = self.vectors[behind]
        return after if symbol == NOTHING else _with_inserts([min(c + after[to] for _, c, to in _edits(symbol, q)) for q in range(4)])

    def blocks(self, symbols: bytes) -> list[int]:
        """Symbols as numbers of blocks; the first is filled up in front."""
        padded = np.frombuffer(bytes([NOTHING]) * (-len(symbols) % BLOCK) + symbols, dtype=np.uint8)
        return (padded.reshape(-1, BLOCK).astype(np.int64) @ SYMBOLS ** np.arange(BLOCK - 1, -1, -1)).tolist()

    def before_all(self, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
        """For every vector behind ``symbols``: the one before them, and what the costs grow by."""
        at = np.arange(len(self.vectors))
        grown = np.zeros(len(at), dtype=np.int64)
        for block in reversed(self.blocks(symbols)):
            grown += self.block_growth[at, block]
            at = self.block_before[at, block]
        return at, grown

    def edits(self, symbols: bytes, vector: int, state: int) -> tuple[str, int, int]:
        """The least string of the cheapest edits from ``state`` on where ``vector`` lies behind, the state they lead to, and the growth."""
        blocks, behind, grown, out = self.blocks(symbols), [], 0, []
        for block in reversed(blocks):
            behind.append(vector)
            grown += int(self.block_growth[vector, block])
            vector = int(self.block_before[vector, block])
        for block, after in zip(blocks, reversed(behind)):
            found = self._ways.get((after, block, state))
            if found is None:
                found = self._ways[after, block, state] = self._expanded(after, block, state)
            out.append(found[0])
            state = found[1]
        return "".join(out), state, grown

    def _expanded(self, vector: int, block: int, state: int) -> tuple[str, int]:
        symbols, inner, out = [block // SYMBOLS ** k % SYMBOLS for k in range(BLOCK)], [], []
        for symbol in symbols:  # from the last on
            inner.append((vector, symbol))
            vector = int(self.before[vector, symbol])
        for behind, symbol in reversed(inner):
            costs, after, stays = self._costs(behind, symbol), self.vectors[behind], symbol != NOTHING
            while stays:
                ways = [(i, c + after[to], to) for i, c, to in _edits(symbol, state)] + [("I", INSERT + costs[NEXT[state]], NEXT[state])]
                initial, state = min((i, to) for i, cost, to in ways if cost == costs[state])
                out.append(initial)
                stays = initial == "I"
        return "".join(out), state

    def ending(self, state: int) -> str:
        """Inserts behind the last turn."""
        out = ""
        while self.vectors[0][state]:
            out, state = out + "I", NEXT[state]
        return out


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


class Counts(NamedTuple):
    """What is counted over turns that follow each other."""

    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    initials: tuple[str, str] | None = None
    #: First and last turn that is not null, and how many different ones.
    turns: tuple[int, int, int] | None = None

    def then(self, other: Counts) -> Counts:
        illegal = self.illegal + other.illegal
        initials, turns = self.initials or other.initials, self.turns or other.turns
        if self.initials and other.initials:
            illegal += self.initials[1] + other.initials[0] not in LAWFUL
            initials = self.initials[0], other.initials[1]
        if self.turns and other.turns:
            turns = self.turns[0], other.turns[1], self.turns[2] + other.turns[2] - (self.turns[1] == other.turns[0])
        return Counts(self.blank + other.blank, self.duplicate + other.duplicate, self.truncated + other.truncated, illegal, initials, turns)

    @property
    def gaps(self) -> int:
        return self.turns[1] - self.turns[0] + 1 - self.turns[2] if self.turns else 0


def _counted(turn: int | None, role: str, blank: bool, symbol: int, n: int) -> Counts:
    """Counts of ``n`` equal turns."""
    again = 0 if blank else n - 1 + (symbol == GONE)
    return Counts(n if blank else 0, again, int(TRUNCATED <= symbol < GONE), n - 1, (role[:1], role[:1]), None if turn is None else (turn, turn, 1))


class _Digest:
    """Takes edits and the turns they keep, in order, and hashes the repaired lines."""

    def __init__(self) -> None:
        self.state, self.lines, self.sha = START, 0, hashlib.sha256()

    def _line(self, role: str, text: str) -> None:
        self.sha.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.lines += 1

    def take(self, edits: str, turns: Iterator[tuple[str, str]]) -> None:
        """``turns`` gives role and text of each turn that is neither blank nor a duplicate."""
        for edit, gone in edits:
            kept = None if edit == "I" or gone else next(turns)
            if edit == "D":
                continue
            if edit == "K":
                self.state = KEPT[self.state]["sua".index(kept[0][:1])]
                self._line(*kept)
            else:
                self.state = NEXT[self.state]
                self._line(ROLE_OF[self.state], kept[1] if kept else "")


def _with_symbols(edits: str, symbols: bytes) -> list[tuple[str, bool]]:
    """Each edit, with whether its turn had to go."""
    rest = iter(symbols)
    return [(e, e != "I" and next(rest) == GONE) for e in edits]


def turns_of(conversations: DataFrame, conv: str, turn: str, role: str, text: str, copies: str | None) -> DataFrame:
    """Different turns with how often they occur (``n``) and their symbol; ``id``, ``turn``, ``role``, ``text``, ``blank``."""
    plain = conversations.select(
        conversations[conv].alias("id"), conversations[turn].cast("bigint").alias("turn"), F.coalesce(conversations[role], F.lit(" ")).alias("role"),
        F.coalesce(conversations[text], F.lit(" ")).alias("text"), (conversations[copies] if copies else F.lit(1)).cast("bigint").alias("n"))
    key = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    once = plain.groupBy("id", "turn", "role", "text").agg(F.sum("n").alias("n")).withColumn("key", key)
    again = (plain.where("n > 0").select("id", "turn", key.alias("key")).distinct()
             .groupBy("id", "key").agg(F.count(F.lit(1)).alias("places"), F.count("turn").alias("told"), F.min("turn").alias("first"))
             .where("places > 1").select(F.col("id").alias("its id"), F.col("key").alias("its key"), "first", (F.col("told") < F.col("places")).alias("null first")))
    joined = once.join(again, F.col("id").eqNullSafe(F.col("its id")) & (F.col("key") == F.col("its key")), "left")
    earlier = F.when(F.col("its key").isNull() | F.col("turn").isNull(), False).otherwise(F.col("null first") | (F.col("turn") > F.col("first")))
    end = F.rtrim(F.col("text"), F.lit(_BLANK))
    kind = F.when(F.col("role").startswith("s"), 0).when(F.col("role").startswith("u"), 1).when(F.col("role").startswith("a"), 2).otherwise(3)
    symbol = F.when((end == "") | earlier, GONE).otherwise(kind + F.when(F.substring(end, -1, 1).isin(".", "!", "?"), 0).otherwise(TRUNCATED))
    return joined.select("id", "turn", "role", "text", "n", (end == "").alias("blank"), symbol.cast("int").alias("symbol"))


_COUNTS = ("blank bigint, duplicate bigint, truncated bigint, illegal bigint, first_initial string, last_initial string, "
           "first_turn bigint, last_turn bigint, n_turns bigint")
_ANSWER = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def _schema(id_type: T.DataType, more: str) -> T.StructType:
    return T.StructType([T.StructField("id", id_type), *T.StructType.fromDDL(more).fields])


def _batch(rows: list[dict], like: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=like)


def _as_columns(c: Counts) -> dict:
    (a, b), (x, y, n) = c.initials or (None, None), c.turns or (None, None, None)
    return {"blank": c.blank, "duplicate": c.duplicate, "truncated": c.truncated, "illegal": c.illegal, "first_initial": a, "last_initial": b,
            "first_turn": x, "last_turn": y, "n_turns": n}


def _from_columns(r: dict) -> Counts:
    return Counts(r["blank"], r["duplicate"], r["truncated"], r["illegal"], None if r["first_initial"] is None else (r["first_initial"], r["last_initial"]),
                  None if r["n_turns"] is None else (r["first_turn"], r["last_turn"], r["n_turns"]))


def _answer(key: object, counts: Counts, cost: int, audit: str, sha: str) -> dict:
    return {"id": key, "gaps": counts.gaps, "blank": counts.blank, "duplicate": counts.duplicate, "truncated": counts.truncated,
            "illegal": counts.illegal, "cost": cost, "audit": audit, "repaired_sha256": sha}


class _Part:
    """Turns that follow each other in one conversation."""

    def __init__(self, goes_on: bool = False):
        self.goes_on, self.counts, self.symbols, self.kept, self.chars = goes_on, Counts(), bytearray(), [], 0

    def add(self, row: dict, n: int) -> None:
        self.counts = self.counts.then(_counted(row["turn"], row["role"], row["blank"], row["symbol"], n))
        self.symbols += bytes([row["symbol"]]) + bytes([GONE]) * (n - 1)
        if row["symbol"] != GONE:
            self.kept.append((row["role"], row["text"]))
            self.chars += len(row["text"])


def _read(schema: pa.Schema, rows: int, chars: int):
    """Sorted turns of a task -> conversations that lie inside it, done; and the parts of others with the turns they may keep."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told, at, size, seqs = [], TaskContext.get().partitionId(), 0, itertools.count()

        def part_rows(key: object, part: _Part) -> list[dict]:
            before, grown = tables().before_all(bytes(part.symbols))
            place = {"id": key, "part": at, "seq": next(seqs)}
            return [place | _as_columns(part.counts) | {"symbols": bytes(part.symbols), "moves": before.tolist(), "grown": grown.tolist()},
                    *(place | {"at": k, "role": r, "text": t} for k, (r, t) in enumerate(part.kept))]

        def closed(key: object, part: _Part) -> dict:
            symbols = bytes(part.symbols)
            edits, state, grown = tables().edits(symbols, 0, START)
            edits, digest = edits + tables().ending(state), _Digest()
            digest.take(_with_symbols(edits, symbols), iter(part.kept))
            return {"done": _answer(key, part.counts, grown, edits, digest.sha.hexdigest())}

        key, part, first = None, None, True
        for batch in batches:
            for row in batch.to_pylist():
                if part is None or row["id"] != key:
                    if part is not None and (first or part.goes_on):
                        told += part_rows(key, part)
                        size, first = size + part.chars, False
                    elif part is not None:
                        told.append(closed(key, part))
                    key, part = row["id"], _Part()
                left = row["n"]
                while left:  # equal turns may be more than a part holds
                    if len(part.symbols) >= rows or part.chars >= chars:
                        told += part_rows(key, part)
                        size += part.chars
                        part = _Part(goes_on=True)
                    n = min(left, rows - len(part.symbols))
                    part.add(row if left == row["n"] else row | {"symbol": GONE}, n)
                    left -= n
                if len(told) >= 4096 or size >= chars:
                    yield _batch(told, schema)
                    told, size = [], 0
        if part is not None:
            told += part_rows(key, part)
        yield _batch(told, schema)
    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, dict]]:
    """Rows, each with whether it begins another conversation."""
    key, begun = None, False
    for batch in batches:
        for row in batch.to_pylist():
            yield not begun or row["id"] != key, row
            key, begun = row["id"], True


def _vectors(schema: pa.Schema):
    """Parts from the last to the first -> the vector behind each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, vector = [], 0
        for other, row in _runs(batches):
            vector = 0 if other else vector
            out.append({"part": row["part"], "seq": row["seq"], "behind": vector})
            vector = row["moves"][vector]
            if len(out) == 10_000:
                yield _batch(out, schema)
                out = []
        yield _batch(out, schema)
    return run


def _exits(schema: pa.Schema):
    """To which state each part leads from each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch([{"id": r["id"], "part": r["part"], "seq": r["seq"], "behind": r["behind"],
                           "exits": [tables().edits(r["symbols"], r["behind"], q)[1] for q in range(4)]} for r in batch.to_pylist()], schema)
    return run


def _states(schema: pa.Schema):
    """Parts from the first to the last -> the state before each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, state = [], START
        for other, row in _runs(batches):
            state = START if other else state
            out.append({"part": row["part"], "seq": row["seq"], "behind": row["behind"], "enters": state})
            state = row["exits"][state]
            if len(out) == 10_000:
                yield _batch(out, schema)
                out = []
        yield _batch(out, schema)
    return run


def _joined_up(schema: pa.Schema):
    """Parts in order, each before the turns it may keep -> conversations."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _runs(batches)
        ahead = next(rows, None)
        while ahead:
            key, counts, cost, audit, digest = ahead[1]["id"], Counts(), 0, [], _Digest()
            begun = True
            while ahead and (begun or not ahead[0]):
                begun = False
                part = ahead[1]
                edits, state, grown = tables().edits(part["symbols"], part["behind"], part["enters"])
                counts, cost, ahead = counts.then(_from_columns(part)), cost + grown, next(rows, None)

                def kept() -> Iterator[tuple[str, str]]:
                    nonlocal ahead
                    while ahead and not ahead[0] and ahead[1]["at"] >= 0:
                        turn, ahead = ahead[1], next(rows, None)
                        yield turn["role"], turn["text"]

                turns = kept()
                digest.take(_with_symbols(edits, part["symbols"]), turns)
                for _ in turns:
                    raise ValueError("a turn without an edit")
                audit.append(edits)
            audit.append(tables().ending(digest.state))
            digest.take(_with_symbols(audit[-1], b""), iter(()))
            yield _batch([_answer(key, counts, cost, "".join(audit), digest.sha.hexdigest())], schema)
    return run


def repair(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", *,
           copies: str | None = None, rows: int = ROWS, chars: int = CHARS) -> DataFrame:
    """One row per conversation: id, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit``, ``repaired_sha256``.

    ``copies`` names a column that says how often a row counts; one that counts 0 times only names its conversation.
    """
    turns = turns_of(conversations, conv, turn, role, text, copies)
    kind = turns.schema["id"].dataType
    place = "part int, seq int"
    schema = T.StructType([*_schema(kind, f"{place}, at int, role string, text string, symbols binary, moves array<int>, grown array<bigint>, {_COUNTS}").fields,
                           T.StructField("done", _schema(kind, _ANSWER))])
    dealt = turns.repartitionByRange("id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("id", "turn", "role", "text")
    read = materialise(dealt.mapInArrow(_read(to_arrow_schema(schema), rows, chars), schema), "turns")
    done = read.where(F.col("done").isNotNull()).select("done.*")
    parts, lines = read.where(F.col("symbols").isNotNull()), read.where(F.col("at").isNotNull())

    def along(df: DataFrame, worker, more: str, *order) -> DataFrame:
        out = T.StructType.fromDDL(more)
        return df.repartition("id").sortWithinPartitions("id", *order).mapInArrow(worker(to_arrow_schema(out)), out)

    behind = along(parts.select("id", "part", "seq", "moves"), _vectors, f"{place}, behind int", F.desc("part"), F.desc("seq"))
    leads = _schema(kind, f"{place}, behind int, exits array<int>")
    exits = parts.select("id", "part", "seq", "symbols").join(behind, ["part", "seq"]).select("id", "part", "seq", "symbols", "behind").mapInArrow(_exits(to_arrow_schema(leads)), leads)
    enters = materialise(along(exits, _states, f"{place}, behind int, enters int", "part", "seq"), "states")
    held = parts.drop("at", "role", "text", "moves", "grown", "done").join(enters, ["part", "seq"]).withColumns(
        {"at": F.lit(-1), "role": F.lit(None).cast("string"), "text": F.lit(None).cast("string")})
    both = held.unionByName(lines.select("id", "part", "seq", "at", "role", "text"), allowMissingColumns=True)
    answer = _schema(kind, _ANSWER)
    joined = both.repartition("id").sortWithinPartitions("id", "part", "seq", "at").mapInArrow(_joined_up(to_arrow_schema(answer)), answer)
    return done.unionByName(joined).withColumnRenamed("id", conv)


def damage(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conversations`` with planted faults by a checksum of place: id, turn, role, text and ``copies`` (0: dropped, 2: repeated)."""
    blank = F.lit(" ")
    place = F.concat(F.coalesce(conversations[conv].cast("string"), blank), F.lit(":"), F.coalesce(conversations[turn].cast("string"), blank))
    marked = conversations.select(
        conversations[conv].alias("id"), conversations[turn].alias("turn"), F.coalesce(conversations[role], blank).alias("role"),
        F.coalesce(conversations[text], blank).alias("text"), (F.crc32(place.cast("binary")) % 20).alias("fate"))
    dropped = F.col("fate") == 0
    return marked.select(
        F.col("id").alias(conv), F.when(~dropped, F.col("turn")).alias(turn),
        F.when(dropped, "").when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias(role),
        F.when(F.col("fate").isin(0, 1), "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias(text),
        F.when(dropped, 0).when(F.col("fate") == 3, 2).otherwise(1).alias("copies"))
