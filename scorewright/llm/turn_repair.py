"""Conversation structure repair: cheapest edits to a legal order of roles, by a checkpointed dynamic program.

The turns of a conversation are read in order by an automaton of four states (nothing yet, after system, after user,
after assistant) that accepts role initials ``(s?(ua)+)?``. Keeping a turn costs nothing, giving it the only role that
may follow costs 2, deleting it 3 (blank turns and repeats must go), inserting an empty turn 2, and a truncated turn
that stays 1. A vector holds, for each state, the least cost from a place to the end. Of the edits that stay on least
costs ("tight") the walk takes the ASCII-least initial; a state and an initial lead to one state only, so the edits
come out ASCII-least as a whole.

Vectors are kept at checkpoints alone. Turns are range partitioned by (conversation, turn) and cut into blocks of
consecutive turns of one conversation, so one long conversation is spread over tasks. Each block has a matrix of least
costs between states; a pass over the blocks of a conversation, last to first, turns matrices into the vectors at the
ends of blocks. With it a block tells which state it leaves in for each state it is entered in, a pass first to last
gives the states it really is entered in, and the block then emits its edits. Inside a block the vectors are again
kept at every square root of its length only, and recomputed while walking forward. A code byte a turn is all that
these passes move. The texts move twice: into order, and to the task that hashes their conversation, row by row (a
digest of a whole conversation is taken in sequence, and its edits are one string; no more of it is held).

Defined cases: null ids are one conversation of their own; null turns come first. Null roles and texts are one space,
which is no role and blank. Turns of one number are ordered by role and a hash of the text. A repeat is a turn whose
role and text (128-bit hash) are those of an earlier one. Other columns are ignored. A conversation without turns has
no edits. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from scorewright.llm.common import slices, tasks
from scorewright.session import materialise

BLOCK = 1024
NONE, SYSTEM, USER, ASSISTANT = range(4)  # states; as code of a turn: no role, system, user, assistant
TRUNCATED, BLANK, REPEAT = 4, 8, 16  # bits of a code above the role
RETYPE, DELETE, INSERT = 2, 3, 2
_FAR = 1 << 50
_NAMES = {USER: "user", ASSISTANT: "assistant"}
_NEXT = (USER, USER, ASSISTANT, USER)  # the only role that may be put in
_BLANKS = "' \\t\\n\\u000b\\u000c\\r'"
Vector = tuple[int, int, int, int]
END: Vector = (0, 2 * INSERT, INSERT, 0)


def _kept(state: int, code: int) -> int:
    """The state after keeping a turn of this code, or -1."""
    role = code & 3
    if code & (BLANK | REPEAT) or not role:
        return -1
    if role == SYSTEM:
        return SYSTEM if state == NONE else -1
    return role if role == _NEXT[state] else -1


def _before(after: Vector, code: int) -> Vector:
    """Least costs before a turn from those after it, with insertions before the turn."""
    out = []
    gone, extra = code & (BLANK | REPEAT), 1 if code & TRUNCATED else 0
    for state in range(4):
        best = DELETE + after[state]
        if not gone:
            best = min(best, RETYPE + extra + after[_NEXT[state]])
            to = _kept(state, code)
            if to >= 0:
                best = min(best, extra + after[to])
        out.append(best)
    user, assistant = min(out[USER], INSERT + out[ASSISTANT]), min(out[ASSISTANT], INSERT + out[USER])
    return min(out[NONE], INSERT + user), min(out[SYSTEM], INSERT + user), user, assistant


@lru_cache(100_000)
def matrix(codes: bytes) -> tuple[Vector, ...]:
    """For each state after the block the least costs to it from each state before."""
    columns = []
    for state in range(4):
        vector: Vector = tuple(0 if s == state else _FAR for s in range(4))
        for code in reversed(codes):
            vector = _before(vector, code)
        columns.append(vector)
    return tuple(columns)


def through(columns, after: Vector) -> Vector:
    return tuple(min(columns[s][b] + after[s] for s in range(4)) for b in range(4))


@lru_cache(100_000)
def walk(codes: bytes, end: Vector, state: int) -> tuple[tuple[str, ...], int]:
    """The ASCII-least tight edits at each turn of a block, entered in ``state``, and the state it is left in.

    ``end`` are the least costs at its end. Vectors are stored at every square root of the length.
    """
    step = isqrt(len(codes)) + 1
    stored, vector = {}, end
    for i in range(len(codes), 0, -1):
        if i % step == 0 or i == len(codes):
            stored[i] = vector
        vector = _before(vector, codes[i - 1])
    out = []
    for begin in range(0, len(codes), step):
        stop = min(begin + step, len(codes))
        vectors = [stored[stop]]
        for i in range(stop, begin, -1):
            vectors.append(_before(vectors[-1], codes[i - 1]))
        vectors.reverse()
        for i in range(begin, stop):
            code, now, after = codes[i], vectors[i - begin], vectors[i - begin + 1]
            gone, extra, edits = code & (BLANK | REPEAT), 1 if code & TRUNCATED else 0, ""
            while True:
                to = _kept(state, code)
                if now[state] == DELETE + after[state]:
                    edits += "D"
                elif now[state] == INSERT + now[_NEXT[state]]:
                    edits, state = edits + "I", _NEXT[state]
                    continue
                elif to >= 0 and now[state] == extra + after[to]:
                    edits, state = edits + "K", to
                elif not gone and now[state] == RETYPE + extra + after[_NEXT[state]]:
                    edits, state = edits + "R", _NEXT[state]
                else:
                    raise AssertionError("no tight edit")
                break
            out.append(edits)
    return tuple(out), state


def closing(state: int) -> str:
    """Edits after the last turn."""
    return "I" * ((END[state]) // INSERT)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage by crc32 of ``conv_id:turn``; nulls of role and text are one space."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                name("role").alias("role"), name("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return (rows.where("kind != 0")
            .select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                    F.explode(F.expr("array_repeat(0, if(kind = 3, 2, 1))")).alias("again"))
            .drop("again"))


_ROWS = "conv_id long, turn long, role string, text string, h1 long, h2 long, block long, place int, codes binary"


def _blocks(turns: DataFrame, block: int) -> DataFrame:
    """The turns in order with block and place, and one row per block with its codes (``codes`` set, place -1)."""
    trimmed = F.expr(f"rtrim({_BLANKS}, text)")
    role = F.expr("case left(role, 1) when 's' then 1 when 'u' then 2 when 'a' then 3 else 0 end")
    code = role + F.when(trimmed == "", BLANK).when(F.right(trimmed, F.lit(1)).isin(".", "!", "?"), 0).otherwise(TRUNCATED)
    key = [F.col("conv_id").isNull(), "conv_id", "role", "text"]
    rows = turns.select("*", code.cast("int").alias("code"), F.xxhash64(*key).alias("h1"), F.xxhash64(F.lit(1), *key).alias("h2"),
                        F.monotonically_increasing_id().alias("tie"))
    order = ["conv_id", "turn", "role", "h1", "h2", "tie"]  # equal turns may lie in several tasks
    rows = rows.repartitionByRange(tasks(turns.sparkSession), *order).sortWithinPartitions(*order)

    def number(batches):
        high, blocks, open_, conv = TaskContext.get().partitionId() << 32, -1, bytearray(), None
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        names = ["conv_id", "turn", "role", "text", "h1", "h2", "block", "place", "codes"]
        for batch in slices(batches, "text", 4_000_000):
            heads, at, places = [], [], []
            for c, code in zip(batch.column("conv_id").to_pylist(), batch.column("code").to_pylist()):
                if blocks < 0 or c != conv or len(open_) == block:
                    if open_:
                        heads.append((conv, high | blocks, bytes(open_)))
                    blocks, conv, open_ = blocks + 1, c, bytearray()
                at.append(high | blocks)
                places.append(len(open_))
                open_.append(code)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names[:6]), pa.array(at, pa.int64()), pa.array(places, pa.int32()),
                 pa.nulls(len(batch), pa.binary())], names)
            if heads:
                yield _heads(heads, kinds, names)
        if open_:
            yield _heads([(conv, high | blocks, bytes(open_))], kinds, names)

    def _heads(heads, kinds, names):
        n = len(heads)
        columns = dict(zip(names, (pa.nulls(n, k) for k in kinds)))
        columns |= {"conv_id": pa.array([h[0] for h in heads], pa.int64()), "block": pa.array([h[1] for h in heads], pa.int64()),
                    "codes": pa.array([h[2] for h in heads], pa.binary()), "place": pa.array([-1] * n, pa.int32())}
        return pa.RecordBatch.from_arrays(list(columns.values()), names)

    return rows.select("conv_id", "turn", "role", "text", "h1", "h2", "code").mapInArrow(number, _ROWS)


def _repeats(turns: DataFrame) -> DataFrame:
    """(block, places): turns whose role and text came earlier in the conversation; at most a block's length each."""
    at = F.struct("block", "place")
    first = turns.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(at).alias("first")).where("n > 1").select("h1", "h2", "first")
    return (turns.select("h1", "h2", "block", "place").join(first, ["h1", "h2"]).where(at != F.col("first"))
            .groupBy("block").agg(F.collect_list("place").alias("places")))


def _each(batches, names: list[str]):
    for batch in batches:
        yield batch, zip(*(batch.column(n).to_pylist() for n in names))


def edits_by_block(blocks: DataFrame) -> DataFrame:
    """(conv_id, block, codes, edits) for blocks of (conv_id, block, codes); ``edits`` has one text a turn and a closing one."""
    vector = pa.list_(pa.int64())

    def matrices(batches):
        for batch, rows in _each(batches, ["codes"]):
            yield batch.append_column("costs", pa.array([[x for column in matrix(c) for x in column] for c, in rows], vector))

    def backward(batches):
        conv, after = object(), END
        for batch, rows in _each(batches, ["conv_id", "costs"]):
            ends, last = [], []
            for c, costs in rows:
                last.append(c != conv)
                if c != conv:
                    conv, after = c, END
                ends.append(after)
                after = through([costs[i:i + 4] for i in range(0, 16, 4)], after)
            yield (batch.select(["conv_id", "block", "codes"]).append_column("ends", pa.array(ends, vector))
                   .append_column("last", pa.array(last, pa.bool_())))

    def leaving(batches):
        for batch, rows in _each(batches, ["codes", "ends"]):
            out = [[walk(c, _least(e), s)[1] if e[s] < _FAR else s for s in range(4)] for c, e in rows]
            yield batch.append_column("leaves", pa.array(out, vector))

    def forward(batches):
        conv, state = object(), NONE
        for batch, rows in _each(batches, ["conv_id", "leaves"]):
            entered = []
            for c, leaves in rows:
                if c != conv:
                    conv, state = c, NONE
                entered.append(state)
                state = leaves[state]
            yield batch.select(["conv_id", "block", "codes", "ends", "last"]).append_column("entered", pa.array(entered, pa.int32()))

    def walking(batches):
        for batch, rows in _each(batches, ["codes", "ends", "last", "entered"]):
            out = []
            for c, e, last, s in rows:
                edits, state = walk(c, _least(e), s)
                out.append([*edits, closing(state) if last else ""])
            yield batch.select(["conv_id", "block", "codes"]).append_column("edits", pa.array(out, pa.list_(pa.string())))

    many, kept = tasks(blocks.sparkSession), "conv_id long, block long, codes binary"
    done = blocks.mapInArrow(matrices, f"{kept}, costs array<long>")
    done = done.repartition(many, "conv_id").sortWithinPartitions("conv_id", F.desc("block")).mapInArrow(
        backward, f"{kept}, ends array<long>, last boolean")
    done = done.repartition(many, "block").mapInArrow(leaving, f"{kept}, ends array<long>, last boolean, leaves array<long>")
    done = done.repartition(many, "conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(
        forward, f"{kept}, ends array<long>, last boolean, entered int")
    return done.repartition(many, "block").mapInArrow(walking, f"{kept}, edits array<string>")


def _least(end) -> Vector:
    """The vector less its least entry: the same edits, and fewer different vectors to remember."""
    low = min(end)
    return tuple(x - low for x in end)


class _Conversation:
    """What is gathered of one conversation while its turns pass by."""

    def __init__(self, conv):
        self.conv, self.state, self.closing, self.hash, self.lines = conv, NONE, "", hashlib.sha256(), 0
        self.gaps = self.blank = self.repeat = self.truncated = self.illegal = self.cost = 0
        self.audit: list[str] = []
        self.role = self.first = self.last = None
        self.turns = 0

    def line(self, role: str, text: str, out):
        self.hash.update(("\n" if self.lines else "").encode() + role.encode() + b":" + text.encode())
        if out is not None:
            out.append((self.conv, self.lines, role, text))
        self.lines += 1

    def edit(self, edits: str, out, role: str = "", text: str = "", code: int = 0):
        self.audit.append(edits)
        for e in edits:
            if e == "D":
                self.cost += DELETE
                continue
            if e == "I":
                self.cost, self.state = self.cost + INSERT, _NEXT[self.state]
                self.line(_NAMES[self.state], "", out)
                continue
            self.cost += 1 if code & TRUNCATED else 0
            if e == "R":
                self.cost, self.state = self.cost + RETYPE, _NEXT[self.state]
                self.line(_NAMES[self.state], text, out)
            else:
                self.state = code & 3
                self.line(role, text, out)

    def turn(self, turn, role: str, text: str, code: int, edits: str, out):
        kind = code & 3
        if self.role is not None and (self.role, kind) not in ((SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)):
            self.illegal += 1
        self.role = kind
        if code & BLANK:
            self.blank += 1
        elif code & REPEAT:
            self.repeat += 1
        elif code & TRUNCATED:
            self.truncated += 1
        if turn is not None:
            self.turns += turn != self.last
            self.first = turn if self.first is None else self.first
            self.last = turn
        self.edit(edits, out, role, text, code)

    def digest(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (self.conv, gaps, self.blank, self.repeat, self.truncated, self.illegal, self.cost, "".join(self.audit),
                self.hash.hexdigest())


_DIGEST = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
           "repaired_sha256 string")
_LINES = "conv_id long, place long, role string, text string"
_INT, _TEXT = pa.int64(), pa.string()


def _repaired(turns: DataFrame, ids: DataFrame, block: int, lines: bool) -> DataFrame:
    rows = materialise(_blocks(turns, block), "turns")
    alone = rows.where("codes is null").drop("codes")
    heads = rows.where("codes is not null").select("conv_id", "block", "codes").join(_repeats(alone), "block", "left")

    def mark(batches):
        for batch, items in _each(batches, ["codes", "places"]):
            out = []
            for codes, places in items:
                new = bytearray(codes)
                for p in places or ():
                    new[p] |= REPEAT
                out.append(bytes(new))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("block"), pa.array(out, pa.binary())],
                                             ["conv_id", "block", "codes"])

    done = edits_by_block(heads.select("conv_id", "block", "codes", "places").mapInArrow(mark, "conv_id long, block long, codes binary"))
    void = lambda kind: F.lit(None).cast(kind)
    columns = ["conv_id", "block", "place", "turn", "role", "text", "codes", "edits"]
    every = (alone.select("conv_id", "block", "place", "turn", "role", "text", void("binary").alias("codes"), void("array<string>").alias("edits"))
             .unionByName(done.select("conv_id", "block", F.lit(-1).alias("place"), void("long").alias("turn"), void("string").alias("role"),
                                      void("string").alias("text"), "codes", "edits"))
             .unionByName(ids.select("conv_id", F.lit(-1).cast("long").alias("block"), F.lit(-1).alias("place"), void("long").alias("turn"),
                                     void("string").alias("role"), void("string").alias("text"), void("binary").alias("codes"),
                                     void("array<string>").alias("edits"))))

    def gather(batches):
        one, codes, edits = None, b"", []
        for batch in slices(batches, "text", 4_000_000):
            made, out = [], [] if lines else None
            for conv, at, place, turn, role, text, c, e in zip(*(batch.column(n).to_pylist() for n in columns)):
                if place >= 0:
                    one.turn(turn, role, text, codes[place], edits[place], out)
                elif at >= 0:
                    codes, edits = c, e
                    one.closing = e[-1]
                else:
                    if one is not None:
                        one.edit(one.closing, out)
                        made.append(one.digest())
                    one = _Conversation(conv)
            yield _emitted(made, out)
        if one is not None:
            out = [] if lines else None
            one.edit(one.closing, out)
            yield _emitted([one.digest()], out)

    def _emitted(made, out):
        if lines:
            kinds = zip(("conv_id", "place", "role", "text"), (_INT, _INT, _TEXT, _TEXT))
            return pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in out], k) for i, (n, k) in enumerate(kinds)})
        names = [p.split(" ")[0] for p in _DIGEST.split(", ")]
        return pa.RecordBatch.from_pydict(
            {n: pa.array([r[i] for r in made], _TEXT if n in ("audit", "repaired_sha256") else _INT) for i, n in enumerate(names)})

    return (every.repartition(tasks(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "block", "place")
            .mapInArrow(gather, _LINES if lines else _DIGEST))


def _plain(turns: DataFrame) -> DataFrame:
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")))


def audits(turns: DataFrame, ids: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """Per conversation: gaps, counts of faults, cost, audit and repaired_sha256; ``ids`` are further conv_ids to list."""
    turns = _plain(turns)
    ids = (turns if ids is None else ids).select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    return _repaired(turns, ids, block, False)


def repaired_turns(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), role, text."""
    turns = _plain(turns)
    return _repaired(turns, turns.select("conv_id").distinct(), block, True)
