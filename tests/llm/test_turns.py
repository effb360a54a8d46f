"""Conversation repair against a plain full table of costs and, on short conversations, all edit sequences."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from scorewright.llm import turn_repair

LEGAL = re.compile("(s?(ua)+)?")


def plain_damage(rows):
    for conv, turn, role, text in rows:
        name = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        role, text = name(role), name(text)
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        yield from [(conv, turn, role, text)] * (2 if kind == 3 else 1)


def faults(turns):
    seen, out = set(), []
    for _, role, text in turns:
        ink = re.sub(r"[\x20\x09-\x0D]+", "", text)
        out.append("blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(turns, marks):
    """(cost, audit, lines) from a full table over suffixes and the last initial, comparing whole audits."""
    def add(rest, cost, letter, *line):
        return rest[0] + cost, letter + rest[1], line + rest[2]

    # insertions: relax until nothing changes, per place from the end
    table = {}
    for i in range(len(turns), -1, -1):
        now = {}
        for shape in ("", "s", "u", "a"):
            now[shape] = one_step(i, shape, turns, marks, table, add)
        while True:
            new = {}
            for shape in now:
                options = [now[shape]]
                for role in ("user", "assistant"):
                    if role[0] in {"": "u", "s": "u", "u": "a", "a": "u"}[shape]:
                        options.append(add(now[role[0]], 2, "I", f"{role}:"))
                new[shape] = min(options, key=lambda x: x[:2])
            if new == now:
                break
            now = new
        table[i] = now
    return table[0][""]


def one_step(i, shape, turns, marks, table, add):
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}[shape]
    out = [(0, "", ())] if i == len(turns) and shape in ("", "a") else []
    if i < len(turns):
        _, role, text = turns[i]
        gone, extra, after = marks[i] in ("blank", "duplicate"), marks[i] == "truncated", table[i + 1]
        out.append(add(after[shape], 3, "D"))
        if not gone:
            if role[:1] and role[0] in follows:
                out.append(add(after[role[0]], extra, "K", f"{role}:{text}"))
            for new in ("user", "assistant"):
                if new[0] in follows:
                    out.append(add(after[new[0]], 2 + extra, "R", f"{new}:{text}"))
    return min(out, key=lambda x: x[:2]) if out else (10 ** 6, "~", ())


def plain_audits(rows, damage=True):
    groups = {conv: [] for conv, *_ in rows}
    for conv, *turn in (plain_damage(rows) if damage else rows):
        groups[conv].append(tuple(turn))
    for conv, turns in groups.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0))
        marks = faults(turns)
        shapes = [t[1][:1] for t in turns]
        cost, audit, lines = cheapest(turns, marks)
        numbers = [t[0] for t in turns if t[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        yield (conv, gaps, marks.count("blank"), marks.count("duplicate"), marks.count("truncated"),
               sum(a + b not in ("su", "ua", "au") for a, b in zip(shapes, shapes[1:])), cost, audit,
               hashlib.sha256("\n".join(lines).encode()).hexdigest())


def key(row):
    return tuple((x is not None, x) if not isinstance(x, str) else x for x in row)


def same(df, want):
    assert sorted(map(tuple, df.collect()), key=key) == sorted(want, key=key)


def test_conversations(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    same(turn_repair.audits(turn_repair.damaged(table), table), list(plain_audits(rows)))


def random_turns(seed, convs=60, longest=40):
    rng = random.Random(seed)
    rows = []
    for conv in range(convs):
        for turn in range(rng.randint(0, longest)):
            text = rng.choice(["Yes.", "no", "", " ", f"Line {turn}!", f"cut {turn}", "Again?", "ends. \n"])
            rows.append((conv, turn * rng.choice([1, 1, 2]) + 100 * turn, rng.choice(["user", "assistant", "system", "tool", "", "user", "assistant"]), text))
    return rows


@pytest.mark.parametrize("block", [1, 3, 1024])
def test_blocks_do_not_matter(spark, block):
    rows = random_turns(block)
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    same(turn_repair.audits(turns, block=block), list(plain_audits(rows, damage=False)))
    lines = turn_repair.repaired_turns(turns, block=block).collect()
    shapes = defaultdict(str)
    for r in sorted(lines, key=lambda r: (r.conv_id, r.place)):
        shapes[r.conv_id] += r.role[0]
    assert all(LEGAL.fullmatch(s) for s in shapes.values())


def all_edits(codes, most):
    """Every audit of at most ``most`` edits that gives a legal order, with its cost."""
    def go(i, shape, audit, cost):
        if len(audit) > most:
            return
        if i == len(codes) and shape in ("", "a"):
            yield cost, audit
        follows = {"": "su", "s": "u", "u": "a", "a": "u"}[shape]
        for new in "ua":
            if new in follows:
                yield from go(i, new, audit + "I", cost + 2)
        if i < len(codes):
            role, mark = codes[i]
            yield from go(i + 1, shape, audit + "D", cost + 3)
            if mark != "gone":
                extra = mark == "cut"
                if role in follows:
                    yield from go(i + 1, role, audit + "K", cost + extra)
                for new in "ua":
                    if new in follows:
                        yield from go(i + 1, new, audit + "R", cost + 2 + extra)

    return min(go(0, "", "", 0))


def test_walk_is_least_of_all_edits():
    rng = random.Random(4)
    roles, marks = {"-": 0, "s": 1, "u": 2, "a": 3}, {"": 0, "cut": turn_repair.TRUNCATED, "gone": turn_repair.BLANK}
    for _ in range(150):
        turns = [(rng.choice("-suau"), rng.choice(["", "", "cut", "gone"])) for _ in range(rng.randint(0, 5))]
        codes = bytes(roles[r] | marks[m] for r, m in turns)
        cost, audit = all_edits(turns, 11)
        edits, state = turn_repair.walk(codes, turn_repair.END, 0) if codes else ((), 0)
        assert "".join(edits) + turn_repair.closing(state) == audit
        assert turn_repair.through(turn_repair.matrix(codes), turn_repair.END)[0] == cost


def test_odd_turns(spark):
    rows = [(None, 1, "user", "a."), (None, 2, "assistant", "b."), (1, None, None, None), (1, None, "user", "x"), (1, 5, "user", "z."),
            (1, 5, "user", "z."), (1, 5, "user", "z."), (2, None, "system", ""), (3, 4, "Assistant", "é "), (4, 0, "user", "long. " * 50_000)]
    schema = "conv_id long, turn long, role string, text string, block long, place int, codes binary, edits string, code int, h1 long, tie long"
    table = spark.createDataFrame([(*r, 7, 3, b"x", "e", 1, 2, 3) for r in rows], schema)
    same(turn_repair.audits(turn_repair.damaged(table), table), list(plain_audits(rows)))
    none = spark.createDataFrame([], schema)
    assert turn_repair.audits(turn_repair.damaged(none), none).collect() == []
    gone = spark.createDataFrame([(9,)], "conv_id long")
    assert tuple(turn_repair.audits(none, gone).first()) == (9, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_one_long_conversation(spark):
    rng = random.Random(1)
    rows = [(0, i, rng.choice(["user", "assistant"]), rng.choice([f"t{i}.", f"t{i}", "same.", ""])) for i in range(4_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    same(turn_repair.audits(turns, block=100), list(plain_audits(rows, damage=False)))
