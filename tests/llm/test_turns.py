import hashlib
import random
import zlib
from functools import lru_cache
from itertools import product

import pytest

from wayfunnel.llm import turns

GRAMMAR = {"^": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def cheapest(rows):
    """Least cost and ASCII-least audit of (kind, initial, copies), by trying every edit at every turn."""
    flat = [(k, i) for kind, i, n in rows for k in [kind] * n]

    @lru_cache(None)
    def rest(at, state, inserted):
        best = (0, "") if at == len(flat) and state in "^a" else (turns.NEVER, "")
        options = []
        if at < len(flat):
            kind, initial = flat[at]
            options.append((2, "D", at + 1, state, 0))
            if kind != turns.FORCED:
                extra = 5 if kind == turns.CUT else 0
                for to, after in GRAMMAR[state].items():
                    if initial == to:
                        options.append((extra, "K", at + 1, after, 0))
                    elif to != "s":
                        options.append((extra + 1, "R", at + 1, after, 0))
        if inserted < 3:
            options += [(5, "I", at, after, inserted + 1) for to, after in GRAMMAR[state].items() if to != "s"]
        for cost, edit, *next_ in options:
            c, audit = rest(*next_)
            best = min(best, (c + cost, edit + audit))
        return best

    return rest(0, "^", 0)


def brute(conversations):
    """Every contract column by plain Python."""
    out = {}
    for conv in {c for c, *_ in conversations}:
        rows = []
        for c, turn, role, text in conversations:
            if c != conv:
                continue
            fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            if fault == 0:
                continue
            text = "" if fault == 1 else "".join(x for x in text if x not in ".!?") if fault == 2 else text
            role = "user" if fault == 4 else role
            rows += [(turn is not None, turn or 0, role, text)] * (2 if fault == 3 else 1)
        rows.sort()
        seen, kinds, blank, duplicate, truncated = set(), [], 0, 0, 0
        for _, _, role, text in rows:
            body = text.strip(" \t\n\x0b\x0c\r")
            if not body:
                blank, kind = blank + 1, turns.FORCED
            elif (role, text) in seen:
                duplicate, kind = duplicate + 1, turns.FORCED
            elif body[-1] not in ".!?":
                truncated, kind = truncated + 1, turns.CUT
            else:
                kind = turns.WHOLE
            seen.add((role, text))
            kinds.append((kind, role[:1], 1))
        cost, audit = cheapest(tuple(kinds))
        numbers = [t for known, t, *_ in rows if known]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[2][:1] + b[2][:1] not in turns.PAIRS for a, b in zip(rows, rows[1:]))
        lines, at, state = [], iter(rows), "^"
        for edit in audit:
            want = "a" if state == "u" else "u"
            role, text = {"u": "user", "a": "assistant"}[want], ""
            if edit != "I":
                _, _, own, text = next(at)
                role = own if edit == "K" else role
            if edit != "D":
                lines.append(f"{role}:{text}")
                state = role[0]
        out[conv] = (gaps, blank, duplicate, truncated, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def found(table):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)
            for r in turns.repaired_conversations(table).collect()}


@pytest.mark.parametrize("length", [1, 2, 3, 4])
def test_every_short_pattern(length):
    for initials in product("sua ", repeat=length):
        for cuts in product(".~", repeat=length):
            rows = tuple((turns.CUT if c == "~" else turns.WHOLE, i, 1) for i, c in zip(initials, cuts, strict=True))
            cost, _, audit = turns.aligned("".join(i + c for i, c in zip(initials, cuts, strict=True)), (0, turns.NEVER, turns.NEVER, 0), "^", True)["^"]
            assert (cost, audit) == cheapest(rows), rows


def conversation(r, conv, n, odd=0.2):
    out = []
    for turn in range(n):
        role = ("user", "assistant")[turn % 2] if r.random() > odd else r.choice(["system", "user", "assistant", "tool", "", None, "users"])
        text = r.choice(["Yes.", "No!", "What?  ", "cut", "", " \n", None, f"number {r.randrange(9)}.", f"so {turn}.", "Ja .", "x\x1c"])
        out.append((conv, turn if r.random() > .1 else r.choice([None, turn + 3, 0]), role, text))
    return out


def test_against_brute_force(spark, monkeypatch):
    r = random.Random(8)
    rows = [x for conv in range(60) for x in conversation(r, conv, r.randrange(1, 14), r.random())]
    rows += conversation(r, 1000, 300) + conversation(r, None, 25) + conversation(r, -5, 90, .9)
    rows += [(2000, 1, "user", "Hello.")] * 50 + [(2001, None, None, None)] * 3  # repeated rows, nothing but nulls
    rows += [(c, 0, "user", "Gone.") for c in range(3000, 3030)]  # some lose their only row
    rows += [(4000, 0, "user", "x " * 400_000 + "."), (4000, 1, "assistant", "." * 300_000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as n", "2 as kind", "3 as first")
    expected = brute(rows)
    assert found(table) == expected
    monkeypatch.setattr(turns, "STRETCH", 3)  # everything is cut into stretches
    monkeypatch.setattr(turns, "ROWS", 5)
    assert found(table.repartition(6)) == expected


def test_a_hot_conversation_lies_in_many_tasks(spark):
    r = random.Random(9)
    rows = conversation(r, 1, 3000) + [x for conv in range(2, 600) for x in conversation(r, conv, 8)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        from wayfunnel.llm._tables import Scratch
        scratch = Scratch(spark, "test")
        order = ("conv_id", "turn", "role", "text")
        marked = scratch.table(turns._marked(turns.damaged(table), scratch))
        read = turns._read(marked.repartitionByRange(8, *order).sortWithinPartitions(*order)).filter("open.conv_id = 1").select("open.*").toPandas()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(set(read["at"] // (1 << 33))) >= 3 and read["kinds"].map(len).max() <= turns.ROWS
    assert found(table)[1][:6] == tuple(list(found(table.filter("conv_id = 1")).values())[0][:6])


def test_empty_table(spark):
    table = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert found(table) == {}
