"""Repair of conversation structure by alignment with the alternating grammar.

A conversation's turns are aligned with each feasible length of the target, (user assistant)* with an optional system turn
in front, by Wagner and Fischer's table of edit costs. Targets of one ending share a table, as they differ in where they
begin; a cell holds the cost of turning the rest of the turns into the rest of the target. Ukkonen's band keeps the cells
whose rest alone, by its difference in length, doesn't cost more than a repair that is known already (the incumbent).
Back-pointers are followed by least initial first, and the audits of all lengths are compared by cost, then in ASCII order.

Long conversations are cut into stretches. Turns are sorted by ranges of (conversation, turn, ...), so that a conversation
of any size lies in many tasks, each of which cuts its turns into stretches and aligns those that may be continued for
every state of the grammar at both ends. A pass over the stretches, last to first, adds up the cheapest ways to the end;
with these every stretch finds its audit by itself; a pass from first to last picks the audits that fit and digests the
repaired turns. Both passes hold one stretch at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfunnel.llm._tables import Scratch
from wayfunnel.llm._text import lean

# Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
PAIRS = ("su", "ua", "au")  # adjacent initials that the grammar allows
SPACES = " \t\n\x0b\x0c\r"

NEVER = 1 << 60
STATES = "^sua"  # nothing yet, after a system turn, after a user's, after an assistant's
STRETCH = 128  # turns that are aligned at a time
ROWS = 1024  # turns in a stretch, those that have to go included
CHARACTERS = 1 << 22  # of a stretch's texts
SLACK = 3 * INSERT  # what it can cost to get from any state to any other
ROLES = {"s": "system", "u": "user", "a": "assistant"}
FORCED, WHOLE, CUT = 0, 1, 2  # kinds of turns: has to go, as it should be, truncated


# -- one stretch ----------------------------------------------------------------

def incumbent(turns: list[str]) -> int:
    """What a simple repair costs: delete truncated turns, keep or rerole the others in turn, complete the last pair."""
    cost, want = 0, "u"
    for initial, cut in turns:
        if cut == "~":
            cost += DELETE
            continue
        cost += 0 if initial == want else REROLE
        want = "a" if want == "u" else "u"
    return cost + (INSERT if want == "a" else 0)


def table(turns: list[str], ending: str, limit: int, open_end: bool) -> list[dict[int, int]]:
    """Wagner and Fischer's costs: for each turn and number of target roles left, of the rest of the turns to that rest.

    The target ends with ``ending`` and alternates. Only cells in the band of ``limit`` exist. Without an ``open_end``
    nothing can be inserted after the last turn.
    """
    other = "u" if ending == "a" else "a"
    count = len(turns)
    rows: list[dict[int, int]] = [{}] * (count + 1)
    rows[count] = {q: INSERT * q for q in range(limit // INSERT + 1)} if open_end else {0: 0}
    for i in range(count - 1, -1, -1):
        below, row, rest = rows[i + 1], {}, count - i
        initial, cut = turns[i]
        extra = TRUNCATED if cut == "~" else 0
        for q in range(max(0, rest - limit // DELETE), rest + limit // INSERT + 1):
            best = below.get(q, NEVER) + DELETE
            if q:
                want = ending if q % 2 else other
                best = min(best, row.get(q - 1, NEVER) + INSERT, below.get(q - 1, NEVER) + extra + (initial != want) * REROLE)
            if best <= limit:
                row[q] = best
        rows[i] = row
    return rows


def follow(turns: list[str], rows: list[dict[int, int]], ending: str, i: int, q: int) -> str:
    """The ASCII-least of the cheapest audits from a cell on."""
    other = "u" if ending == "a" else "a"
    out = []
    while i < len(turns) or q:
        cost = rows[i][q]
        if i < len(turns) and rows[i + 1].get(q, NEVER) + DELETE == cost:
            out.append("D")
            i += 1
        elif q and rows[i].get(q - 1, NEVER) + INSERT == cost:
            out.append("I")
            q -= 1
        else:
            out.append("K" if turns[i][0] == (ending if q % 2 else other) else "R")
            i, q = i + 1, q - 1
    return "".join(out)


@lru_cache(10_000)
def aligned(pattern: str, ends: tuple[int, ...], entries: str, last: bool) -> dict[str, tuple[int, str, str]]:
    """For each entry state the cheapest cost with what follows, the state at the end, and the least such audit.

    ``pattern`` has an initial and ``~`` (truncated) or ``.`` for each turn that may stay; ``ends`` is what the way from
    each of ``STATES`` to the end costs. Turns can be put in after the ``last`` ones only; before others they belong to what
    follows.
    """
    turns = [pattern[i:i + 2] for i in range(0, len(pattern), 2)]
    count, out = len(turns), {}
    limit = incumbent(turns)
    if not last or entries != STATES[0]:
        limit += SLACK
    if not last:
        limit += max((e for e in ends[2:] if e < NEVER), default=0) - min((e for e in ends if e < NEVER), default=0)
    tables = {x: table(turns, x, limit, last) for x in "ua" if ends[STATES.index(x)] < NEVER}
    for entry in entries:
        found = []
        stay = DELETE * count + ends[STATES.index(entry)]
        if stay < NEVER:
            found.append((stay, entry, None))
        for ending, rows in tables.items():
            after = ends[STATES.index(ending)]
            starts = "u" if entry != "u" else "a"
            odd = ending == starts  # the number of roles from the one that is due to the ending
            found += [(cost + after, ending, (0, q)) for q, cost in rows[0].items() if q and q % 2 == odd]
            if entry == "^":  # a system turn can come first where all before it are deleted
                odd = ending == "u"
                found += [(DELETE * i + (TRUNCATED if turns[i][1] == "~" else 0) + cost + after, ending, (i + 1, q))
                          for i in range(count) if turns[i][0] == "s" for q, cost in rows[i + 1].items() if q and q % 2 == odd]
        if entry == "^" and ends[1] < NEVER:
            found += [(DELETE * (count - 1) + (TRUNCATED if turns[i][1] == "~" else 0) + ends[1], "s", (i + 1, 0))
                      for i in range(count) if turns[i][0] == "s"]
        least = min((f[0] for f in found), default=NEVER)
        best = []
        for cost, ending, at in found:
            if cost == least:
                if at is None:
                    audit = "D" * count
                elif ending == "s":
                    audit = "D" * (at[0] - 1) + "K" + "D" * (count - at[0])
                else:
                    lead = "" if at[0] == 0 else "D" * (at[0] - 1) + "K"
                    audit = lead + follow(turns, tables[ending], ending, *at)
                best.append((audit, ending))
        if best:
            audit, ending = min(best)
            out[entry] = (least, ending, audit)
    return out


def costs(pattern: str) -> tuple[list[int], list[int]]:
    """Of a stretch that goes on: costs from each state to each (16 numbers), and from each to the end if it is the last."""
    through = [NEVER] * 16
    for end in range(4):
        only = tuple(0 if i == end else NEVER for i in range(4))
        for state, found in aligned(pattern, only, STATES, False).items():
            through[4 * STATES.index(state) + end] = found[0]
    final = aligned(pattern, (0, NEVER, NEVER, 0), STATES, True)
    return through, [final[s][0] if s in final else NEVER for s in STATES]


def woven(kinds: bytes, copies: list[int], audit: str) -> str:
    """The audit with the deletions of turns that have to go, each as soon as it is reached."""
    out, rest = [], iter(audit)
    for kind, n in zip(kinds, copies, strict=True):
        if kind == FORCED:
            out.append("D" * n)
            continue
        for edit in rest:
            out.append(edit)
            if edit != "I":
                break
    return "".join(out) + "".join(rest)


def repaired(kinds: bytes, roles: list[str], texts: list[str], audit: str, state: str) -> tuple[list[str], str]:
    """The turns that stay or are put in, and the state after them; ``audit`` without turns that have to go."""
    out, at = [], (i for i, kind in enumerate(kinds) if kind != FORCED)
    for edit in audit:
        want = "a" if state == "u" else "u"
        if edit == "I":
            out.append(f"{ROLES[want]}:")
            state = want
            continue
        i = next(at)
        if edit == "K":
            out.append(f"{roles[i]}:{texts[i]}")
            state = roles[i][0]
        elif edit == "R":
            out.append(f"{ROLES[want]}:{texts[i]}")
            state = want
    return out, state


# -- turns as they are read -------------------------------------------------------

def damaged(conversations: DataFrame) -> DataFrame:
    """Turns with planted faults, told by crc32 of ``conv_id:turn`` modulo 20; a null counts as one space.

    0 drops a row, 1 empties its text, 2 removes its full stops, question and exclamation marks, 3 repeats it, 4 makes it
    the user's.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    fault = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", space)
    return conversations.select("conv_id", "turn", "role", "text").withColumn("fault", fault).filter("fault <> 0").select(
        "conv_id", "turn",
        F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.coalesce("role", space)).alias("role"),
        F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(F.col("fault") == 3, F.lit(2)).otherwise(F.lit(1)).alias("copies"))


def _marked(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """Different turns with their number of copies, their kind, and how many are blank or duplicate."""
    names = [F.xxhash64(F.lit(i), F.col("conv_id").isNull(), "conv_id", "role", "text").alias(f"h{i}") for i in (1, 2)]
    single = scratch.table(turns.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").cast("long").alias("n"))
                           .select("*", F.substring(F.rtrim("text", F.lit(SPACES)), -1, 1).alias("end"), *names))
    place = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    first = scratch.table(single.filter("end <> ''").groupBy("h1", "h2").agg(F.min(place).alias("first")))
    blank = F.col("end") == ""
    told = single.join(first, ["h1", "h2"], "left")
    duplicates = F.when(blank, F.lit(0)).when(F.col("first") == place, F.col("n") - 1).otherwise(F.col("n"))
    kind = F.when(F.col("n") == F.when(blank, F.col("n")).otherwise(duplicates), FORCED).when(F.col("end").isin(".", "!", "?"), WHOLE).otherwise(CUT)
    return told.select("conv_id", "turn", "role", "text", F.when(blank, F.col("n")).otherwise(0).alias("blank"),
                       duplicates.alias("duplicate"), kind.alias("kind"), "n")


class Stretch:
    """Turns of one conversation in order, as far as they were read."""

    def __init__(self, conv: int | None, begins: bool):
        self.conv, self.begins = conv, begins  # at the beginning of a task's turns, or cut off from earlier ones
        self.roles, self.texts, self.kinds, self.copies = [], [], bytearray(), []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = self.kept = self.size = 0
        self.first = self.last = self.head = self.tail = None

    def add(self, turn: int | None, role: str, text: str, blank: int, duplicate: int, kind: int, n: int) -> None:
        initial = role[:1]
        if self.head is None:
            self.head = initial
        else:
            self.illegal += self.tail + initial not in PAIRS
        self.tail = initial
        self.illegal += n - 1  # a role never follows itself
        if turn is not None:
            self.turns += turn != self.last
            self.first = turn if self.first is None else self.first
            self.last = turn
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += kind == CUT
        for forced, count in ((False, 1), (True, n - 1)) if kind != FORCED else ((True, n),):
            if count:
                self.kinds.append(FORCED if forced else kind)
                self.copies.append(count)
                self.roles.append(role)
                self.texts.append("" if forced else text)
                self.kept += not forced
                self.size += len(self.texts[-1])

    @property
    def full(self) -> bool:
        return self.kept >= STRETCH or len(self.kinds) >= ROWS or self.size >= CHARACTERS


def pattern(kinds: bytes, roles: list[str]) -> str:
    return "".join((role[:1] or " ") + ("~" if kind == CUT else ".") for kind, role in zip(kinds, roles, strict=True) if kind != FORCED)


COUNTS = "blank long, duplicate long, truncated long, illegal long"
ENDS = "first long, last long, turns long, head string, tail string"
OPEN = f"at long, conv_id long, {COUNTS}, {ENDS}, kinds binary, copies array<long>, roles array<string>, texts array<string>, through array<long>, final array<long>"
DONE = f"conv_id long, gaps long, {COUNTS}, cost long, audit string, repaired_sha256 string"


def _gaps(first: int | None, last: int | None, turns: int) -> int:
    return 0 if first is None else last - first + 1 - turns


def _read(turns: DataFrame) -> DataFrame:
    """Rows for sorted turns: finished conversations (``done``) and stretches of those that may go on elsewhere (``open``)."""
    names = ("conv_id", "turn", "role", "text", "blank", "duplicate", "kind", "n")

    def finished(s: Stretch) -> dict:
        cost, _, audit = aligned(pattern(s.kinds, s.roles), (0, NEVER, NEVER, 0), "^", True)["^"]
        text = "\n".join(repaired(s.kinds, s.roles, s.texts, audit, "^")[0])
        forced = sum(n for kind, n in zip(s.kinds, s.copies) if kind == FORCED)
        return {"conv_id": s.conv, "gaps": _gaps(s.first, s.last, s.turns), "blank": s.blank, "duplicate": s.duplicate, "truncated": s.truncated,
                "illegal": s.illegal, "cost": cost + DELETE * forced, "audit": woven(s.kinds, s.copies, audit),
                "repaired_sha256": hashlib.sha256(text.encode()).hexdigest()}

    def unfinished(s: Stretch, at: int) -> dict:
        through, final = costs(pattern(s.kinds, s.roles))
        return {"at": at, "conv_id": s.conv, "blank": s.blank, "duplicate": s.duplicate, "truncated": s.truncated, "illegal": s.illegal,
                "first": s.first, "last": s.last, "turns": s.turns, "head": s.head, "tail": s.tail, "kinds": bytes(s.kinds), "copies": s.copies,
                "roles": s.roles, "texts": s.texts, "through": through, "final": final}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("done", pa.struct(_arrow(DONE))), ("open", pa.struct(_arrow(OPEN)))])
        at, now, rows, weight = TaskContext.get().partitionId() << 33, None, [], 0

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(rows, schema=schema)

        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(name)) for name in names]
            for lo in range(0, batch.num_rows, 1024):
                for conv, *turn in zip(*(c.slice(lo, 1024).to_pylist() for c in columns)):
                    if now is None or now.conv != conv or now.full:
                        same = now is not None and now.conv == conv
                        if now is not None:
                            rows.append({"open": unfinished(now, at)} if now.begins or same else {"done": finished(now)})
                            at += 1
                        now = Stretch(conv, now is None or same)
                    now.add(*turn)
                    weight += len(turn[2]) + 64
                    if weight > 1 << 22:
                        yield packed()
                        rows, weight = [], 0
        if now is not None:
            rows.append({"open": unfinished(now, at)})
        if rows:
            yield packed()

    return turns.select(*names).mapInArrow(lean(run), f"done struct<{_typed(DONE)}>, open struct<{_typed(OPEN)}>")


def _typed(fields: str) -> str:
    """Columns as the fields of a struct."""
    return ", ".join(f"{name}:{kind}" for name, kind in (x.split(" ", 1) for x in fields.split(", ")))


def _arrow(fields: str) -> list[pa.Field]:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    kinds |= {f"array<{name}>": pa.list_(kind) for name, kind in kinds.items()}
    return [pa.field(name, kinds[kind]) for name, kind in (x.split(" ", 1) for x in fields.split(", "))]


def _ways(stretches: DataFrame) -> DataFrame:
    """For each stretch of a conversation what the cheapest way from each state after it costs (``ends``; null after the last)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, ahead = (), None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if conv != (row["conv_id"],):
                    conv, ahead = (row["conv_id"],), None
                out.append({"at": row["at"], "ends": ahead})
                ahead = row["final"] if ahead is None else [
                    min(NEVER, *(row["through"][4 * s + e] + ahead[e] for e in range(4))) for s in range(4)]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("at", pa.int64()), ("ends", pa.list_(pa.int64()))]))

    sorted_back = stretches.select("conv_id", "at", "through", "final").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("at"))
    return sorted_back.mapInArrow(run, "at long, ends array<long>")


def _audits(stretches: DataFrame) -> DataFrame:
    """For each stretch and state at its beginning the audit and the state at its end; ``ends`` as ``_ways`` gives them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                ends = (0, NEVER, NEVER, 0) if row["ends"] is None else tuple(row["ends"])
                found = aligned(pattern(row["kinds"], row["roles"]), ends, STATES, row["ends"] is None)
                out.append({"at": row["at"], "audits": [found[s][2] if s in found else None for s in STATES],
                            "states": "".join(found[s][1] if s in found else "-" for s in STATES)})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("at", pa.int64()), ("audits", pa.list_(pa.string())), ("states", pa.string())]))

    return stretches.select("at", "kinds", "roles", "ends").mapInArrow(lean(run), "at long, audits array<string>, states string")


def _joined(stretches: DataFrame) -> DataFrame:
    """Finished conversations from their stretches in order; one stretch at a time is held, and the audit so far."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, now = pa.schema(_arrow(DONE)), None

        def result() -> pa.RecordBatch:
            now["gaps"] = _gaps(now.pop("first"), now.pop("last"), now.pop("turns"))
            now["audit"], now["repaired_sha256"] = "".join(now["audit"]), now.pop("digest").hexdigest()
            return pa.RecordBatch.from_pylist([now], schema=schema)

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if now is None or now["conv_id"] != row["conv_id"]:
                    if now is not None:
                        yield result()
                    now = {"conv_id": row["conv_id"], "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": [],
                           "first": None, "last": None, "turns": 0, "digest": hashlib.sha256(), "state": "^", "tail": None, "begun": False}
                for name in ("blank", "duplicate", "truncated", "illegal", "turns"):
                    now[name] += row[name]
                now["turns"] -= row["first"] is not None and row["first"] == now["last"]  # a turn that was cut in two
                now["illegal"] += now["tail"] is not None and now["tail"] + row["head"] not in PAIRS
                now["first"] = row["first"] if now["first"] is None else now["first"]
                now["last"] = now["last"] if row["last"] is None else row["last"]
                now["tail"] = row["tail"]
                audit = row["audits"][STATES.index(now["state"])]
                lines, now["state"] = repaired(row["kinds"], row["roles"], row["texts"], audit, now["state"])
                if lines:
                    now["digest"].update((("\n" if now["begun"] else "") + "\n".join(lines)).encode())
                    now["begun"] = True
                now["audit"].append(woven(row["kinds"], row["copies"], audit))
                now["cost"] += _cost(row["kinds"], row["copies"], audit)
        if now is not None:
            yield result()

    return stretches.repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(lean(run), DONE)


def _cost(kinds: bytes, copies: list[int], audit: str) -> int:
    """What the edits of an audit cost, deletions of turns that have to go included."""
    kept = iter(kind for kind in kinds if kind != FORCED)
    total = DELETE * sum(n for kind, n in zip(kinds, copies) if kind == FORCED)
    for edit in audit:
        if edit == "I":
            total += INSERT
            continue
        cut = next(kept) == CUT
        total += DELETE if edit == "D" else (TRUNCATED if cut else 0) + (REROLE if edit == "R" else 0)
    return total


def repair(turns: DataFrame) -> DataFrame:
    """Faults and the cheapest repair of each conversation in ``turns`` (``conv_id``, ``turn``, ``role``, ``text``, ``copies``).

    Returns ``conv_id``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit`` and
    ``repaired_sha256``. Turns go by ``turn`` (nulls first), then role and text. ``copies`` says how often a row stands
    there; equal rows count as such copies. Ids and turns are integers; a null id is a conversation of its own.
    """
    spark, scratch = turns.sparkSession, Scratch(turns.sparkSession, "turns")
    typed = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text", "copies")
    marked = scratch.table(_marked(typed, scratch))
    order = ("conv_id", "turn", "role", "text")
    read = scratch.table(_read(marked.repartitionByRange(*order).sortWithinPartitions(*order)))
    done = read.filter("done is not null").select("done.*")
    stretches = read.filter("open is not null").select("open.*")
    ways = scratch.table(_ways(stretches))
    audits = scratch.table(_audits(stretches.join(ways, "at")))
    return done.unionByName(_joined(stretches.drop("through", "final").join(audits, "at")))


def repaired_conversations(conversations: DataFrame) -> DataFrame:
    """``repair`` of ``conversations`` after planted faults (``damaged``), a row for every conversation there was.

    Those without any row left have zeros, an empty audit and the digest of an empty text. Null roles and texts are one
    space. Other columns are ignored; an empty table has no rows.
    """
    scratch = Scratch(conversations.sparkSession, "conversations")
    fixed = scratch.table(repair(damaged(conversations)))
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    gone = every.join(fixed.select(F.col("conv_id").alias("c")), F.col("conv_id").eqNullSafe(F.col("c")), "left_anti")
    zero = F.lit(0).cast("long")
    columns: list[Column] = [zero.alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return fixed.unionByName(gone.select("conv_id", *columns, F.lit("").alias("audit"), F.sha2(F.lit(""), 256).alias("repaired_sha256")))
