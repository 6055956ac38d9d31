"""Token ids packed into rows of one length by best fit decreasing.

Texts are encoded; texts over the length are split into pieces without loss. Pieces are dealt evenly over groups of
bounded size, and each group is packed: pieces from long to short, each into the row with the least room that still
takes it, found by a segment tree over the amounts of room. A packed row holds the ids, the cumulative lengths of its
segments, and positions that start again at each segment.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfunnel.llm._text import lean, row_key

LENGTH = 2048
GROUP_BYTES = 4 << 20  # text in a group
#: Fixed value: how the vocabulary's text is cut before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Ids of whole texts. Words are not kept: the library encodes faster than a table of known words is read."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        self.end = max(ranks.values()) + 1
        self._encode = tiktoken.Encoding("packed", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(self, text: str) -> np.ndarray:
        return np.array(self._encode(text), np.uint32)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Room:
    """Rows by their room, with a segment tree that finds the least room of at least some size."""

    def __init__(self, length: int):
        self.leaves = 1 << length.bit_length()
        self.any = [False] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        node = self.leaves + room
        while node and not self.any[node]:
            self.any[node] = True
            node //= 2

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return (room, row) with the least room of at least ``size``."""
        node = self.leaves + size
        while not self.any[node]:
            while node & 1:  # from a right child go up
                node //= 2
                if node <= 1:
                    return None
            node += 1  # to the sibling at the right
        while node < self.leaves:
            node = 2 * node if self.any[2 * node] else 2 * node + 1
        room = node - self.leaves
        row = self.rows[room].pop()
        if not self.rows[room]:
            self.any[node] = False
            node //= 2
            while node:
                self.any[node] = self.any[2 * node] or self.any[2 * node + 1]
                node //= 2
        return room, row


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Places of the pieces in each row; equal sizes keep their order."""
    room, rows = Room(length), []
    for piece in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = room.take(sizes[piece])
        if found is None:
            left, row = length, len(rows)
            rows.append([])
        else:
            left, row = found
        rows[row].append(piece)
        if left > sizes[piece]:
            room.put(left - sizes[piece], row)
    return rows


def packed(docs: DataFrame, path: str, length: int = LENGTH, *, group_bytes: int = GROUP_BYTES, id_column: str = "doc_id",
           text_column: str = "text", binary: bool = True) -> DataFrame:
    """Rows of ``length`` ids from all whole texts, encoded with the rank file ``path``.

    Returns ``group`` and ``row``, ``n_tokens``, ``n_segments``, ``cu_seqlens`` (0 and the end of each segment),
    ``segments`` (id of the text, number of its first token), ``ids_sha256`` and ``positions_sha256`` and, where asked
    for, ``ids`` and ``positions``: 32-bit little-endian numbers; what the segments leave is filled with the first
    unused id and position 0. Null and empty texts give no segment; repeated rows are packed each; other columns are
    not read. Rows are dealt to groups by a hash and their place in the input, so copies spread; a text's pieces stay
    together in one group.
    """
    total = docs.agg(F.sum(F.octet_length(text_column))).first()[0] or 0
    groups = max(1, -(-total // group_bytes))
    kind = docs.schema[id_column].dataType.simpleString()
    keyed = docs.select(F.col(id_column).alias("_id"), row_key(docs, id_column, text_column)[0], F.col(text_column).alias("text"))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                deal = (part.column(1).to_numpy().astype(np.uint64) + np.arange(lo, lo + part.num_rows, dtype=np.uint64)) % np.uint64(groups)
                ids = [own.ids(t.as_py() or "").tobytes() for t in part.column(2)]
                yield pa.RecordBatch.from_arrays([pa.array(deal.astype(np.int32)), part.column(0), part.column(1), pa.array(ids, pa.large_binary())
                                                  .cast(pa.binary())], names=["group", "_id", "_r1", "ids"])

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_r1", "ascending"), ("_id", "ascending")])
        texts = [np.frombuffer(x.as_py(), np.uint32) for x in table.column("ids")]
        pieces = [(i, at) for i, ids in enumerate(texts) for at in range(0, len(ids), length)]
        names = table.column("_id").to_pylist()
        columns: dict[str, list] = {n: [] for n in ("row", "n_tokens", "n_segments", "cu", "segments", "ids", "positions")}
        fill = encoder(path).end
        for number, row in enumerate(best_fit_decreasing([min(length, len(texts[i]) - at) for i, at in pieces], length)):
            parts = [texts[i][at:at + length] for i, at in (pieces[p] for p in row)]
            ends = np.cumsum([0, *map(len, parts)])
            ids, positions = np.full(length, fill, "<u4"), np.zeros(length, "<u4")
            ids[:ends[-1]] = np.concatenate(parts)
            positions[:ends[-1]] = np.concatenate([np.arange(len(x)) for x in parts])
            for name, value in zip(columns, (number, int(ends[-1]), len(row), ends.tolist(), [
                    {"id": names[pieces[p][0]], "first": pieces[p][1]} for p in row], ids.tobytes(), positions.tobytes()), strict=True):
                columns[name].append(value)
        id_type = table.schema.field("_id").type
        segment = pa.list_(pa.struct([("id", id_type), ("first", pa.int32())]))
        group = table.column("group")[0].as_py() if table.num_rows else 0
        digests = [pa.array([hashlib.sha256(x).hexdigest() for x in columns[n]], pa.string()) for n in ("ids", "positions")]
        out = [pa.array([group] * len(columns["row"]), pa.int32()), pa.array(columns["row"], pa.int32()), pa.array(columns["n_tokens"], pa.int32()),
               pa.array(columns["n_segments"], pa.int32()), pa.array(columns["cu"], pa.list_(pa.int32())), pa.array(columns["segments"], segment), *digests]
        if binary:
            out += [pa.array(columns[n], pa.binary()) for n in ("ids", "positions")]
        return pa.Table.from_arrays(out, names=["group", "row", "n_tokens", "n_segments", "cu_seqlens", "segments", "ids_sha256", "positions_sha256",
                                                *["ids", "positions"] * binary])

    schema = (f"group int, row int, n_tokens int, n_segments int, cu_seqlens array<int>, segments array<struct<id: {kind}, first: int>>, "
              "ids_sha256 string, positions_sha256 string" + ", ids binary, positions binary" * binary)
    return (keyed.mapInArrow(lean(encoded), f"group int, _id {kind}, _r1 long, ids binary").filter(F.length("ids") > 0)
            .groupBy("group").applyInArrow(pack, schema))
