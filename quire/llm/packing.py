"""Packing of tokenised documents into training sequences: bounded-space online best fit.

Each partition reads its documents once and keeps WINDOWS open windows. What a document has beyond whole windows goes
into the open window that it leaves least room in; where none has room, the fullest window is topped up with the front of
the piece and emitted, and the rest of the piece is placed in turn. So windows leave full. At a partition's end its open
windows are merged into full ones and one rest; rests of GROUP partitions are merged in the same way, group by group, until
one is left. That last rest is cut at powers of two, at which a sequence needs no padding. A task holds WINDOWS + 1
windows at most; a merge holds GROUP rests.

Texts are encoded by units (letter runs and the like, see UnitTokenizer), each distinct one once. Texts that may hold
white space beyond ASCII are encoded whole.

Defined results: null counts as an empty text, which has its end id alone; ids may be null or repeat, each row is a
document; an empty table gives no piece; extra columns are not read.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import textkit as tk
from quire.llm.common import Workspace, arrow_pass

WINDOWS = 32
GROUP = 256
#: Distinct units that a worker remembers before it starts anew.
REMEMBER = 800_000

# Bytes: 1 letter, 2 digit or mark that ends no letter run's meaning, 4 what makes a chunk be encoded whole.
_KIND = np.full(256, 2, np.uint8)
_KIND[[*range(65, 91), *range(97, 123), 0xC3]] = 1
_KIND[[*range(0x00, 0x09), *range(0x0E, 0x20), 0x27, 0x7F]] = 4
_KIND[0x80:0xC3] = 4
_KIND[0xC4:] = 4
# Bytes that white space beyond ASCII, or control characters taken for it, may begin with.
_ODD = np.zeros(256, bool)
_ODD[[*range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True
_SLOTS = 22


class UnitTokenizer:
    """Token ids of texts, by a memory of units.

    The tokenizer lower-cases, drops white space, and takes letter runs and runs of other marks apart. A white-space chunk
    of Latin-1 letters, digits and ASCII marks but the apostrophe is therefore the same as its runs one by one, each run a
    unit; any other chunk is a unit whole. Units are known by a 64-bit hash of their lower-cased bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True  # their strings in a text are ordinary text
        self.last = np.zeros(self.tok.get_vocab_size(), bool)  # tokens that end a word
        for token, i in self.tok.get_vocab().items():
            self.last[i] = token.endswith("</w>")
        self.reset()

    def reset(self) -> None:
        self.slot = np.full(1 << _SLOTS, -1, np.int32)
        self.hash, self.start, self.size = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.flat = np.zeros(1 << 18, np.uint32)
        self.count = self.used = 0

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash in memory, -1 for none. A slot is tried at each of a few steps after the hash's own."""
        out = np.full(len(h), -1, np.int64)
        rest = np.arange(len(h))
        at = (h >> np.uint64(64 - _SLOTS)).astype(np.int64)
        while len(rest):
            k = self.slot[at]
            hit = (k >= 0) & (self.hash[k] == h[rest])
            out[rest[hit]] = k[hit]
            on = (k >= 0) & ~hit
            rest, at = rest[on], (at[on] + 1) & ((1 << _SLOTS) - 1)
        return out

    def _add(self, h: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        n, m = len(h), len(ids)
        while self.count + n > len(self.hash):
            self.hash, self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.hash, self.start, self.size))
        while self.used + m > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        k = np.arange(self.count, self.count + n)
        self.hash[k], self.size[k], self.start[k] = h, size, self.used + np.cumsum(size) - size
        self.flat[self.used : self.used + m] = ids
        at = (h >> np.uint64(64 - _SLOTS)).astype(np.int64)
        while len(k):  # open addressing; of those that want one slot the last gets it
            free = self.slot[at] < 0
            self.slot[at[free]] = k[free]
            on = self.slot[at] != k
            k, at = k[on], (at[on] + 1) & ((1 << _SLOTS) - 1)
        self.count, self.used = self.count + n, self.used + m

    def _learn(self, h: np.ndarray, units: list[str], letters: np.ndarray) -> None:
        """Letter runs give one word each, so many are encoded as one text and told apart by the tokens that end words."""
        words, other = np.flatnonzero(letters), np.flatnonzero(~letters)
        for i in range(0, len(words), 4096):
            k = words[i : i + 4096]
            ids = np.array(self.tok.encode(" ".join([units[j] for j in k]), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(k):
                self._add(h[k], np.diff(ends, prepend=0), ids)
            else:  # a vocabulary whose words cannot be told apart: one by one
                other = np.concatenate([other, k])
        for i in range(0, len(other), 4096):  # an encoding takes far more memory than its ids
            k = other[i : i + 4096]
            got = [e.ids for e in self.tok.encode_batch_fast([units[j] for j in k], add_special_tokens=False)]
            self._add(h[k], np.array([len(x) for x in got], np.int64), np.array([y for x in got for y in x], np.uint32))

    def _units(self, buf: np.ndarray, off: np.ndarray):
        """Starts and ends of units, whether they are letters, lower-cased bytes."""
        kind = _KIND[buf]
        low = tk.LOWER[buf]
        after = np.zeros(len(buf), bool)
        after[1:] = buf[:-1] == 0xC3
        after &= (buf >= 0x80) & (buf < 0xC0)
        kind[after & (buf != 0x97) & (buf != 0xB7)] = 1
        kind[after & ((buf == 0x97) | (buf == 0xB7))] = 4
        low[after & (buf <= 0x9E) & (buf != 0x97)] += 0x20
        s, e, _ = tk.word_spans(buf, off)
        bad = np.concatenate([[0], np.cumsum(kind == 4)])
        safe = bad[e] == bad[s]
        inner = np.zeros(len(buf) + 1, np.int32)
        inner[s[safe]] += 1
        inner[e[safe]] -= 1
        turn = np.zeros(len(buf), bool)
        turn[1:] = (kind[1:] != kind[:-1]) & (np.cumsum(inner[:-1])[1:] > 0)
        turn[s] = False
        cut = np.flatnonzero(turn & ~tk.SPACE[buf])
        s, e = np.sort(np.concatenate([s, cut])), np.sort(np.concatenate([e, cut]))
        return s, e, (kind[s] == 1) & (bad[e] == bad[s]), low

    def encode(self, col) -> list[np.ndarray]:
        """Ids of each row of an Arrow column of texts."""
        out: list[np.ndarray] = []
        for a, b, buf, off in tk.slices(col):
            if self.count > REMEMBER:
                self.reset()
            odd = np.concatenate([[0], np.cumsum(_ODD[buf])])
            whole = np.flatnonzero(odd[off[1:]] > odd[off[:-1]])
            s, e, letters, low = self._units(buf, off)
            h = tk.span_hash(tk.prefix_hash(low), s, e)
            k = self._find(h)
            miss = np.flatnonzero(k < 0)
            if len(miss):
                new, first = np.unique(h[miss], return_index=True)
                first = miss[first]
                raw = low.tobytes()
                for i in range(0, len(new), 1 << 17):
                    f = first[i : i + (1 << 17)]
                    self._learn(new[i : i + (1 << 17)], [raw[x:y].decode("utf-8", "replace") for x, y in zip(s[f].tolist(), e[f].tolist(), strict=True)], letters[f])
                k[miss] = self._find(h[miss])
            n = self.size[k]
            before = np.concatenate([[0], np.cumsum(n)])
            flat = self.flat[np.repeat(self.start[k] - before[:-1], n) + np.arange(before[-1])]
            at = before[np.searchsorted(s, off)]
            rows = [flat[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            for i in whole.tolist():
                rows[i] = np.array(self.tok.encode(buf[off[i] : off[i + 1]].tobytes().decode(), add_special_tokens=False).ids, np.uint32)
            out += rows
        return out


_tokenizers: dict[str, UnitTokenizer] = {}


def tokenizer(path: str) -> UnitTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = UnitTokenizer(path)
    return _tokenizers[path]


Piece = tuple  # (doc_id, start, doc_tokens, ids)


class Packer:
    """Open windows under best fit. full() gives windows as lists of pieces; rest() ends the packing."""

    def __init__(self, size: int, windows: int = WINDOWS):
        self.size, self.windows = size, windows
        self.open: list[tuple[int, int, list[Piece]]] = []  # (room, number, pieces), by room
        self.count = 0

    def _close(self, i: int, piece: Piece, n: int) -> tuple[list[Piece], Piece]:
        """Takes out window i, topped up with n ids of the piece; gives the rest of the piece."""
        _, _, pieces = self.open.pop(i)
        doc, start, total, ids = piece
        return [*pieces, (doc, start, total, ids[:n])], (doc, start + n, total, ids[n:])

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        doc, start, total, ids = piece
        while len(ids) >= self.size:
            yield [(doc, start, total, ids[: self.size])]
            start, ids = start + self.size, ids[self.size :]
        piece = (doc, start, total, ids)
        while n := len(piece[3]):
            i = bisect.bisect_left(self.open, (n,))
            if i < len(self.open):
                room, number, pieces = self.open.pop(i)
                if room == n:
                    yield [*pieces, piece]
                else:
                    bisect.insort(self.open, (room - n, number, [*pieces, piece]))
                return
            if len(self.open) < self.windows:
                self.count += 1
                bisect.insort(self.open, (self.size - n, self.count, [piece]))
                return
            done, piece = self._close(0, piece, self.open[0][0])
            yield done

    def merge(self) -> Iterator[list[Piece]]:
        """Empties the smallest windows into the fullest, until one rest is left in self.open."""
        while len(self.open) > 1:
            _, _, pieces = self.open.pop()
            for piece in pieces:
                while len(piece[3]):
                    if not self.open:
                        self.open.append((self.size - len(piece[3]), 0, [piece]))
                        break
                    room = self.open[0][0]
                    if len(piece[3]) < room:
                        _, number, have = self.open.pop(0)
                        bisect.insort(self.open, (room - len(piece[3]), number, [*have, piece]))
                        break
                    done, piece = self._close(0, piece, room)
                    yield done


def _powers(pieces: list[Piece]) -> Iterator[list[Piece]]:
    """A rest cut into sequences whose sizes are powers of two, the largest first."""
    left = sum(len(p[3]) for p in pieces)
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        seq = []
        while room:
            doc, start, total, ids = pieces[0]
            seq.append((doc, start, total, ids[:room]))
            pieces = [(doc, start + room, total, ids[room:]), *pieces[1:]] if len(ids) > room else pieces[1:]
            room -= len(seq[-1][3])
        yield seq


_SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary, ids_crc32 long, part long"
_FIELDS = pa.schema([(n.split()[0], pa.binary() if n.endswith("binary") else pa.int64()) for n in _SCHEMA.split(", ")])


class _Rows:
    """Collects output rows. A rest (part not null) keeps its ids; a sequence keeps them if they are asked for."""

    def __init__(self, first_id: int, keep_ids: bool):
        self.next, self.keep, self.cols = first_id, keep_ids, [[] for _ in _FIELDS]

    def put(self, pieces: list[Piece], part: int | None = None) -> None:
        at = 0
        for doc, start, total, ids in pieces:
            raw = ids.astype("<u4").tobytes()
            row = (doc, start, len(ids), total, self.next, at, raw if self.keep or part is not None else None, zlib.crc32(raw), part)
            for c, v in zip(self.cols, row, strict=True):
                c.append(v)
            at += len(ids)
        self.next += 1

    def take(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if len(self.cols[0]) >= least:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(self.cols, _FIELDS, strict=True)], schema=_FIELDS)
            self.cols = [[] for _ in _FIELDS]


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 1, windows: int = WINDOWS, keep_ids: bool = True) -> DataFrame:
    """A row per piece: (doc_id, start, length, doc_tokens, sequence_id, offset, ids, ids_crc32). ids are little-endian
    unsigned 32-bit numbers (null without keep_ids); ids_crc32 is their checksum."""
    ws = Workspace(docs.sparkSession, "packing")

    def run(batches):
        tok, packer, part = tokenizer(tokenizer_path), Packer(size, windows), TaskContext.get().partitionId()
        rows = _Rows(part << 30, keep_ids)
        end = np.array([end_id], np.uint32)
        for b in batches:
            for doc, ids in zip(b.column(0).to_pylist(), tok.encode(b.column(1)), strict=True):
                for seq in packer.add((doc, 0, len(ids) + 1, np.concatenate([ids, end]))):
                    rows.put(seq)
            yield from rows.take(2000)
        for seq in packer.merge():
            rows.put(seq)
        for _, _, pieces in packer.open:
            rows.put(pieces, part)
        yield from rows.take()

    def merging(group: int, last: bool):
        def merge(key, t):
            t = t.sort_by([("part", "ascending"), ("sequence_id", "ascending"), ("offset", "ascending")])
            number = key[0].as_py()
            packer, rows = Packer(size, windows), _Rows((group << 60) | (number << 30), keep_ids)
            for doc, start, total, raw in zip(*(t.column(k).to_pylist() for k in ("doc_id", "start", "doc_tokens", "ids")), strict=True):
                for seq in packer.add((doc, start, total, np.frombuffer(raw, "<u4"))):
                    rows.put(seq)
            for seq in packer.merge():
                rows.put(seq)
            for _, _, pieces in packer.open:
                if last:
                    for seq in _powers(pieces):
                        rows.put(seq)
                else:
                    rows.put(pieces, number)
            return pa.Table.from_batches(list(rows.take()), _FIELDS)

        return merge

    level = ws.save(arrow_pass(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, _SCHEMA))
    done, group = level.where("part is null"), 0
    while (parts := level.agg(F.max("part")).first()[0]) is not None:
        group += 1
        rests = level.where("part is not null").withColumn("g", F.floor(F.col("part") / GROUP).cast("long"))
        level = ws.save(rests.groupBy("g").applyInArrow(merging(group, parts < GROUP), _SCHEMA))
        done = done.union(level.where("part is null"))
    return done.drop("part")
