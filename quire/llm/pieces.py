"""SentencePiece encoding by forward filtering and backward sampling over the piece lattice, and lossless decoding.

A text is a blank and its bytes. Its lattice has an edge wherever the vocabulary has a piece (the blank stands for the
vocabulary's word mark), and byte edges for characters that no piece gives. A path's weight is exp(alpha * sum of its
pieces' scores). Forward filtering sums the weights of all paths to each node; backward sampling then draws, from the end,
each edge by its share of that sum, so a segmentation comes out with its exact probability. The draw depends on the row's
key, the chunk's place in the text and the step alone, not on how rows are dealt out. alpha None takes the best path.

No piece of the vocabulary holds a blank after another byte, or a line end with anything else (checked when it is read),
so no edge crosses the start of a run of blanks or a line end; the lattice falls into chunks there, and each distinct
chunk of a batch is filtered once. All steps are array operations over a batch's chunks.

Decoding joins the pieces' bytes and drops the first blank; decode(encode(text)) == text for every text.

Defined results: null and empty texts have no ids and decode to an empty text; null keys count as one key; repeated rows
with one key get the same ids; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import textkit as tk
from quire.llm.common import arrow_pass

_U = np.uint64
_SLOTS = 21


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.score = np.zeros(n)
        raw: list[bytes] = [b""] * n
        self.byte_id = np.full(256, -1, np.int32)
        normal = {}
        for i in range(n):
            piece = sp.id_to_piece(i)
            self.score[i] = sp.get_score(i)
            if sp.is_byte(i):
                raw[i] = bytes([int(piece[1:-1], 16)])
                self.byte_id[raw[i][0]] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                raw[i] = piece.replace("▁", " ").encode()
                normal[raw[i]] = i
                body = raw[i].lstrip(b" ")
                if b" " in body or b"\n" in raw[i] and len(raw[i]) > 1:
                    raise ValueError(f"piece {piece!r} crosses a chunk")
        if (self.byte_id < 0).any():
            raise ValueError("the vocabulary has no byte pieces")
        self.size = np.array([len(x) for x in raw], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.flat = np.frombuffer(b"".join(raw), np.uint8)
        # every prefix of a piece: its hash, and the piece that it is, if any
        prefixes = {p[:k]: normal.get(p[:k], -1) for p in normal for k in range(1, len(p) + 1)}
        keys = list(prefixes)
        buf = np.frombuffer(b"".join(keys), np.uint8)
        end = np.cumsum([len(k) for k in keys])
        h = tk.span_hash(tk.prefix_hash(buf), np.concatenate([[0], end[:-1]]), end)
        self.hash, self.piece = h, np.array([prefixes[k] for k in keys], np.int32)
        self.table = [np.full(1 << _SLOTS, -1, np.int32), np.full(1 << _SLOTS, -1, np.int32)]
        self.table[0][(h >> _U(64 - _SLOTS)).astype(np.int64)] = np.arange(len(h))
        lost = np.flatnonzero(self.table[0][(h >> _U(64 - _SLOTS)).astype(np.int64)] != np.arange(len(h)))
        slot = (h[lost] & _U((1 << _SLOTS) - 1)).astype(np.int64)
        self.table[1][slot] = lost
        if len(np.unique(slot)) < len(lost):
            raise ValueError("prefix table is too small")
        self.longest = int(max(map(len, normal)))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash among the prefixes, -1 for none."""
        k = self.table[0][(h >> _U(64 - _SLOTS)).astype(np.int64)]
        miss = np.flatnonzero((k < 0) | (self.hash[k] != h))
        if len(miss):
            m = self.table[1][(h[miss] & _U((1 << _SLOTS) - 1)).astype(np.int64)]
            k[miss] = np.where((m >= 0) & (self.hash[m] == h[miss]), m, -1)
        return k


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def _edges(v: Vocabulary, buf: np.ndarray, end_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, size, piece) of all lattice edges over concatenated chunks; end_of gives each byte's chunk end."""
    c = tk.prefix_hash(buf)
    at = np.arange(len(buf))
    start, size, piece = [], [], []
    for k in range(1, v.longest + 1):
        at = at[at + k <= end_of[at]]
        if not len(at):
            break
        found = v.find(tk.span_hash(c, at, at + k))
        at, found = at[found >= 0], found[found >= 0]
        hit = v.piece[found] >= 0
        start.append(at[hit])
        size.append(np.full(int(hit.sum()), k))
        piece.append(v.piece[found[hit]])
    s, n, p = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (start, size, piece))
    # byte edges over characters that no piece gives
    lead = (buf & 0xC0) != 0x80
    char_at = np.maximum.accumulate(np.where(lead, np.arange(len(buf)), 0))
    nxt = np.concatenate([np.flatnonzero(lead), [len(buf)]])
    width = nxt[np.searchsorted(nxt, char_at, "right")] - char_at
    whole = np.zeros(len(buf), bool)
    whole[s[n == width[s]]] = True
    bare = np.flatnonzero(~whole[char_at])
    return np.concatenate([s, bare]), np.concatenate([n, np.ones(len(bare), np.int64)]), np.concatenate([p, v.byte_id[buf[bare]]])


def encode(v: Vocabulary, buf: np.ndarray, off: np.ndarray, keys: np.ndarray, alpha: float | None = 2e-4, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of texts given as bytes and offsets; keys: 64-bit row keys."""
    n_docs = len(off) - 1
    size = np.diff(off)
    live = size > 0
    # each text that is not empty gets its first blank
    shift = np.concatenate([[0], np.cumsum(live)])
    pos = np.arange(len(buf)) + np.repeat(shift[1:], size)
    text = np.full(len(buf) + int(shift[-1]), 32, np.uint8)
    text[pos] = buf
    off = off + shift
    n = len(text)
    if not n:
        return np.zeros(0, np.int32), np.zeros(n_docs + 1, np.int64)
    head = np.zeros(n, bool)
    blank, line = text == 32, text == 10
    head[1:] = blank[1:] & ~blank[:-1] | line[1:] | line[:-1]
    head[off[:-1][live]] = True
    s = np.flatnonzero(head)
    e = np.concatenate([s[1:], [n]])
    doc = np.searchsorted(off, s, "right") - 1
    _, first, which = np.unique(tk.span_hash(tk.prefix_hash(text), s, e), return_index=True, return_inverse=True)
    # the distinct chunks, one after the other
    us, un = s[first], e[first] - s[first]
    base = np.concatenate([[0], np.cumsum(un)])
    take = np.repeat(us - base[:-1], un) + np.arange(base[-1])
    chunk = text[take]
    start, width, piece = _edges(v, chunk, np.repeat(base[1:], un))
    # a chunk's node q is its byte offset; the flat node number has a place more for each chunk before
    of = np.repeat(np.arange(len(un)), un)
    rel = np.arange(len(chunk)) - base[:-1][of]
    node_from, node_to = start + of[start], start + of[start] + width
    rel_to = rel[start] + width
    weight = v.score[piece] * (alpha if alpha is not None else 1.0)
    order = np.lexsort((-width, node_to, rel_to))
    node_from, node_to, rel_to, weight, piece, width = (x[order] for x in (node_from, node_to, rel_to, weight, piece, width))
    forward = np.zeros(int(base[-1]) + len(un))
    share = np.zeros(len(order))
    steps = np.searchsorted(rel_to, np.arange(1, int(un.max()) + 2))
    seg = np.concatenate([[0], np.flatnonzero(np.diff(node_to)) + 1]) if len(node_to) else np.zeros(0, np.int64)
    seg_at = np.searchsorted(seg, steps)
    for a, b, i, j in zip(steps[:-1], steps[1:], seg_at[:-1], seg_at[1:], strict=True):
        if a == b:
            continue
        val = forward[node_from[a:b]] + weight[a:b]
        cut = seg[i:j] - a
        total = np.logaddexp.reduceat(val, cut) if alpha is not None else np.maximum.reduceat(val, cut)
        forward[node_to[seg[i:j]]] = total
        rep = np.repeat(total, np.diff(np.concatenate([cut, [b - a]])))
        share[a:b] = np.exp(val - rep) if alpha is not None else val == rep
    cum = np.cumsum(share)
    lo = np.zeros(len(forward), np.int64)
    hi = np.zeros(len(forward), np.int64)
    lo[node_to[seg]] = seg
    hi[node_to[seg]] = np.concatenate([seg[1:], [len(node_to)]]) - 1
    # backward sampling, all chunks of the batch a step at a time
    ends = base[1:] + np.arange(len(un))
    tops = base[:-1] + np.arange(len(un))
    rank = np.arange(len(s)) - np.searchsorted(s, off[:-1])[doc]
    stream = tk.mix(tk.mix(keys[doc] + _U(seed)) + rank.astype(_U) * _U(0x9E3779B97F4A7C15))
    alive = np.arange(len(s))
    at = ends[which]
    goal = tops[which]
    taken, count, step = [], np.zeros(len(s), np.int64), 0
    while len(alive):
        here = at[alive]
        before = cum[lo[here]] - share[lo[here]]
        u = (tk.mix(stream[alive] + _U((step + 1) * 0xD1B54A32D192ED03 % 2**64)) >> _U(11)).astype(np.float64) * 2.0**-53
        room = cum[hi[here]] - before
        mark = before + u * room
        edge, last = lo[here], hi[here]
        on = np.flatnonzero((cum[edge] <= mark) & (edge < last))
        while len(on):  # edges of a node are few, the likely (long) ones first
            edge[on] += 1
            on = on[(cum[edge[on]] <= mark[on]) & (edge[on] < last[on])]
        taken.append((alive, piece[edge]))
        count[alive] += 1
        at[alive] = node_from[edge]
        alive = alive[at[alive] > goal[alive]]
        step += 1
    place = np.cumsum(count)
    ids = np.zeros(int(place[-1]), np.int32)
    for k, (who, got) in enumerate(taken):
        ids[place[who] - 1 - k] = got
    per_doc = np.zeros(n_docs + 1, np.int64)
    np.add.at(per_doc, doc + 1, count)
    return ids, np.cumsum(per_doc)


def decode(v: Vocabulary, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts of ids."""
    size = v.size[ids]
    total = np.concatenate([[0], np.cumsum(size)])
    flat = v.flat[np.repeat(v.start[ids] - total[:-1], size) + np.arange(total[-1])]
    at = total[off]
    some = np.diff(off) > 0
    keep = np.ones(len(flat), bool)
    keep[at[:-1][some]] = False
    return flat[keep], at - np.concatenate([[0], np.cumsum(some)])


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", alpha: float | None = 2e-4, seed: int = 0, output: str = "ids") -> DataFrame:
    """(doc_id, ids) of every row; with output "digest" (doc_id, n_pieces, ids_crc32, lossless) instead, from the ids and
    their decoding, so that a query over a large table need not write all ids."""
    import zlib

    ids_schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    digest_schema = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("lossless", pa.bool_())])

    def run(batches):
        v = vocabulary(model_path)
        for b in batches:
            key = np.asarray(b.column(0).fill_null(-1)).astype(np.int64).view(_U)
            for i, j, buf, off in tk.slices(b.column(1)):
                ids, at = encode(v, buf, off, key[i:j], alpha, seed)
                own = b.column(0).slice(i, j - i)
                if output == "ids":
                    yield tk.batch(ids_schema, doc_id=own, ids=pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids)))
                    continue
                back, back_at = decode(v, ids, at)
                same = np.array_equal(back, buf) and np.array_equal(back_at, off)
                ok = [same or bytes(back[back_at[k] : back_at[k + 1]]) == bytes(buf[off[k] : off[k + 1]]) for k in range(j - i)]
                raw = ids.astype("<u4")
                crc = [zlib.crc32(raw[at[k] : at[k + 1]].tobytes()) for k in range(j - i)]
                yield tk.batch(digest_schema, doc_id=own, n_pieces=np.diff(at), ids_crc32=crc, lossless=ok)

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if output == "ids":
        return arrow_pass(src, run, "doc_id long, ids array<int>")
    return arrow_pass(src, run, "doc_id long, n_pieces long, ids_crc32 long, lossless boolean")


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids decode to an empty text."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        v = vocabulary(model_path)
        for b in batches:
            rows = [np.array(x if x is not None else [], np.int64) for x in b.column(1).to_pylist()]
            flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            out, at = decode(v, flat, np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int64))
            yield tk.batch(schema, doc_id=b.column(0), text=[bytes(out[at[k] : at[k + 1]]).decode("utf-8", "replace") for k in range(len(rows))])

    return arrow_pass(encoded.select(F.col("doc_id").cast("long"), "ids"), run, "doc_id long, text string")
