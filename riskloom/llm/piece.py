"""SentencePiece encoding with seeded merge-dropout, and decoding.

Encoding starts from single characters and merges the adjacent pair of the best score, leftmost first, until none is left: the agenda of a
merge-type model. Each candidate pair, told by where its two symbols begin and end in the document, is skipped if a hash keyed with the seed and
doc_id falls below the dropout. So another seed or document segments the same words in another way, while the same call always gives the
same ids, and all of them decode to the same text.

The agenda runs over many segments at once. No merge can cross two neighbouring characters that are neighbours in no piece, so texts fall
apart there into short segments, which lie as rows of a matrix; each round merges the best pair of every row. Long segments take a heap.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, read, text_slices

DROPOUT, SEED = 0.1, 1
MODEL = "piece_bpe_32k.model"
_NONE = np.uint32(2**32 - 1)
_SPACE = 0x2581
#: Longest segment that the matrix takes.
WIDEST = 48
_STEPS = [2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 24, 32, WIDEST]
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """A merge-type SentencePiece model with byte fallback, as tables."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.piece = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        ids = {self.piece[i]: i for i in plain}
        byte = {int(self.piece[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        if len(byte) < 256:
            raise ValueError("the model has no byte fallback")
        self.byte = np.array([byte[b] for b in range(256)], np.int32)
        scores = np.array([sp.get_score(i) for i in range(n)])
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        self.raw = [b""] * n
        for i in plain:
            self.raw[i] = self.piece[i].replace("▁", " ").encode()
        for b, i in byte.items():
            self.raw[i] = bytes([b])
        # Characters that pieces have: their symbol, and a small number for the table of neighbours.
        chars = sorted({c for p in ids for c in p})
        self.symbol, self.small = np.full(0x110000, -1, np.int32), np.zeros(0x110000, np.int32)
        joined = sorted({c for p in ids if len(p) > 1 for c in p})
        for c in chars:
            self.symbol[ord(c)] = ids.get(c, -1)
        for k, c in enumerate(joined):
            self.small[ord(c)] = k + 1
        self.side = len(joined) + 1
        neighbours = {(p[i], p[i + 1]) for p in ids for i in range(len(p) - 1)}
        #: 0: no piece has the two side by side; 1: some piece has them inside; 2 + id: they are a piece.
        self.pair = np.zeros(self.side * self.side, np.uint16)
        for a, b in neighbours:
            both = ids.get(a + b) if a in ids and b in ids else None
            self.pair[self.small[ord(a)] * self.side + self.small[ord(b)]] = 1 if both is None else both + 2
        merges = {}
        for p, i in ids.items():
            for k in range(1, len(p)):
                a, b = ids.get(p[:k]), ids.get(p[k:])
                if a is not None and b is not None:
                    merges[a * n + b] = i
        self.n = n
        self._hash(merges)

    def _hash(self, merges: dict[int, int]) -> None:
        """A table without collisions: keys of a bucket are moved together until all their slots are free."""
        bits = max(10, (4 * len(merges)).bit_length())
        keys = np.array(sorted(merges), np.uint64)
        self.mask, self.top, self.low = np.uint64((1 << bits) - 1), np.uint64(64 - bits + 2), np.uint64(64 - 2 * bits if bits < 22 else 20)
        for odd in _K:
            h = keys * odd
            bucket, base = (h >> self.top).astype(np.int64), ((h >> self.low) & self.mask).astype(np.int64)
            self.odd, self.moved = odd, np.zeros(1 << (bits - 2), np.int64)
            self.key, self.to = np.full(1 << bits, 2**64 - 1, np.uint64), np.zeros(1 << bits, np.int32)
            used = bytearray(1 << bits)
            order = np.argsort(bucket, kind="stable")
            groups = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []
            if all(self._place(g, base[g].tolist(), bucket, used, keys, merges) for g in sorted(groups, key=len, reverse=True)):
                return
        raise ValueError("no hash without collisions found")

    def _place(self, group, base, bucket, used, keys, merges) -> bool:
        mask = len(used) - 1
        if len(set(base)) < len(base):
            return False
        d = 0
        while any(used[(b + d) & mask] for b in base):
            d = (d * 5 + 12345) & mask if d else 1
        self.moved[bucket[group[0]]] = d
        for i, b in zip(group, base):
            s = (b + d) & mask
            used[s], self.key[s], self.to[s] = 1, keys[i], merges[int(keys[i])]
        return True

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that two symbols make, or -1."""
        k = a.astype(np.int64) * self.n + b
        k[(a < 0) | (b < 0)] = 2**62
        h = k.view(np.uint64) * self.odd
        slot = (((h >> self.low) & self.mask).astype(np.int64) + self.moved[(h >> self.top).astype(np.int64)]) & np.int64(self.mask)
        return np.where(self.key[slot] == k.view(np.uint64), self.to[slot], np.int32(-1))


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _kept(key: np.ndarray, left: np.ndarray, right: np.ndarray, end: np.ndarray, least: np.uint64) -> np.ndarray:
    """Which candidates, symbols [left, right) and [right, end), aren't skipped."""
    return mix64(key + left.astype(np.uint64) * _K[0] + right.astype(np.uint64) * _K[1] + end.astype(np.uint64) * _K[2]) >= least


def document_keys(doc_ids: np.ndarray, seed: int) -> np.ndarray:
    return mix64(mix64(doc_ids.astype(np.int64).view(np.uint64) + np.uint64(seed * int(_K[0]) & (2**64 - 1))))


def _agenda(p: Pieces, ids: list[int], key: np.uint64, first: int, least: int) -> list[tuple[int, int]]:
    """One long segment by a heap: (id, end) of its symbols."""
    n, m64 = len(ids), 2**64 - 1
    ids, after, before, end = list(ids), list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap: list[tuple[int, int, int, int, int]] = []
    k0, k1, k2, base = *(int(k) for k in _K), int(key)
    rank, table = p.rank, {}

    def mix(x: int) -> int:
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & m64
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & m64
        return x ^ (x >> 31)

    def offer(a: int) -> None:
        b = after[a] if a >= 0 else n
        if a < 0 or b >= n or ids[a] < 0 or ids[b] < 0:
            return
        pair = ids[a], ids[b]
        to = table.get(pair)
        if to is None:
            to = table[pair] = int(p.merged(np.array([pair[0]], np.int32), np.array([pair[1]], np.int32))[0])
        if to >= 0 and mix((base + (first + a) * k0 + (first + b) * k1 + (first + end[b]) * k2) & m64) >= least:
            heapq.heappush(heap, (int(rank[to]), a, b, end[b], to))

    for a in range(n - 1):
        offer(a)
    while heap:
        _, a, b, e, to = heapq.heappop(heap)
        if ids[a] == -2 or ids[b] == -2 or after[a] != b or end[b] != e:
            continue
        ids[a], ids[b], end[a], after[a] = to, -2, e, after[b]
        if after[a] < n:
            before[after[a]] = a
        offer(before[a])
        offer(a)
    return [(i, e) for i, e in zip(ids, end) if i != -2]


def encode(p: Pieces, data: np.ndarray, offs: np.ndarray, keys: np.ndarray, dropout: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts and each text's number of ids. A raw U+2581 goes by its bytes, since its piece would decode to a space."""
    least = np.uint64(min(2**64 - 1, int(dropout * 2.0**64)))
    some = np.diff(offs) > 0
    # Code points with a space before each text that isn't empty.
    cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.r_[0, np.cumsum((data & 0xC0) != 0x80)][offs]
    starts = lead[:-1] + np.r_[0, np.cumsum(some)[:-1]]
    size = len(cp) + int(some.sum())
    c, gap = np.empty(size, np.uint32), np.zeros(size, bool)
    gap[starts[some]] = True
    c[~gap] = cp
    raw = c == _SPACE
    raw[gap] = False
    c[gap] = 32
    space = c == 32
    sym = p.symbol[c]
    sym[space] = p.symbol[_SPACE]
    sym[raw] = -1
    small = p.small[c]
    small[space] = p.small[_SPACE]
    small[raw] = 0
    doc = np.searchsorted(starts[some], np.arange(size), "right") - 1
    doc = np.flatnonzero(some)[doc] if size else doc
    local = np.arange(size) - starts[doc]
    link = p.pair[small[:-1].astype(np.int64) * p.side + small[1:]] if size > 1 else np.zeros(0, np.uint16)
    link[gap[1:]] = 0
    begin = np.flatnonzero(np.r_[True, link == 0]) if size else np.zeros(0, np.int64)
    length = np.diff(np.r_[begin, size])
    out, used = sym.copy(), np.ones(size, bool)  # out: the symbol that begins at a place; used: whether one does
    low = 2
    for top in _STEPS:
        at = begin[(length >= low) & (length <= top)]
        n = length[(length >= low) & (length <= top)]
        low = top + 1
        for s in range(0, len(at), 16384):
            _rows(p, at[s : s + 16384], n[s : s + 16384], top, sym, link, local, keys[doc[at[s : s + 16384]]], least, out, used)
    for a, n in zip(begin[length > WIDEST].tolist(), length[length > WIDEST].tolist()):
        used[a : a + n] = False
        e = 0
        for i, stop in _agenda(p, sym[a : a + n].tolist(), keys[doc[a]], int(local[a]), int(least)):
            out[a + e], used[a + e], e = i, True, stop
    ids, doc, place = out[used], doc[used], np.flatnonzero(used)
    # Characters without a piece go by their bytes.
    bad = np.flatnonzero(ids < 0)
    if len(bad):
        code = c[place[bad]].astype(np.int64)
        width = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
        head = np.array([0, 0, 0xC0, 0xE0, 0xF0])
        rep = np.ones(len(ids), np.int64)
        rep[bad] = width
        to = np.r_[0, np.cumsum(rep)[:-1]]
        full = np.repeat(ids, rep)
        for k in range(4):
            sel = width > k
            shift = 6 * (width[sel] - 1 - k)
            b = (code[sel] >> shift) & np.where(width[sel] == 1, 0x7F, 0x3F)
            b |= head[width[sel]] if k == 0 else 0x80
            full[to[bad[sel]] + k] = p.byte[b]
        ids, doc = full, np.repeat(doc, rep)
    return ids, np.bincount(doc, minlength=len(offs) - 1)


def _rows(p, at, n, width, sym, link, local, key, least, out, used) -> None:
    """Merges segments of up to ``width`` symbols side by side and writes what is left to out and used.

    Row k holds what begins at character k of each segment, so a symbol's place is its row and its end the row of the next symbol. A
    candidate's priority is its rank, then its place; the least of each column is the one that the agenda would take.
    """
    m = len(at)
    lanes = np.arange(width, dtype=np.int64)[:, None]
    idx = at[None, :] + lanes
    inside = lanes < n[None, :]
    idx[~inside] = 0
    used[idx[inside]] = False
    ids = np.where(inside, sym[idx], -1).ravel()
    follow = np.repeat(np.arange(1, width + 1, dtype=np.int64), m)
    before = np.repeat(np.arange(-1, width, dtype=np.int64), m)
    to = np.where(inside[1:], link[np.minimum(idx[:-1], len(link) - 1)].astype(np.int32) - 2, -1)
    first = local[at]
    ok = to >= 0
    if least:
        k, r = np.nonzero(ok)
        x = first[r] + k
        ok[k, r] = _kept(key[r], x, x + 1, x + 2, least)
    prio = np.full((width, m), _NONE, np.uint32)
    prio[:-1] = np.where(ok, p.rank[to].astype(np.uint32) << np.uint32(6) | lanes[:-1].astype(np.uint32), _NONE)
    to, flat, alive = np.concatenate([to.ravel(), np.full(m, -1, np.int32)]), prio.ravel(), inside.ravel().copy()
    r = np.arange(m)

    def offer(place: np.ndarray, k: np.ndarray, col: np.ndarray, a: np.ndarray, b: np.ndarray, middle: np.ndarray, end: np.ndarray) -> None:
        t = p.merged(a, b)
        ok = t >= 0
        if least:
            h = np.flatnonzero(ok)
            x = first[col[h]]
            ok[h] = _kept(key[col[h]], x + k[h], x + middle[h], x + end[h], least)
        to[place] = t
        flat[place] = np.where(ok, p.rank[t].astype(np.uint32) << np.uint32(6) | k.astype(np.uint32), _NONE)

    while len(r):
        best = (prio if len(r) == m else prio[:, r]).min(axis=0)
        live = best < _NONE
        if not live.all():
            r, best = r[live], best[live]
            if not len(r):
                break
        k = (best & np.uint32(63)).astype(np.int64)
        a = k * m + r
        b = follow[a] * m + r
        t, e = to[a], follow[b]
        ids[a], follow[a], flat[a], flat[b], alive[b] = t, e, _NONE, _NONE, False
        before[e * m + r] = k
        h = np.flatnonzero(e < n[r])
        right = e[h] * m + r[h]
        offer(a[h], k[h], r[h], t[h], ids[right], e[h], follow[right])
        q = before[a]
        h = np.flatnonzero(q >= 0)
        left = q[h] * m + r[h]
        offer(left, q[h], r[h], ids[left], t[h], k[h], e[h])
    where = idx.ravel()[alive]
    out[where] = ids[alive]
    used[where] = True


def decode(p: Pieces, ids: np.ndarray) -> str:
    """The text of ids: pieces and bytes joined, without the space that encoding put first. Control and unknown ids have no text."""
    raw = b"".join([p.raw[i] for i in ids.tolist()])
    return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def encode_documents(docs: DataFrame, dropout: float = DROPOUT, seed: int = SEED, model: str | None = None) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n_ids, ids, lossless): the ids of each text, and whether decoding them gave the text back byte for byte.

    Rows stay in the order of docs. A NULL text has NULL ids and lossless and 0 n_ids; an empty one no ids. A NULL doc_id is keyed as 0. Repeated rows get the same ids; an empty
    table gives no rows; extra columns are ignored. The model's file is read on the driver alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pieces(model or model_path()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            for first, last, data, offs in text_slices(batch.column(1), 1 << 20):
                part = batch.slice(first, last - first)
                null = part.column(1).is_null().to_numpy(zero_copy_only=False)
                keys = document_keys(part.column(0).fill_null(0).to_numpy(), seed)
                ids, n = encode(p, data, offs, keys, dropout)
                at, flat, same = np.r_[0, np.cumsum(n)], ids.tolist(), np.zeros(last - first, bool)
                for i in range(last - first):
                    raw = b"".join([p.raw[x] for x in flat[at[i] : at[i + 1]]])
                    same[i] = raw[1:] == data[offs[i] : offs[i + 1]].tobytes()
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids), mask=pa.array(null))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), lists, pa.array(same, mask=null)], ["doc_id", "n_ids", "ids", "lossless"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_ids long, ids array<int>, lossless boolean")


def decode_documents(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, ids) -> (doc_id, text); NULL ids give a NULL text, no ids an empty one."""
    shared = encoded.sparkSession.sparkContext.broadcast(pieces(model or model_path()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            texts = [None if x is None else decode(p, np.array(x, np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document, a tenth of the candidate merges dropped."""
    return encode_documents(read(spark, sf_dir, "documents"))
