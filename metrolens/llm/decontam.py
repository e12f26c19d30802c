"""Benchmark decontamination by q-gram lemma filtering (operator 5).

Benchmark items are cut into overlapping pieces of ``PIECE`` bytes. A piece of
n bytes that occurs in a text with at most k edits shares at least
n + 1 - q - k * q of its q-grams with the text there, all within k diagonals
(text place - piece place) of one another. So shared q-grams are counted in
diagonal bands wider than k, every two neighbouring bands taken together, and
only regions that reach the bound are verified by banded alignment, many
regions at a time.

Texts are compared in lower case with each run of punctuation and white space
as one blank, so that line breaks, indents and doubled blanks cost no edits;
the place of every byte kept is remembered, and spans are byte offsets into
the original UTF-8 text.
The edit budget is a tenth of the piece, a little less for short pieces, so
that the bound is never below ``LEAST_SHARED`` q-grams. Items of fewer than
``SHORTEST`` bytes as they are written, or too few for that bound once their
blanks are single, are too short to prove anything and are not searched.

The benchmark is searched in blocks of at most about ``BLOCK`` pieces: each
block is broadcast, and all texts are read against it.

Null and empty texts and items match nothing; rows without item_id still
count. Documents are told apart by doc_id and text (``version``, a hash of the
text), so rows that share a doc_id, or have none, are reported each with its own
spans; rows equal in both are one document. An empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metrolens.llm.common import map_arrow

Q = 8
PIECE, STRIDE, SHORTEST = 80, 40, 40
LEAST_SHARED = 8
LEAST_PIECE = Q + LEAST_SHARED - 1
BAND = 16              # diagonals; more than any edit budget
BLOCK = 20_000
_GAP = PIECE + 4 * BAND
_TABLE_BITS = 22
_POSTINGS = 1 << 20    # shared q-grams listed at once
_PLACES = 1 << 18      # places of a text looked up at once
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))
# Characters whose lower case has another number of bytes; they stay.
_UNEVEN = re.compile("[" + "".join(c for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x1F000)))
                                   if len(c.lower().encode()) != len(c.encode())) + "]")


def budget(n: int) -> int:
    """Edits allowed in a piece of ``n`` bytes."""
    return max(0, min(n // 10, (n + 1 - Q - LEAST_SHARED) // Q))


def shared_bound(n: int) -> int:
    return n + 1 - Q - budget(n) * Q


def _plain(text: bytes) -> bytes:
    """Lower case with blanks, byte for byte."""
    if not text.isascii():
        t = text.decode("utf-8", "surrogateescape")
        t = "".join(c if _UNEVEN.match(c) else c.lower() for c in t) if _UNEVEN.search(t) else t.lower()
        text = t.encode("utf-8", "surrogateescape")
    return text.translate(_PLAIN)


def pieces(items: DataFrame) -> DataFrame:
    """(item_id, piece, bytes): the overlapping pieces of the items."""

    def run(part):
        take, number, out = [], [], []
        for i, text in enumerate(part.column("text").cast(pa.binary()).to_pylist()):
            plain = _plain(text or b"").strip()
            if len(plain) < SHORTEST:
                continue
            plain = b" ".join(plain.split())
            if len(plain) < LEAST_PIECE:
                continue
            starts = list(range(0, max(len(plain) - PIECE, 0) + 1, STRIDE))
            if starts[-1] + PIECE < len(plain):
                starts.append(len(plain) - PIECE)
            for k, s in enumerate(starts):
                take.append(i)
                number.append(k)
                out.append(plain[s:s + PIECE])
        return {"take": take, "piece": number, "bytes": out}

    return map_arrow(items.select("item_id", "text"), run, "piece int, bytes binary", keep=("item_id",))


class Index:
    """The q-grams of a block of pieces: sorted codes with postings, and a
    bit table that turns most places of a text away at once."""

    def __init__(self, block: list[bytes]):
        self.pieces = [np.frombuffer(p, np.uint8) for p in block]
        self.length = np.array([len(p) for p in block], np.int64)
        self.bound = np.array([shared_bound(len(p)) for p in block], np.int64)
        self.budget = np.array([budget(len(p)) for p in block], np.int64)
        codes = [np.ndarray((len(p) - Q + 1,), "<u8", p.tobytes(), strides=(1,)).copy() for p in self.pieces]
        code = np.concatenate(codes)
        owner = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        place = np.concatenate([np.arange(len(c)) for c in codes])
        order = np.argsort(code, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.codes, first = np.unique(code[order], return_index=True)
        self.first = np.append(first, len(code))
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[self.cell(self.codes)] = True
        width = int(self.length.max())
        self.matrix = np.zeros((len(block), width), np.uint8)
        for i, p in enumerate(self.pieces):
            self.matrix[i, :len(p)] = p

    @staticmethod
    def cell(code: np.ndarray) -> np.ndarray:
        return (code * _SPREAD) >> np.uint64(64 - _TABLE_BITS)

    def shared(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, number of the code) of the q-grams that some piece has too.
        ``code`` overlaps itself: it is looked up part by part, so that its
        copies of eight bytes a place stay small however long the texts are."""
        places, numbers = [], []
        for start in range(0, len(code), _PLACES):
            part = code[start:start + _PLACES]
            near = np.flatnonzero(self.table[self.cell(part)])
            at = np.minimum(np.searchsorted(self.codes, part[near]), len(self.codes) - 1)
            same = self.codes[at] == part[near]
            places.append(near[same] + start)
            numbers.append(at[same])
        return np.concatenate(places), np.concatenate(numbers)

    def regions(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece, band): pairs of neighbouring bands that reach the bound."""
        near, at = self.shared(np.ndarray((len(buf) - Q + 1,), "<u8", buf.data, strides=(1,)))
        # a region needs that many hits of any kind within its length
        least, reach = int(self.bound.min()), int((self.length + 2 * self.budget).max()) + 2 * BAND
        if len(near) < least:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        dense = np.flatnonzero(near[least - 1:] - near[:len(near) - least + 1] <= reach)
        mark = np.zeros(len(near) + 1, np.int64)
        np.add.at(mark, dense, 1)
        np.add.at(mark, dense + least, -1)
        keep = np.cumsum(mark)[:-1] > 0
        near, at = near[keep], at[keep]
        many = self.first[at + 1] - self.first[at]
        upto = np.cumsum(many)
        span = len(buf) // BAND + 4 * PIECE
        keys, counts, held, start = [], [], 0, 0
        while start < len(near):         # periodic texts share many q-grams at every place: count them part by part
            stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + _POSTINGS, "right")))
            m, a = many[start:stop], at[start:stop]
            posting = np.repeat(self.first[a] - np.cumsum(m) + m, m) + np.arange(m.sum())
            band = (np.repeat(near[start:stop], m) - self.place[posting] + PIECE) // BAND
            key, n = np.unique(self.owner[posting] * span + band, return_counts=True)
            keys.append(key)
            counts.append(n)
            held, start = held + len(key), stop
            if held > _POSTINGS or start == len(near):
                key, which = np.unique(np.concatenate(keys), return_inverse=True)
                n = np.bincount(which, weights=np.concatenate(counts), minlength=len(key)).astype(np.int64)
                keys, counts, held = [key], [n], 0
        if not keys:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        nxt = np.searchsorted(key, key + 1)
        both = n + np.where((nxt < len(key)) & (key[np.minimum(nxt, len(key) - 1)] == key + 1),
                            n[np.minimum(nxt, len(n) - 1)], 0)
        good = both >= self.bound[key // span]
        return key[good] // span, key[good] % span

    def align(self, buf: np.ndarray, piece: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(edits, end): least edits of each piece within its two bands, and
        where the best occurrence ends. Rows are bytes of the piece, columns
        the diagonals of the bands and the budget around them."""
        n, margin = self.length[piece], int(self.budget.max())
        lowest = band * BAND - PIECE - margin
        diagonals = np.arange(2 * BAND + 2 * margin)
        padded = np.concatenate([np.zeros(2 * PIECE + margin, np.uint8), buf, np.zeros(4 * PIECE + 4 * margin, np.uint8)])
        origin = lowest[:, None] + diagonals + 2 * PIECE + margin
        cost = np.zeros((len(piece), len(diagonals)), np.int32)
        edits, end = np.full(len(piece), 10**6), np.zeros(len(piece), np.int64)
        for i in range(int(n.max())):
            step = cost + (padded[origin + i] != self.matrix[piece, i][:, None])
            step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)
            cost = np.minimum.accumulate(step - diagonals, axis=1) + diagonals
            done = np.flatnonzero(n == i + 1)
            if len(done):
                best = cost[done].argmin(axis=1)
                edits[done] = cost[done, best]
                end[done] = lowest[done] + best + i + 1
        return edits, end


def _places(mask: np.ndarray) -> np.ndarray:
    """Where ``mask`` holds, in four bytes a place if they do."""
    out, at = np.empty(np.count_nonzero(mask), np.int32 if len(mask) < 2**31 else np.int64), 0
    for start in range(0, len(mask), _PLACES):
        found = np.flatnonzero(mask[start:start + _PLACES])
        out[at:at + len(found)] = found + start
        at += len(found)
    return out


def _plain_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, origin, starts): plain texts, kept apart by gaps of zero bytes;
    each byte's place before runs of blanks became one, and the texts' starts
    among these places."""
    texts = [t or b"" for t in column.cast(pa.binary()).to_pylist()]
    gap = bytes(_GAP)
    starts = np.concatenate([[0], np.cumsum([len(t) + _GAP for t in texts])])[:-1] + _GAP
    raw = np.frombuffer(gap + gap.join(map(_plain, texts)) + gap, np.uint8)
    del texts
    kept = raw != 32
    kept[1:] |= raw[:-1] != 32
    return raw[kept], _places(kept), starts


def search(index: Index, column: pa.Array) -> dict[str, np.ndarray]:
    """Verified occurrences in a batch: row, piece, start, end, edits."""
    buf, origin, starts = _plain_buffer(column)
    piece, band = index.regions(buf)
    found = {k: [] for k in ("row", "piece", "start", "end", "edits")}
    for i in range(0, len(piece), 2000):
        p, b = piece[i:i + 2000], band[i:i + 2000]
        edits, end = index.align(buf, p, b)
        good = edits <= index.budget[p]
        p, end, edits = p[good], end[good], edits[good]
        first = origin[np.maximum(end - index.length[p], 0)].astype(np.int64)
        stop = origin[end - 1].astype(np.int64) + 1
        row = np.searchsorted(starts, stop - 1, "right") - 1
        found["row"].append(row)
        found["piece"].append(p)
        found["start"].append(np.maximum(first - starts[row], 0))
        found["end"].append(stop - starts[row])
        found["edits"].append(edits)
    return {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in found.items()}


def blocks(spark: SparkSession, items: DataFrame, block: int = BLOCK):
    """Broadcast (ids, pieces, piece numbers) blocks of bounded size, one after another."""
    cut = pieces(items).cache()
    try:
        count = -(-cut.count() // block)
        part = F.pmod(F.xxhash64("item_id", "piece"), F.lit(max(count, 1)))
        for i in range(count):
            rows = cut.where(part == i).select("item_id", "piece", "bytes").collect()
            if rows:
                yield spark.sparkContext.broadcast(([r["item_id"] for r in rows], [bytes(r["bytes"]) for r in rows],
                                                    [r["piece"] for r in rows]))
    finally:
        cut.unpersist()


def _indexed(shared):
    """The block's index, made once per task."""
    cell: list[Index] = []

    def get() -> Index:
        if not cell:
            cell.append(Index(shared.value[1]))
        return cell[0]
    return get


def occurrences(spark: SparkSession, docs: DataFrame, items: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, version, item_id, piece, start, end, edits of every piece found
    (a span as wide as the piece, up to the verified end)."""
    named = docs.select("doc_id", F.xxhash64("text").alias("version"), "text")
    out = None
    for shared in blocks(spark, items, block):
        index = _indexed(shared)

        def run(part, shared=shared, index=index):
            hit = search(index(), part.column("text"))
            ids, number = shared.value[0], shared.value[2]
            return {"take": hit["row"], "item_id": [ids[p] for p in hit["piece"].tolist()],
                    "piece": [number[p] for p in hit["piece"].tolist()], "start": hit["start"], "end": hit["end"], "edits": hit["edits"]}

        found = map_arrow(named, run, "item_id long, piece int, start int, end int, edits int", keep=("doc_id", "version"))
        out = found if out is None else out.union(found)
    if out is None:
        out = spark.createDataFrame([], "doc_id long, version long, item_id long, piece int, start int, end int, edits int")
    return out


def contaminated(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per document and item found in it: span of the occurrence, the edits of
    its best piece and the number of its pieces found."""
    return occurrences(spark, docs, items).groupBy("doc_id", "version", "item_id").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min("edits").alias("edits"),
        F.size(F.collect_set("piece")).cast("long").alias("n_pieces"))


def clean(spark: SparkSession, docs: DataFrame, items: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` in which no piece occurs, all columns as they are."""
    for shared in blocks(spark, items, block):
        index = _indexed(shared)

        def run(part, index=index):
            hit = np.zeros(part.num_rows, bool)
            hit[search(index(), part.column("text"))["row"]] = True
            return {"take": np.flatnonzero(~hit)}

        docs = map_arrow(docs, run, "", keep=tuple(docs.columns))
    return docs
