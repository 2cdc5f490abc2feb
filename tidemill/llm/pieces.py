"""SentencePiece encoding and decoding by suffix array.

A text is an optional leading blank and its characters, blanks written as U+2581; pieces hold that mark
only at their start or alone, so a run of blanks and what follows it up to the next blank (a unit) is
encoded by itself, and equal units once per batch. The distinct units of a batch are concatenated, in
blocks of about BLOCK characters so that the index stays small; a suffix array over them (to the depth of
the longest piece) is searched in one binary search for the range of occurrences of every piece, and the
occurrences, sorted by position, are the edges of the lattice. Relaxing keeps, of every unit's edges that
join exactly two of its present symbols, the one of best score (leftmost among equals), until no edge
joins two: the segmentation of a BPE model.
Characters without a piece fall back to their bytes.

Defined results: null and empty texts have no ids; invalid UTF-8 never reaches this code; U+2581 in a
text decodes as a blank, as the model can't tell them apart; of edges of equal score (ties) the leftmost
joins first; very long texts are encoded whole, and so are batches of them; an empty table gives an empty
result; repeated rows are encoded alike; other columns are kept, but those named ids, n_tokens or whole,
whose names the results take.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.base import batched, joined_bytes, mix, powers, spans, summed

MODEL, MARK, DEPTH = "/opt/tokenizers/piece_bpe_32k.model", "▁", 16
#: Units up to this length are relaxed together, a step of each at a time; longer ones with a heap each.
LONG = 48
#: Entries gathered at once.
BLOCK = 1 << 17
#: Bytes of a batch, whose equal units are encoded once.
BATCH = 8_000_000


@dataclass
class Vocabulary:
    """Pieces by id; byte pieces, and pieces that stand for no text, are told apart."""

    pieces: list[str]
    scores: list[float]
    byte_ids: np.ndarray  # id of each byte's piece, -1 if there is none
    silent: np.ndarray  # ids of control pieces
    unknown: int

    @staticmethod
    def load(path: str = MODEL) -> Vocabulary:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        byte_ids = np.full(256, -1, np.int32)
        for i in range(n):
            if m.is_byte(i):
                byte_ids[int(m.id_to_piece(i)[3:5], 16)] = i
        return Vocabulary([m.id_to_piece(i) for i in range(n)], [m.get_score(i) for i in range(n)], byte_ids, np.array([i for i in range(n) if m.is_control(i)], np.int32), m.unk_id())

    def ready(self) -> Vocabulary:
        """With the tables that encoding and decoding look up."""
        if hasattr(self, "char_id"):
            return self
        special = {*self.silent.tolist(), *self.byte_ids.tolist(), self.unknown}
        normal = [i for i, p in enumerate(self.pieces) if i not in special and p]
        if any(MARK in p.lstrip(MARK) for p in (self.pieces[i] for i in normal)):
            raise ValueError("a piece holds a blank after another character")
        if max(len(self.pieces[i]) for i in normal) > DEPTH:
            raise ValueError(f"a piece is longer than {DEPTH}")
        chars = sorted({c for i in normal for c in self.pieces[i]})
        if len(chars) > 65_000:
            raise ValueError("too many different characters")
        #: Dense numbers of characters, from 1; the last is for all others.
        self.other = len(chars) + 1
        self.dense = np.full(0x110000, self.other, np.uint16)
        self.dense[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.dense[32] = self.dense[ord(MARK)]
        self.char_id = np.full(len(chars) + 2, -1, np.int32)
        one = [i for i in normal if len(self.pieces[i]) == 1]
        self.char_id[[self.dense[ord(self.pieces[i])] for i in one]] = one
        self.long_ids = np.array([i for i in normal if len(self.pieces[i]) > 1], np.int32)
        self.length = np.array([len(self.pieces[i]) for i in self.long_ids])
        grid = np.zeros((len(self.long_ids), DEPTH), np.uint16)
        for k, i in enumerate(self.long_ids):
            p = self.pieces[i]
            grid[k, : len(p)] = [self.dense[ord(c)] for c in p]
        self.low = packed(grid)
        self.high = packed(np.where(grid == 0, np.uint16(0xFFFF), grid))
        self.high[-1] += (grid[:, -1] > 0).astype(np.uint64)  # above the occurrences of a piece of full depth, too
        score = np.array([self.scores[i] for i in self.long_ids], np.float32)
        self.rank = np.searchsorted(np.unique(-score), -score)
        # Decoding: the bytes of each piece, one after the other.
        text = [p.replace(MARK, " ").encode() for p in self.pieces]
        for i in self.silent:
            text[i] = b""
        text[self.unknown] = " ⁇ ".encode()
        for b, i in enumerate(self.byte_ids):
            if i >= 0:
                text[i] = bytes([b])
        self.bytes_of = np.frombuffer(b"".join(text), np.uint8)
        self.bytes_n = np.array([len(x) for x in text])
        self.bytes_at = np.cumsum(self.bytes_n) - self.bytes_n
        return self


def packed(grid: np.ndarray) -> list[np.ndarray]:
    """Rows of DEPTH 16-bit numbers as four 64-bit keys that order alike."""
    g = grid.astype(np.uint64)
    return [(g[:, k] << np.uint64(48)) | (g[:, k + 1] << np.uint64(32)) | (g[:, k + 2] << np.uint64(16)) | g[:, k + 3] for k in range(0, DEPTH, 4)]


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Positions in order of the DEPTH characters from there on, and their keys in that order."""
    padded = np.concatenate([text, np.zeros(DEPTH, text.dtype)]).astype(np.uint64)
    n = len(text)
    four = (padded[: n + DEPTH - 3] << np.uint64(48)) | (padded[1 : n + DEPTH - 2] << np.uint64(32)) | (padded[2 : n + DEPTH - 1] << np.uint64(16)) | padded[3 : n + DEPTH]
    keys = [four[k : k + n] for k in range(0, DEPTH, 4)]
    order = np.argsort(keys[0], kind="stable")
    # Only runs of equal first keys need the others.
    first = keys[0][order]
    tied = np.zeros(n, bool)
    tied[1:] = first[1:] == first[:-1]
    tied[:-1] |= tied[1:]
    where = np.flatnonzero(tied)
    if len(where):
        own = order[where]
        order[where] = own[np.lexsort((keys[3][own], keys[2][own], keys[1][own], keys[0][own]))]
    return order, [k[order] for k in keys]


def lower_bound(keys: list[np.ndarray], wanted: list[np.ndarray]) -> np.ndarray:
    """Of each wanted key the number of smaller ones, all in one binary search."""
    n = len(keys[0])
    lo, hi = np.zeros(len(wanted[0]), np.int64), np.full(len(wanted[0]), n)
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = np.minimum((lo + hi) // 2, n - 1)
        less, equal = np.zeros(len(lo), bool), np.ones(len(lo), bool)
        for k, w in zip(keys, wanted, strict=True):
            x = k[mid]
            less |= equal & (x < w)
            equal &= x == w
        lo, hi = np.where(open_ & less, mid + 1, lo), np.where(open_ & ~less, mid, hi)


def edges(text: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(position, place in long_ids) of every occurrence of a longer piece, by position."""
    order, keys = suffix_array(text)
    lo, hi = lower_bound(keys, v.low), lower_bound(keys, v.high)
    count = np.maximum(hi - lo, 0)
    at, piece = order[spans(lo, count)], np.repeat(np.arange(len(count)), count)
    by = np.argsort(at, kind="stable")
    return at[by], piece[by]


def relax(n: int, first: np.ndarray, unit: np.ndarray, at: np.ndarray, piece: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Which positions of the text start a symbol, and the id of each longer symbol at its start (-1: one character).

    first: where units start, n included; unit: of each edge.
    """
    cut, ids = np.ones(n + 1, bool), np.full(n, -1, np.int32)
    end, rank = at + v.length[piece], v.rank[piece]
    long_ = np.diff(first)[unit] > LONG if len(unit) else np.zeros(0, bool)
    for u in np.unique(unit[long_]):
        own = slice(*np.searchsorted(unit, [u, u + 1]))
        heaped(int(first[u]), int(first[u + 1]), at[own], end[own], rank[own], v.long_ids[piece[own]], cut, ids)
    at, end, rank, piece, unit = (x[~long_] for x in (at, end, rank, piece, unit))
    while len(at):
        seen = np.cumsum(cut)
        inside = seen[end - 1] - seen[at]
        live = cut[at] & cut[end] & (inside > 0)
        at, end, rank, piece, unit, inside = (x[live] for x in (at, end, rank, piece, unit, inside))
        ready = np.flatnonzero(inside == 1)
        if not len(ready):
            break
        u = unit[ready]
        start = np.concatenate([[0], np.flatnonzero(u[1:] != u[:-1]) + 1])
        key = rank[ready].astype(np.int64) * (n + 1) + at[ready]
        best = np.minimum.reduceat(key, start)
        pick = ready[key == np.repeat(best, np.diff(np.concatenate([start, [len(u)]])))]
        places = np.flatnonzero(cut)
        cut[places[np.searchsorted(places, at[pick], side="right")]] = False
        ids[at[pick]] = v.long_ids[piece[pick]]
    return cut[:n], ids


def heaped(lo: int, hi: int, at, end, rank, piece, cut: np.ndarray, ids: np.ndarray) -> None:
    """Relax one long unit: a heap of the edges that join two present symbols."""
    known = {(int(a), int(b)): (int(r), int(p)) for a, b, r, p in zip(at, end, rank, piece, strict=True)}
    after = {i: i + 1 for i in range(lo, hi)}
    before = {i + 1: i for i in range(lo, hi)}
    heap: list = []

    def offer(a, mid):
        if mid in after and (found := known.get((a, after[mid]))):
            heapq.heappush(heap, (found[0], a, mid, after[mid], found[1]))

    for i in range(lo, hi):
        offer(i, i + 1)
    while heap:
        _, a, mid, b, p = heapq.heappop(heap)
        if after.get(a) != mid or after.get(mid) != b:
            continue
        cut[mid], ids[a], after[a], before[b] = False, p, b, a
        del after[mid]
        offer(a, b)
        if a > lo:
            offer(before[a], a)


def blocks(count: np.ndarray, most: int = BLOCK) -> list[slice]:
    """Slices of consecutive rows that hold about `most` entries together, one row at least. Bounds what is gathered at once."""
    total = np.cumsum(count)
    cut = np.searchsorted(total, np.arange(most, int(total[-1]) if len(total) else 0, most), side="right")
    cut = np.unique(np.concatenate([[0], cut, [len(count)]]))
    return [slice(int(a), int(b)) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def encode_bytes(data: np.ndarray, starts: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows, one after the other, and their number in each row. Row i is data[starts[i]:starts[i + 1] - 1], blanks as 0x20."""
    v = v.ready()
    size = np.diff(starts) - 1
    # Every row that isn't empty gets a leading blank, in the place of the byte before it.
    full = size > 0
    shifted, kept = np.concatenate([np.full(1, 32, np.uint8), data[:-1]]), np.ones(len(data), bool)
    shifted[starts[:-1]] = 32
    kept[starts[:-1][~full]] = False
    text = shifted[kept]
    del data, shifted, kept
    text_n = size + full
    row_at = np.cumsum(text_n) - text_n
    begin = np.zeros(len(text), bool)
    begin[1:] = (text[1:] == 32) & (text[:-1] != 32)
    begin[row_at[full]] = True
    unit_at = np.flatnonzero(begin)
    del begin
    unit_n = np.diff(np.concatenate([unit_at, [len(text)]]))
    units = np.diff(np.searchsorted(unit_at, np.concatenate([row_at, [len(text)]])))
    if not len(unit_at):
        return np.zeros(0, np.int32), np.zeros(len(size), np.int64)
    hashes = np.empty(len(unit_at), np.uint64)
    for own in blocks(unit_n):
        lo, hi = unit_at[own.start], unit_at[own.stop] if own.stop < len(unit_at) else len(text)
        with np.errstate(over="ignore"):
            place = spans(np.zeros(own.stop - own.start, np.int64), unit_n[own])
            terms = (text[lo:hi].astype(np.uint64) + np.uint64(1)) * powers(0xA24BAED4963EE407, int(unit_n[own].max()))[place]
            hashes[own] = mix(np.add.reduceat(terms, unit_at[own] - lo) + unit_n[own].astype(np.uint64))
    _, one, number = np.unique(hashes, return_index=True, return_inverse=True)
    number = number.astype(np.int32)
    # The distinct units as characters, a 0 after each.
    raw_n = unit_n[one]
    raw = text[spans(unit_at[one], raw_n)]
    del hashes, text, unit_at, unit_n
    code = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    length = summed(((raw & 0xC0) != 0x80).astype(np.int64), raw_n)
    del raw
    first = np.concatenate([[0], np.cumsum(length + 1)])
    grid = np.zeros(int(first[-1]), np.uint16)
    where = spans(first[:-1], length)
    grid[where] = v.dense[code]
    cut, ids = np.ones(len(grid), bool), np.full(len(grid), -1, np.int32)
    for own in blocks(length + 1):
        lo, hi = first[own.start], first[own.stop]
        local = first[own.start : own.stop + 1] - lo
        at, piece = edges(grid[lo:hi], v)
        cut[lo:hi], ids[lo:hi] = relax(len(grid[lo:hi]), local, np.searchsorted(local, at, side="right") - 1, at, piece, v)
    # One id a symbol, but as many as it has bytes for a character without a piece.
    start = where[cut[where]]
    symbol = ids[start]
    single = symbol < 0
    symbol[single] = v.char_id[grid[start[single]]]
    lost = np.flatnonzero(symbol < 0)
    n_ids = np.ones(len(start), np.int64)
    lost_bytes = b""
    if len(lost):
        code_at = np.searchsorted(where, start[lost])
        characters = [chr(c).encode() for c in code[code_at].tolist()]
        n_ids[lost] = [len(c) for c in characters]
        lost_bytes = b"".join(characters)
    out = np.repeat(symbol, n_ids)
    out[out < 0] = v.byte_ids[np.frombuffer(lost_bytes, np.uint8)]
    out[out < 0] = v.unknown
    per_unit = summed(n_ids, np.diff(np.searchsorted(start, first)))
    from_ = np.cumsum(per_unit) - per_unit
    count = per_unit[number]
    found, at = np.empty(int(count.sum()), np.int32), 0
    for own in blocks(count):
        part = out[spans(from_[number[own]], count[own])]
        found[at : at + len(part)] = part
        at += len(part)
    return found, summed(count, units)


def decode_ids(ids: np.ndarray, count: np.ndarray, v: Vocabulary) -> list[bytes]:
    """The text of each row as UTF-8, without the leading blank."""
    v = v.ready()
    n = v.bytes_n[ids]
    raw = b"".join(v.bytes_of[spans(v.bytes_at[ids[own]], n[own])].tobytes() for own in blocks(n))
    ends = np.cumsum(summed(n, count)) if len(count) else np.zeros(0, int)
    out, at = [], 0
    for end in ends.tolist():
        row = raw[at:end]
        out.append(row[1:] if row[:1] == b" " else row)
        at = end
    return out


def encode_column(column, v: Vocabulary):
    """An Arrow list column of ids."""
    import pyarrow as pa
    import pyarrow.compute as pc

    ids, count = encode_bytes(*joined_bytes(pc.replace_substring(column, MARK, " ")), v)
    return pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)])), pa.array(ids)).cast(pa.list_(pa.int32())), ids, count


def encoded(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """docs with `ids`, `n_tokens` and `whole` (decoding the ids gives the text again) instead of `text`."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model))
    rest = [c for c in docs.columns if c not in ("text", "ids", "n_tokens", "whole")]

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for t in batched(batches, BATCH):
            text = t.column("text").combine_chunks()
            column, ids, count = encode_column(text, shared.value)
            back = pa.array(decode_ids(ids, count, shared.value), pa.binary())
            want = pc.fill_null(pc.replace_substring(text, MARK, " "), "").cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*[t.column(c).combine_chunks() for c in rest], column, pa.array(count), pc.equal(back, want)], [*rest, "ids", "n_tokens", "whole"])

    schema = docs.select(*rest, F.lit(None).cast("array<int>").alias("ids"), F.lit(0).cast("long").alias("n_tokens"), F.lit(True).alias("whole")).schema
    return docs.select(*rest, "text").mapInArrow(run, schema)


def decoded(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """rows with `text` instead of `ids`."""
    shared = rows.sparkSession.sparkContext.broadcast(Vocabulary.load(model))
    rest = [c for c in rows.columns if c not in ("ids", "text")]

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            column = batch.column("ids")
            count = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
            text = decode_ids(np.asarray(pc.list_flatten(column)), count, shared.value)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array([x.decode("utf-8", "replace") for x in text], pa.string())], [*rest, "text"])

    return rows.select(*rest, "ids").mapInArrow(run, rows.select(*rest, F.lit("").alias("text")).schema)
