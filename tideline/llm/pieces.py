"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

A blank is the whitespace marker of the pieces, and one marker is put before every text.
In the trie the marker is the byte 0x20, so texts are walked as they are, and a marker
that is really in a text can only be spelled by byte pieces: decoding gives back every
text exactly. Among all ways to write a text as pieces the one with the highest sum of
log scores is taken; a character that is no piece may be spelled in bytes at a penalty.

No piece has a marker after another character, so texts are cut before each blank that
follows something else, and each distinct segment is encoded once.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tideline.llm import words as W
from tideline.llm.bitplanes import CACHED, SegmentEncoder

MARKER = "▁"
PENALTY = 10.0  # below the least score, for a character spelled in bytes
SEARCH_BYTES = 1 << 16  # new segments searched together; a longer one alone, whole
DECODE_IDS = 1 << 16  # ids of whole texts decoded together; a longer text alone


@dataclass
class Pieces:
    """A vocabulary: the trie, log scores, and the bytes of every id."""

    base: np.ndarray
    check: np.ndarray
    piece: np.ndarray  # id that ends at a node, or -1
    score: np.ndarray
    byte_ids: np.ndarray
    flat: np.ndarray
    offsets: np.ndarray
    longest: int

    @property
    def fallback(self) -> float:
        return float(self.score[np.isfinite(self.score)].min()) - PENALTY


def double_array(entries: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check and value of a trie: from node s, byte c leads to t = base[s] + c if check[t] = s."""
    children: list[dict[int, int]] = [{}]
    ends = {}
    for text, value in entries:
        node = 0
        for c in text:
            if c not in children[node]:
                children[node][c] = len(children)
                children.append({})
            node = children[node][c]
        ends[node] = value
    room = 2 * len(children) + 1024
    base, check, value = np.zeros(room, np.int32), np.full(room, -1, np.int32), np.full(room, -1, np.int32)
    check[0] = 0
    place, free = {0: 0}, 1
    for node in range(len(children)):  # parents come before their children
        if not children[node]:
            continue
        labels = np.array(sorted(children[node]))
        at, look = 0, free
        while not at:
            while look + 5120 > len(check):
                grow = len(check)
                base = np.concatenate([base, np.zeros(grow, np.int32)])
                check, value = (np.concatenate([x, np.full(grow, -1, np.int32)]) for x in (check, value))
            tried = look + np.flatnonzero(check[look:look + 4096] < 0) - labels[0]
            tried = tried[tried > 0]
            fits = tried[(check[tried[:, None] + labels] < 0).all(axis=1)]
            if len(fits):
                at = int(fits[0])
            elif look == free and len(tried) < 400:
                free = look = look + 4096  # nearly full: not searched again
            else:
                look += 4096
        here = place[node]
        base[here] = at
        check[at + labels] = here
        for c in labels.tolist():
            child = children[node][c]
            place[child] = at + c
            value[at + c] = ends.get(child, -1)
    used = int(np.flatnonzero(check >= 0).max()) + 257
    return base[:used], check[:used], value[:used]


def build_pieces(scored: list[tuple[str, float, int]], byte_ids: list[int], size: int) -> Pieces:
    """From (piece, log score, id) and the ids of the 256 byte pieces; ``size`` ids in all."""
    entries, scores, spelled = [], np.full(size, -np.inf), [b""] * size
    for text, score, i in scored:
        raw = text.replace(MARKER, " ").encode()
        if b" " in raw.lstrip(b" "):
            raise ValueError("a piece has a whitespace marker after another character")
        entries.append((raw, i))
        scores[i], spelled[i] = score, raw
    for b, i in enumerate(byte_ids):
        spelled[i] = bytes([b])
    base, check, value = double_array(sorted(entries))
    return Pieces(base, check, value, scores, np.array(byte_ids, np.uint32), np.frombuffer(b"".join(spelled), np.uint8),
                  np.cumsum([0, *map(len, spelled)]), max(len(raw) for raw, _ in entries))


def load_pieces(path: str) -> Pieces:
    """Pieces of a model file. Scores that are merge ranks 0, -1, -2, ... become Zipf's log(1/(rank + 1))."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    scores = {i: model.get_score(i) for i in plain}
    used = [s for s in scores.values() if s > -1e8]  # runs of markers carry no rank
    if min(used) < -100 and all(s == int(s) for s in used):
        last = max(-s for s in used) + 1
        scores = {i: -float(np.log(1 + (-s if s > -1e8 else last))) for i, s in scores.items()}
    return build_pieces([(model.id_to_piece(i), scores[i], i) for i in plain], byte_ids, size)


def viterbi(pieces: Pieces, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best pieces of data[start:end] for each pair: ids one after the other, and how many each has.

    All positions walk the trie together, one byte at a time; then the best scores advance
    through all segments together, one position at a time.
    """
    size = end - start
    text = W.gather(data, start, size)
    first = np.cumsum(size) - size
    total = len(text)
    owner_end = np.repeat(first + size, size)

    lead = (text & 0xC0) != 0x80
    chars = np.flatnonzero(lead)
    width = np.diff(np.append(chars, total))
    at, to, ids = [], [], []
    single = np.zeros(total, bool)
    char_width = np.zeros(total, np.int64)
    char_width[chars] = width
    pos, node = chars, np.zeros(len(chars), np.int64)
    for step in range(pieces.longest):
        inside = pos + step < owner_end[pos] if len(pos) else np.zeros(0, bool)
        pos, node = pos[inside], node[inside]
        if not len(pos):
            break
        child = pieces.base[node] + text[pos + step]
        ok = (child < len(pieces.check)) & (child > 0)
        ok[ok] = pieces.check[child[ok]] == node[ok]
        pos, node = pos[ok], child[ok].astype(np.int64)
        found = pieces.piece[node]
        hit = found >= 0
        at.append(pos[hit])
        to.append(pos[hit] + step + 1)
        ids.append(found[hit].astype(np.int64))
        single[pos[hit][char_width[pos[hit]] == step + 1]] = True
    odd = chars[~single[chars]]
    at, to = np.concatenate([*at, odd]), np.concatenate([*to, odd + char_width[odd]])
    ids = np.concatenate([*ids, np.full(len(odd), -1)]).astype(np.int64)
    gain = np.where(ids >= 0, pieces.score[np.maximum(ids, 0)], pieces.fallback)

    # cell p of a segment is the position before its byte p; one more cell ends it
    shift = np.repeat(np.arange(len(size)), size)
    depth = np.arange(total) - np.repeat(first, size)
    order = np.argsort(depth[at], kind="stable")
    at, to, ids, gain = at[order], to[order], ids[order], gain[order]
    cuts = np.searchsorted(depth[at], np.arange(int(size.max(initial=0)) + 1))
    cell_from, cell_to = at + shift[at], to + shift[at]
    best = np.full(total + len(size), -np.inf)
    best[first + np.arange(len(size))] = 0.0
    back_id, back_len = np.zeros(len(best), np.int64), np.zeros(len(best), np.int64)
    for a, b in zip(cuts[:-1], cuts[1:]):
        reach = best[cell_from[a:b]] + gain[a:b]
        better = reach > best[cell_to[a:b]]  # one start reaches each cell once
        goal = cell_to[a:b][better]
        best[goal], back_id[goal], back_len[goal] = reach[better], ids[a:b][better], (to - at)[a:b][better]

    seg = np.flatnonzero(size > 0)
    cell = (first + size + np.arange(len(size)))[seg]
    stop = (first + np.arange(len(size)))[seg]
    trail = []
    while len(seg):
        trail.append((seg, back_id[cell], back_len[cell], cell - back_len[cell] - seg))
        cell = cell - back_len[cell]
        on = cell > stop
        seg, cell, stop = seg[on], cell[on], stop[on]
    if not trail:
        return np.zeros(0, np.uint32), np.zeros(len(size), np.int64)
    owner, piece, length, begin = (np.concatenate([t[k] for t in reversed(trail)]) for k in range(4))
    order = np.argsort(owner, kind="stable")
    owner, piece, length, begin = owner[order], piece[order], length[order], begin[order]
    count = np.where(piece < 0, length, 1)
    spread = np.repeat(piece, count)
    inner = np.arange(len(spread)) - np.repeat(np.cumsum(count) - count, count)
    spelled = pieces.byte_ids[text[np.minimum(np.repeat(begin, count) + inner, total - 1)]]
    out = np.where(spread < 0, spelled, np.maximum(spread, 0).astype(np.uint32))
    return out.astype(np.uint32), np.bincount(owner, weights=count, minlength=len(size)).astype(np.int64)


class PieceEncoder(SegmentEncoder):
    """Encodes by :func:`viterbi`, remembering segments."""

    most = CACHED

    def __init__(self, pieces: Pieces):
        super().__init__(None)
        self.pieces = pieces

    def starts(self, data, offsets):
        blank = data == 32
        cut = blank.copy()
        cut[1:] &= ~blank[:-1]
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        return np.flatnonzero(cut)

    def encode_segments(self, data, start, end):
        """Runs of segments one after the other: a search holds some hundred bytes for each byte."""
        before = np.concatenate([[0], np.cumsum(end - start)])
        found, lo = [viterbi(self.pieces, data, start[:0], end[:0])], 0
        while lo < len(start):
            hi = max(lo + 1, int(np.searchsorted(before, before[lo] + SEARCH_BYTES, "right")) - 1)
            found.append(viterbi(self.pieces, data, start[lo:hi], end[lo:hi]))
            lo = hi
        return tuple(np.concatenate(part) for part in zip(*found))

    def encode_texts(self, data, offsets):
        """Ids of all texts and how many each has; a text that is not empty begins with a marker."""
        real = np.diff(offsets) > 0
        shift = np.concatenate([[0], np.cumsum(real)])
        marked = np.full(len(data) + int(shift[-1]), 32, np.uint8)
        marked[np.arange(len(data)) + np.repeat(shift[1:], np.diff(offsets))] = data
        return self.encode(marked, offsets + shift)


def decode_ids(pieces: Pieces, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
    """Texts of runs of ids; markers become blanks, the first one goes, bytes that are no UTF-8 are replaced."""
    at, size = pieces.offsets[:-1][ids], np.diff(pieces.offsets)[ids]
    flat = W.gather(pieces.flat, at, size)
    ends = np.concatenate([[0], np.cumsum(size)])[bounds]
    raw = flat.tobytes()
    return [raw[a + (raw[a:a + 1] == b" "):b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])]


def encode_pieces(docs: DataFrame, pieces: Pieces, text: str = "text", to: str = "ids") -> DataFrame:
    """docs with the piece ids of every whole text; null and empty texts have none.

    Other columns pass unread; a column named like the new one is replaced.
    """
    docs = docs.select(*[c for c in docs.columns if c != to])
    held = docs.sparkSession.sparkContext.broadcast(pieces)  # one vocabulary
    schema = T.StructType([*docs.schema.fields, T.StructField(to, T.ArrayType(T.IntegerType()))])

    def run(batches):
        own = held.value
        encoder = W.worker_cache(f"pieces_{zlib.crc32(own.flat.tobytes() + own.score.tobytes())}", lambda: PieceEncoder(own))
        for batch in batches:
            for lo, hi, data, offsets in W.slices(batch.column(text), W.SMALL_BYTES):
                ids, n = encoder.encode_texts(data, offsets)
                column = W.lists(ids.view(np.int32), np.concatenate([[0], np.cumsum(n)]), pa.int32())
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, column], schema.names)

    return docs.mapInArrow(run, schema)


def decode_pieces(docs: DataFrame, pieces: Pieces, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """docs with the text of the ids; null ids give an empty text, a column named like the new one is replaced."""
    docs = docs.select(*[c for c in docs.columns if c != to])
    held = docs.sparkSession.sparkContext.broadcast(pieces)
    schema = T.StructType([*docs.schema.fields, T.StructField(to, T.StringType())])

    def run(batches):
        for batch in batches:
            before = np.concatenate([[0], np.cumsum(batch.column(ids).value_lengths().fill_null(0).to_numpy())]).astype(np.int64)
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(before, before[lo] + DECODE_IDS, "right")) - 1)
                some = batch.slice(lo, hi - lo)
                values = some.column(ids).flatten().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [*some.columns, pa.array(decode_ids(held.value, values, before[lo:hi + 1] - before[lo]), pa.string())], schema.names)
                lo = hi

    return docs.mapInArrow(run, schema)
