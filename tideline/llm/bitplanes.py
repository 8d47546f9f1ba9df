"""Token ids in files of byte planes.

A file holds ids in blocks of 65,536. A block of 4-byte ids is transposed, so that all
first bytes stand together, then all second bytes, and so on; each plane is compressed
with zstandard on its own. Document ids and lengths are kept the same way, as 8-byte
values. A JSON index of all chunks ends the file:

    magic, chunks ..., index, length of the index (8 bytes, little endian), magic
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm import words as W
from tideline.llm.tables import in_doc_order, saved
from tideline.session import scratch_path

MAGIC = b"TLPLANE1"
BLOCK_IDS = 65_536
CACHED = 500_000  # segments that a worker remembers
JOINED_BYTES = 1 << 15  # bytes of new segments that are encoded as one text
ENCODE_BYTES = 1 << 20


class PlaneWriter:
    """Writes blocks of ids and the documents they belong to, holding one block at a time."""

    def __init__(self, stream):
        self.stream, self.at = stream, 0
        self.index = {"ids": [], "docs": [], "n_ids": 0, "n_docs": 0}
        self.squeeze = zstandard.ZstdCompressor(level=3)
        self.ids: list[np.ndarray] = []
        self.waiting = 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> list[int]:
        self.stream.write(data)
        self.at += len(data)
        return [self.at - len(data), len(data)]

    def _planes(self, values: np.ndarray) -> list[list[int]]:
        octets = values.view(np.uint8).reshape(len(values), values.itemsize)
        return [self._put(self.squeeze.compress(np.ascontiguousarray(octets[:, k]).tobytes())) for k in range(values.itemsize)]

    def add(self, ids: np.ndarray, doc_ids: np.ndarray, missing: np.ndarray, lengths: np.ndarray) -> None:
        """Ids of whole documents; ``missing`` marks documents without doc_id."""
        self.index["n_ids"] += len(ids)
        self.index["n_docs"] += len(doc_ids)
        self.index["docs"].append([len(doc_ids), *(self._planes(v) for v in (
            doc_ids.astype("<i8"), lengths.astype("<i8"), missing.astype("u1")))])
        self.ids.append(ids.astype("<u4"))
        self.waiting += len(ids)
        if self.waiting >= BLOCK_IDS:
            flat, whole = np.concatenate(self.ids), self.waiting // BLOCK_IDS * BLOCK_IDS
            for lo in range(0, whole, BLOCK_IDS):
                self.index["ids"].append([BLOCK_IDS, self._planes(flat[lo:lo + BLOCK_IDS])])
            self.ids, self.waiting = [flat[whole:]], self.waiting - whole

    def close(self) -> None:
        if self.waiting:
            self.index["ids"].append([self.waiting, self._planes(np.concatenate(self.ids))])
        index = json.dumps(self.index).encode()
        self._put(index + struct.pack("<Q", len(index)) + MAGIC)


class PlaneReader:
    """Reads the blocks and documents of a file that can seek."""

    def __init__(self, stream):
        self.stream = stream
        end = stream.seek(0, 2) if not hasattr(stream, "size") else stream.size()
        end = end if isinstance(end, int) else stream.tell()
        tail = self._get(end - 16, 16)
        if tail[8:] != MAGIC or self._get(0, 8) != MAGIC:
            raise ValueError("not a whole file of byte planes")
        size, = struct.unpack("<Q", tail[:8])
        self.index = json.loads(self._get(end - 16 - size, size))
        self.expand = zstandard.ZstdDecompressor()

    def _get(self, at: int, size: int) -> bytes:
        self.stream.seek(at)
        return self.stream.read(size)

    def _values(self, n: int, planes: list[list[int]], kind: str) -> np.ndarray:
        octets = np.empty((n, len(planes)), np.uint8)
        for k, (at, size) in enumerate(planes):
            octets[:, k] = np.frombuffer(self.expand.decompress(self._get(at, size)), np.uint8)
        return octets.reshape(-1).view(kind)

    def blocks(self) -> Iterator[np.ndarray]:
        for n, planes in self.index["ids"]:
            yield self._values(n, planes, "<u4")

    def documents(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for n, ids, lengths, missing in self.index["docs"]:
            yield self._values(n, ids, "<i8"), self._values(n, missing, "u1") == 1, self._values(n, lengths, "<i8")


def segment_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where texts may be cut without changing a byte-level encoding.

    A blank after a character that is no white space always begins a new piece. White space
    beyond ASCII (and the four separators before the blank) is recognised by its bytes.
    """
    n = len(data)
    start = np.zeros(n, bool)
    if n > 1:
        p1 = np.concatenate([[0], data[:-1]]).astype(np.uint8)
        p2, p3 = np.concatenate([[0], p1[:-1]]).astype(np.uint8), np.concatenate([[0, 0], p1[:-2]]).astype(np.uint8)
        space = ((p1 >= 9) & (p1 <= 13)) | ((p1 >= 28) & (p1 <= 32))
        two = (p2 == 0xC2) & ((p1 == 0x85) | (p1 == 0xA0))
        general = (p3 == 0xE2) & (p2 == 0x80) & ((p1 <= 0x8A) | (p1 == 0xA8) | (p1 == 0xA9) | (p1 == 0xAF))
        three = (((p3 == 0xE1) & (p2 == 0x9A) & (p1 == 0x80)) | general
                 | ((p3 == 0xE2) & (p2 == 0x81) & (p1 == 0x9F)) | ((p3 == 0xE3) & (p2 == 0x80) & (p1 == 0x80)))
        start = (data == 32) & ~(space | two | three)
    start[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(start)


class SegmentEncoder:
    """Encodes texts segment by segment and remembers segments; equal to encoding them whole."""

    most = 2 * CACHED

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.octets = None if tokenizer is None else self._octets()
        self.forget()

    def _octets(self) -> np.ndarray:
        """How many bytes of a text each id stands for, where pieces are byte for byte."""
        names, added = self.tokenizer.get_vocab(), {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        octets = np.zeros(max(names.values(), default=-1) + 1, np.int64)
        for name, i in names.items():
            octets[i] = len(name.encode()) if name in added else len(name)
        return octets

    def forget(self) -> None:
        self.keys, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return segment_starts(data, offsets)

    def _alone(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        texts = [raw[a:b].decode() for a, b in zip(start, end)]
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for f in found for i in f], np.uint32), np.array([len(f) for f in found], np.int64)

    def _joined(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Segments that may follow each other, as texts of many; None if the ids do not end where segments do."""
        size = end - start
        raw, bounds = W.gather(data, start, size).tobytes(), np.concatenate([[0], np.cumsum(size)])
        cuts = np.unique(np.append(np.searchsorted(bounds, np.arange(0, bounds[-1], JOINED_BYTES)), len(size)))
        texts = [raw[bounds[a]:bounds[b]].decode() for a, b in zip(cuts[:-1], cuts[1:])]
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in found])
        ends = np.cumsum(self.octets[ids])
        last = np.searchsorted(ends, bounds[1:])
        if ends[-1] != bounds[-1] or (ends[last] != bounds[1:]).any():
            return None
        return ids, np.diff(last + 1, prepend=0)

    def encode_segments(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the segments one after the other, and how many each has.

        Segments that begin with a blank and end so that a text may be cut there are encoded many at a time.
        """
        fits = (data[start] == 32) & (end > start)
        some = np.flatnonzero(fits)
        bounds = np.cumsum((end - start)[some])
        joined = np.append(W.gather(data, start[some], (end - start)[some]), np.uint8(32))
        fits[some] = np.isin(bounds, segment_starts(joined, np.array([0, len(joined)])))
        some, rest = np.flatnonzero(fits), np.flatnonzero(~fits)
        found = self._joined(data, start[some], end[some]) if len(some) else None
        if found is None:
            return self._alone(data, start, end)
        ids, n = np.zeros(0, np.uint32), np.zeros(len(start), np.int64)
        n[some] = found[1]
        if len(rest):
            ids, n[rest] = self._alone(data, start[rest], end[rest])
        ids, at = np.concatenate([found[0], ids]), np.empty(len(start), np.int64)
        order = np.concatenate([some, rest])
        at[order] = np.cumsum(n[order]) - n[order]
        return W.gather(ids, at, n), n

    def _learn(self, keys: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        at = len(self.flat) + np.cumsum(size) - size
        self.flat = np.concatenate([self.flat, ids])
        where = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.size = (np.insert(a, where, b) for a, b in ((self.keys, keys), (self.at, at), (self.size, size)))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has."""
        start = self.starts(data, offsets)
        end = np.append(start[1:], len(data))[:len(start)]
        table = W.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        keys, first, group = np.unique(W.run_hashes(table[data], start, end), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > self.most:
            self.forget()
        known = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        if len(self.keys):
            new = self.keys[np.minimum(known, len(self.keys) - 1)] != keys
        if new.any():
            self._learn(keys[new], *self.encode_segments(data, start[first[new]], end[first[new]]))
        place = np.searchsorted(self.keys, keys)
        at, size = self.at[place][group], self.size[place][group]
        ids = W.gather(self.flat, at, size)
        row = np.searchsorted(offsets, start, "right") - 1
        return ids, np.bincount(row, weights=size, minlength=len(offsets) - 1).astype(np.int64)


def write_token_ids(docs: DataFrame, tokenizer_json: str, folder: str, end_id: int = 0) -> DataFrame:
    """Write every whole text's ids, each followed by ``end_id``, in order of doc_id; one row a file.

    Returns part, path, n_docs, n_ids. A file is written under a name of its attempt and
    then renamed, so a repeated task replaces it whole. ``folder`` is a URI or path that
    all executors share; ``tokenizer_json`` is the content of a tokenizers file.
    """
    held = docs.sparkSession.sparkContext.broadcast(tokenizer_json)  # one vocabulary file

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        name = f"encoder_{zlib.crc32(held.value.encode())}"
        encoder = W.worker_cache(name, lambda: SegmentEncoder(Tokenizer.from_str(held.value)))
        store, base = fs.FileSystem.from_uri(folder)
        writer = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                part = batch.column("part")[0].as_py()
                final = f"{base}/ids-{part:06d}.planes"
                store.create_dir(base, recursive=True)
                trial = f"{final}.{uuid.uuid4().hex}"
                stream = store.open_output_stream(trial)
                writer = PlaneWriter(stream)
            doc_id = batch.column("doc_id")
            plain, missing = doc_id.fill_null(0).to_numpy(), doc_id.is_null().to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in W.slices(batch.column("text"), ENCODE_BYTES):
                ids, n = encoder.encode(data, offsets)
                ended = np.full(len(ids) + hi - lo, end_id, np.uint32)
                ended[np.arange(len(ids)) + np.repeat(np.arange(hi - lo), n)] = ids
                writer.add(ended, plain[lo:hi], missing[lo:hi], n + 1)
        if writer is not None:
            writer.close()
            stream.close()
            store.move(trial, final)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([final]), pa.array([writer.index["n_docs"]]), pa.array([writer.index["n_ids"]])],
                ["part", "path", "n_docs", "n_ids"])

    dealt = in_doc_order(docs.select("doc_id", "text")).withColumn("part", F.spark_partition_id())
    return saved(dealt.mapInArrow(run, "part int, path string, n_docs long, n_ids long"), "files")


def read_token_ids(files: DataFrame, folder: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32, from reading every block."""
    def run(batches):
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                with store.open_input_file(path) as stream:
                    reader = PlaneReader(stream)
                    blocks, held = reader.blocks(), np.zeros(0, "<u4")
                    for ids, missing, lengths in reader.documents():
                        sums = np.zeros(len(ids), np.int64)
                        for k, n in enumerate(lengths.tolist()):
                            crc = 0
                            while n:
                                if not len(held):
                                    held = next(blocks)
                                crc = zlib.crc32(held[:n].tobytes(), crc)
                                n, held = n - min(n, len(held)), held[n:]
                            sums[k] = crc
                        starts = start + np.cumsum(lengths) - lengths
                        start += int(lengths.sum())
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(ids, mask=missing), pa.array(starts), pa.array(lengths), pa.array(sums)],
                            ["doc_id", "start", "n_tokens", "ids_crc32"])

    # one row a file: the ids of all files before it
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = files.withColumn("start", before).select("path", "start")
    tasks = placed.repartition(max(1, files.count()), "path")
    return tasks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_id_table(docs: DataFrame, tokenizer_path: str, folder: str | None = None) -> DataFrame:
    """Write the ids of docs and read them back: doc_id, start, n_tokens, ids_crc32 for each row.

    Null texts are empty and hold the end id alone. Documents follow each other by doc_id,
    nulls first, ties by a hash of the text; repeated rows are written each. Other columns
    are not read. Files go to a new folder under ``spark.checkpoint.dir`` unless named.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        vocabulary = f.read()
    folder = folder or scratch_path(docs.sparkSession, "token_ids")
    return read_token_ids(write_token_ids(docs, vocabulary, folder), folder)
