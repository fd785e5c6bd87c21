"""Token ids in bit or byte planes: encode documents, write them in doc_id order, read them back.

File layout (little-endian):

* ``TKPL``, then u32 version, block size, bits per id, 1 for byte planes;
* blocks of ``block_ids`` ids (the last may be shorter). A block is transposed
  to one plane per bit or per byte; each plane is one zstandard frame. Byte
  planes are the default: on text they are smaller and cheaper than bit planes;
* the document index (doc_ids, whether null, lengths) as one zstandard frame;
* the chunk index (ids in the block, then the length of each plane's frame) as
  one zstandard frame, with the block offsets implied by the running sum;
* a fixed-length tail that says where both indexes lie, ending in ``TKPL``.

A reader that wants ids [a, b) decodes the blocks that hold them only.

Defined cases: a null text is empty and yields the end id alone. Documents are
ordered by doc_id (null first), repeated doc_ids by a hash of the text and the
text. Columns beside doc_id and the text column are ignored. An empty table
yields no file.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attempt_name, few_tasks, fresh_dir, make_dir, map_arrow, open_store, text_or_empty, values_of

MAGIC = b"TKPL"
BLOCK_IDS = 16384
#: Tokens that a task reads back.
READ_TOKENS = 32 << 20
END_ID = 0
_HEAD = struct.Struct("<4sIIII")
_TAIL = struct.Struct("<QIQIQ4s")
#: Bound on the remembered pieces of a worker; beyond it they become the old half, and the old half goes.
CACHE_PIECES = 450_000

#: Stand in front of pieces that no space precedes; texts that hold them are encoded in one go.
_COMMA, _STOP, _LINE = "\x01", "\x02", "\x03"
_UNSAFE = re.compile(r"\s\s|[\x01-\x03]")
_ENCODERS: dict = {}


class Encoder:
    """The ids of texts under one tokenizer file, as little-endian bytes of ``width`` bytes an id.

    In a text without two adjacent white-space characters each space, each line
    end and, after a letter or digit, each full stop or comma that ends a word
    starts a new pre-token of a byte-level tokenizer. Pieces between them are
    encoded apart and remembered. Any other text, and one that holds a special
    token's string, is encoded in one go.
    """

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        import json

        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        spec = json.loads(self.tok.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.by_piece = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        top = max([*self.tok.get_vocab(with_added_tokens=True).values(), 1])
        self.bits = max(8, int(top).bit_length())
        self.dtype = np.dtype("<u2" if self.bits <= 16 else "<u4")
        self.starts = {m: np.zeros(top + 1, dtype=bool) for m in " \n"}
        for t, i in self.tok.get_vocab(with_added_tokens=True).items():
            self.starts[" "][i], self.starts["\n"][i] = t[:1] == "\u0120", t[:1] == "\u010a"
        self.limit, self.first, self.old = cache_pieces, {}, {}
        self.rest = self._fixed()

    def _fixed(self) -> dict:
        return {_COMMA: self._whole(","), _STOP: self._whole(".")}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _learn(self, pieces: set) -> None:
        """Put ids of unseen pieces in the memory.

        Pieces that follow a space go in as one text, where a token that starts
        with a space starts the next piece; those that follow a line end too,
        told apart by the line end's token.
        """
        miss = pieces
        if self.old:
            new = miss.difference(self.old)
            self.rest.update((p, self.old[p]) for p in miss - new)
            miss = new
        if "" in miss:
            miss.discard("")
            self.rest[""] = self._whole(" ")
        lines = [p for p in miss if p[0] == _LINE]
        self._learn_joined(list(miss.difference(lines)), " ", 0)
        self._learn_joined(lines, "\n", 1)

    def _learn_joined(self, pieces: list, mark: str, skip: int) -> None:
        if not pieces:
            return
        text = mark + mark.join([p[skip:] for p in pieces] if skip else pieces)
        ids = np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.dtype)
        raw, width = ids.tobytes(), self.dtype.itemsize
        cuts = (np.flatnonzero(self.starts[mark][ids]) * width).tolist()
        if len(cuts) == len(pieces):
            cuts.append(len(raw))
            self.rest.update(zip(pieces, [raw[a:b] for a, b in zip(cuts, cuts[1:])]))
        else:
            self.rest.update((p, self._whole(mark + p[skip:])) for p in pieces)

    def encode(self, text: str) -> bytes:
        if not self.by_piece or not _plain_space(text) or any(s in text for s in self.special):
            return self._whole(text)
        if _plain_stops(text):
            text = text.replace(",", " " + _COMMA).replace(".", " " + _STOP).replace("\n", " " + _LINE)
        pieces = text.split(" ")
        head = pieces[0]
        if head not in self.first:
            if len(self.first) >= self.limit // 4:
                self.first.clear()
            self.first[head] = self._whole(head)
        del pieces[0]
        miss = set(pieces).difference(self.rest)
        if miss:
            if len(self.rest) >= self.limit:
                self.old, self.rest = self.rest, self._fixed()
                miss = set(pieces).difference(self.rest)
            self._learn(miss)
        return self.first[head] + b"".join(map(self.rest.__getitem__, pieces))


def _plain_space(text: str) -> bool:
    """Is all white space single, and are the marks of this module absent?

    The first test is the cheap one: a text whose words, joined by one space, give
    it back has single spaces and line ends only. Other texts are searched.
    """
    if " ".join(text.split()) == text.replace("\n", " "):
        return not (_COMMA in text or _STOP in text or _LINE in text)
    return not _UNSAFE.search(text)


def _plain_stops(text: str) -> bool:
    """Does each full stop and comma follow a letter or digit and precede a space, a line end or the end?"""
    for mark in ".,":
        parts = text.split(mark)
        if len(parts) > 1:
            if not all([p[-1:].isalnum() for p in parts[:-1]]):
                return False
            if not {p[:1] for p in parts[1:]} <= {" ", "\n", ""}:
                return False
    return True


def encoder(path: str, cache_pieces: int = CACHE_PIECES) -> Encoder:
    """One encoder per worker process, file and size of its memory."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    key = path, cache_pieces
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, cache_pieces)
    return _ENCODERS[key]


def to_planes(ids: np.ndarray, bits: int, per_byte: bool = False) -> list[bytes]:
    """Planes of ids, the highest bit (or byte) first."""
    if per_byte:
        return [x.tobytes() for x in ids.astype(">u4").view(np.uint8).reshape(-1, 4)[:, 4 - (bits + 7) // 8 :].T]
    wide = ids.astype(">u4").view(np.uint8).reshape(-1, 4)
    flat = np.unpackbits(wide, axis=1)[:, 32 - bits :]
    return [x.tobytes() for x in np.packbits(flat.T, axis=1)]


def from_planes(planes: list[bytes], n: int, per_byte: bool = False) -> np.ndarray:
    """The ``n`` ids of planes."""
    if per_byte:
        wide = np.zeros((n, 4), dtype=np.uint8)
        wide[:, 4 - len(planes) :] = np.frombuffer(b"".join(planes), dtype=np.uint8).reshape(len(planes), n).T
        return wide.view(">u4").reshape(-1).astype("<u4")
    bits = len(planes)
    rows = np.frombuffer(b"".join(planes), dtype=np.uint8).reshape(bits, -1)
    flat = np.zeros((n, 32), dtype=np.uint8)
    flat[:, 32 - bits :] = np.unpackbits(rows, axis=1)[:, :n].T
    return np.packbits(flat, axis=1).view(">u4").reshape(-1).astype("<u4")


class Writer:
    """Writes one file of documents to a binary stream."""

    def __init__(self, out, bits: int, block_ids: int = BLOCK_IDS, level: int = 3, per_byte: bool = False):
        import zstandard

        self.out, self.bits, self.block_ids, self.per_byte = out, bits, block_ids, per_byte
        self.z = zstandard.ZstdCompressor(level=level)
        self.pending: list[np.ndarray] = []
        self.n_pending = self.n_ids = 0
        self.chunks: list[list[int]] = []
        self.docs: list[tuple] = []
        self.at = out.write(_HEAD.pack(MAGIC, 1, block_ids, bits, per_byte)) or _HEAD.size

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, doc_id is None, len(ids)))
        self.pending.append(ids)
        self.n_pending += len(ids)
        self.n_ids += len(ids)
        if self.n_pending >= self.block_ids:
            all_ids = np.concatenate(self.pending)
            whole = len(all_ids) // self.block_ids * self.block_ids
            for i in range(0, whole, self.block_ids):
                self._block(all_ids[i : i + self.block_ids])
            self.pending, self.n_pending = [all_ids[whole:]], len(all_ids) - whole

    def _put(self, data: bytes) -> int:
        self.out.write(data)
        self.at += len(data)
        return len(data)

    def _block(self, ids: np.ndarray) -> None:
        self.chunks.append([len(ids), *(self._put(self.z.compress(p)) for p in to_planes(ids, self.bits, self.per_byte))])

    def close(self) -> None:
        if self.n_pending:
            self._block(np.concatenate(self.pending))
        doc_at = self.at
        ids = np.array([d[0] for d in self.docs], dtype="<i8").tobytes()
        null = np.array([d[1] for d in self.docs], dtype=np.uint8).tobytes()
        length = np.array([d[2] for d in self.docs], dtype="<i8").tobytes()
        n_doc = self._put(self.z.compress(ids + null + length))
        chunk_at = self.at
        n_chunk = self._put(self.z.compress(np.array(self.chunks, dtype="<u4").tobytes()))
        self.out.write(_TAIL.pack(doc_at, n_doc, chunk_at, n_chunk, len(self.docs), MAGIC))


class Reader:
    """Reads a file of documents from a seekable binary file of ``size`` bytes."""

    def __init__(self, f, size: int):
        import zstandard

        self.f, self.z = f, zstandard.ZstdDecompressor()
        f.seek(0)
        magic, version, self.block_ids, self.bits, self.per_byte = _HEAD.unpack(f.read(_HEAD.size))
        f.seek(size - _TAIL.size)
        doc_at, n_doc, chunk_at, n_chunk, docs, tail = _TAIL.unpack(f.read(_TAIL.size))
        if magic != MAGIC or tail != MAGIC or version != 1:
            raise ValueError("not a token file")
        f.seek(doc_at)
        raw = self.z.decompress(f.read(n_doc))
        self.doc_ids = np.frombuffer(raw[: 8 * docs], dtype="<i8")
        self.nulls = np.frombuffer(raw[8 * docs : 9 * docs], dtype=np.uint8)
        self.lengths = np.frombuffer(raw[9 * docs :], dtype="<i8")
        f.seek(chunk_at)
        self.chunks = np.frombuffer(self.z.decompress(f.read(n_chunk)), dtype="<u4").reshape(-1, 1 + ((self.bits + 7) // 8 if self.per_byte else self.bits))
        sizes = self.chunks[:, 1:].sum(axis=1, dtype=np.int64)
        self.offsets = _HEAD.size + np.concatenate([[0], np.cumsum(sizes)])

    def block(self, k: int) -> np.ndarray:
        self.f.seek(int(self.offsets[k]))
        raw, planes, at = self.f.read(int(self.offsets[k + 1] - self.offsets[k])), [], 0
        for n in self.chunks[k, 1:].tolist():
            planes.append(self.z.decompress(raw[at : at + n]))
            at += n
        return from_planes(planes, int(self.chunks[k, 0]), bool(self.per_byte))

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids [start, stop) of the file, from the blocks that hold them."""
        if stop <= start:
            return np.zeros(0, dtype="<u4")
        first, last = start // self.block_ids, (stop - 1) // self.block_ids
        found = np.concatenate([self.block(k) for k in range(first, last + 1)])
        return found[start - first * self.block_ids : stop - first * self.block_ids]

    def documents(self):
        """(doc_id, ids) of each document, reading each block once."""
        have, k = np.zeros(0, dtype="<u4"), 0
        for doc_id, null, n in zip(self.doc_ids.tolist(), self.nulls.tolist(), self.lengths.tolist()):
            parts, got = [have], len(have)
            while got < n:
                parts.append(self.block(k))
                got += len(parts[-1])
                k += 1
            have = np.concatenate(parts) if len(parts) > 1 else have
            yield None if null else doc_id, have[:n]
            have = have[n:]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def write_tokens(docs: DataFrame, folder: str, tokenizer: str | None = None, text: str = "text", end_id: int | None = END_ID, block_ids: int = BLOCK_IDS, per_byte: bool = True, cache_pieces: int = CACHE_PIECES) -> DataFrame:
    """Encode and write ``docs`` below ``folder``; one row per file in doc_id order: part, file, n_docs, n_tokens.

    Texts are dealt by range over doc_id, then encoded and written in the same
    task: ids never cross the network. The list of files, a row for each task
    that wrote one, is the driver's; a task that runs again names its own file.
    """
    import pyarrow as pa

    path = tokenizer or default_tokenizer()
    make_dir(docs.sparkSession, folder)

    def write(batches):
        from pyspark import TaskContext

        e, writer, out, name = encoder(path, cache_pieces), None, None, attempt_name("tokens", ".tkpl")
        end = [] if end_id is None else np.array([end_id], dtype=e.dtype)
        for b in batches:
            for doc_id, s in zip(values_of(b.column(0)), values_of(b.column(1))):
                if writer is None:
                    fs, base = open_store(folder)
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    writer = Writer(out, e.bits, block_ids, per_byte=per_byte)
                ids = np.frombuffer(e.encode(s), dtype=e.dtype)
                writer.add(doc_id, np.concatenate([ids, end]) if len(end) else ids)
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "file": [name], "n_docs": pa.array([len(writer.docs)], pa.int64()), "n_tokens": pa.array([writer.n_ids], pa.int64())})

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    d = d.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    kind = "part long, file string, n_docs long, n_tokens long"
    return docs.sparkSession.createDataFrame(map_arrow(d, write, kind).collect(), kind)


def read_tokens(files: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """Read the files back: doc_id, start, n_tokens, ids_crc32 and, if asked, ids (array of long).

    The driver holds one row per file, to know how many ids lie before it.
    """
    import pyarrow as pa

    spark, before, rows = files.sparkSession, 0, []
    for r in sorted(files.collect(), key=lambda r: r["part"]):
        rows.append((r["file"], before))
        before += r["n_tokens"]

    def read(batches):
        fs, base = open_store(folder)
        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with fs.open_input_file(f"{base}/{name}") as f:
                    out = {k: [] for k in schema.names}
                    for doc_id, ids in Reader(f, f.size()).documents():
                        for k, v in zip(schema.names, (doc_id, start, len(ids), zlib.crc32(ids.tobytes()), ids)):
                            out[k].append(v)
                        start += len(ids)
                        if len(out["doc_id"]) == 1000:
                            yield pa.RecordBatch.from_pydict(out, schema=schema)
                            out = {k: [] for k in schema.names}
                    yield pa.RecordBatch.from_pydict(out, schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int64()))] * with_ids)
    table = spark.createDataFrame(rows, "file string, start long")
    tasks = max(1, min(len(rows), few_tasks(spark, before, READ_TOKENS)))
    return map_arrow(table.repartition(tasks), read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def store(spark: SparkSession, docs: DataFrame, cache_pieces: int = CACHE_PIECES) -> DataFrame:
    """Write ``docs`` to a fresh folder of token files and return what reading them gives."""
    folder = fresh_dir(spark, "tokens")
    return read_tokens(write_tokens(docs, folder, cache_pieces=cache_pieces), folder)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: all documents as token files, read back."""
    return store(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
