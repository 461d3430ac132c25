"""Token ids in binary files of independent zstandard frames with a seek table.

A file is frames, then a table, then a trailer:

* frame: one zstandard frame with content checksum; it holds whole documents, ids
  little-endian, one document after the other;
* table: little-endian, one entry per frame (offset u64, stored bytes u64, raw
  bytes u64, crc32 of the stored bytes u32, first document u32) and one entry per
  document (id i64, number of ids u64), both behind their counts (u64, u64);
* trailer: table offset u64, crc32 of the table u32, bytes per id u32, MAGIC.

A reader seeks to the trailer, reads the table, and decompresses only the frames
that hold the documents it wants.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyra.llm._common import partitions, scratch_path, tidy
from papyra.llm.byte_bpe import encoder
from papyra.llm.words import as_texts, slices

MAGIC = b"PAPYTOK1"
FRAME = np.dtype([("offset", "<u8"), ("stored", "<u8"), ("raw", "<u8"), ("crc", "<u4"), ("first", "<u4")])
DOC = np.dtype([("id", "<i8"), ("n", "<u8")])
TRAILER = struct.Struct("<QII8s")
FRAME_BYTES = 1 << 20
NO_ID = np.iinfo(np.int64).min


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """Any store that pyarrow knows by its URI; plain paths are local or mounted."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


class Writer:
    def __init__(self, sink, width: int, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.sink, self.width, self.most = sink, width, frame_bytes
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frames, self.docs, self.held, self.size, self.at, self.first = [], [], [], 0, 0, 0

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        raw = ids.astype(f"<u{self.width}").tobytes()
        if self.held and self.size + len(raw) > self.most:
            self.flush()
        self.docs.append((doc_id, len(ids)))
        self.held.append(raw)
        self.size += len(raw)

    def flush(self) -> None:
        data = self.packer.compress(b"".join(self.held))
        self.frames.append((self.at, len(data), self.size, zlib.crc32(data), self.first))
        self.sink.write(data)
        self.at += len(data)
        self.held, self.size, self.first = [], 0, len(self.docs)

    def close(self) -> None:
        if self.held:
            self.flush()
        table = (struct.pack("<QQ", len(self.frames), len(self.docs)) + np.array(self.frames, FRAME).tobytes()
                 + np.array(self.docs, DOC).tobytes())
        self.sink.write(table + TRAILER.pack(self.at, zlib.crc32(table), self.width, MAGIC))


class Reader:
    """Random access to the documents of one file; every read is checked."""

    def __init__(self, source):
        self.source = source
        size = source.size() if hasattr(source, "size") else source.seek(0, io.SEEK_END)
        source.seek(size - TRAILER.size)
        at, crc, self.width, magic = TRAILER.unpack(source.read(TRAILER.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        source.seek(at)
        table = source.read(size - TRAILER.size - at)
        if zlib.crc32(table) != crc:
            raise ValueError("the seek table is damaged")
        n, m = struct.unpack_from("<QQ", table)
        self.frames = np.frombuffer(table, FRAME, n, 16)
        self.docs = np.frombuffer(table, DOC, m, 16 + n * FRAME.itemsize)

    def frame(self, k: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """(document number, id, ids) of the documents of frame k."""
        f = self.frames[k]
        self.source.seek(int(f["offset"]))
        data = self.source.read(int(f["stored"]))
        if zlib.crc32(data) != f["crc"]:
            raise ValueError(f"frame {k} is damaged")
        ids = np.frombuffer(zstandard.ZstdDecompressor().decompress(data, int(f["raw"])), f"<u{self.width}")
        last = int(self.frames[k + 1]["first"]) if k + 1 < len(self.frames) else len(self.docs)
        at = 0
        for i in range(int(f["first"]), last):
            n = int(self.docs[i]["n"])
            yield i, int(self.docs[i]["id"]), ids[at:at + n]
            at += n

    def get(self, numbers: Iterable[int]) -> Iterator[tuple[int, int, np.ndarray]]:
        """The asked documents; frames without any are not read."""
        want = np.unique(np.fromiter(numbers, np.int64))
        of = np.searchsorted(self.frames["first"], want, "right") - 1
        for k in np.unique(of):
            asked = set(want[of == k].tolist())
            yield from (x for x in self.frame(int(k)) if x[0] in asked)


def write_tokens(docs: DataFrame, out_dir: str, tokenizer: str, end_id: int, id_col: str = "doc_id",
                 text_col: str = "text", frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Encode whole texts and write them in ascending id order; returns the
    manifest: file (name under ``out_dir``), n_docs, n_tokens, first_id, start.

    Texts are dealt out by ranges of the id, one file per range and task; the
    texts move once and ids go straight from the encoder to the file.  A file
    is written under a name of the task's attempt and renamed when complete, so
    lost executors and repeated attempts leave whole files only.  The manifest
    has one row per file; ``start`` sums over these rows, not over documents.

    Defined cases: a null text is empty and has the end id alone; null ids come
    first and are stored as the smallest 64-bit number; equal ids keep all rows;
    other columns are not read; an empty table writes no file.
    """
    fs, root = filesystem(out_dir)
    fs.create_dir(root, recursive=True)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("__id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    n = partitions(docs.sparkSession)
    dealt = rows.repartitionByRange(n, "__id").sortWithinPartitions("__id", F.xxhash64("__text"))

    def run(batches):
        task = TaskContext.get()
        store, base = filesystem(out_dir)
        enc = encoder(tokenizer)
        name = f"tokens-{task.partitionId():09d}.bin"
        part = f"{base}/.{name}.{task.taskAttemptId()}"
        writer = sink = None
        docs_, ids_, first = 0, 0, None
        for batch in batches:
            texts = as_texts(batch["__text"])
            keys = batch["__id"].to_numpy()
            for at, some in slices(texts, 4 << 20):
                ids, n = enc.flat(some)
                ids = np.insert(ids, np.cumsum(n), end_id)
                ends = np.cumsum(n + 1).tolist()
                for key, a, b in zip(keys[at:at + len(some)].tolist(), [0, *ends], ends):
                    if writer is None:
                        sink = store.open_output_stream(part)
                        writer, first = Writer(sink, 2 if max(enc.size, end_id + 1) <= 1 << 16 else 4, frame_bytes), key
                    writer.add(key, ids[a:b])
                docs_ += len(n)
                ids_ += len(ids)
        if writer is not None:
            writer.close()
            sink.close()
            store.move(part, f"{base}/{name}")
            yield pa.RecordBatch.from_pydict({"file": [name], "n_docs": [docs_], "n_tokens": [ids_], "first_id": [first]})

    files = dealt.mapInArrow(tidy(run), "file string, n_docs long, n_tokens long, first_id long")
    path = f"{out_dir}/manifest"
    files.write.parquet(path)
    done = docs.sparkSession.read.schema(files.schema).parquet(path)
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return done.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")))


def read_tokens(manifest: DataFrame, out_dir: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32, ids) of every document, read back frame by
    frame; each task takes whole files."""
    def run(batches):
        store, base = filesystem(out_dir)
        for batch in batches:
            for name, start in zip(batch["file"].to_pylist(), batch["start"].to_pylist(), strict=True):
                with store.open_input_file(f"{base}/{name}") as f:
                    r = Reader(f)
                    for k in range(len(r.frames)):
                        keys, starts, lens, crcs, ids = [], [], [], [], []
                        for _, key, x in r.frame(k):
                            keys.append(None if key == NO_ID else key)
                            starts.append(start)
                            lens.append(len(x))
                            crcs.append(zlib.crc32(x.astype("<u4").tobytes()))
                            ids.append(x)
                            start += len(x)
                        flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(lens, pa.int64()), pa.array(crcs, pa.int64()),
                             pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32), flat)],
                            [id_col, "start", "n_tokens", "ids_crc32", "ids"])

    names = manifest.select("file", "start").repartition(partitions(manifest.sparkSession), "file")
    return names.mapInArrow(run, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long, ids array<int>")


def token_dir(docs: DataFrame) -> str:
    return scratch_path(docs.sparkSession, "tokens")
