"""Token ids as length-delimited binary records.

A data file is a run of frames:

    length   8 bytes, little-endian, of the payload
    check    4 bytes, masked CRC-32 of the length bytes
    payload  doc_id (8 bytes), flags (1 byte), ids (2 or 4 bytes each)
    check    4 bytes, masked CRC-32 of the payload

Flag 1: doc_id is NULL; flag 2: ids take four bytes (a vocabulary over 65,536).
Beside the data files lies the offset index, a Parquet table with one row per
record (file, offset, frame length, doc_id, token counts), so that records can
be read in any order.

Documents are range-partitioned and sorted by doc_id; each task frames its
range into files of bounded size. File names and contents follow from the
range alone, files appear under their name only when complete, and the index
is committed by Spark's own writer, so a repeated task leaves the same files.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.bpe import byte_symbols
from quarry.llm.common import ship_package, slices, texts

#: A new data file is begun beyond this size.
FILE_BYTES = 64 << 20
#: Most tasks that read files back; each then reads several.
MOST_TASKS = 100_000
#: Memory bounds of a task (results do not depend on them): remembered pieces
#: of text, bytes of text tokenised at once, bytes per batch read back.
PIECES_KEPT = 800_000
SLICE_BYTES = 16 << 20
READ_BYTES = 8 << 20

_HEAD = struct.Struct("<QI")
_KEY = struct.Struct("<qB")
_SUM = struct.Struct("<I")
_CLOSING = ".,;:!?"
_RUN = regex.compile(r"(?<=\S) (?=\S)")

INDEX = "file string, offset long, length long, doc_id long, n_tokens long, start_in_file long"


def masked(data: bytes) -> int:
    """CRC-32 rotated right by 15 bits plus a constant, so that the checksum
    of data that holds checksums stays meaningful."""
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, wide: bool) -> bytes:
    payload = _KEY.pack(doc_id or 0, (doc_id is None) + 2 * wide) + ids
    size = struct.pack("<Q", len(payload))
    return size + _SUM.pack(masked(size)) + payload + _SUM.pack(masked(payload))


def unframe(data: bytes) -> tuple[int | None, np.ndarray]:
    """doc_id and ids of one whole frame; ValueError if a checksum is wrong."""
    size, check = _HEAD.unpack_from(data)
    if masked(data[:8]) != check or len(data) != size + 16:
        raise ValueError("a record's length is damaged")
    payload = data[12:-4]
    if masked(payload) != _SUM.unpack(data[-4:])[0]:
        raise ValueError("a record's payload is damaged")
    doc_id, flags = _KEY.unpack_from(payload)
    return None if flags & 1 else doc_id, np.frombuffer(payload, "<u4" if flags & 2 else "<u2", offset=_KEY.size)


def frames(stream) -> Iterator[bytes]:
    """The frames of an open data file, one at a time."""
    while head := stream.read(_HEAD.size):
        if len(head) < _HEAD.size or masked(head[:8]) != _HEAD.unpack(head)[1]:
            raise ValueError("a record's length is damaged")
        yield head + stream.read(_HEAD.unpack(head)[0] + 4)


class ChunkTokenizer:
    """The ``tokenizers`` library over the pieces of a text, each distinct
    piece once while it is remembered.

    With a byte-level pre-tokeniser a word always ends before a single space
    between other characters, so the ids of the pieces between such spaces, in
    a row, are the text's ids. The distinct pieces of a batch are numbered by
    Arrow, new ones are encoded in one call (a piece begins with its only
    space, so the ids that stand for a space show where each begins), and the
    ids of all texts are gathered by number. Texts with other runs of white
    space are cut where the rule holds; other tokenisers get whole texts.
    """

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_str(spec)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.wide = self.lib.get_vocab_size() > 1 << 16
        self.kind = "<u4" if self.wide else "<u2"
        pre = json.loads(spec)["pre_tokenizer"] or {}
        self.by_pieces = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre["add_prefix_space"]
        self.begins = np.zeros(self.lib.get_vocab_size(), bool)
        self.space, self.code = byte_symbols()[ord(" ")], "I" if self.wide else "H"
        self.begins[[i for t, i in self.lib.get_vocab().items() if t.startswith(self.space)]] = True
        self.known: dict[str, bytes | None] = {}
        self.words: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _learn(self, pieces: list[str]) -> None:
        """Ids of pieces with a space before them; None where the piece has
        white space at an end, so that the rule above does not hold. An ASCII
        word is a single word of the pre-tokeniser, and what closes it another:
        these go to the library's model as they are."""
        if len(self.words) > PIECES_KEPT:
            self.words = {}
        known, words, model, others = self.known, self.words, self.lib.model, []
        for p in pieces:
            if not p or p != p.strip():
                known[p] = None
                continue
            word = p.rstrip(_CLOSING)
            if not (word.isascii() and word.isalpha()):
                others.append(p)
                continue
            ids = words.get(word)
            if ids is None:
                words[word] = ids = array(self.code, [t.id for t in model.tokenize(self.space + word)]).tobytes()
            tail = p[len(word):]
            if tail not in self.tails:
                self.tails[tail] = self._ids(tail)
            known[p] = ids + self.tails[tail]
        for i in range(0, len(others), 20_000):
            part = others[i : i + 20_000]
            ids = np.array(self.lib.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)[0].ids, np.int64)
            at = np.flatnonzero(self.begins[ids])
            if len(at) == len(part):
                data = ids.astype(self.kind).tobytes()
                bounds = (np.append(at, len(ids)) * np.dtype(self.kind).itemsize).tolist()
                known.update(zip(part, [data[i:j] for i, j in zip(bounds, bounds[1:])]))
            else:  # a special token with a space of its own
                known.update((p, self._ids(" " + p)) for p in part)

    def encode(self, batch: pa.Array, end_id: int) -> list[bytes]:
        """Ids of each text, ``end_id`` after them, in the record's width."""
        end = np.array([end_id], self.kind).tobytes()
        if not self.by_pieces:
            return [self._ids(t) + end for t in batch.to_pylist()]
        cut = pc.split_pattern(batch, " ")
        bounds = cut.offsets.to_numpy()
        bounds = bounds - bounds[0]
        numbered = cut.flatten().dictionary_encode()
        number, distinct = numbered.indices.to_numpy(), numbered.dictionary.to_pylist()
        if len(self.known) > PIECES_KEPT:
            self.known = {p: self.known[p] for p in distinct if p in self.known}
        self._learn([p for p in distinct if p not in self.known])
        coded = [self.known[p] for p in distinct]
        odd = np.fromiter((c is None for c in coded), bool, len(coded))[number]
        odd = np.logical_or.reduceat(odd, bounds[:-1])
        size = np.fromiter((len(c or b"") for c in coded), np.int64, len(coded)) // np.dtype(self.kind).itemsize
        begin = np.cumsum(size) - size
        length = size[number]
        length[bounds[:-1]] = 0  # the first piece of a text has no space before it
        stop = np.cumsum(length)
        flat = np.frombuffer(b"".join([c or b"" for c in coded]), self.kind)
        data = flat[np.repeat(begin[number] - (stop - length), length) + np.arange(stop[-1])].tobytes()
        edge = np.append(0, stop[bounds[1:] - 1]) * np.dtype(self.kind).itemsize
        firsts = [distinct[n] for n in number[bounds[:-1]].tolist()]
        return [
            (b"".join([self._ids(c) for c in _apart(batch[k].as_py())]) if bad else self._ids(first) + data[i:j]) + end
            for k, (bad, first, i, j) in enumerate(zip(odd.tolist(), firsts, edge.tolist(), edge[1:].tolist()))
        ]


def _apart(text: str) -> list[str]:
    """A text cut before single spaces between other characters."""
    first, *rest = _RUN.split(text)
    return [first, *(" " + c for c in rest)]


def _local(path: str):
    """File system and path of a URI as the tasks see it."""
    return pafs.FileSystem.from_uri(regex.sub("^file:/+", "/", path))


class _Writer:
    """Frames one task's documents into files of bounded size."""

    def __init__(self, folder: str, part: int):
        self.fs, self.folder = _local(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.part, self.n, self.out, self.at, self.tokens = part, 0, None, 0, 0

    def add(self, data: bytes, doc_id, n_tokens: int) -> tuple:
        if self.out is None:
            self.name = f"part-{self.part:08d}-{self.n:06d}.rec"
            self.temp = f"{self.folder}/_{self.name}.{os.getpid()}-{os.urandom(6).hex()}"
            self.out, self.at, self.tokens = self.fs.open_output_stream(self.temp), 0, 0
        row = (self.name, self.at, len(data), doc_id, n_tokens, self.tokens)
        self.out.write(data)
        self.at += len(data)
        self.tokens += n_tokens
        return row

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            final = f"{self.folder}/{self.name}"
            if self.fs.get_file_info(final).type != pafs.FileType.NotFound:
                self.fs.delete_file(final)
            self.fs.move(self.temp, final)
            self.out, self.n = None, self.n + 1


def write_records(docs: DataFrame, path: str, tokenizer_path: str, end_id: int,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise every document, write data files in ``path/data`` and the index
    in ``path/index``, both in ascending doc_id order; return the index.

    ``path`` must be on storage that the driver and all executors share. NULL
    texts are empty; every record ends with ``end_id``. NULL doc_ids come
    first; rows of one doc_id are ordered by their text, repeated rows keep one
    record each. An empty table writes an empty index. Texts of any length are
    one record, made in one task; other columns do not matter, whatever their
    name.
    """
    spark = docs.sparkSession
    src = texts(docs, id_col, text_col)
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    folder = f"{path}/data"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, writer = ChunkTokenizer(spec.value), _Writer(folder, TaskContext.get().partitionId())
        width = 4 if coder.wide else 2
        for whole in batches:
            for batch in slices(whole, SLICE_BYTES):
                rows = []
                for doc_id, coded in zip(batch.column(0).to_pylist(), coder.encode(batch.column(1), end_id)):
                    rows.append(writer.add(frame(doc_id, coded, coder.wide), doc_id, len(coded) // width))
                    if writer.at >= FILE_BYTES:
                        writer.close()
                kinds = [pa.string(), *[pa.int64()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                                 names=["file", "offset", "length", "doc_id", "n_tokens", "start_in_file"])
        writer.close()

    # rows of one doc_id may be many (NULL ids): their texts' hashes spread them
    keyed = src.withColumn("h", F.xxhash64("text")).withColumn("n", F.monotonically_increasing_id())
    ordered = keyed.repartitionByRange("doc_id", "h", "n").sortWithinPartitions("doc_id", "h", "n").select("doc_id", "text")
    ordered.mapInArrow(run, INDEX).write.parquet(f"{path}/index")
    return spark.read.schema(INDEX).parquet(f"{path}/index")


def file_starts(index: DataFrame) -> DataFrame:
    """``file`` and ``file_start``, the tokens in all files before it. One row
    per data file goes through one task, not one per record."""
    files = index.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("file_start"))


_READ = "file string, doc_id long, start long, ids binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["file", "doc_id", "start", "ids"])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record in file order: ``file``, ``doc_id``, ``start`` (tokens in
    all records before it) and ``ids`` (little-endian 32-bit). All checksums
    are verified. Files are spread over as many tasks as there are files."""
    ship_package(spark)
    folder = f"{path}/data"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _local(folder)
        for batch in batches:
            for name, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, size = [], 0
                with fs.open_input_stream(f"{base}/{name}", buffer_size=1 << 20) as stream:
                    for data in frames(stream):
                        doc_id, ids = unframe(data)
                        rows.append((name, doc_id, before, ids.astype("<u4").tobytes()))
                        before += len(ids)
                        size += 4 * len(ids)
                        if size > READ_BYTES:
                            yield _batch(rows)
                            rows, size = [], 0
                if rows:
                    yield _batch(rows)

    files = file_starts(spark.read.schema(INDEX).parquet(f"{path}/index"))
    tasks = min(MOST_TASKS, max(1, files.count()))
    return files.repartitionByRange(tasks, "file").mapInArrow(run, _READ)


def shuffled_read(spark: SparkSession, path: str, seed: int) -> DataFrame:
    """Every record once, in a random order fixed by ``seed``, each read at its
    offset: ``file``, ``doc_id``, ``start`` and ``ids``."""
    ship_package(spark)
    folder = f"{path}/data"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _local(folder)
        name, source, rows, size = None, None, [], 0
        for batch in batches:
            for file, offset, length, before in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, fs.open_input_file(f"{base}/{file}")
                doc_id, ids = unframe(source.read_at(length, offset))
                rows.append((file, doc_id, before, ids.astype("<u4").tobytes()))
                size += 4 * len(ids)
                if size > READ_BYTES:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)

    index = spark.read.schema(INDEX).parquet(f"{path}/index")
    index = index.join(file_starts(index), "file").select("file", "offset", "length", (F.col("file_start") + F.col("start_in_file")).alias("start"))
    dealt = index.withColumn("r", F.xxhash64(F.lit(seed), "file", "offset"))
    return dealt.repartitionByRange("r").sortWithinPartitions("r").drop("r").mapInArrow(run, _READ)
