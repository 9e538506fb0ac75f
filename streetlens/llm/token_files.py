"""Token ids as Arrow files of fixed-size-list batches: equal-length sequences and masks, random access."""

from __future__ import annotations

import itertools
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streetlens.llm.arrays import RangeHash, chunks, text_bytes, word_spans
from streetlens.session import scratch_path

SPACE, LETTER, DIGIT, OTHER = range(4)

#: Bytes of text encoded at once; the arrays beside them take some sixty times as much.
PIECE_BYTES = 1 << 20


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    table = {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


class IdTable:
    """Ids of pieces by the hash of their bytes, as flat arrays: some 30 bytes a piece."""

    def __init__(self):
        self.keys, self.begin, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def __len__(self) -> int:
        return len(self.keys)

    def has(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), bool)
        return self.keys[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)] == keys

    def add(self, keys: np.ndarray, lists: list[list[int]]) -> None:
        """Puts in new keys, in ascending order, with their ids."""
        size = np.fromiter(map(len, lists), np.int32, len(lists))
        flat = np.fromiter(itertools.chain.from_iterable(lists), np.uint32, int(size.sum()))
        place = np.searchsorted(self.keys, keys)
        begin = len(self.ids) + np.cumsum(size, dtype=np.int64) - size
        self.keys, self.begin, self.size = (
            np.insert(old, place, new) for old, new in ((self.keys, keys), (self.begin, begin), (self.size, size)))
        self.ids = np.concatenate((self.ids, flat))


class PieceEncoder:
    """Encodes with a tokenizer of the ``tokenizers`` library, each distinct piece of text once.

    The vocabulary is lower case, drops white space and never joins letters, digits or other signs, so
    words of ASCII and Latin-1 letters are cut into runs of one kind and each run goes to the model of
    the tokenizer. Words with anything else (other scripts, apostrophes, special tokens) go through the
    whole tokenizer. Both give the ids of encoding the whole text.
    """

    def __init__(self, path: str, keep: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.letters = {b: sign for b, sign in enumerate(byte_alphabet())}
        self.known = IdTable()
        self.keep = keep
        self.kinds = np.full(256, OTHER, np.uint8)
        self.kinds[[9, 10, 11, 12, 13, 32]] = SPACE
        self.kinds[48:58] = DIGIT
        self.kinds[65:91] = self.kinds[97:123] = LETTER
        self.kinds[128:] = LETTER

    def cut(self, data: np.ndarray, offsets: np.ndarray):
        """Bytes as they are encoded, starts and ends of the pieces, which are plain, first piece of each text."""
        kinds = self.kinds[data]
        starts, ends, _ = word_spans(data, offsets, self.kinds != SPACE)
        before = np.concatenate((np.zeros(1, np.uint8), data[:-1]))
        after = np.concatenate((data[1:], np.zeros(1, np.uint8)))
        latin = before == 0xC3
        odd = (data >= 0x80) & (data != 0xC3) & ~latin
        odd |= latin & ((data == 0x97) | (data == 0xB7))
        odd |= (data == 0x27) | ((data == 0x3C) & (after == 0x7C))
        count = np.concatenate(([0], np.cumsum(odd)))
        plain_word = count[ends] == count[starts]
        change = np.zeros(len(data) + 1, np.int8)
        change[starts[plain_word]] += 1
        change[ends[plain_word]] -= 1
        plain = np.cumsum(change[:-1]).astype(bool)
        lower = data.copy()
        lower[plain & (data >= 65) & (data <= 90)] += 32
        lower[plain & latin & (data >= 0x80) & (data <= 0x9E)] += 32
        opens = np.zeros(len(data) + 1, bool)
        opens[1:-1] = plain[1:] & plain[:-1] & ((kinds[1:] != kinds[:-1]) | (kinds[1:] == DIGIT))
        opens &= np.append(kinds, SPACE) != SPACE
        opens[starts] = True
        first = np.flatnonzero(opens)
        # a piece ends where the next one opens or where its word ends
        word = np.searchsorted(starts, first, "right") - 1
        last = np.minimum(np.append(first[1:], len(data)), ends[word]) if len(first) else first
        return lower, first, last, plain_word[word], np.searchsorted(first, offsets)

    def ids_of(self, raw: bytes, plain: bool) -> list[int]:
        if plain:
            return [t.id for t in self.model.tokenize(raw.decode("latin-1").translate(self.letters))]
        return self.whole.encode(raw.decode("utf-8", "replace"), add_special_tokens=False).ids

    def encode(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, each text followed by ``end_id``, and the ids per text."""
        data, offsets = text_bytes(column)
        if not len(data):
            return np.full(len(column), end_id, np.uint32), np.ones(len(column), np.int64)
        data, starts, ends, plain, first = self.cut(data, offsets)
        keys = RangeHash(data).of(starts, ends) ^ plain.astype(np.uint64)
        values, at, piece = np.unique(keys, return_index=True, return_inverse=True)
        del keys
        if len(self.known) > self.keep:
            self.known = IdTable()
        new = np.flatnonzero(~self.known.has(values))
        self.known.add(values[new], [self.ids_of(data[starts[i]:ends[i]].tobytes(), bool(plain[i])) for i in at[new]])
        place = np.searchsorted(self.known.keys, values)
        # the end id is one more piece behind those of each text
        flat = np.append(self.known.ids, np.uint32(end_id))
        begin, sizes = np.append(self.known.begin[place], len(flat) - 1), np.append(self.known.size[place], np.int32(1))
        piece = np.insert(piece, first[1:], len(values))
        lengths = sizes[piece]
        stops = np.cumsum(lengths, dtype=np.int64)
        out = flat[np.repeat(begin[piece] - (stops - lengths), lengths) + np.arange(stops[-1])]
        total = np.concatenate(([0], stops))
        edge = first + np.arange(len(first))
        return out, np.diff(total[edge])


def file_schema(length: int, kind: pa.DataType) -> pa.Schema:
    return pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])


class SequenceWriter:
    """Packs a stream of ids into rows of ``length`` ids; the mask is true where an id is real."""

    def __init__(self, sink, length: int, kind: pa.DataType, batch_rows: int):
        self.schema, self.length, self.kind, self.size = file_schema(length, kind), length, kind, length * batch_rows
        self.file = pa.ipc.new_file(sink, self.schema)
        self.held: list[np.ndarray] = []
        self.count = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.count += len(ids)
        if self.count >= self.size:
            flat = np.concatenate(self.held)
            full = len(flat) // self.size * self.size
            for start in range(0, full, self.size):
                self.write(flat[start:start + self.size])
            self.held, self.count = [flat[full:]], len(flat) - full

    def write(self, ids: np.ndarray) -> None:
        rows = -(-len(ids) // self.length)
        padded = np.zeros(rows * self.length, self.kind.to_pandas_dtype())
        padded[:len(ids)] = ids
        real = np.arange(len(padded)) < len(ids)
        self.file.write_batch(pa.record_batch([
            pa.FixedSizeListArray.from_arrays(pa.array(padded), self.length),
            pa.FixedSizeListArray.from_arrays(pa.array(real), self.length)], schema=self.schema))

    def close(self) -> None:
        if self.count:
            self.write(np.concatenate(self.held))
        self.file.close()


def open_ipc(path: str) -> pa.RecordBatchFileReader:
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return pa.ipc.open_file(pa.memory_map(inner) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(inner))


class SequenceFile:
    """Random access to one file: a sequence, or any range of ids, without copying whole batches."""

    def __init__(self, path: str):
        self.file = open_ipc(path)
        self.length = self.file.schema.field("ids").type.list_size
        self.rows = self.file.get_batch(0).num_rows if self.file.num_record_batches else 1

    def sequence(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of one sequence: views into the file."""
        batch = self.file.get_batch(number // self.rows)
        row = number % self.rows
        return (batch.column(0).slice(row, 1).flatten().to_numpy(),
                batch.column(1).slice(row, 1).flatten().to_numpy(zero_copy_only=False))

    def ids(self, start: int, stop: int) -> np.ndarray:
        size = self.length * self.rows
        parts = []
        for number in range(start // size, -(-stop // size)):
            values = self.file.get_batch(number).column(0).flatten().to_numpy()
            parts.append(values[max(0, start - number * size):stop - number * size])
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint32)


MANIFEST = "part int, path string, docs_path string, n_docs bigint, n_ids bigint"


def file_writer(folder: str, tokenizer_path: str, end_id: int, length: int, batch_rows: int, kind: pa.DataType):
    """Task: writes its documents as one file of sequences and one index of documents; returns their names.

    Names are new in every attempt, so an attempt that is lost or repeated never touches another's files:
    only those named in the result are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        part = TaskContext.get().partitionId()
        name = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}"
        store, inner = fs.FileSystem.from_uri(name)
        encoder = PieceEncoder(tokenizer_path)
        n_docs = n_ids = 0
        schema = pa.schema([("doc_id", pa.int64()), ("offset", pa.int64()), ("n_ids", pa.int64())])
        with store.open_output_stream(inner + ".arrow") as sink, store.open_output_stream(inner + ".docs") as docs:
            sequences = SequenceWriter(sink, length, kind, batch_rows)
            with pa.ipc.new_file(docs, schema) as index:
                for batch in chunks(itertools.chain([first], batches), "text", PIECE_BYTES):
                    ids, counts = encoder.encode(batch.column("text"), end_id)
                    sequences.add(ids)
                    offset = n_ids + np.cumsum(counts) - counts
                    index.write_batch(pa.record_batch([batch.column("doc_id").cast(pa.int64()), pa.array(offset), pa.array(counts)], schema=schema))
                    n_docs, n_ids = n_docs + len(counts), n_ids + len(ids)
            sequences.close()
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([part], pa.int32()), "path": [name + ".arrow"], "docs_path": [name + ".docs"],
            "n_docs": [n_docs], "n_ids": [n_ids]})

    return run


def write_token_files(
    docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = 1, length: int = 2048,
    batch_rows: int = 256, vocabulary: int = 1 << 16,
) -> DataFrame:
    """Encode ``text`` of all rows in ascending ``doc_id`` order into Arrow files; returns their manifest.

    Each file holds record batches of ``batch_rows`` sequences of ``length`` ids (fixed-size lists) with
    a mask that is false on the padding behind the file's last id; a second file lists its documents.
    The manifest has one row per file: ``part`` (files of ascending parts hold ascending ids), ``path``,
    ``docs_path``, ``n_docs``, ``n_ids`` and ``start``, the number of ids in all files before it. Ids are stored
    with 16 bits where the vocabulary allows. ``folder`` is one all executors reach; default: a new one below
    the shared folder.

    A null text is empty and holds the end id only; a null ``doc_id`` sorts first; repeated rows are all
    kept. Only ``doc_id`` and ``text`` are read. An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    if folder is None:
        folder = scratch_path(spark, "tokens")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    kind = pa.uint16() if vocabulary <= 1 << 16 else pa.uint32()
    ordered = docs.select(F.col("doc_id").cast("bigint"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    written = ordered.mapInArrow(file_writer(folder, tokenizer_path, end_id, length, batch_rows, kind), MANIFEST)
    # one row per file: the driver only adds up their sizes
    rows = sorted(written.collect())
    starts = itertools.accumulate((r.n_ids for r in rows), initial=0)
    return spark.createDataFrame([(*r, s) for r, s in zip(rows, starts)], MANIFEST + ", start bigint")


def file_reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            tokens = SequenceFile(row["path"])
            docs = open_ipc(row["docs_path"])
            for number in range(docs.num_record_batches):
                part = docs.get_batch(number)
                offset, count = part.column(1).to_numpy(), part.column(2).to_numpy()
                sums = [zlib.crc32(tokens.ids(a, a + n).astype("<u4").tobytes()) for a, n in zip(offset.tolist(), count.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column(0), "start": pa.array(offset + row["start"]), "n_tokens": pa.array(count),
                    "ids_crc32": pa.array(sums, pa.int64())})


def read_documents(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Every document as read back from the files: ``doc_id``, ``start`` (ids of all documents before it),
    ``n_tokens`` and ``ids_crc32`` over its ids as little-endian unsigned 32-bit integers."""
    files = manifest.repartitionByRange(max(1, manifest.count()), "part").select("path", "docs_path", "start")
    return files.mapInArrow(file_reader, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
