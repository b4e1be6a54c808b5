"""Token ids in checksummed binary files, one per range of document ids."""

from __future__ import annotations

import os
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, Window

from broadsheet.llm import runs
from broadsheet.llm.common import file_system, partitions, scratch, tidy, written
from broadsheet.llm.rangecoder import BLOCK, HEAD_BYTES, decode_block, encode_block, read_head

END_ID = 0
# Bytes of distinct words and their ids that a worker keeps.
KEPT = 48 << 20
# Text whose words are looked up at a time, in bytes, and words that are encoded as one text.
BYTES = 8 << 20
TOGETHER = 256
_FOOT = struct.Struct("<QQI4s")
_FOOT_MAGIC = b"TIDX"


class LibraryTokenizer:
    """The tokenizers library with a bounded cache of words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.size = self.tokenizer.get_vocab_size()
        # Bytes of text that each id stands for: a character of a byte-level token is one byte.
        self._bytes = np.zeros(self.size, dtype=np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self._bytes[i] = len(token)
        for i, token in self.tokenizer.get_added_tokens_decoder().items():
            self._bytes[i] = len(token.content.encode())
        self._known = runs.Known(self._learn, KEPT)

    def _learn(self, units: pa.Array) -> pa.Array:
        """Ids of each of the units. Those that begin with white space and end a word are encoded
        alike wherever they stand, for no piece of the tokenizer reaches across the end of a word:
        many are encoded as one text, and the bytes of ids show the borders."""
        data, borders = runs.flat(units)
        blank = runs.white(data)
        chained = blank[borders[:-1]] & ~blank[borders[1:] - 1]
        data, borders = runs.flat(units.filter(pa.array(chained)))
        data, cuts = data.tobytes(), [*borders[:-1:TOGETHER].tolist(), int(borders[-1])]
        texts = [data[a:b].decode() for a, b in zip(cuts, cuts[1:])]
        alone = units.filter(pa.array(~chained)).to_pylist()
        made = [np.array(m.ids, "<u4") for m in self.tokenizer.encode_batch_fast(texts + alone, add_special_tokens=False)]
        ids = np.concatenate([np.zeros(0, "<u4"), *made[: len(texts)]])
        ends = np.cumsum(self._bytes[ids])
        cuts = np.searchsorted(ends, borders[1:])
        if len(cuts) and (cuts[-1] + 1 != len(ids) or (ends[cuts] != borders[1:]).any()):
            raise ValueError("an id reaches across the end of a word")
        made = made[len(texts) :]
        sizes = np.concatenate((np.diff(cuts, prepend=-1), [len(m) for m in made])).astype(np.int64)
        order = np.concatenate((np.flatnonzero(chained), np.flatnonzero(~chained)))
        return runs.lists(np.concatenate([ids, *made]), sizes).take(pa.array(np.argsort(order)))

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts one after the other, as unsigned 32-bit integers, and where each
        text's ids begin and the last one's end. A distinct word is encoded once."""
        return self._known.ids_of_all(*runs.units(texts))

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of one whole text."""
        return self.encode_all(pa.array([text], pa.string()))[0]


_LOADED: dict[str, LibraryTokenizer] = {}


def _tokenizer(path: str) -> LibraryTokenizer:
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads only cost
        _LOADED[path] = LibraryTokenizer(path)
    return _LOADED[path]


class FileWriter:
    """Appends documents; whole blocks go out as they fill, the index of documents at the end."""

    def __init__(self, uri: str, vocabulary: int):
        system, path = file_system(uri)
        self.out, self.vocabulary = system.open_output_stream(path), vocabulary
        self.pending: list[np.ndarray] = []
        self.waiting = self.ids = self.written = 0
        self.docs: list[int | None] = []
        self.lengths: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.lengths.append(len(ids))
        self.pending.append(ids)
        self.waiting += len(ids)
        self.ids += len(ids)
        if self.waiting >= BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.zeros(0, "<u4")
        whole = len(ids) if last else len(ids) - len(ids) % BLOCK
        for at in range(0, whole, BLOCK):
            block = encode_block(ids[at : min(whole, at + BLOCK)], self.vocabulary)
            self.out.write(block)
            self.written += len(block)
        self.pending = [ids[whole:]]
        self.waiting = len(ids) - whole

    def close(self) -> None:
        self._flush(True)
        nulls = np.array([d is None for d in self.docs], dtype=np.uint8)
        docs = np.array([d or 0 for d in self.docs], dtype="<i8")
        index = zlib.compress(nulls.tobytes() + docs.tobytes() + np.array(self.lengths, dtype="<u8").tobytes())
        self.out.write(index)
        self.out.write(_FOOT.pack(self.written, len(self.docs), zlib.crc32(index), _FOOT_MAGIC))
        self.out.close()


def _exactly(file, size: int) -> bytes:
    data = file.read(size)
    if len(data) != size:
        raise ValueError("truncated token file")
    return data


def read_documents(uri: str):
    """Each document of a file in order: id, ids. Holds one block and one document at a time."""
    system, path = file_system(uri)
    with system.open_input_file(path) as file:
        file.seek(file.size() - _FOOT.size)
        end, count, checksum, magic = _FOOT.unpack(_exactly(file, _FOOT.size))
        if magic != _FOOT_MAGIC:
            raise ValueError("not a token file")
        file.seek(end)
        index = _exactly(file, file.size() - _FOOT.size - end)
        if zlib.crc32(index) != checksum:
            raise ValueError("damaged index")
        index = zlib.decompress(index)
        nulls = np.frombuffer(index, np.uint8, count)
        docs = np.frombuffer(index, "<i8", count, offset=count)
        lengths = np.frombuffer(index, "<u8", count, offset=9 * count).astype(np.int64)
        file.seek(0)
        held, at = np.zeros(0, "<u4"), 0
        for null, doc, length in zip(nulls.tolist(), docs.tolist(), lengths.tolist()):
            parts = []
            while length:
                if at == len(held):
                    head = _exactly(file, HEAD_BYTES)
                    held, at = decode_block(head, _exactly(file, read_head(head)[2])), 0
                some = held[at : at + length]
                parts.append(some)
                at += len(some)
                length -= len(some)
            yield None if null else doc, np.concatenate(parts) if parts else np.zeros(0, "<u4")


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Encode every text, append ``end_id``, and write the ids in ascending ``doc_id`` order.

    Returns the table of files: ``uri, part, documents, ids``, in order of ``part``. Rows are
    range-partitioned by id (null first; ties by a hash of the text, then the text), and a task
    writes one file. The ranges are found from ids and hashes, no text goes to the driver. File names
    are new for every attempt and only those of the returned, written table count, so a task
    that runs again leaves no double. A null or empty text has the end id only.
    """
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash"))
        .repartitionByRange(partitions(docs.sparkSession), "doc_id", "hash")
        .sortWithinPartitions("doc_id", "hash", "text")
        .select("doc_id", "text")
    )

    def run(batches):
        writer, uri, model = None, f"{folder}/ids-{uuid.uuid4().hex}.tids", _tokenizer(tokenizer)
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            for part in runs.slices(batch, BYTES):
                writer = writer or FileWriter(uri, max(model.size, end_id + 1))
                ids, borders = model.encode_all(part.column("text"))
                borders = borders.tolist()
                for doc_id, a, b in zip(part.column("doc_id").to_pylist(), borders, borders[1:]):
                    writer.add(doc_id, np.concatenate([ids[a:b], end]))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict(
                {"uri": [uri], "part": [TaskContext.get().partitionId()],
                 "documents": [len(writer.docs)], "ids": [writer.ids]},
                pa.schema([("uri", pa.string()), ("part", pa.int32()), ("documents", pa.int64()), ("ids", pa.int64())]),
            )

    _make_folder(folder)
    return written(ordered.mapInArrow(tidy(run), "uri string, part int, documents long, ids long"), "token-files")


def _make_folder(folder: str) -> None:
    system, path = file_system(folder)
    system.create_dir(path)


def read_token_files(files: DataFrame) -> DataFrame:
    """``doc_id, start, ids`` of every document of the files that ``write_token_files`` returned.

    ``ids`` are little-endian unsigned 32-bit integers, end id included; ``start`` is the number
    of ids of all documents before. A task reads whole files, a block at a time.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    placed = files.select("uri", "part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))

    def run(batches):
        for batch in batches:
            for uri, start in zip(batch.column("uri").to_pylist(), batch.column("base").to_pylist()):
                rows, held = [], 0
                for doc_id, ids in read_documents(uri):
                    rows.append((doc_id, start, ids.tobytes()))
                    start += len(ids)
                    held += len(ids)
                    if held >= 1 << 20 or len(rows) >= 5000:
                        yield _rows(rows)
                        rows, held = [], 0
                if rows:
                    yield _rows(rows)

    spread = placed.repartitionByRange(max(partitions(files.sparkSession), 1), "part")
    return spread.mapInArrow(tidy(run), "doc_id long, start long, ids binary")


def _rows(rows) -> pa.RecordBatch:
    docs, starts, ids = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(ids, pa.binary())],
        ["doc_id", "start", "ids"],
    )


def token_folder(spark) -> str:
    """A new folder for token files."""
    return scratch(spark, "token-files")
