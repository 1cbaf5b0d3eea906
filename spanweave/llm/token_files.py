"""Operator 8: token ids as Arrow files of equal-length sequences.

Documents are range-partitioned by (``doc_id``, row number), so one id may fill several files,
and there are as many files as the bytes of the texts ask for; each partition becomes one stream of ids
(every document closed by ``end_id``) in an Arrow IPC file whose batches hold fixed-size
lists: ``ids`` (``seq_len`` unsigned integers, of 16 bits if the vocabulary allows, else 32)
and ``mask`` (as many bits, unset only on the padding of a file's last sequence).  Any sequence is found by its number without reading
the others, and a memory map serves it without a copy.  A second small file holds the
documents' ids, starts and lengths, since the end id may also occur inside a text.

A task writes under a name of its own attempt and renames the files when they are complete,
so a lost or repeated task leaves whole files only.  ``path`` must be in storage that all
executors share; files are opened through the file system named by its URI.

The tokenizer drops white space, lower-cases and never joins across white space or between
a letter and a full stop or comma after it, so the ids of a text are the ids of its words
and marks in turn.  Words are looked up in a cache of two generations: the elder is dropped
when the younger is full, and what is used moves to the younger.

Null or empty texts hold the end id alone.  Rows with equal ids stay, in the order of the
input's splits and rows; a null ``doc_id`` comes first.  Very long texts are encoded whole, one
at a time.  An empty table gives no files and no rows.  Other columns are not read.
"""

from __future__ import annotations

import functools
import math
import os
import re
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import texts
from .words import pieces

SEQ_LEN = 2048
BATCH_SEQUENCES = 64
CACHE_WORDS = 250_000
#: Bytes of text in a file: the smaller while there are at most ``SMALL_FILES``.
SMALL_FILE_BYTES, FILE_BYTES, SMALL_FILES = 16 << 20, 256 << 20, 1_000
_GAP = re.compile("[\x20\x09-\x0d]+")
_MARK = re.compile("(?<=[A-Za-zß-öø-ÿ])([.,])(?=[\x20\x09-\x0dA-Za-z]|\\Z)")

#: What ``str.split`` takes for white space besides ``_GAP``, in Latin-1.
_ODD = "\x1c\x1d\x1e\x1f\x85\xa0"


def words_of(text: str) -> list[str]:
    """Parts that are tokenised on their own; lower-cased where that is sure to be the tokenizer's way."""
    try:
        text.encode("latin-1")
        text = text.lower()
    except UnicodeEncodeError:
        return _GAP.split(_MARK.sub(r" \1 ", text))
    text = _MARK.sub(r" \1 ", text)
    return _GAP.split(text) if any(c in text for c in _ODD) else text.split()


@functools.lru_cache(maxsize=4)
def word_encoder(tokenizer_path: str):
    """A function from texts to the bytes of their ids, and the type that holds an id; one for each Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)
    young: dict[str, bytes] = {"": b""}
    old: dict[str, bytes] = {}

    def encode(batch: list[str | None]) -> list[bytes]:
        nonlocal young, old
        split = [words_of(t) if t else [] for t in batch]
        new = {w for words in split for w in words}.difference(young)
        missing = []
        for w in new:
            if w in old:
                young[w] = old[w]
            else:
                missing.append(w)
        for at in range(0, len(missing), 10_000):
            part = missing[at : at + 10_000]
            for word, got in zip(part, tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                young[word] = array("I", got.ids).tobytes()
        out = [b"".join(map(young.__getitem__, words)) for words in split]
        if len(young) > CACHE_WORDS:
            old, young = young, {"": b""}
        return out

    return encode, pa.uint16() if tokenizer.get_vocab_size() <= 1 << 16 else pa.uint32()


def _open(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)


def _sequence_schema(seq_len: int, kind: pa.DataType) -> pa.Schema:
    return pa.schema([pa.field("ids", pa.list_(kind, seq_len), False), pa.field("mask", pa.list_(pa.bool_(), seq_len), False)])


_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class _SequenceFile:
    """Packs ids into sequences and writes them batch by batch."""

    def __init__(self, sink, seq_len: int, kind: pa.DataType):
        self.schema = _sequence_schema(seq_len, kind)
        self.writer, self.seq_len, self.left, self.size = pa.ipc.new_file(sink, self.schema), seq_len, [], 0

    def add(self, ids: np.ndarray) -> None:
        self.left.append(ids)
        self.size += len(ids)
        if self.size >= self.seq_len * BATCH_SEQUENCES:
            self._write(self.size - self.size % self.seq_len)

    def _write(self, n: int) -> None:
        flat = np.concatenate(self.left)
        self.left, self.size = [flat[n:]], len(flat) - n
        step = self.seq_len * BATCH_SEQUENCES
        for at in range(0, n, step):
            self._batch(flat[at : min(n, at + step)], np.ones(min(n, at + step) - at, bool))

    def _batch(self, ids: np.ndarray, mask: np.ndarray) -> None:
        flat = (pa.array(ids, self.schema.field("ids").type.value_type), pa.array(mask))
        self.writer.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(x, self.seq_len) for x in flat], schema=self.schema))

    def close(self) -> None:
        self._write(self.size - self.size % self.seq_len)
        if self.size:
            pad = self.seq_len - self.size
            self._batch(np.pad(np.concatenate(self.left), (0, pad)), np.arange(self.seq_len) < self.size)
        self.writer.close()


def write(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 2, seq_len: int = SEQ_LEN) -> DataFrame:
    """Write the files below ``path``; returns ``file_no``, ``sequences``, ``index``, ``n_docs`` and ``n_tokens`` of each.  Lazy: files appear as it runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        fs, base = _open(path)
        fs.create_dir(base, recursive=True)
        own = f"{base}/.{number:06d}-{uuid.uuid4().hex}"
        encode, kind = word_encoder(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()
        start = n_docs = 0
        with fs.open_output_stream(own + ".seq") as s, fs.open_output_stream(own + ".doc") as d:
            out, index = _SequenceFile(s, seq_len, kind), pa.ipc.new_file(d, _DOCS)
            for batch in pieces(batches, "text"):
                ids = [x + end for x in encode(batch.column("text").to_pylist())]
                out.add(np.frombuffer(b"".join(ids), "<u4"))
                n = np.array([len(x) // 4 for x in ids], np.int64)
                starts = start + np.cumsum(n) - n
                index.write_batch(pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(starts), pa.array(n)], schema=_DOCS))
                start, n_docs = start + int(n.sum()), n_docs + len(ids)
            out.close()
            index.close()
        names = [f"{base}/{number:06d}.{kind}.arrow" for kind in ("sequences", "docs")]
        for kind, name in zip((".seq", ".doc"), names, strict=True):
            fs.move(own + kind, name)
        yield pa.RecordBatch.from_pydict({"file_no": [number], "n_docs": [n_docs], "n_tokens": [start]}, schema=pa.schema([("file_no", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    rows = texts(docs)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(size / FILE_BYTES), min(SMALL_FILES, math.ceil(size / SMALL_FILE_BYTES)))
    ordered = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(parts, "doc_id", "row").sortWithinPartitions("doc_id", "row")
    made = ordered.select("doc_id", "text").mapInArrow(run, "file_no bigint, n_docs bigint, n_tokens bigint")
    name = lambda kind: F.format_string(f"{path}/%06d.{kind}.arrow", "file_no")
    return made.select("file_no", name("sequences").alias("sequences"), name("docs").alias("index"), "n_docs", "n_tokens")


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Documents back from the files of a stored manifest: ``doc_id``, ``start`` over all files, ``n_tokens`` and ``ids`` (binary)."""
    files = sorted(map(tuple, manifest.where("n_docs > 0").select("file_no", "sequences", "index", "n_tokens").collect()))
    starts = np.cumsum([0] + [f[3] for f in files]).tolist()
    rows = [(f[1], f[2], s) for f, s in zip(files, starts, strict=False)]
    listed = spark.createDataFrame(rows, "sequences string, `index` string, base bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from read_file(row["sequences"], row["index"], row["base"])

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids binary"
    return listed.repartition(max(1, len(rows)), "sequences").mapInArrow(run, schema)


def read_file(sequences: str, index: str, base: int, batch_docs: int = 512) -> Iterator[pa.RecordBatch]:
    """Walk one pair of files, holding the sequences that the next documents lie in."""
    fs, seq_path = _open(sequences)
    with fs.open_input_file(seq_path) as s, fs.open_input_file(_open(index)[1]) as d:
        seqs, docs = pa.ipc.open_file(s), pa.ipc.open_file(d)
        held, first, taken = np.empty(0, seqs.schema.field("ids").type.value_type.to_pandas_dtype()), 0, 0
        for k in range(docs.num_record_batches):
            got = docs.get_batch(k)
            for at in range(0, got.num_rows, batch_docs):
                part = got.slice(at, batch_docs)
                begin, n = (np.asarray(part.column(c)) for c in ("start", "n_tokens"))
                more = [held[begin[0] - first :]]
                size, first = len(more[0]), int(begin[0])
                while size < begin[-1] + n[-1] - first:
                    batch = seqs.get_batch(taken)
                    mask = batch.column("mask").flatten().to_numpy(zero_copy_only=False)
                    more.append(np.asarray(batch.column("ids").flatten())[mask])
                    size, taken = size + len(more[-1]), taken + 1
                held = np.concatenate(more)
                ids = [held[a - first : a - first + c].astype("<u4").tobytes() for a, c in zip(begin.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(begin + base), pa.array(n), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])


def sequence(path: str, number: int) -> tuple[pa.Array, pa.Array]:
    """Ids and mask of one sequence of a local file, as views of its memory map."""
    reader = pa.ipc.open_file(pa.memory_map(path))
    per = reader.get_batch(0).num_rows
    batch = reader.get_batch(number // per)
    width = reader.schema.field("ids").type.list_size
    at = (number % per) * width
    return batch.column("ids").flatten().slice(at, width), batch.column("mask").flatten().slice(at, width)
