"""Operator 5: byte-level BPE encoding and decoding.

The tiktoken library does the merges with a rank file at ``ranks_path``; the file is read
on the executors, never copied.  Texts of over ``LONG_CHARS`` characters are cut where the
pattern is bound to end a match: before a space that has a Latin letter on each side.  Up to
there no match can reach over the space, and no alternative looks behind.  Decoding joins
the raw bytes of the ids and never goes through strings, so it is exact for every input.

Null or empty texts give no ids and empty bytes.  Each input row gives one output row:
repeated rows and null ids stay.  Extra columns are not read.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .columns import small_batches, texts
from .words import pieces

LONG_CHARS = 1 << 20
_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
_SAFE = re.compile(f"(?<=[{_LATIN}])(?= [{_LATIN}])")


@functools.lru_cache(maxsize=4)
def encoding(ranks_path: str, pattern: str):
    """The tokenizer, built once in each Python worker."""
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_parts(text: str, limit: int = LONG_CHARS) -> Iterator[str]:
    """``text`` in parts of about ``limit`` characters that are tokenised as the whole is."""
    at = 0
    while len(text) - at > limit and (cut := _SAFE.search(text, at + limit)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode(docs: DataFrame, ranks_path: str, pattern: str, and_decode: bool = False) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``ids``: the ids as little-endian unsigned 32-bit integers.

    ``and_decode`` adds ``decoded``, the raw bytes of the stored ids, in the same Python worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoding(ranks_path, pattern)
        for batch in pieces(batches, "text"):
            ids = []
            for text in batch.column("text").to_pylist():
                parts = [np.array(tokens.encode_ordinary(p), "<u4").tobytes() for p in safe_parts(text or "")]
                ids.append(b"".join(parts))
            columns = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids": pa.array(ids, pa.binary())}
            if and_decode:
                columns["decoded"] = pa.array([_bytes(tokens, x) for x in ids], pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    small_batches(docs.sparkSession)
    return texts(docs).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary" + ", decoded binary" * and_decode)


def _bytes(tokens, ids: bytes) -> bytes:
    return tokens.decode_bytes(np.frombuffer(ids, "<u4").tolist())


def decode(tokens: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Adds ``decoded``, the raw bytes of ``ids``, to what ``encode`` returns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = encoding(ranks_path, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                raw = [_bytes(back, x) for x in batch.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])

    return tokens.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary, decoded binary")
