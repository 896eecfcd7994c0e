"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

Long texts are cut at boundaries where no match of the splitting pattern can
span, so pieces encode as the whole text would and memory stays bounded.
Decoding looks up raw bytes per id; it never goes through text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.common import arrow

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN

# Characters of a piece before the next safe boundary is taken.
PIECE_CHARS = 65_536

# A match never runs on over these points: before a single space between two
# letters or digits, between ASCII letters and digits, and from an ASCII letter
# or digit to punctuation other than the apostrophe of a contraction.
SAFE = regex.compile(
    r"(?<=[\p{L}\p{N}])(?= [\p{L}\p{N}])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z0-9])(?=[!\"#$%&()*+,./:;<=>?@-])"
)


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})


@lru_cache(maxsize=4)
def vocabulary(path: str) -> list[bytes | None]:
    ranks = load_ranks(path)
    out: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """Cut ``text`` at safe boundaries, each at least ``size`` characters after the last.

    A text without such a boundary stays whole.
    """
    at = 0
    while len(text) - at > size:
        found = SAFE.search(text, at + size)
        if found is None:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def encode_text(text: str, path: str = RANKS, pattern: str = PATTERN, size: int = PIECE_CHARS) -> bytes:
    """Ids of one text as little-endian unsigned 32-bit integers."""
    enc = encoder(path, pattern)
    return b"".join(np.array(enc.encode_ordinary(piece), dtype="<u4").tobytes() for piece in pieces(text, size))


def encode(docs: DataFrame, text: str = "text", out: str = "ids", path: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """Add ``out``: the ids of each whole text as little-endian uint32 bytes, and drop the text.

    Null and empty texts give zero ids. All other columns pass through, so
    repeated rows stay repeated; an existing column ``out`` is replaced.
    """
    keep = docs.drop(out)
    schema = keep.drop(text).withColumn(out, F.lit(b"")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            ids = [encode_text(t or "", path, pattern) for t in batch.column(at).to_pylist()]
            rest = [c for i, c in enumerate(batch.columns) if i != at]
            names = [n for i, n in enumerate(batch.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(ids, pa.binary())], names=[*names, out])

    return arrow(keep, run, schema)


def decode(encoded: DataFrame, ids: str = "ids", out: str = "decoded", path: str = RANKS) -> DataFrame:
    """Add ``out``: the raw bytes that the ids stand for (null ids: empty). An unknown id is an error."""
    keep = encoded.drop(out)
    schema = keep.withColumn(out, F.lit(b"")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            found = [b"".join(map(words.__getitem__, np.frombuffer(v or b"", "<u4").tolist())) for v in values]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=[*batch.schema.names, out])

    return arrow(keep, run, schema)


def digests(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document: number of ids, SHA-256 of the ids and of the bytes decoded from them."""
    coded = decode(encode(docs.select(key, "text")))
    return coded.select(
        key,
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
