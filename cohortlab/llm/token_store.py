"""Token files: independent zstandard frames with a trailing seek table.

A file holds the ids of documents in ascending doc_id order:

* data frames of ``FRAME_IDS`` ids each (the last one shorter), little-endian,
  2 bytes an id if the vocabulary allows it, else 4;
* a skippable frame with the document index (zstandard: doc_id, number of ids);
* a skippable frame with the seek table: for every frame above its compressed
  and decompressed size and the low 32 bits of the XXH64 of its content (the
  layout of zstandard's seekable format; the index counts as 0 bytes).

As all data frames but the last have the same number of ids, the frames of a
document follow from its offset, and a reader decompresses no others.

Files are written by the tasks that encode, under a name of their own attempt;
only files named in the manifest, which Spark commits, count. A lost executor
costs a repeated task and leaves at most an unnamed file.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.llm.common import arrow, stage
from cohortlab.scale import stage_path

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 1

FRAME_IDS = 65_536
LEVEL = 3
# Encoded words a Python worker remembers, and the longest word it keeps.
CACHE_WORDS = 1_500_000
CACHE_WORD_BYTES = 200

# Key of documents without an id in the index; they come first. No document may have it as its id.
NO_ID = -(1 << 63)

# Fixed values of the file format.
SEEK_FRAME = 0x184D2A5E
INDEX_FRAME = 0x184D2A50
SEEK_MAGIC = 0x8F92EAB1
CHECKSUMS = 0x80
INDEX_HEAD = struct.Struct("<4sBxxxIQQ")
INDEX_MAGIC = b"TKS1"


# --- encoding -------------------------------------------------------------

# ASCII white space becomes a space and A-Z a-z; the tokenizer does both itself.
PLAIN = bytes(32 if i in b"\t\n\v\f\r " else i + 32 if 65 <= i <= 90 else i for i in range(256))
# From a letter to ASCII punctuation other than an apostrophe: the tokenizer's pattern always ends a piece there.
STEM = re.compile(rb"(.*?(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]))([!-&(-/:-@[-`{-~].*)", re.S)


LETTERS = re.compile(rb"(?:[a-z]|\xc3[\xa0-\xb6\xb8-\xbf])+")


class WordEncoder:
    """Ids of words as little-endian uint32 bytes, encoded by the tokenizers library and remembered.

    The tokenizer's pattern never matches across white space and its
    normaliser works on single words, so the ids of a text are those of its
    words in order. A word with punctuation behind it is its stem and the rest.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.added = {t: np.array([i], "<u4").tobytes() for t, i in added.items()}
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        # added tokens are cut out of the texts first; a word that only looks like one after lower-casing is ordinary
        self.tokenizer.encode_special_tokens = True
        self.words: dict[bytes, bytes] = {}
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        if suffix:
            self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True

    def library(self, texts: list[bytes]) -> list[np.ndarray]:
        coded = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [np.array(e.ids, "<u4") for e in coded]

    def learn(self, words: list[bytes]) -> None:
        """Encode new words. Words of letters alone are one piece each: many go in one text, cut where a piece ends."""
        known, parts = self.words, {}
        for w in words:
            if stem := STEM.fullmatch(w):
                parts[w] = stem
        wanted = {w for w in words if w not in parts}
        wanted.update(x for stem in parts.values() for x in stem.groups() if x not in known)
        plain = [w for w in wanted if LETTERS.fullmatch(w)]
        other = [w for w in wanted if not LETTERS.fullmatch(w)]
        groups = [plain[i : i + 200] for i in range(0, len(plain), 200)]
        for group, ids in zip(groups, self.library([b" ".join(g) for g in groups]), strict=True):
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(group) and cuts[-1] == len(ids):
                raw, at = ids.tobytes(), [0, *(4 * cuts).tolist()]
                known.update((w, raw[at[i] : at[i + 1]]) for i, w in enumerate(group))
            else:
                other += group
        known.update((w, ids.tobytes()) for w, ids in zip(other, self.library(other), strict=True))
        for w, stem in parts.items():
            known[w] = known[stem[1]] + known[stem[2]]

    def batch(self, texts: Sequence[str | None]) -> list[bytes]:
        """Ids of each whole text; null as empty. Added tokens that stand in a text get their own id, as in the library."""
        if any(t and token in t for t in texts for token in self.added):
            parts = [self.cut.split(t or "") for t in texts]
            ids = iter(self.plain([p for some in parts for p in some[::2]]))
            return [b"".join(self.added[p] if i % 2 else next(ids) for i, p in enumerate(some)) for some in parts]
        return self.plain(texts)

    def plain(self, texts: Sequence[str | None]) -> list[bytes]:
        """Ids of texts without added tokens."""
        split = [(t or "").encode().translate(PLAIN).split() for t in texts]
        met = set().union(*split)
        if len(self.words) + len(met) > CACHE_WORDS:
            self.words.clear()
        self.learn(new := [w for w in met if w not in self.words])
        out = [b"".join(map(self.words.__getitem__, words)) for words in split]
        for w in new:
            if len(w) > CACHE_WORD_BYTES:
                del self.words[w]
        return out


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


@lru_cache(maxsize=2)
def id_width(path: str) -> int:
    """Bytes an id needs; the end id 1 is in any vocabulary."""
    return 2 if word_encoder(path).tokenizer.get_vocab_size() <= 1 << 16 else 4


# --- files ----------------------------------------------------------------


class Writer:
    """Streams documents into one file; holds one frame and 16 bytes a document."""

    def __init__(self, out, width: int = 4, frame_ids: int = FRAME_IDS):
        self.out, self.width, self.frame_ids = out, width, frame_ids
        self.pending, self.waiting = bytearray(), frame_ids * width
        self.entries: list[tuple[int, int, int]] = []
        self.keys: list[int] = []
        self.sizes: list[int] = []
        self.zstd = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)

    def add(self, key: int, ids: bytes) -> None:
        """``ids``: little-endian uint32."""
        self.keys.append(key)
        self.sizes.append(len(ids) // 4)
        self.pending += ids if self.width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()
        while len(self.pending) >= self.waiting:
            self.frame(bytes(self.pending[: self.waiting]))
            del self.pending[: self.waiting]

    def frame(self, content: bytes) -> None:
        packed = self.zstd.compress(content)
        self.out.write(packed)
        self.entries.append((len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))

    def close(self) -> None:
        if self.pending:
            self.frame(bytes(self.pending))
        head = INDEX_HEAD.pack(INDEX_MAGIC, self.width, self.frame_ids, len(self.keys), sum(self.sizes))
        body = head + self.zstd.compress(np.array(self.keys, "<i8").tobytes() + np.array(self.sizes, "<i8").tobytes())
        self.out.write(struct.pack("<II", INDEX_FRAME, len(body)) + body)
        self.entries.append((len(body) + 8, 0, xxhash.xxh64_intdigest(body) & 0xFFFFFFFF))
        table = b"".join(struct.pack("<III", *e) for e in self.entries)
        footer = struct.pack("<IBI", len(self.entries), CHECKSUMS, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SEEK_FRAME, len(table) + 9) + table + footer)


class Reader:
    """Random access to one file: reads the seek table, the index, then only wanted frames."""

    def __init__(self, source):
        self.source = source
        size = source.seek(0, 2)
        n, flags, magic = struct.unpack("<IBI", self.bytes(size - 9, 9))
        if magic != SEEK_MAGIC or flags != CHECKSUMS:
            raise ValueError("no seek table at the end of the token file")
        begin = size - 9 - 12 * n
        self.entries = list(struct.iter_unpack("<III", self.bytes(begin, 12 * n)))
        self.starts = [0, *np.cumsum([e[0] for e in self.entries]).tolist()]
        if self.starts[-1] != begin - 8:
            raise ValueError("the seek table does not cover the token file")
        body = self.bytes(self.starts[-2] + 8, self.entries[-1][0] - 8)
        self.check(body, self.entries[-1][2])
        magic, self.width, self.frame_ids, docs, self.n_ids = INDEX_HEAD.unpack_from(body)
        if magic != INDEX_MAGIC:
            raise ValueError("the token file has no document index")
        index = np.frombuffer(zstandard.ZstdDecompressor().decompress(body[INDEX_HEAD.size :]), "<i8")
        self.keys, self.sizes = index[:docs], index[docs:]
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)])
        self.cached: tuple[int, bytes] = (-1, b"")
        self.frames_read = 0

    def bytes(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    @staticmethod
    def check(content: bytes, digest: int) -> None:
        if xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != digest:
            raise ValueError("a frame of the token file is damaged")

    def frame(self, k: int) -> bytes:
        if self.cached[0] != k:
            packed, plain, digest = self.entries[k]
            content = zstandard.ZstdDecompressor().decompress(self.bytes(self.starts[k], packed), max_output_size=plain)
            self.check(content, digest)
            self.cached, self.frames_read = (k, content), self.frames_read + 1
        return self.cached[1]

    def ids(self, i: int) -> np.ndarray:
        """Ids of the i-th document of the file."""
        lo, hi = int(self.offsets[i]) * self.width, int(self.offsets[i + 1]) * self.width
        size, parts = self.frame_ids * self.width, []
        while lo < hi:
            k, at = divmod(lo, size)
            part = self.frame(k)[at : at + hi - lo]
            parts.append(part)
            lo += len(part)
        return np.frombuffer(b"".join(parts), f"<u{self.width}").astype("<u4")

    def find(self, key: int) -> range:
        """Positions of the documents with this doc_id."""
        return range(int(np.searchsorted(self.keys, key)), int(np.searchsorted(self.keys, key, "right")))


def opened(path: str):
    """File system and path behind a URI or a plain path."""
    return pafs.FileSystem.from_uri(path)


# --- jobs -----------------------------------------------------------------


@dataclass
class Store:
    """Token files in a shared folder and their manifest: shard, path, docs, ids, first and last doc_id."""

    manifest: DataFrame
    n_shards: int


def write(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, end_id: int = END_ID, folder: str | None = None) -> Store:
    """Encode every whole text, append ``end_id`` and write token files in ascending ``key`` order.

    Null and empty texts hold the end id alone. Rows without a key come first
    and are read back without one; ``fetch`` cannot ask for them. Repeated keys
    are kept, ordered by a hash of the text. An empty table gives no files.
    """
    folder = folder or stage_path(docs.sparkSession, "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encoder, end = word_encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        batch = next((b for b in batches if b.num_rows), None)
        if batch is None:
            return
        store, at = opened(folder)
        store.create_dir(at, recursive=True)
        name = f"{at}/part-{part:06d}-{uuid.uuid4().hex}.tokens.zst"
        with store.open_output_stream(name, compression=None) as out:
            writer = Writer(out, id_width(tokenizer))
            while batch is not None:
                for k, ids in zip(batch.column(0).to_pylist(), encoder.batch(batch.column(1).to_pylist()), strict=True):
                    writer.add(NO_ID if k is None else k, ids + end)
                batch = next(batches, None)
            writer.close()
        path = f"{folder}/{name.rsplit('/', 1)[1]}"
        values = [part, path, len(writer.keys), sum(writer.sizes), writer.keys[0], writer.keys[-1]]
        names = ["shard", "path", "docs", "ids", "first_id", "last_id"]
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names=names)

    order = F.xxhash64(text)
    ranged = docs.select(F.col(key).cast("long"), text).repartitionByRange(F.col(key).asc_nulls_first(), order).sortWithinPartitions(F.col(key).asc_nulls_first(), order)
    schema = "shard long, path string, docs long, ids long, first_id long, last_id long"
    manifest = stage(arrow(ranged, run, schema), "token-manifest")
    return Store(manifest, manifest.count())


def read(store: Store, key: str = "doc_id") -> DataFrame:
    """All documents of a store, from its files: key, start (ids of all documents before), n_tokens, ids (uint32 bytes).

    Starts are running sums over the manifest, which has one row per file.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = store.manifest.select("path", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, at = opened(path)
                with fs.open_input_file(at) as source:
                    reader = Reader(source)
                    for lo in range(0, len(reader.keys), 512):
                        some = range(lo, min(lo + 512, len(reader.keys)))
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(reader.keys[lo : some.stop], pa.int64(), mask=reader.keys[lo : some.stop] == NO_ID),
                                pa.array(reader.offsets[lo : some.stop] + base, pa.int64()),
                                pa.array(reader.sizes[lo : some.stop], pa.int64()),
                                pa.array([reader.ids(i).tobytes() for i in some], pa.binary()),
                            ],
                            names=[key, "start", "n_tokens", "ids"],
                        )

    return arrow(shards.repartition(max(1, store.n_shards)), run, f"{key} long, start long, n_tokens long, ids binary")


def fetch(store: Store, wanted: Sequence[int], key: str = "doc_id") -> DataFrame:
    """Requested documents only: (key, ids). Opens the files whose id range can hold them and decompresses only their frames."""
    ask = sorted(set(wanted) - {NO_ID})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, lo, hi in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                mine = [w for w in ask if lo <= w <= hi]
                if not mine:
                    continue
                fs, at = opened(path)
                with fs.open_input_file(at) as source:
                    reader = Reader(source)
                    rows = [(w, reader.ids(i).tobytes()) for w in mine for i in reader.find(w)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=[key, "ids"]
                )

    shards = store.manifest.select("path", "first_id", "last_id").repartition(max(1, store.n_shards))
    return arrow(shards, run, f"{key} long, ids binary")


def digests(store: Store, key: str = "doc_id") -> DataFrame:
    """What the files hold, per document: start, n_tokens and the crc32 of its ids as little-endian uint32."""
    return read(store, key).select(key, "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
