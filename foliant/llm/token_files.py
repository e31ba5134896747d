"""Token-id files: a concatenated id array with Elias-Fano encoded document bounds.

A shard file is a header, the documents' ids, the document bounds in Elias-Fano form with a
sampled select index, and the token ids. Bounds take about 2 + log2(tokens / documents) bits
a document, against 64 in a plain table, and any one of them is found in constant time.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.llm.common import NO_ID, in_parts, range_bounds, range_of, scratch_path
from foliant.llm.pieces import word_ids

MAGIC = b"TIDEF1\0\0"

#: A select sample is kept for every so many ones.
SAMPLE = 256

_HEADER = struct.Struct("<8sQQBBBxIQQ")  # magic, documents, tokens, id width, low bits, has ids, low bytes, high bytes, samples


class EliasFano:
    """A non-decreasing sequence of numbers up to ``universe``."""

    def __init__(self, n: int, universe: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray) -> None:
        self.n, self.universe, self.low_bits, self.low, self.high, self.samples = n, universe, low_bits, low, high, samples
        self._words: tuple[bytes, bytes, list[int]] | None = None

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        low_bits = max(0, (max(1, universe) // max(1, n)).bit_length() - 1)
        mask = np.uint64((1 << low_bits) - 1)
        bits = ((values & mask)[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1) if low_bits else np.zeros((n, 0), np.uint64)
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros(n + (universe >> low_bits) + 1, np.uint8)
        flags[ones] = 1
        return cls(n, universe, low_bits, low, np.packbits(flags, bitorder="little"), ones[::SAMPLE].astype(np.uint64))

    def select(self, i: int) -> int:
        """The i-th value, from the nearest sample on."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        if self._words is None:
            self._words = self.high.tobytes() + bytes(8), self.low.tobytes() + bytes(16), self.samples.tolist()
        high, low, samples = self._words
        at, left = samples[i // SAMPLE], i % SAMPLE
        byte = at >> 3
        word = int.from_bytes(high[byte : byte + 8], "little") >> (at & 7) << (at & 7)
        while (count := word.bit_count()) <= left:
            left -= count
            byte += 8
            word = int.from_bytes(high[byte : byte + 8], "little")
        for _ in range(left):
            word &= word - 1
        top = byte * 8 + (word & -word).bit_length() - 1 - i
        p = i * self.low_bits
        return top << self.low_bits | int.from_bytes(low[p >> 3 : (p >> 3) + 9], "little") >> (p & 7) & (1 << self.low_bits) - 1

    def all(self) -> np.ndarray:
        """Every value, at once."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        top = (ones - np.arange(self.n)).astype(np.uint64)
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        low = (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64) if self.low_bits else np.uint64(0)
        return (top << np.uint64(self.low_bits)) | low

    def nbytes(self) -> int:
        return len(self.low) + len(self.high) + 8 * len(self.samples)


def pack_shard(doc_ids: list[int], tokens: list[bytes], width: int) -> bytes:
    """A shard file's bytes. Documents in the given order; a document may be empty."""
    lengths = np.array([len(t) // width for t in tokens], dtype=np.int64)
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    ef = EliasFano.of(ends, total)
    head = _HEADER.pack(MAGIC, len(tokens), total, width, ef.low_bits, 1, len(ef.low), len(ef.high), len(ef.samples))
    return b"".join([head, np.asarray(doc_ids, "<i8").tobytes(), ef.low.tobytes(), ef.high.tobytes(), ef.samples.astype("<u8").tobytes(), *tokens])


class Shard:
    """A shard file, read in place."""

    def __init__(self, data: bytes) -> None:
        magic, self.n, self.tokens, self.width, low_bits, _, low, high, samples = _HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token-id shard")
        at = _HEADER.size
        self.doc_ids = np.frombuffer(data, "<i8", self.n, at)
        at += 8 * self.n
        parts = []
        for kind, count in (("u1", low), ("u1", high), ("<u8", samples)):
            parts.append(np.frombuffer(data, kind, count, at))
            at += parts[-1].nbytes
        self.bounds = EliasFano(self.n, self.tokens, low_bits, *parts)
        self.ids = np.frombuffer(data, f"<u{self.width}", self.tokens, at)

    def ends(self) -> np.ndarray:
        """Where each document ends, by the select structure."""
        return np.fromiter(map(self.bounds.select, range(self.n)), np.int64, self.n)

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document, found through the select structure."""
        return self.ids[self.bounds.select(i - 1) if i else 0 : self.bounds.select(i)]


def write_token_files(
    docs: DataFrame,
    vocabulary: str,
    end_id: int,
    path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    bytes_per_range: int = 1 << 23,
    shard_tokens: int = 1 << 22,
    spaced: bool = False,
) -> DataFrame:
    """Encodes whole texts and writes them as shards in ascending order of id.

    Ids are cut into ranges of about ``bytes_per_range`` bytes of text, one task each, and
    these into shards of about ``shard_tokens`` tokens, so the concatenation of the shards in
    order is the id array of the corpus. A shard travels as
    the ``file`` column of a Parquet folder at ``path`` (the shared folder if None): Spark's
    committer then leaves whole shards only, on any store, whatever executors are lost.

    Returns the written folder: shard, first_id, docs, tokens, file.

    Null text counts as empty (the end id alone); a null id is written as the least long.
    Equal ids stay next to each other, ordered by text; if they fill several ranges, by a hash
    of their texts between these. An empty table writes no shard. Ids
    below 65,536 take two bytes, others four.
    """
    path = path or scratch_path(docs.sparkSession, "token-files")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bounds = range_bounds(rows, "doc", "text", bytes_per_range)
    ranged = rows.withColumn("range", range_of(F.col("doc"), F.col("text"), bounds).cast("int"))
    dealt = ranged.repartitionById(len(bounds) + 1, F.col("range")).sortWithinPartitions("doc", "text")

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = word_ids(vocabulary, spaced)
        end = encoder.pack([end_id])
        number, ids, tokens, size = 0, [], [], 0

        def done() -> pd.DataFrame:
            return pd.DataFrame({"shard": [number], "first_id": [ids[0]], "docs": [len(ids)], "tokens": [size // encoder.width], "file": [pack_shard(ids, tokens, encoder.width)]})

        for batch in in_parts(batches):
            encoded = encoder.encode(batch["text"].tolist())
            for place, doc, found in zip(batch["range"].tolist(), batch["doc"].tolist(), encoded, strict=True):
                if not ids:
                    number = max(number + 1, place << 32)  # ranges in order, and a range's shards
                ids.append(doc)
                tokens.append(found + end)
                size += len(found) + len(end)
                if size >= shard_tokens * encoder.width:
                    yield done()
                    ids, tokens, size = [], [], 0
        if ids:
            yield done()

    dealt.mapInPandas(shards, "shard long, first_id long, docs long, tokens long, file binary").write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def read_token_files(files: DataFrame) -> DataFrame:
    """Reads shards back: shard, doc_id, start, n_tokens, ids (as written, little-endian), width.

    ``start`` is the number of ids before the document in the whole array: its place in the
    shard, by the select structure, after the shards before it.
    """

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, base, data in zip(batch["shard"], batch["base"], batch["file"], strict=True):
                s = Shard(data)
                ends = s.ends()
                begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                raw, w = s.ids.tobytes(), s.width
                for i in range(0, s.n, 512):
                    a, b = begins[i : i + 512], ends[i : i + 512]
                    yield pd.DataFrame({"shard": shard, "doc_id": s.doc_ids[i : i + 512], "start": base + a, "n_tokens": b - a, "ids": [raw[x * w : y * w] for x, y in zip(a, b, strict=True)], "width": w})

    return _with_base(files).mapInPandas(documents, "shard long, doc_id long, start long, n_tokens long, ids binary, width int")


#: Shards up to which their places are broadcast, 16 bytes each.
BROADCAST = 500_000


def _with_base(files: DataFrame) -> DataFrame:
    """shard, base (ids before it), file. One number a range is summed in one task, then one a shard within its range."""
    sizes = files.select("shard", "tokens", F.shiftright("shard", 32).alias("range"))
    upto = Window.rowsBetween(Window.unboundedPreceding, -1)
    ranges = sizes.groupBy("range").agg(F.sum("tokens").alias("tokens"))
    ranges = ranges.select("range", F.coalesce(F.sum("tokens").over(upto.orderBy("range")), F.lit(0)).alias("before"))
    within = F.coalesce(F.sum("tokens").over(upto.partitionBy("range").orderBy("shard")), F.lit(0))
    starts = sizes.withColumn("within", within).join(ranges, "range").select("shard", (F.col("before") + F.col("within")).alias("base"))
    if files.count() <= BROADCAST:
        starts = F.broadcast(starts)
    return files.select("shard", "file").join(starts, "shard").select("shard", "base", "file")


def digests(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of written shards; the ids never leave the reading task."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for base, data in zip(batch["base"], batch["file"], strict=True):
                s = Shard(data)
                ends = s.ends()
                begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                wide = s.ids.astype("<u4")
                yield pd.DataFrame({"doc_id": s.doc_ids, "start": base + begins, "n_tokens": ends - begins, "ids_crc32": [zlib.crc32(wide[x:y]) for x, y in zip(begins, ends, strict=True)]})

    return _with_base(files).mapInPandas(each, "doc_id long, start long, n_tokens long, ids_crc32 long")


def file_of(spark: SparkSession, path: str, shard: int) -> bytes:
    """One shard file's bytes, e.g. to copy it out of the store."""
    return bytes(spark.read.parquet(path).where(F.col("shard") == shard).head()["file"])
