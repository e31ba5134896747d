"""Byte-level BPE as a monoid: texts are encoded by halves and joined at the seams.

In a leaf each match of the pattern is encoded by the tiktoken library. Where two parts meet, a window around the seam is encoded
anew and grows until the tokens outside are proven to stay: the window must begin at a place
where the splitting pattern cuts whatever follows, and end where the new cuts meet a cut of
the right part. Inside one very long match of the pattern the same is done with tokens, and
proven by the fact that a row of tokens is the BPE encoding if and only if every two
neighbours are the encoding of their bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import in_parts

#: Code points of a leaf, and matches or tokens by which a window grows first.
LEAF, GROWTH = 1024, 4

#: Matches whose ids a worker keeps; emptied when full, which costs time only.
KEPT = 500_000


class TreeBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF) -> None:
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(pattern)
        self.leaf = leaf
        self.kept: dict[str, list[int]] = {}

    # pieces: one match of the pattern

    def _pair(self, a: int, b: int) -> bool:
        whole = self.encoding.decode_single_token_bytes(a) + self.encoding.decode_single_token_bytes(b)
        return self.encoding._encode_single_piece(whole) == [a, b]

    def join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        """Encodings of two byte strings to that of both in a row, as one match of the pattern."""
        grow = GROWTH
        while left and right:
            i, j = max(0, len(left) - grow), min(len(right), grow)
            seam = self.encoding._encode_single_piece(b"".join(map(self.encoding.decode_single_token_bytes, left[i:] + right[:j])))
            if (not i or self._pair(left[i - 1], seam[0])) and (j == len(right) or self._pair(seam[-1], right[j])):
                return left[:i] + seam + right[j:]
            grow *= 2
        return left + right

    def piece(self, data: bytes) -> list[int]:
        """One match of the pattern, by halves if long."""
        if len(data) <= self.leaf:
            return self.encoding._encode_single_piece(data)
        half = len(data) // 2
        return self.join_tokens(self.piece(data[:half]), self.piece(data[half:]))

    def match_ids(self, word: str) -> list[int]:
        """Ids of a match of the pattern within a leaf; common ones are kept."""
        if (ids := self.kept.get(word)) is None:
            ids = self.piece(word.encode())
            if len(word) < 32:
                if len(self.kept) >= KEPT:
                    self.kept.clear()
                self.kept[word] = ids
        return ids

    # texts

    def encode(self, text: str) -> list[int]:
        """The ids that the library gives for the whole text, without special tokens."""
        return list(chain.from_iterable(self._tree(text, 0, len(text))[1]))

    def _tree(self, text: str, a: int, b: int) -> tuple[list[int], list[list[int]]]:
        """Cuts (the starts of matches within a..b, as if nothing lay outside) and each match's ids."""
        if b - a <= self.leaf:
            words = [m[0] for m in self.split.finditer(text, a, b)] if self.split.groups else self.split.findall(text, a, b)
            return list(accumulate(map(len, words), initial=a))[:-1], [self.match_ids(w) for w in words]
        half = (a + b) // 2
        return self._join(text, b, self._tree(text, a, half), self._tree(text, half, b), half)

    def _join(self, text: str, b: int, left: tuple, right: tuple, half: int) -> tuple[list[int], list[list[int]]]:
        (ls, li), (rs, ri) = left, right
        # The pattern looks one character past a match, and three from its start (at 'll and the
        # like). Matches of the left part that had these to look at stand; the last one never had.
        keep = len(ls) - 1
        while keep > 0 and ls[keep - 1] + 3 > half:
            keep -= 1
        at, known = ls[keep], {s: i for i, s in enumerate(rs)}
        starts, ids = ls[:keep], li[:keep]
        while at < b:
            if at in known:  # from one cut on, the same text is cut alike
                i = known[at]
                return starts + rs[i:], ids + ri[i:]
            end = self.split.match(text, at, b).end()
            starts.append(at)
            ids.append(self._match(text, at, end, half, left, right))
            at = end
        return starts, ids

    def _match(self, text: str, at: int, end: int, half: int, left: tuple, right: tuple) -> list[int]:
        """A match at the seam: if both parts hold long pieces of it, their tokens are joined."""
        if at < half < end and end - at > self.leaf:
            (ls, li), (rs, ri) = left, right
            if ls[-1] == at and (len(rs) == 1 or rs[1] == end):
                return self.join_tokens(li[-1], ri[0])
        return self.piece(text[at:end].encode())

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of the ids: parts are decoded and put in a row, up the tree."""
        if len(ids) <= self.leaf:
            return self.encoding.decode_bytes(ids)
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(maxsize=4)
def tree_bpe(path: str, pattern: str, leaf: int = LEAF) -> TreeBpe:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return TreeBpe(ranks, pattern, leaf)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF, with_ids: bool = True) -> DataFrame:
    """Encodes every whole text, then decodes the ids.

    Columns: ``id_col``, n_tokens, ids_sha256, decoded_sha256, and with ``with_ids`` ids
    (array of ints) and decoded (bytes). Hashes are of the ids as little-endian unsigned
    32-bit integers and of the decoded bytes.

    Null text counts as empty, which has no ids; a null id stays null; repeated rows give
    repeated results; an empty table gives no rows; other columns are ignored.
    """
    kind = dict(docs.select(id_col).dtypes)[id_col]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = tree_bpe(ranks_path, pattern, leaf)
        for batch in in_parts(batches):
            ids = [bpe.encode(t) for t in batch["text"].tolist()]
            decoded = [bpe.decode(x) for x in ids]
            out = pd.DataFrame({id_col: batch["id"], "n_tokens": [len(x) for x in ids]})
            out["ids_sha256"] = [hashlib.sha256(np.asarray(x, dtype="<u4").tobytes()).hexdigest() for x in ids]
            out["decoded_sha256"] = [hashlib.sha256(x).hexdigest() for x in decoded]
            if with_ids:
                out["ids"], out["decoded"] = ids, decoded
            yield out

    # ids travel as strings, so that nulls and wide numbers survive pandas
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = f"`{id_col}` string, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * with_ids
    return rows.mapInPandas(each, schema).withColumn(id_col, F.col(id_col).cast(kind))
