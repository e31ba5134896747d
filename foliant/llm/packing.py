"""Best-fit packing of token pieces into sequences by linear grouping.

The whole corpus is planned from the histogram of piece lengths, at most one number a
length: large lengths go into groups of equal cardinality and are rounded up to their
group's longest, configurations of these few sizes are optimised by column generation,
real pieces take the places, and what is left is put where it fits best. The plan says which
ranks of which length go to which run of sequences, so placing pieces is a join, and no task
ever holds a group.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import cut, in_parts
from foliant.llm.pieces import word_ids

#: Groups of large lengths that are tried, and the share of a sequence from which a length is large.
SETTINGS = ((24, 1 / 4), (24, 1 / 3), (24, 1 / 2))


def _best_configuration(sizes: list[int], worth: np.ndarray, room: int) -> tuple[float, list[int]]:
    """The unbounded knapsack: how many of each size are worth most in a sequence."""
    best = np.zeros(room + 1)
    last = np.full(room + 1, -2)
    each = np.array(sizes)
    for space in range(min(sizes), room + 1):
        back = space - each
        values = np.where(back >= 0, best[np.maximum(back, 0)] + worth, -1.0)
        at = int(values.argmax())
        best[space] = best[space - 1]
        if values[at] > best[space] + 1e-12:
            best[space], last[space] = values[at], at
    counts, space = [0] * len(sizes), room
    while space > 0:
        if last[space] == -2:
            space -= 1
        else:
            counts[last[space]] += 1
            space -= sizes[last[space]]
    return float(best[room]), counts


def configurations(sizes: list[int], demand: list[int], room: int, rounds: int = 200) -> list[tuple[list[int], int]]:
    """Configurations and how often each is used, rounded down, near the optimum of the fractional problem."""
    k = len(sizes)
    basis = np.diag([float(room // s) for s in sizes])
    patterns = [[room // s if i == j else 0 for j in range(k)] for i, s in enumerate(sizes)]
    b = np.array(demand, float)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        worth = np.ones(k) @ inverse
        value, counts = _best_configuration(sizes, worth, room)
        if value <= 1 + 1e-7:
            break
        x, d = inverse @ b, inverse @ np.array(counts, float)
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = counts
        patterns[out] = counts
    x = np.linalg.inv(basis) @ b
    return [(p, int(np.floor(v + 1e-9))) for p, v in zip(patterns, x, strict=True) if v >= 1 - 1e-9]


class Bins:
    """Kinds of sequences: their items, how many there are of each, by room left."""

    def __init__(self) -> None:
        self.kinds: list[tuple[list[int], int]] = []
        self.by_room: dict[int, list[int]] = defaultdict(list)
        self.rooms: list[int] = []

    def add(self, items: list[int], times: int, room: int) -> None:
        if times:
            self.kinds.append((items, times))
            if room not in self.by_room:
                insort(self.rooms, room)
            self.by_room[room].append(len(self.kinds) - 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """A kind with the least room that holds the length, and that room; it leaves the set."""
        at = bisect_left(self.rooms, length)
        if at == len(self.rooms):
            return None
        room = self.rooms[at]
        kind = self.by_room[room].pop()
        if not self.by_room[room]:
            del self.by_room[room]
            self.rooms.pop(at)
        return kind, room


def pack(counts: dict[int, int], room: int, groups: int, share: float) -> list[tuple[list[int], int]]:
    """Kinds of sequences for ``counts`` pieces of each length: (items, times)."""
    left = {n: c for n, c in counts.items() if c}
    large = sorted((n for n in left if n > room * share and n < room), reverse=True)
    bins = Bins()
    if left.get(room):
        bins.add([room], left.pop(room), 0)
    total = sum(left[n] for n in large)
    if groups and total:
        # linear grouping: runs of (length, count), each group of about the same number of pieces
        per = -(-total // groups)
        members: list[list[list[int]]] = []
        taken = per
        for n in large:
            c = left[n]
            while c:
                if taken == per:
                    members.append([])
                    taken = 0
                k = min(c, per - taken)
                members[-1].append([n, k])
                taken += k
                c -= k
        merged: dict[int, list[list[int]]] = {}
        for m in members:  # groups that round up to the same length are one size
            merged.setdefault(m[0][0], []).extend(m)
        sizes = list(merged)
        for pattern, times in configurations(sizes, [sum(k for _, k in merged[s]) for s in sizes], room):
            # substitution: each place takes real pieces of its group, longest first
            places = [s for s, k in zip(sizes, pattern, strict=True) for _ in range(k)]
            while times:
                need = {s: places.count(s) for s in set(places)}
                runs = {s: [r for r in merged[s] if r[1]] for s in need}
                if any(sum(r[1] for r in runs[s]) < need[s] for s in need):
                    break
                items, used = [], defaultdict(int)
                for s in need:
                    want = need[s]
                    for r in runs[s]:
                        k = want if r[1] >= want * times else min(want, r[1])
                        items += [r[0]] * k
                        used[s, id(r)] = k
                        want -= k
                        if not want:
                            break
                step = times
                for s in need:
                    for r in runs[s]:
                        if k := used.get((s, id(r))):
                            step = min(step, r[1] // k)
                for s in need:
                    for r in runs[s]:
                        r[1] -= used.get((s, id(r)), 0) * step
                for n in items:
                    left[n] -= step
                bins.add(items, step, room - sum(items))
                times -= step
    for n in sorted((n for n in left if left[n]), reverse=True):  # best fit, longest first
        c = left[n]
        while c:
            found = bins.take(n)
            if found is None:
                t = room // n
                whole, rest = divmod(c, t)
                bins.add([n] * t, whole, room - n * t)
                bins.add([n] * rest, 1 if rest else 0, room - n * rest)
                c = 0
                continue
            kind, space = found
            items, times = bins.kinds[kind]
            t = space // n
            whole = min(times, c // t)
            rest = min(c - whole * t, t - 1) if whole < times else 0
            bins.kinds[kind] = (items, 0)
            bins.add([*items, *[n] * t], whole, space - n * t)
            bins.add([*items, *[n] * rest], 1 if rest else 0, space - n * rest)
            bins.add(items, times - whole - (1 if rest else 0), space)
            c -= whole * t + rest
    return [(items, times) for items, times in bins.kinds if times]


def best_pack(counts: dict[int, int], room: int) -> list[tuple[list[int], int]]:
    """The plan with the fewest sequences over ``SETTINGS``."""
    return min((pack(counts, room, *s) for s in SETTINGS), key=lambda plan: sum(t for _, t in plan))


def placements(plan: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, past the last rank, sequence of the first, offset) for each item of each kind."""
    out, ranks, sequence = [], defaultdict(int), 0
    for items, times in plan:
        offset = 0
        for n in items:
            out.append((n, ranks[n], ranks[n] + times, sequence, offset))
            ranks[n] += times
            offset += n
        sequence += times
    return out


def token_pieces(docs: DataFrame, vocabulary: str, end_id: int, room: int, id_col: str = "doc_id", text_col: str = "text", spaced: bool = True) -> DataFrame:
    """Pieces of at most ``room`` tokens: doc, piece, start, length, ids_crc32, part, local (rank of its length in the part).

    Only texts of more than ``room`` tokens are cut; all pieces but the first have ``room``.
    """

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = word_ids(vocabulary, spaced)
        end, w = encoder.pack([end_id]), encoder.width
        part, seen = TaskContext.get().partitionId(), np.zeros(room + 1, np.int64)
        for batch in in_parts(batches):
            rows = []
            for doc, ids in zip(batch["doc"].tolist(), encoder.encode(batch["text"].tolist()), strict=True):
                wide = np.frombuffer(ids + end, f"<u{w}").astype("<u4")
                n, a, i = len(wide), 0, 0
                while a < n:
                    b = a + ((n - a) % room or room)
                    rows.append((doc, i, a, b - a, zlib.crc32(wide[a:b]), part, int(seen[b - a])))
                    seen[b - a] += 1
                    a, i = b, i + 1
            yield pd.DataFrame(rows, columns=["doc", "piece", "start", "length", "ids_crc32", "part", "local"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    nullable = rows.withColumn("none", F.col("doc").isNull()).withColumn("doc", F.coalesce("doc", F.lit(-(1 << 63))))
    found = nullable.select("doc", "text").mapInPandas(cut_up, "doc long, piece int, start long, length long, ids_crc32 long, part int, local long")
    return found.withColumn("doc", F.when(F.col("doc") != F.lit(-(1 << 63)), F.col("doc")))


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 0, room: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece with its sequence and offset.

    Columns: ``id_col``, piece, start, length, ids_crc32, sequence_id, offset.

    The driver gets one count a length (``room`` at most) and sends back the plan, whose size
    depends on the number of lengths, not of documents. Null text counts as empty: the end
    id alone. Null ids stay null. Repeated rows are packed once each. An empty table gives no
    rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    pieces = cut(token_pieces(docs, vocabulary, end_id, room, id_col, text_col))
    by_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = placements(best_pack(counts, room))
    base = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = by_part.withColumn("base", base).select("part", "length", "base")
    ranked = pieces.join(starts, ["part", "length"]).withColumn("rank", F.col("base") + F.col("local"))
    table = spark.createDataFrame(pd.DataFrame(plan or [(0, 0, 0, 0, 0)], columns=["of", "low", "high", "first", "offset"]), "of long, low long, high long, first long, offset long")
    on = (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    return ranked.join(F.broadcast(table), on).select(
        F.col("doc").alias(id_col), "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset"
    )
