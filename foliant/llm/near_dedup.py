"""Near duplicates by BagMinHash signatures, banding and exact multiset overlap.

A document is the multiset of its five-word shingles. For every shingle of weight w, unit
Poisson processes over the weight levels 1..w, grouped into dyadic intervals, scatter points
in time over the slots of a signature; each slot keeps its earliest point. Two signatures
agree in a slot with a probability equal to the weighted Jaccard similarity. Points come in
order of time, so a process stops once every slot has an earlier point.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import cut, in_parts, text_hash

WORDS, SIMILARITY = 5, 0.8

#: Slots of a signature, bands, and slots of a band; each slot is in two bands. A pair at 0.8
#: shares no band with probability 2e-4, one at 0.4 shares one with 3 %, one at 0.3 with 0.3 %.
SLOTS, BANDS, ROWS = 192, 48, 8

_M = np.uint64(0xFFFFFFFFFFFFFFFF)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_OF_BYTE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWER = np.cumprod(np.full(64, 0x5851F42D4C957F2D, dtype=np.uint64))
_PLACE = np.cumprod(np.full(WORDS, 0xD6E8FEB86659FD93, dtype=np.uint64))


_ORDER = np.random.default_rng(20240502)
_BAND_SLOTS = np.concatenate([_ORDER.permutation(SLOTS) for _ in range(-(-BANDS * ROWS // SLOTS))])[: BANDS * ROWS].reshape(BANDS, ROWS)


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * _B
    z = (z ^ (z >> np.uint64(27))) * _C
    return z ^ (z >> np.uint64(31))


def _word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each lower-case word between ASCII white space."""
    data = np.frombuffer(text.lower().encode(errors="replace"), np.uint8)
    inside = ~_IS_SPACE[data]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    length = ends - starts
    at = np.flatnonzero(inside)
    place = at - np.repeat(starts, length)
    value = _OF_BYTE[data[at]] * _POWER[place & 63] + (place >> 6).astype(np.uint64) * _A * _OF_BYTE[data[at]]
    first = np.concatenate([[0], np.cumsum(length)[:-1]])
    return _mix(np.add.reduceat(value, first) + length.astype(np.uint64) * _A)


def shingles(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, ascending, and their counts. A text of one to four words is one shingle."""
    words = _word_hashes(text)
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(words) < WORDS:
        return _mix((words * _PLACE[: len(words)]).sum(keepdims=True) + np.uint64(len(words))), np.ones(1, np.int64)
    n = len(words) - WORDS + 1
    return np.unique(_mix(sum(words[i : i + n] * _PLACE[i] for i in range(WORDS))), return_counts=True)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets; 1 if both are empty."""
    total = int(a[1].sum() + b[1].sum())
    if not total:
        return 1.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / (total - both)


def signature(items: np.ndarray, counts: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """The identity (a 64-bit hash) of the earliest point in each slot; zeros for an empty bag."""
    found = np.zeros(slots, np.uint64)
    if not len(items):
        return found
    best = np.full(slots, np.inf)
    # dyadic intervals of weight levels: [0,1), [1,2), [2,4), [4,8), ...
    keys, widths, lows, weights = [_mix(items ^ _A)], [np.ones(len(items))], [np.zeros(len(items))], [counts.astype(float)]
    low, level = 1, 1
    while (some := counts > low).any():
        keys.append(_mix(items[some] + np.uint64((level + 1) * int(_A) & (1 << 64) - 1)))
        widths.append(np.full(some.sum(), float(low)))
        lows.append(np.full(some.sum(), float(low)))
        weights.append(counts[some].astype(float))
        low, level = low * 2, level + 1
    key, width, low, weight = (np.concatenate(x) for x in (keys, widths, lows, weights))
    time, step = np.zeros(len(key)), np.zeros(len(key), np.uint64)
    while len(key):
        block = 1 if len(key) >= slots else -(-2 * slots // len(key))
        point = step[:, None] + np.arange(1, block + 1, dtype=np.uint64)
        z = _mix(key[:, None] ^ (point * _A))
        u = ((z >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)
        times = time[:, None] + np.cumsum(-np.log(u) / width[:, None], axis=1)
        y = _mix(z ^ _C)
        # a point's level in its interval: the coins that lead down the interval's halves
        taken = low[:, None] + np.floor((y >> np.uint64(32)).astype(float) / (1 << 32) * width[:, None]) < weight[:, None]
        slot = (y & np.uint64(0xFFFFFFFF)) % np.uint64(slots)
        s, t, name = slot[taken].astype(np.int64), times[taken], z[taken]
        np.minimum.at(best, s, t)
        first = best[s] == t
        found[s[first]] = name[first]
        live = times[:, -1] < best.max()
        key, width, low, weight, time, step = key[live], width[live], low[live], weight[live], times[live, -1], point[live, -1]
    return found


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key a band, as signed numbers."""
    parts = sig[_BAND_SLOTS] * np.cumprod(np.full(ROWS, 0xA0761D6478BD642F, dtype=np.uint64))
    return _mix(parts.sum(axis=1) + np.arange(1, BANDS + 1, dtype=np.uint64) * _A).view(np.int64)


def _bag_name(items: np.ndarray, counts: np.ndarray) -> tuple[int, int]:
    raw = hashlib.blake2b(items.tobytes() + counts.tobytes(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, h1 and h2 (128-bit name of the bag), weight (number of shingles), bands (array of longs)."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in in_parts(batches):
            rows = []
            for doc, text in zip(batch["doc"].tolist(), batch["text"].tolist(), strict=True):
                items, counts = shingles(text)
                rows.append((doc, *_bag_name(items, counts), int(counts.sum()), band_keys(signature(items, counts)).tolist() if len(items) else []))
            yield pd.DataFrame(rows, columns=["doc", "h1", "h2", "weight", "bands"])

    return _rows(docs, id_col, text_col).mapInPandas(each, "doc long, h1 long, h2 long, weight long, bands array<long>")


_NO_ID = -(1 << 63)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _bags(nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node, items and counts (bytes) of the wanted documents; only their texts travel, once."""
    texts = _rows(docs, id_col, text_col).join(nodes.select(F.col("node").alias("doc")).distinct(), "doc", "left_semi")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in in_parts(batches):
            found = [shingles(t) for t in batch["text"].tolist()]
            yield pd.DataFrame({"node": batch["doc"], "items": [i.tobytes() for i, _ in found], "counts": [c.astype("<i4").tobytes() if len(c) and c.max() > 1 else b"" for _, c in found]})

    return cut(texts.mapInPandas(each, "node long, items binary, counts binary"))


def _bag(items: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    found = np.frombuffer(items, np.uint64)
    return found, np.frombuffer(counts, "<i4").astype(np.int64) if counts else np.ones(len(found), np.int64)


def _verified(pairs: DataFrame, bags: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose bags overlap enough."""
    both = pairs.join(bags.select(F.col("node").alias("b"), F.col("items").alias("ib"), F.col("counts").alias("cb")), "b")
    both = both.join(bags.select(F.col("node").alias("a"), F.col("items").alias("ia"), F.col("counts").alias("ca")), "a")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ok = [overlap(_bag(w, x), _bag(y, z)) >= similarity for w, x, y, z in zip(batch["ia"], batch["ca"], batch["ib"], batch["cb"], strict=True)]
            yield batch.loc[ok, ["a", "b"]]

    return both.select("a", "b", "ia", "ca", "ib", "cb").mapInPandas(each, "a long, b long").distinct()


#: Members of one side of a cell, and the shingles that its bags hold together.
CELL, CELL_SHINGLES = 2048, 1 << 21


def _prefixes(mixed: DataFrame, bags: DataFrame, similarity: float) -> DataFrame:
    """Postings (token, node, label, weight, start) of the bags' prefixes, without tokens of one bag alone.

    ``mixed``: node, label, weight. Bags are put in one global order, the rarest shingles first;
    ``start`` is a shingle's place in its bag. Two bags that overlap enough share a shingle
    of their prefixes, the first (1 - similarity) of each: an exact filter, not an estimate.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held = [_bag(i, c) for i, c in zip(batch["items"], batch["counts"], strict=True)]
            sizes = np.array([len(x) for x, _ in held])
            for some in np.split(np.arange(len(held)), np.flatnonzero(np.diff(np.cumsum(sizes) >> 18)) + 1):  # about 2^18 shingles a frame
                if len(some):
                    token, n = np.concatenate([held[k][0] for k in some]), np.concatenate([held[k][1] for k in some])
                    yield pd.DataFrame({"node": np.repeat(batch["node"].to_numpy()[some], sizes[some]), "token": token.view(np.int64), "n": n.astype(np.int32)})

    tokens = bags.join(mixed.select("node"), "node", "left_semi").mapInPandas(each, "node long, token long, n int")
    common = tokens.groupBy("token").agg(F.count("*").alias("bags")).where("bags > 1")
    order = Window.partitionBy("node").orderBy("bags", "token")
    placed = tokens.join(common, "token").select(
        "token", "node", F.sum("n").over(Window.partitionBy("node")).alias("shared"), F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")
    )
    start = F.col("weight") - F.col("shared") + F.col("before")  # shingles of this bag alone come first
    return placed.join(mixed, "node").select("token", "node", "label", "weight", start.alias("start")).where(F.col("start") <= F.col("weight") - F.ceil(F.col("weight") * F.lit(similarity) - F.lit(1e-9)))


def _between_labels(postings: DataFrame, similarity: float) -> DataFrame:
    """The postings that may lead from one component to another, with ``outside``: whether the node lies outside the token's largest component.

    A token of one component alone leads nowhere, nor does a posting from which on too little is left, even
    beside the token's smallest bag and the one with the most left.
    """
    sizes = postings.groupBy("token", "label").agg(F.count("*").alias("n"), F.min("weight").alias("least"), F.max(F.col("weight") - F.col("start")).alias("left"))
    mixed = sizes.groupBy("token").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count("*").alias("kinds"), F.min("least").alias("least"), F.max("left").alias("left")).where("kinds > 1")
    share = F.lit(similarity / (1 + similarity))
    other = F.greatest(F.col("least"), F.col("weight") * F.lit(similarity))
    enough = F.least("left", F.col("weight") - F.col("start")) >= share * (F.col("weight") + other) - F.lit(1e-6)
    return postings.join(mixed, "token").where(enough).select(*postings.columns, (F.col("label") != F.col("main")).alias("outside"))


def _in_cells(members: DataFrame) -> DataFrame:
    """A row for each cell (token, i, j) that a member enters, as is_x or is_y or both, and the cell's bin.

    The members of a token are dealt to blocks of about ``CELL`` members and ``CELL_SHINGLES``
    shingles; a cell meets one block's outside members with another block's members. A token of
    one block is one cell, which every member enters once. Cells of the same i and j share bins,
    as most are small.
    """
    blocks = F.greatest(F.ceil(F.count("*") / F.lit(float(CELL))), F.ceil(F.sum("weight") / F.lit(float(CELL_SHINGLES))))
    sizes = members.groupBy("token").agg(blocks.alias("blocks"))
    of_all = members.agg(F.sum("weight").alias("w"), F.count("*").alias("n")).head()
    bins = 1 + max((of_all["w"] or 0) // CELL_SHINGLES, of_all["n"] // (4 * CELL))
    sized = members.join(sizes, "token").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    whole = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)

    def enters(x: bool, y: bool, i: Column, j: Column) -> Column:
        return F.struct(F.lit(x).alias("is_x"), F.lit(y).alias("is_y"), i.alias("i"), j.alias("j"))

    as_x = F.when(F.col("outside"), F.transform(whole, lambda k: enters(True, False, F.col("block"), k))).otherwise(F.array().cast("array<struct<is_x: boolean, is_y: boolean, i: bigint, j: bigint>>"))
    as_y = F.transform(whole, lambda k: enters(False, True, k, F.col("block")))
    cells = F.when(F.col("blocks") == 1, F.array(enters(True, True, F.col("block"), F.col("block")))).otherwise(F.concat(as_x, as_y))
    return sized.withColumn("cell", F.explode(cells)).select(*members.columns, "cell.*", F.pmod(F.xxhash64("token"), F.lit(bins)).alias("bin"))


def _may_link(cells: pd.DataFrame, similarity: float) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of a bin of cells: an outside one, and the others of its cell which by sizes and places may overlap with it enough."""
    order = np.argsort(cells["token"].to_numpy(), kind="stable")
    token, node, label, weight, start, outside, is_x, is_y = (cells[c].to_numpy()[order] for c in ("token", "node", "label", "weight", "start", "outside", "is_x", "is_y"))
    left, share = weight - start, similarity / (1 + similarity)
    edges = np.flatnonzero(np.diff(token, prepend=token[:1] - 1, append=token[-1:] + 1))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        for k in (np.flatnonzero(outside[a:b] & is_x[a:b]) + a).tolist():
            maybe = is_y[a:b] & (label[a:b] != label[k]) & (~outside[a:b] | (node[a:b] > node[k])) & (np.minimum(left[a:b], left[k]) >= share * (weight[a:b] + weight[k]) - 1e-6)
            if maybe.any():
                yield int(order[k]), order[np.flatnonzero(maybe) + a]


def _compared_in_cells(postings: DataFrame, bags: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between components among bags that share a token of their prefixes, found without a row for any pair.

    At the first token that two bags share, in the global order, they overlap by no more than
    what each has left from there on. So the cells are first gone through without bags, which
    leaves the members with a possible partner; only their bags travel, to be compared.
    """

    def possible(cells: pd.DataFrame) -> pd.DataFrame:
        some = np.zeros(len(cells), bool)
        for k, others in _may_link(cells, similarity):
            some[k] = some[others] = True
        return cells.loc[some, ["token", "node", "label", "weight", "start", "outside"]]

    def compared(cells: pd.DataFrame) -> pd.DataFrame:
        node, weight = cells["node"].to_numpy(), cells["weight"].to_numpy()
        held = [_bag(i, c) for i, c in zip(cells["items"], cells["counts"], strict=True)]
        found: list[tuple[int, int]] = []
        for k, others in _may_link(cells, similarity):
            a, ca = held[k]
            for some in np.array_split(others, 1 + int(weight[others].sum()) // CELL_SHINGLES):
                if not len(some):
                    continue
                lengths = np.array([len(held[o][0]) for o in some])
                b, cb = np.concatenate([held[o][0] for o in some]), np.concatenate([held[o][1] for o in some])
                place = np.minimum(np.searchsorted(a, b), len(a) - 1)
                both = np.add.reduceat(np.where(a[place] == b, np.minimum(ca[place], cb), 0), np.concatenate([[0], np.cumsum(lengths)[:-1]]))
                found += [(min(int(node[k]), m), max(int(node[k]), m)) for m in node[some][both >= similarity * (weight[k] + weight[some] - both)].tolist()]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    schema = "token long, node long, label long, weight long, start long, outside boolean"
    left = cut(_in_cells(postings).groupBy("bin", "i", "j").applyInPandas(possible, schema).distinct())
    rows = _in_cells(left).join(bags, "node")  # bags join last, so that only ids move before
    return rows.groupBy("bin", "i", "j").applyInPandas(compared, "a long, b long").distinct()


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node, label: the least node that is reachable. ``nodes``: node; ``links``: a, b.

    Each round every node takes the least label around it, then the label of that label; the
    rounds needed grow with the logarithm of a component's width in practice. Nothing is collected.
    """
    edges = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = cut(edges.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")))
    while True:
        around = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        new = labels.join(around, labels["node"] == around["a"], "left").select("node", "label", F.least("label", "near").alias("low"))
        target = new.select(F.col("node").alias("low"), F.col("low").alias("lower"))
        jumped = cut(new.join(target, "low", "left").select("node", F.col("label").alias("old"), F.least(F.col("low"), F.col("lower")).alias("label")))
        if jumped.where("old <> label").isEmpty():
            break
        labels = jumped.select("node", "label")
    return nodes.select("node").distinct().join(jumped.select("node", "label"), "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: ``id_col``, class_id (the least id of its class), n_copies (rows with the same bag), n_links (verified links of that bag).

    A class is a connected component of documents whose multisets of five-word shingles
    overlap by ``similarity`` or more. Equal bags are one node, so copies are never compared.
    In each bucket of a band all members are compared with the least one. The members of buckets
    that still hold several components go through an exact prefix filter: bags that overlap
    enough share one of their rarest shingles, and at the first one shared have enough left.
    Those that may overlap are compared with the bags of other components, block by block. So
    every pair that shares a band is compared, ruled out or already connected: no link between
    classes is lost, and no bucket emits its pairs.

    Null text counts as empty. Texts without words form one class. A null id is kept as null,
    its class like any other's; rows without id are documents of their own. Rows with the
    same id are one document: their classes merge. An empty table gives no rows. Other columns
    are ignored.
    """
    if docs.where(F.col(id_col).isNull()).limit(2).count() > 1:
        keyed, keys = _own_keys(docs, id_col, text_col, F.col(id_col).isNull())
        own = keys.select("__key", F.col("__id").alias(id_col))
        least = keys.select(F.col("__key").alias("class_id"), F.col("__id").alias("__class"))
        found = near_groups(keyed, "__key", text_col, similarity)
        return found.join(own, "__key").join(least, "class_id").select(id_col, F.col("__class").alias("class_id"), "n_copies", "n_links")
    sigs = cut(signatures(docs, id_col, text_col))
    nodes = cut(sigs.groupBy("h1", "h2").agg(F.min("doc").alias("node"), F.count("*").alias("n_copies"), F.first("weight").alias("weight"), F.first("bands").alias("bands")))
    members = nodes.select("node", "weight", F.explode("bands").alias("key"))
    pivots = members.groupBy("key").agg(F.min(F.struct("node", "weight")).alias("pivot"), F.count("*").alias("n")).where("n > 1").select("key", "n", F.col("pivot.node").alias("a"), F.col("pivot.weight").alias("weight_a"))
    shared = cut(members.join(pivots, "key"))  # only buckets with two members or more are looked at from here on
    pairs = cut(shared.where((F.col("node") != F.col("a")) & _can_reach(F.col("weight"), F.col("weight_a"), similarity)).select("a", F.col("node").alias("b")).distinct())
    bags = _bags(shared.select("node"), docs, id_col, text_col)
    # rows of one id that hold several texts are linked as they are
    own = sigs.join(nodes.select("h1", "h2", "node"), ["h1", "h2"])
    same_id = own.groupBy("doc").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("a", "b")
    links = cut(_verified(pairs, bags, similarity).unionByName(same_id).distinct())
    labels = cut(components(nodes, links))

    # labels meet each node once, not each of its buckets; the two of a pair are compared already
    held = shared.where("n > 2").groupBy("node", "weight").agg(F.collect_list("key").alias("keys"))
    held = cut(held.join(labels, "node").select("node", "weight", "label", F.explode("keys").alias("key")))
    mixed = held.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    open_nodes = cut(held.join(mixed, "key", "left_semi").select("node", "label", "weight").distinct())
    postings = cut(_between_labels(cut(_prefixes(open_nodes, bags, similarity)), similarity))
    more = cut(_compared_in_cells(postings, bags, similarity))
    if not more.isEmpty():
        links = cut(links.unionByName(more).distinct())
        labels = cut(components(nodes, links))
    degree = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("n_links"))
    classes = nodes.select("h1", "h2", "node", "n_copies").join(labels, "node").join(degree, "node", "left")
    return sigs.select("doc", "h1", "h2").join(classes, ["h1", "h2"]).select(
        F.when(F.col("doc") != F.lit(_NO_ID), F.col("doc")).alias(id_col),
        F.when(F.col("label") != F.lit(_NO_ID), F.col("label")).alias("class_id"),
        "n_copies",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def _can_reach(x, y, similarity: float):  # noqa: ANN001, ANN202
    """Bags whose sizes differ more cannot overlap enough."""
    return F.least(x, y) >= F.greatest(x, y) * F.lit(similarity)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The document with the least id of each class, with all its columns; a row that is repeated, id and text, stays once.

    Rows with one id or none and different texts are documents of their own here; a null id is the least.
    """
    ids = docs.groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias("n"))
    if not ids.where("n > 1").isEmpty():
        docs_keyed, _ = _own_keys(docs, id_col, text_col, F.lit(True))
        return keep_one(docs_keyed.dropDuplicates(["__key"]), "__key", text_col, similarity).select(*docs.columns)
    none = F.lit(_NO_ID)
    groups = near_groups(docs, id_col, text_col, similarity)
    firsts = groups.where(F.col(id_col).eqNullSafe(F.col("class_id"))).select(F.coalesce(F.col(id_col), none).alias("__id"))
    return docs.withColumn("__id", F.coalesce(F.col(id_col).cast("long"), none)).join(firsts, "__id", "left_semi").drop("__id")


def _own_keys(docs: DataFrame, id_col: str, text_col: str, apart: Column) -> tuple[DataFrame, DataFrame]:
    """The documents with __key, and __key with its __id.

    Keys ascend with the ids, null first. Where ``apart`` holds, a key is of one id and text,
    elsewhere of one id.
    """
    rows = docs.withColumn("__id", F.col(id_col).cast("long")).withColumn("__hash", F.when(apart, text_hash(text_col)).otherwise(""))
    order = [F.col("__id").asc_nulls_first(), "__hash"]
    keys = cut(rows.select("__id", "__hash").distinct().orderBy(*order).withColumn("__key", F.monotonically_increasing_id()))
    found = keys.select(F.col("__id").alias("__i"), F.col("__hash").alias("__h"), "__key")
    keyed = rows.join(found, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__hash") == F.col("__h")))
    return keyed.select(*docs.columns, "__key"), keys.select("__key", "__id")
