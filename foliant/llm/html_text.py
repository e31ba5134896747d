"""Main text of web pages: page structure, and suffix arrays over each host's pages.

A page is cut into blocks, each with the zone it lies in: main (inside the article), aside
(elements that are menus, headers, footers, sidebars, forms by their names) or open (all
else outside the article). The words of all blocks outside articles are laid end to end by
host; a suffix array with common-prefix lengths finds the long runs of words that lie on
pages with different articles, so a copied page repeats nothing. What is covered goes from
open blocks, and so does a block whose place in the page is boilerplate: the share of such
blocks that the arrays cover decides, class names being worth a stated number of blocks.
The unique runs of open blocks stay beside the article.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import cut, in_parts

#: Words of a repeated run (a shorter block must be repeated whole), and pages of one suffix array (a hot host has several, which are merged).
RUN, PAGES = 8, 500

#: A place is boilerplate from this share of covered blocks on, without and with a telling class name. The name counts
#: as ``PRIOR`` covered blocks, no name as as many uncovered ones.
SHARE, NAMED_SHARE, PRIOR = 0.5, 0.05, 100

#: Attributes as browsers read them: a quote counts right after = only, and one that is not closed goes on to the end.
_ATTRS = r"""(?:[\s/]++|=?[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+|(?=>)))?+|=)*+"""
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<(?P<raw>script|style|template|textarea|select|iframe|title|head)(?=[\s/>])(?P<rest>{_ATTRS})(?:>|\Z)"
    rf"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>{_ATTRS})(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
#: Elements that end a block, that hold no content, that make zones and places.
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ZONES = frozenset("article main nav header footer aside form section div menu dialog ul ol span p table details fieldset button figure body html li td".split())
_MAIN = frozenset(["article", "main"])
_ASIDE = frozenset("nav header footer aside form menu dialog button fieldset".split())
_HOLDERS = frozenset("div section ul ol".split())
#: Words of class names and ids of what is not main text. The last ones only count outside articles.
_NAMED = frozenset(
    "ad ads advert adverts advertisement advertisements breadcrumb breadcrumbs comment comments consent cookie cookies disqus menu menus nav navbar navigation newsletter notice notices notification notifications promo sidebar sidebars sponsor sponsored".split()
)
_NAMED_OUTSIDE = _NAMED | frozenset("banner footer header masthead modal pager pagination popup related replies respond share sharing skip social subscribe toolbar widget".split())
_ATTR = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_ROLE = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())


def _names(attrs: str) -> tuple[list[str], list[str]]:
    """Class names and ids, and roles, in lower case."""
    names: list[str] = []
    roles: list[str] = []
    for m in _ATTR.finditer(attrs):
        (roles if m[1].lower() == "role" else names).extend((m[2] or m[3] or m[4] or "").lower().split())
    return names, roles


def _telling(names: list[str], known: frozenset) -> bool:
    """Whether a name, or its first or last part, is known: comments, cookie-notice, ad-slot."""
    return any(part in known for name in names for part in (name, *re.split("[-_]", name)[:: max(1, len(re.split("[-_]", name)) - 1)]))


@dataclass
class Block:
    """``place``: the elements around it with their class names; ``named``: one of these tells that it is no main text."""

    zone: str
    text: str
    place: str
    named: bool


def page_blocks(page: str) -> list[Block]:
    """The blocks that have text, in page order.

    Character references are decoded, white space is one space. Scripts, styles and form
    controls are dropped. An element that is never closed ends with the one around it.
    """
    out: list[Block] = []
    stack: list[tuple[str, str, str, bool]] = []  # name, and zone, place and named outside of it
    words: list[str] = []
    zone, place, named, at, n = "open", "", False, 0, len(page)

    def end() -> None:
        if words:
            text = " ".join(html.unescape("".join(words)).split())
            if text:
                out.append(Block(zone, text, place, named))
            words.clear()

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            words.append(page[at:])
            break
        if m.start() > at:
            words.append(page[at : m.start()])
        at = m.end()
        if m["cdata"] is not None:
            words.append(html.escape(m["cdata"]))
        elif m["raw"]:
            name = m["raw"].lower()
            close = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
            if close:
                at = close.end()
            elif name not in ("head", "title"):
                at = n
        elif m["name"]:
            name = m["name"].lower()
            if name in _BLOCK:
                end()
            elif name == "br":
                words.append(" ")
            if name in _VOID or name not in _ZONES:
                continue
            if not m["close"]:
                if name == "p" and stack and stack[-1][0] == "p" or name == "li" and stack and stack[-1][0] == "li":
                    _, zone, place, named = stack.pop()
                stack.append((name, zone, place, named))
                if not m["attrs"] and name not in _MAIN and name not in _ASIDE and name not in _HOLDERS:
                    continue
                names, roles = _names(m["attrs"]) if m["attrs"] else ([], [])
                if name in _MAIN:
                    new = "main" if zone != "aside" else "aside"
                elif name in _ASIDE and not (name == "header" and zone == "main") or name not in ("body", "html") and not _ROLE.isdisjoint(roles):
                    new = "aside"
                else:
                    new = "aside" if zone == "main" and name in _HOLDERS and _telling(names, _NAMED) else zone
                told = named or name in _HOLDERS and _telling(names, _NAMED_OUTSIDE)
                where = f"{place}>{name}" + "".join("." + re.sub("[0-9]+", "#", x) for x in sorted(names)) if name not in ("body", "html") else place
                if (new, told, where) != (zone, named, place):
                    end()
                    zone, named, place = new, told, where
            else:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        if stack[i][1:] != (zone, place, named):
                            end()
                            _, zone, place, named = stack[i]
                        del stack[i:]
                        break
                    if stack[i][0] in ("article", "main", "body") and name not in ("article", "main", "body", "html"):
                        break
    end()
    return out


def blocks(page: str) -> list[tuple[str, str]]:
    """(zone, text) of each block."""
    return [(b.zone, b.text) for b in page_blocks(page)]


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def suffix_array(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order, by doubling, and how many tokens each shares with the one before it."""
    n = len(tokens)
    _, rank = np.unique(tokens, return_inverse=True)
    levels, done = [rank.astype(np.int64) + 1], 1
    while n and levels[-1].max() < n and done < n:
        rank = levels[-1]
        after = np.zeros(n, np.int64)
        after[: n - done] = rank[done:]
        _, rank = np.unique(rank * (n + 1) + after, return_inverse=True)
        levels.append(rank.astype(np.int64) + 1)
        done *= 2
    order = np.argsort(levels[-1], kind="stable")
    shared = np.zeros(n, np.int64)
    if n > 1:
        i, j = order[1:].copy(), order[:-1].copy()
        length = np.zeros(n - 1, np.int64)
        for k in range(len(levels) - 1, -1, -1):  # ranks of 2^k tokens agree: that many more are shared
            fits = np.flatnonzero((i < n) & (j < n))
            fits = fits[levels[k][i[fits]] == levels[k][j[fits]]]
            step = np.minimum(1 << k, n - np.maximum(i[fits], j[fits]))
            i[fits], j[fits], length[fits] = i[fits] + step, j[fits] + step, length[fits] + step
        shared[1:] = length
    return order, shared


def repeated_from(tokens: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each place, how many tokens from there on also lie elsewhere with another owner."""
    n = len(tokens)
    found = np.zeros(n, np.int64)
    if n < 2:
        return found
    order, shared = suffix_array(tokens)
    who = owner[order]
    for way in (1, -1):  # the nearest suffix of another owner before it in order, then after it
        # between a suffix and that one lie only suffixes of its own owner: the least length shared on the way counts
        w, link = (who, shared) if way == 1 else (who[::-1], np.concatenate([[0], shared[1:][::-1]]))
        fresh = np.concatenate([[True], w[1:] != w[:-1]])
        start = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        least = link.copy()
        runs = np.flatnonzero(~fresh)
        for k in np.split(runs, np.flatnonzero(np.diff(runs) > 1) + 1) if len(runs) else []:
            least[k[0] - 1 : k[-1] + 1] = np.minimum.accumulate(link[k[0] - 1 : k[-1] + 1])
        least[start == 0] = 0  # nobody else comes before
        at = order if way == 1 else order[::-1]
        found[at] = np.maximum(found[at], least)
    return found


def _laid_out(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Word numbers of the texts end to end, each closed by a number of its own; word names; where each text lies."""
    numbers: dict[str, int] = {}
    tokens, places = [], []
    for text in texts:
        a = len(tokens)
        tokens += [numbers.setdefault(w, len(numbers)) for w in text.split()]
        places.append((a, len(tokens)))
        tokens.append(-len(places))
    names = np.array([int.from_bytes(hashlib.blake2b(w.encode(errors="replace"), digest_size=8).digest(), "little") for w in numbers] or [0], np.uint64)
    return np.array(tokens, np.int64), names, places


def _covered(length: np.ndarray, a: int, b: int, run: int) -> list[tuple[int, int]]:
    """The stretches of the text a..b that repeated runs cover, counted from its start; a run has ``run`` words or is the whole text."""
    reach = np.minimum(length[a:b], b - a - np.arange(b - a))
    starts = np.flatnonzero(reach >= min(run, b - a))
    out: list[tuple[int, int]] = []
    for x, y in zip(starts.tolist(), (starts + reach[starts]).tolist(), strict=True):
        if out and x <= out[-1][1]:
            out[-1] = (out[-1][0], max(y, out[-1][1]))
        else:
            out.append((x, y))
    return out


_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _windows_of(texts: list[str], run: int) -> pd.DataFrame:
    """text, place, size, and a and b: two 64-bit names, the same everywhere, of each ``run`` words in a row, or of all words of a shorter text."""
    tokens, names, places = _laid_out(texts)
    starts, lengths = np.array([p[0] for p in places], np.int64), np.array([q - p for p, q in places], np.int64)
    parts = []
    for size in np.unique(np.minimum(lengths, run)).tolist():
        some = np.flatnonzero(lengths == size if size < run else lengths >= run)
        each = lengths[some] - size + 1 if size else np.zeros(len(some), np.int64)
        text = np.repeat(some, each)
        place = np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each)
        words = [names[tokens[starts[text] + place + i]] for i in range(size)]
        frame = {"text": text, "place": place, "size": size}
        for name, f in zip("ab", _FACTORS, strict=True):
            power = np.cumprod(np.full(max(1, size), f, np.uint64))
            z = sum((w * p for w, p in zip(words, power, strict=False)), np.full(len(text), size if size < run else 0, np.uint64))
            z = (z ^ (z >> np.uint64(31))) * np.uint64(f)
            frame[name] = (z ^ (z >> np.uint64(29))).view(np.int64)
        parts.append(pd.DataFrame(frame))
    return pd.concat(parts) if parts else pd.DataFrame({c: pd.Series(dtype="int64") for c in ("text", "place", "size", "a", "b")})


_NO_ID = -(1 << 63)


def parsed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page, h (of the html), url, host, owner (hash of the article, else of all text), main and rest.

    main: array of (at, text), rest: array of (at, zone, text, place, named); ``at`` is the block's number in the page.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in in_parts(batches, "html"):
            rows = []
            for page, h, url, data in zip(batch["page"].tolist(), batch["h"].tolist(), batch["url"].tolist(), batch["html"].tolist(), strict=True):
                found = page_blocks(data)
                main = [{"at": i, "text": b.text} for i, b in enumerate(found) if b.zone == "main"]
                rest = [{"at": i, "zone": b.zone, "text": b.text, "place": b.place, "named": b.named} for i, b in enumerate(found) if b.zone != "main"]
                own = "\n".join(x["text"] for x in main or rest)
                owner = int.from_bytes(hashlib.blake2b(own.encode(errors="replace"), digest_size=8).digest(), "little", signed=True)
                rows.append((page, h, url, host_of(url), owner, main, rest))
            yield pd.DataFrame(rows, columns=["page", "h", "url", "host", "owner", "main", "rest"])

    text = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("page"), F.xxhash64(text).alias("h"), F.col(url_col).cast("string").alias("url"), text.alias("html"))
    return rows.mapInPandas(each, "page long, h long, url string, host string, owner long, main array<struct<at: int, text: string>>, rest array<struct<at: int, zone: string, text: string, place: string, named: boolean>>")


_OPEN = "page long, h long, host string, owner long, at int, place string, named boolean, text string, words int, many boolean, covered array<struct<a: int, b: int>>"


def open_blocks(rest: DataFrame, run: int = RUN, pages_per_array: int = PAGES) -> DataFrame:
    """The open blocks with the stretches that repeat on pages of their host with another article.

    ``rest``: page, h, host, owner, rest. Pages of a host are dealt to arrays of about
    ``pages_per_array`` pages. Where a host has several, the runs that lie in different arrays
    are found by their names: each array has one row a name, merged by host. ``many``: the
    host has more than one article, so that something could repeat.
    """
    sizes = rest.groupBy("host").agg(F.ceil(F.count("*") / F.lit(pages_per_array)).alias("arrays"), (F.min("owner") < F.max("owner")).alias("many"))
    dealt = rest.join(sizes, "host").withColumn("array", F.pmod(F.xxhash64("page", "h"), F.col("arrays"))).repartition("host", "array")  # by host alone, a hot one would be one task

    def each(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates(["page", "h"])
        texts = [x["text"] for found in group["rest"] for x in found]
        owners = np.repeat(group["owner"].to_numpy(), [len(x) for x in group["rest"]])
        tokens, _, places = _laid_out(texts)
        owner = np.repeat(owners, [b - a + 1 for a, b in places])
        length, rows, k = repeated_from(tokens, owner), [], 0
        for page, h, host, own, many, found in zip(*(group[c].tolist() for c in ("page", "h", "host", "owner", "many", "rest")), strict=True):
            for x in found:
                a, b = places[k]
                k += 1
                if x["zone"] == "open":
                    rows.append((page, h, host, own, x["at"], x["place"], x["named"], x["text"], b - a, many, [{"a": p, "b": q} for p, q in _covered(length, a, b, run)]))
        return pd.DataFrame(rows, columns=["page", "h", "host", "owner", "at", "place", "named", "text", "words", "many", "covered"])

    def windows(group: pd.DataFrame) -> pd.DataFrame:
        owners = np.repeat(group["owner"].to_numpy(), [len(x) for x in group["rest"]])
        found = _windows_of([x["text"] for found in group["rest"] for x in found], run)
        found = found.assign(low=owners[found["text"].to_numpy()])
        merged = found.groupby(["a", "b"], as_index=False).agg(low=("low", "min"), high=("low", "max"))
        merged.insert(0, "host", group["host"].iloc[0])
        return merged

    found = cut(dealt.groupBy("host", "array").applyInPandas(each, _OPEN))
    hot = dealt.where("arrays > 1").groupBy("host", "array").applyInPandas(windows, "host string, a long, b long, low long, high long")
    common = cut(hot.groupBy("host", "a", "b").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("host", "a", "b"))
    if common.isEmpty():
        return found

    def each_window(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in in_parts(batches):
            found = _windows_of(batch["text"].tolist(), run)
            rows = batch[["page", "h", "host", "at"]].iloc[found["text"].to_numpy()].reset_index(drop=True)
            yield rows.assign(**{c: found[c].to_numpy() for c in ("a", "b", "place", "size")})

    spread = found.join(sizes.where("arrays > 1").select("host"), "host", "left_semi").select("page", "h", "host", "at", "text").mapInPandas(each_window, "page long, h long, host string, at int, a long, b long, place int, size int")
    more = spread.join(common, ["host", "a", "b"]).groupBy("page", "h", "at").agg(F.collect_list(F.struct(F.col("place").alias("a"), (F.col("place") + F.col("size")).alias("b"))).alias("more"))
    return found.join(more, ["page", "h", "at"], "left").withColumn("covered", F.concat("covered", F.coalesce("more", F.array().cast("array<struct<a: int, b: int>>")))).drop("more")


def _left(words: list[str], covered: list) -> list[str]:
    gone = np.zeros(len(words), bool)
    for c in covered:
        gone[c["a"] : c["b"]] = True
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


def kept_runs(found: DataFrame) -> DataFrame:
    """page, h, kept: (at, text) of what stays of the pages' open blocks, for pages where something does.

    ``found``: from :func:`open_blocks`. A place is judged by the share of its blocks, on hosts
    where something could repeat, whose words are covered by half or more.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            left = [_left(text.split(), covered) for text, covered in zip(batch["text"], batch["covered"], strict=True)]
            yield batch[["page", "h", "at", "place", "named", "many"]].assign(text=[" ".join(x) for x in left], gone=[2 * len(x) <= w for x, w in zip(left, batch["words"], strict=True)])

    judged = cut(found.mapInPandas(each, "page long, h long, at int, place string, named boolean, many boolean, text string, gone boolean"))
    votes = judged.groupBy("place", "named").agg(F.count(F.when(F.col("many"), 1)).alias("blocks"), F.count(F.when(F.col("many") & F.col("gone"), 1)).alias("hits"))
    share = (F.col("hits") + F.when(F.col("named"), F.lit(PRIOR)).otherwise(F.lit(0))) / (F.col("blocks") + F.lit(PRIOR))
    plain = votes.where(share < F.when(F.col("named"), F.lit(NAMED_SHARE)).otherwise(F.lit(SHARE))).select("place", "named")
    left = judged.where("text <> ''").join(plain, ["place", "named"])
    return left.groupBy("page", "h").agg(F.collect_list(F.struct("at", "text")).alias("kept"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", run: int = RUN, pages_per_array: int = PAGES) -> DataFrame:
    """The main text of every page.

    Columns: ``id_col``, ``url_col``, text, n_chars.

    An article or main element is kept whole but for what its elements or class names call a
    menu, footer, sidebar, notice, advert, form or comments; passages in it that other pages
    share stay. Of the blocks outside, the unique runs stay whose place is not boilerplate, in
    page order. Copies of one article (of one text, without article) count once, so copied
    pages keep their text. Pages are read twice: once for the blocks outside articles, which
    alone are kept and compared, once for the articles.

    Null html counts as empty, whose text is empty; a null or odd url belongs to the host
    without a name; a null id is kept as null; repeated rows give repeated results, pages of one
    id and different html are pages of their own. An empty table gives no rows. Other columns
    are ignored.
    """
    rest = cut(parsed(pages, id_col, url_col, html_col).where(F.size("rest") > 0).select("page", "h", "host", "owner", "rest"))
    kept = cut(kept_runs(open_blocks(rest, run, pages_per_array)))
    found = parsed(pages, id_col, url_col, html_col).select("page", "h", "url", "main")
    if not kept.isEmpty():
        none = F.array().cast("array<struct<at: int, text: string>>")
        found = found.join(kept, ["page", "h"], "left").withColumn("main", F.array_sort(F.concat("main", F.coalesce("kept", none))))
    text = F.array_join(F.col("main.text"), "\n")
    return found.select(F.when(F.col("page") != F.lit(_NO_ID), F.col("page")).alias(id_col), F.col("url").alias(url_col), text.alias("text"), F.length(text).cast("long").alias("n_chars"))
