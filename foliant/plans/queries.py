"""Queries over the standard tables, one for each operator of the engine that SQL can express, with their SQL.

Most functions call the kernels of ``functions`` and ``operators`` that also serve documents;
only key, order and value columns differ. Where the document operator works on a file's bytes,
the query states its rule over columns instead, and the operator has tests of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import text as tx
from foliant.operators import blocks, layout, relational as rel, spatial
from foliant.operators.content import CATEGORIES, running_total

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable:
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# scans, searches, sizes


@query("SELECT doc_id, lang, n_chars FROM documents WHERE n_chars > 2000")
def src_scan_filter(spark, sf):
    return table(spark, sf, "documents").where("n_chars > 2000").select("doc_id", "lang", "n_chars")


@query("SELECT doc_id, CASE WHEN contains(text, 'the') THEN CAST(length(text) - instr(reverse(text), 'eht') - 2 AS BIGINT) ELSE CAST(-1 AS BIGINT) END AS at FROM documents")
def find_last(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.find_last(F.col("text"), "the").alias("at"))


@query("SELECT doc_id, CAST(instr(text, 'the') - 1 AS BIGINT) AS at FROM documents")
def find_first(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.find_first(F.col("text"), "the").alias("at"))


@query("""
    SELECT doc_id, CASE WHEN n_chars < 1024 THEN concat(n_chars, ' B')
        WHEN n_chars < 1048576 THEN printf('%.1f KB', floor(n_chars / 1024 * 10 + 0.5) / 10) ELSE printf('%.1f MB', floor(n_chars / 1048576 * 10 + 0.5) / 10) END AS size FROM documents
""")
def format_size(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.size_text(F.col("n_chars")).alias("size"))


# values out of text


@query(r"SELECT doc_id, regexp_extract(text, '[+-]?[0-9]+(\.[0-9]+)?') AS token, TRY_CAST(nullif(regexp_extract(text, '[+-]?[0-9]+(\.[0-9]+)?'), '') AS DOUBLE) AS value FROM documents")
def num_token(spark, sf):
    token = F.regexp_extract("text", r"[+-]?[0-9]+(\.[0-9]+)?", 0)
    return table(spark, sf, "documents").select("doc_id", token.alias("token"), F.when(token != "", token.try_cast("double")).alias("value"))


@query(r"""SELECT conv_id, turn, regexp_replace(replace(replace(replace(text, '\', '\\'), '(', '\('), ')', '\)'), '\\([\\()])', '\1', 'g') AS text FROM conversations""")
def unescape(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.unescaped(tx.escaped(F.col("text"))).alias("text"))


@query(r"SELECT conv_id, turn, replace(replace(replace(text, '\', '\\'), '(', '\('), ')', '\)') AS text FROM conversations")
def escape_text(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.escaped(F.col("text")).alias("text"))


@query("SELECT doc_id, decode(unhex(hex(encode(text)))) AS text FROM documents")
def hex_decode(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.decode(F.unhex(F.hex("text")), "UTF-8").alias("text"))


@query("SELECT doc_id, lower(hex(encode(text))) AS hex FROM documents")
def hex_encode(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.lower(F.hex("text")).alias("hex"))


@query(r"SELECT doc_id, regexp_replace(text, '%[^\r\n]*', '', 'g') AS text FROM documents")
def strip_comments(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.regexp_replace("text", r"%[^\r\n]*", "").alias("text"))


# cross-references


@query("SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def newest_wins(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_id", "event_type", "value")
    return rel.newest_wins(events, ["user_id"], ["event_id"])


@query("SELECT o_orderkey, coalesce(c_name, '?') AS c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def ref_resolve(spark, sf):
    names = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return rel.lookup(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), names, ["o_custkey"], "c_name", F.lit("?"), "c_name").select("o_orderkey", "c_name")


@query("""
    WITH RECURSIVE walk AS (
        SELECT conv_id, turn, CAST(0 AS BIGINT) AS depth FROM conversations WHERE turn = 0
        UNION ALL SELECT c.conv_id, c.turn, w.depth + 1 FROM walk w JOIN conversations c ON c.conv_id = w.conv_id AND c.turn = w.turn + 1
    ) SELECT conv_id, turn, depth FROM walk
""")
def prev_chain(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn")
    w = Window.partitionBy("conv_id").orderBy("turn")
    # a link to turn + 1 holds as long as the turns are 0, 1, 2, ...: the chain is the run that starts at 0
    return turns.withColumn("depth", (F.row_number().over(w) - 1).cast("bigint")).where("turn = depth")


@query("SELECT o_orderkey, concat(lpad(CAST(o_orderkey AS VARCHAR), 10, '0'), ' ', lpad(CAST(o_custkey % 65536 AS VARCHAR), 5, '0'), CASE WHEN o_orderstatus = 'F' THEN ' f' ELSE ' n' END) AS entry FROM orders")
def fixed_width_encode(spark, sf):
    entry = F.concat(tx.fixed_width(F.col("o_orderkey"), 10), F.lit(" "), tx.fixed_width(F.col("o_custkey") % 65536, 5), F.when(F.col("o_orderstatus") == "F", " f").otherwise(" n"))
    return table(spark, sf, "orders").select("o_orderkey", entry.alias("entry"))


@query("""
    WITH h AS (SELECT doc_id, md5(text) AS h FROM documents)
    SELECT doc_id, CAST(concat('0x', substr(h, 1, 2)) AS BIGINT) AS kind, CAST(concat('0x', substr(h, 3, 8)) AS BIGINT) AS first, CAST(concat('0x', substr(h, 11, 4)) AS BIGINT) AS second FROM h
""")
def fixed_width_decode(spark, sf):
    h = F.md5("text")
    return table(spark, sf, "documents").select("doc_id", tx.big_endian(h, 1, 2).alias("kind"), tx.big_endian(h, 3, 8).alias("first"), tx.big_endian(h, 11, 4).alias("second"))


@query("""
    WITH nodes AS (
        SELECT concat('/', lpad(CAST(r_regionkey AS VARCHAR), 9, '0')) AS path, r_name AS name FROM region
        UNION ALL SELECT concat('/', lpad(CAST(n_regionkey AS VARCHAR), 9, '0'), '/', lpad(CAST(n_nationkey AS VARCHAR), 9, '0')), n_name FROM nation
        UNION ALL SELECT concat('/', lpad(CAST(n_regionkey AS VARCHAR), 9, '0'), '/', lpad(CAST(n_nationkey AS VARCHAR), 9, '0'), '/', lpad(CAST(s_suppkey AS VARCHAR), 9, '0')), s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
    ) SELECT path, name, row_number() OVER (PARTITION BY split_part(path, '/', 2) ORDER BY path) AS place FROM nodes
""")
def tree_preorder(spark, sf):
    part = lambda c: F.concat(F.lit("/"), tx.fixed_width(F.col(c), 9))
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name", F.concat(part("n_regionkey"), part("n_nationkey")).alias("path"))
    leaves = table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat("path", part("s_suppkey")).alias("path"), F.col("s_name").alias("name"))
    nodes = table(spark, sf, "region").select(part("r_regionkey").alias("path"), F.col("r_name").alias("name")).union(nation.select("path", "n_name")).union(leaves)
    w = Window.partitionBy(F.split("path", "/")[1]).orderBy("path")
    return nodes.select("path", "name", F.row_number().over(w).cast("bigint").alias("place"))


@query("SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def concat_ordered(spark, sf):
    return rel.ordered_concat(table(spark, sf, "conversations"), ["conv_id"], ["turn"], "text", " ")


@query("""
    SELECT s_suppkey, CASE WHEN s_acctbal > 5000 THEN s_name WHEN n_nationkey % 2 = 0 THEN n_name ELSE r_name END AS resources
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""")
def inherit_nearest(spark, sf):
    own = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", F.when(F.col("s_acctbal") > 5000, F.col("s_name")).alias("own"))
    parent = table(spark, sf, "nation").select("n_nationkey", "n_regionkey", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("parent"))
    root = table(spark, sf, "region").select("r_regionkey", F.col("r_name").alias("root"))
    joined = own.join(parent, F.col("s_nationkey") == F.col("n_nationkey")).join(root, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select("s_suppkey", F.coalesce("own", "parent", "root").alias("resources"))


@query("""
    SELECT p_partkey, CAST(CASE WHEN p_size > 25 THEN p_size ELSE CASE WHEN p_retailprice > 1000 THEN p_retailprice ELSE 612 END END AS DOUBLE) AS width,
        CAST(CASE WHEN p_size > 25 THEN p_size * 2 ELSE CASE WHEN p_retailprice > 1000 THEN p_retailprice / 2 ELSE 792 END END AS DOUBLE) AS height FROM part
""")
def coalesce_box(spark, sf):
    size, price = F.col("p_size").cast("double"), F.col("p_retailprice")
    box = lambda ok, w, h: F.when(ok, F.struct(w.alias("w"), h.alias("h")))
    best = F.coalesce(box(size > 25, size, size * 2), box(price > 1000, price, price / 2), F.struct(F.lit(612.0).alias("w"), F.lit(792.0).alias("h")))
    return table(spark, sf, "part").select("p_partkey", best.alias("b")).select("p_partkey", F.col("b.w").alias("width"), F.col("b.h").alias("height"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity * 1.5::DOUBLE AS x, (792::DOUBLE - l_discount * 100) * 1.5::DOUBLE AS y FROM lineitem")
def coord_flip(spark, sf):
    x, y = spatial.flipped(F.col("l_quantity"), F.col("l_discount") * 100, F.lit(792.0), F.lit(1.5))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", x.alias("x"), y.alias("y"))


# content


@query(r"""
    SELECT page_id, CAST(i - 1 AS BIGINT) AS op_idx, tags[i] AS tag FROM (
        SELECT page_id, tags, unnest(range(1, len(tags) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '</?[a-zA-Z][^>]*>') AS tags FROM pages))
""")
def tokenize_html(spark, sf):
    tags = F.regexp_extract_all("html", F.lit("</?[a-zA-Z][^>]*>"), 0)
    return table(spark, sf, "pages").select("page_id", F.posexplode(tags).alias("op_idx", "tag")).withColumn("op_idx", F.col("op_idx").cast("bigint"))


@query("""
    SELECT event_id, CASE event_type WHEN 'click' THEN 'text' WHEN 'view' THEN 'path' WHEN 'signup' THEN 'color' WHEN 'purchase' THEN 'xobject' ELSE 'other' END AS category FROM events
""")
def classify(spark, sf):
    events = table(spark, sf, "events")
    # event types stand for one operator of each category
    stands = {"click": "Tj", "view": "re", "signup": "rg", "purchase": "Do"}
    pairs = [(e, next(c for c, names in CATEGORIES.items() if op in names)) for e, op in stands.items()]
    names = spark.createDataFrame(pairs, "event_type string, category string")
    return rel.lookup(events.select("event_id", "event_type"), names, ["event_type"], "category", F.lit("other"), "category").select("event_id", "category")


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 4) AS total FROM events")
def stateful_running(spark, sf):
    return running_total(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "value").select("event_id", F.round("total", 4).alias("total"))


_MATRIX = ["l_quantity", "l_discount", "l_tax", "l_quantity", "l_extendedprice", "l_discount"]


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity * 2 + l_discount * 0, 6) AS a, round(l_quantity * 1 + l_discount * 3, 6) AS b, round(l_tax * 2 + l_quantity * 0, 6) AS c,
        round(l_tax * 1 + l_quantity * 3, 6) AS d, round(l_extendedprice * 2 + l_discount * 0 + 5, 6) AS e, round(l_extendedprice * 1 + l_discount * 3 + 7, 6) AS f FROM lineitem
""")
def matrix_mul(spark, sf):
    found = spatial.multiply([F.col(c) for c in _MATRIX], [F.lit(float(x)) for x in (2, 1, 0, 3, 5, 7)])
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[F.round(v, 6).alias(n) for n, v in zip("abcdef", found, strict=True)])


@query("""
    SELECT event_id, round(coalesce(sum((value / 1000 * 12 + 0.5 + CASE WHEN event_type = 'view' THEN 1.0 ELSE 0.0 END) * 0.9) OVER (
        PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4)::DOUBLE AS x FROM events
""")
def advance_prefix_sum(spark, sf):
    advance = layout.advance(F.col("value"), F.lit(12.0), F.lit(0.5), F.when(F.col("event_type") == "view", 1.0).otherwise(0.0), F.lit(0.9))
    return rel.prefix_sum(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], advance, "x").select("event_id", F.round("x", 4).alias("x"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (1 - l_discount) * (1 - l_tax) AS r, (1 - l_tax) * (1 - l_tax) AS g, (1 - l_quantity / 50) * (1 - l_tax) AS b FROM lineitem")
def cmyk_rgb(spark, sf):
    r, g, b = spatial.cmyk_to_rgb(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 50, F.col("l_tax"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r.alias("r"), g.alias("g"), b.alias("b"))


# fonts


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN coalesce(c_mktsegment, chr(65)) ELSE coalesce(n_name, chr(66)) END AS unicode FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0 LEFT JOIN nation ON o_custkey = n_nationkey")
def decode_lookup(spark, sf):
    cmap = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("cmap"))
    names = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("o_custkey"), F.col("n_name").alias("enc"))
    joined = table(spark, sf, "orders").join(cmap, "o_custkey", "left").join(names, "o_custkey", "left")
    return joined.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", F.coalesce("cmap", F.chr(F.lit(65)))).otherwise(F.coalesce("enc", F.chr(F.lit(66)))).alias("unicode"))


@query("""
    WITH n AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'error' THEN CAST(floor(value) AS BIGINT) END AS num FROM events),
    r AS (SELECT *, count(num) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM n)
    SELECT event_id, code FROM (SELECT event_id, num, coalesce(max(num) OVER (PARTITION BY user_id, run), 0)
        + CAST(sum(CASE WHEN num IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS BIGINT) - 1 AS code FROM r) WHERE num IS NULL
""")
def differences_fill(spark, sf):
    number = F.when(F.col("event_type") == "error", F.floor("value").cast("bigint"))
    return rel.fill_differences(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], number).select("event_id", F.col("code").cast("bigint").alias("code"))


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def dim_lookup(spark, sf):
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, sf, "customer").join(nation, "c_nationkey").select("c_custkey", "n_name")


@query("""
    SELECT vec_id, CAST(32 + i - 1 AS BIGINT) AS code, CAST(embedding[i] AS DOUBLE) AS width FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)
""")
def posexplode_offset(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "width")).select("vec_id", (F.col("pos") + 32).cast("bigint").alias("code"), F.col("width").cast("double").alias("width"))


@query("SELECT p_partkey, unnest(range(p_size, p_size + 4)) AS code FROM part")
def range_expand(spark, sf):
    return rel.expand_ranges(table(spark, sf, "part").select("p_partkey", "p_size"), F.col("p_size"), F.col("p_size") + 3, "code").select("p_partkey", "code")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(p_retailprice, 1000) AS width FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size < 20) ON l_partkey = p_partkey")
def width_lookup(spark, sf):
    widths = table(spark, sf, "part").where("p_size < 20").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return rel.lookup(lines, widths, ["l_partkey"], "p_retailprice", F.lit(1000.0), "width")


@query(None)
def string_width(spark, sf):
    """Whole texts, row by row: every character has the default, letters differ from it. An empty text has no width, null stays null."""
    text = F.col("text")
    counts = [(F.length(text) - F.length(F.replace(text, F.lit(chr(97 + i)), F.lit("")))) * F.lit(500.0 + 10 * i - 600.0) for i in range(26)]
    width = sum(counts, F.length(text) * F.lit(600.0)) / 1000 * 12
    return table(spark, sf, "documents").select("doc_id", width.alias("width"))


@query(r"""
    SELECT page_id, CAST(i - 1 AS BIGINT) AS place, a[i] AS src, b[i] AS dst FROM (SELECT page_id, a, b, unnest(range(1, len(a) + 1)) AS i FROM (
        SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS a, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS b FROM pages))
""")
def regex_pairs(spark, sf):
    shape = F.lit('<a href="([^"]*)">([^<]*)</a>')
    both = F.arrays_zip(F.regexp_extract_all("html", shape, 1).alias("src"), F.regexp_extract_all("html", shape, 2).alias("dst"))
    return table(spark, sf, "pages").select("page_id", F.posexplode(both).alias("place", "p")).select("page_id", F.col("place").cast("bigint").alias("place"), F.col("p.src").alias("src"), F.col("p.dst").alias("dst"))


@query("SELECT p_name AS unicode, arg_min(p_partkey, p_partkey) AS code FROM part GROUP BY p_name")
def reverse_lookup(spark, sf):
    return table(spark, sf, "part").groupBy(F.col("p_name").alias("unicode")).agg(F.min_by("p_partkey", "p_partkey").alias("code"))


@query(None)
def encode_lookup(spark, sf):
    """Whole texts, row by row; null if no character has a code."""
    hexed = F.regexp_replace("text", "[^a-z ]", "")
    for i in range(26):  # in order: the digits a to f only arise once the letters a to f are gone
        hexed = F.replace(hexed, F.lit(chr(97 + i)), F.lit(f"{i + 1:04x}"))
    hexed = F.replace(hexed, F.lit(" "), F.lit("0020"))
    return table(spark, sf, "documents").select("doc_id", F.when(hexed != "", hexed).alias("hex"))


# layout


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY round(value), ts, event_id) AS place FROM events")
def reading_order(spark, sf):
    w = Window.partitionBy("user_id").orderBy(F.round("value"), "ts", "event_id")
    return table(spark, sf, "events").select("event_id", F.row_number().over(w).cast("bigint").alias("place"))


_KEYS, _ORDER = ["user_id"], ["ts", "event_id"]


@query("""
    WITH g AS (SELECT event_id, user_id, value, coalesce(value - lag(value) OVER w > 30, false) AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT event_id, user_id, 'char' AS kind, value FROM g UNION ALL SELECT event_id, user_id, 'space' AS kind, value FROM g WHERE gap
""")
def word_gaps(spark, sf):
    gap = F.coalesce(F.col("value") - rel.before("value", _KEYS, _ORDER) > 30, F.lit(False))
    return layout.with_gaps(table(spark, sf, "events"), gap).select("event_id", "user_id", "kind", "value")


_FAR = "abs(value - lag(value) OVER w) > 25"


@query(f"""
    SELECT event_id, user_id, CAST(sum(CASE WHEN far THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS line
    FROM (SELECT *, {_FAR} AS far FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
""")
def line_islands(spark, sf):
    far = F.abs(F.col("value") - rel.before("value", _KEYS, _ORDER)) > 25
    return rel.islands(table(spark, sf, "events"), _KEYS, _ORDER, far, "line").select("event_id", "user_id", "line")


_BLOCKS = f"""
    lined AS (SELECT event_id, user_id, ts, value, CAST(sum(CASE WHEN far THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS line
        FROM (SELECT *, {_FAR} AS far FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))),
    lines AS (SELECT user_id, line, min(value) AS top, max(value) AS height FROM lined GROUP BY user_id, line),
    blocks AS (SELECT user_id, line, CAST(sum(CASE WHEN far THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY line) AS BIGINT) AS block FROM (
        SELECT *, abs(top - lag(top) OVER w) > lag(height) OVER w * 0.5 AS far FROM lines WINDOW w AS (PARTITION BY user_id ORDER BY line)))
"""


def _event_blocks(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    return layout.two_level(events, _KEYS, _ORDER, "value", 25.0, 0.5)


@query(f"WITH {_BLOCKS} SELECT event_id, lined.user_id, line, block FROM lined JOIN blocks USING (user_id, line)")
def block_islands(spark, sf):
    return _event_blocks(spark, sf).select("event_id", "user_id", "line", "block")


@query(f"""
    WITH {_BLOCKS} SELECT lined.user_id, block, count(*) AS n, min(value) AS low, max(value) AS high, arg_min(event_id, (ts, event_id)) AS first_id,
        string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id) AS ids FROM lined JOIN blocks USING (user_id, line) GROUP BY lined.user_id, block
""")
def block_agg(spark, sf):
    rows = F.array_sort(F.collect_list(F.struct("ts", "event_id")))
    return _event_blocks(spark, sf).groupBy("user_id", "block").agg(
        F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.min_by("event_id", F.struct("ts", "event_id")).alias("first_id"),
        F.array_join(F.transform(rows, lambda x: x["event_id"].cast("string")), ",").alias("ids"),
    )


@query("""
    WITH g AS (SELECT user_id, event_type, min(ts) AS first, count(*) AS n FROM events GROUP BY user_id, event_type)
    SELECT user_id, event_type, n, row_number() OVER (PARTITION BY user_id ORDER BY first, event_type) AS place FROM g
""")
def split_by_key(spark, sf):
    groups = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min("ts").alias("first"), F.count("*").alias("n"))
    w = Window.partitionBy("user_id").orderBy("first", "event_type")
    return groups.select("user_id", "event_type", "n", F.row_number().over(w).cast("bigint").alias("place"))


@query(r"SELECT item_id, i AS line FROM (SELECT item_id, unnest(string_split(concat(text, chr(10), '  ', chr(9)), chr(10))) AS l, CAST(generate_subscripts(string_split(concat(text, chr(10), '  ', chr(9)), chr(10)), 1) - 1 AS BIGINT) AS i FROM benchmark) WHERE trim(l, ' ' || chr(9)) <> ''")
def nonblank(spark, sf):
    lines = F.split(F.concat("text", F.lit("\n  \t")), "\n")
    return table(spark, sf, "benchmark").select("item_id", F.posexplode(lines).alias("line", "l")).where(~tx.is_blank(F.col("l"))).select("item_id", F.col("line").cast("bigint").alias("line"))


@query("""
    SELECT l_orderkey, min(l_quantity) AS x0, max(l_quantity + l_discount * 10) AS x1, round(min(l_tax * 100 - 0.85 * l_linenumber), 6) AS y0, round(max(l_tax * 100 + 0.15 * l_linenumber), 6) AS y1 FROM lineitem GROUP BY l_orderkey
""")
def bbox(spark, sf):
    box = layout.bounding_box(F.col("l_quantity"), F.col("l_tax") * 100, F.col("l_discount") * 10, F.col("l_linenumber").cast("double"))
    found = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(*[c.alias(n) for n, c in box.items()])
    return found.select("l_orderkey", "x0", "x1", F.round("y0", 6).alias("y0"), F.round("y1", 6).alias("y1"))


@query("SELECT user_id, string_agg(event_type, ' ' ORDER BY floor(value / 2), ts, event_id) AS text FROM events GROUP BY user_id")
def merge_ordered(spark, sf):
    events = table(spark, sf, "events").withColumn("row", F.floor(F.col("value") / 2))
    return rel.ordered_concat(events, ["user_id"], ["row", "ts", "event_id"], "event_type", " ")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) ")
def anti_replace(spark, sf):
    gone = table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"))
    w = Window.partitionBy("user_id").orderBy(*_ORDER)
    return table(spark, sf, "events").join(gone, "user_id", "left_anti").select("event_id", F.row_number().over(w).cast("bigint").alias("place"))


@query("SELECT event_id, concat('tb_', row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) AS id FROM events")
def seq_id(spark, sf):
    w = Window.partitionBy("user_id").orderBy(*_ORDER)
    return table(spark, sf, "events").select("event_id", F.concat(F.lit("tb_"), (F.row_number().over(w) - 1).cast("string")).alias("id"))


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, least(e, a + e, c + e, a + c + e) AS x0, least(f, b + f, d + f, b + d + f) AS y0, greatest(e, a + e, c + e, a + c + e) AS x1, greatest(f, b + f, d + f, b + d + f) AS y1
    FROM (SELECT *, l_quantity AS a, l_discount AS b, l_tax AS c, l_quantity AS d, l_extendedprice AS e, l_discount AS f FROM lineitem)
""")
def affine_bbox(spark, sf):
    box = spatial.unit_square_box([F.col(c) for c in _MATRIX])
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[c.alias(n) for n, c in zip(("x0", "y0", "x1", "y1"), box, strict=True)])


# edits and revisions


@query("""
    WITH e AS (SELECT user_id AS c_custkey, concat(event_type, event_id) AS new FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type IN ('click', 'error')) WHERE r = 1)
    SELECT c_custkey, coalesce(new, c_name) AS c_name, new IS NOT NULL AS modified FROM customer LEFT JOIN e USING (c_custkey)
""")
def overlay_update(spark, sf):
    edits = table(spark, sf, "events").where("event_type in ('click', 'error')")
    edits = edits.select(F.col("user_id").alias("c_custkey"), F.concat("event_type", F.col("event_id").cast("string")).alias("c_name"), "ts", "event_id")
    return rel.overlay(table(spark, sf, "customer").select("c_custkey", "c_name"), edits, ["c_custkey"], "c_name", ["ts", "event_id"])


@query("""
    SELECT conv_id, turn, role AS op FROM conversations UNION ALL
    SELECT conv_id, n + i AS turn, ['BT', 'Tf', 'Tm', 'Tj', 'ET'][i] AS op FROM (SELECT conv_id, max(turn) AS n, unnest(range(1, 6)) AS i FROM conversations GROUP BY conv_id)
""")
def append_rows(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", F.col("role").alias("op"))
    new = turns.groupBy("conv_id").agg(F.max("turn").alias("n")).select("conv_id", "n", F.posexplode(F.array(*map(F.lit, ("BT", "Tf", "Tm", "Tj", "ET")))).alias("i", "op"))
    return turns.unionByName(new.select("conv_id", (F.col("n") + F.col("i") + 1).alias("turn"), "op"))


@query("SELECT user_id, greatest(CAST(10000 AS BIGINT), max(event_id) + 1) AS size FROM events GROUP BY user_id")
def max_plus_one(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.greatest(F.lit(10000).cast("bigint"), F.max("event_id") + 1).alias("size"))


@query("SELECT conv_id, turn, CAST(coalesce(sum(octet_length(encode(text))) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at FROM conversations")
def offset_prefix_sum(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", F.octet_length("text").alias("n"))
    return rel.prefix_sum(turns, ["conv_id"], ["turn"], F.col("n"), "at").select("conv_id", "turn", F.col("at").cast("bigint").alias("at"))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events QUALIFY rank <= 30")
def last_n_per_key(spark, sf):
    return rel.last_n(table(spark, sf, "events").select("user_id", "event_id", "ts"), _KEYS, _ORDER, 30).select("user_id", "event_id", "rank")


@query("""
    SELECT c_custkey, 'name' AS field, coalesce(c_name, '') AS value FROM customer UNION ALL SELECT c_custkey, 'segment', coalesce(c_mktsegment, '') FROM customer
    UNION ALL SELECT c_custkey, 'nation', coalesce(CAST(c_nationkey AS VARCHAR), '') FROM customer
""")
def unpivot_fields(spark, sf):
    fields = {"name": F.col("c_name"), "segment": F.col("c_mktsegment"), "nation": F.col("c_nationkey").cast("string")}
    pairs = F.array(*[F.struct(F.lit(k).alias("field"), F.coalesce(v, F.lit("")).alias("value")) for k, v in fields.items()])
    return table(spark, sf, "customer").select("c_custkey", F.explode(pairs).alias("p")).select("c_custkey", "p.field", "p.value")


@query("SELECT event_id, strftime(ts, 'D:%Y%m%d%H%M%S') AS date FROM events")
def format_date(spark, sf):
    return table(spark, sf, "events").select("event_id", tx.literal_date(F.col("ts")).alias("date"))


@query("SELECT event_id, strftime(ts, '%Y/%m/%d %H:%M:%S') AS date FROM events")
def parse_date(spark, sf):
    return table(spark, sf, "events").select("event_id", tx.readable_date(tx.literal_date(F.col("ts"))).alias("date"))


@query("SELECT c_custkey, string_agg(concat('/', k, ' (', v, ')'), ' ' ORDER BY k) AS dict FROM (SELECT c_custkey, 'Author' AS k, c_name AS v FROM customer UNION ALL SELECT c_custkey, 'Subject', CASE WHEN c_acctbal > 0 THEN c_mktsegment ELSE '' END FROM customer) WHERE v <> '' GROUP BY c_custkey")
def kv_serialize(spark, sf):
    pairs = F.array(F.struct(F.lit("Author").alias("k"), F.col("c_name").alias("v")), F.struct(F.lit("Subject").alias("k"), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).otherwise("").alias("v")))
    entry = F.transform(F.filter(pairs, lambda p: p["v"] != ""), lambda p: F.concat(F.lit("/"), p["k"], F.lit(" ("), tx.escaped(p["v"]), F.lit(")")))
    return table(spark, sf, "customer").select("c_custkey", F.array_join(entry, " ").alias("dict"))


@query(None)
def utf16_hex(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.utf16_literal(F.col("text")).alias("literal"))


@query("SELECT doc_id, md5(text) AS md5 FROM documents")
def md5_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5("text").alias("md5"))


# spatial


@query("""
    WITH p AS (SELECT event_id, value AS x, CAST(user_id % 100 AS DOUBLE) AS y FROM events),
    b AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS x0, p_size + 8.0::DOUBLE AS x1, CAST(p_partkey % 100 AS DOUBLE) AS y0, p_partkey % 100 + 6.0::DOUBLE AS y1 FROM part)
    SELECT p.event_id, min(b.id) AS hit FROM p LEFT JOIN b ON x >= x0 AND x <= x1 AND y >= y0 AND y <= y1 GROUP BY p.event_id
""")
def first_hit(spark, sf):
    """Every part has its box; boxes of equal bounds are dealt to the grid once, with their least id."""
    points = table(spark, sf, "events").select("event_id", F.col("value").alias("x"), (F.col("user_id") % 100).cast("double").alias("y"))
    size, row = F.col("p_size").cast("double"), (F.col("p_partkey") % 100).cast("double")
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), size.alias("x0"), (size + 8.0).alias("x1"), row.alias("y0"), (row + 6.0).alias("y1"))
    boxes = parts.groupBy("x0", "x1", "y0", "y1").agg(F.min("id").alias("id"))
    return spatial.first_hit(points, boxes, "event_id", ["id"], 10.0).select("event_id", "hit")


@query("""
    SELECT label, arg_min(vec_id, (round(list_distance(embedding, list_resize(CAST([] AS FLOAT[]), len(embedding), 0.1)), 5), vec_id)) AS vec_id FROM embeddings GROUP BY label
""")
def nearest(spark, sf):
    distance = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda acc, e: acc + (e.cast("double") - 0.1) * (e.cast("double") - 0.1)))
    return table(spark, sf, "embeddings").groupBy("label").agg(F.min_by("vec_id", F.struct(F.round(distance, 5), F.col("vec_id"))).alias("vec_id"))


@query("""
    SELECT event_id, CASE WHEN abs(x - 60) <= 6 AND y >= -6 AND y <= 106 THEN 'right' WHEN abs(y - 100) <= 6 AND x >= -6 AND x <= 66 THEN 'bottom'
        WHEN abs(x) <= 6 AND y >= -6 AND y <= 106 THEN 'left' WHEN abs(y) <= 6 AND x >= -6 AND x <= 66 THEN 'top' END AS edge FROM (SELECT event_id, value AS x, user_id % 110 AS y FROM events)
""")
def near_edge(spark, sf):
    found = spatial.edge(F.col("value"), F.col("user_id") % 110, F.lit(60.0), F.lit(100.0))
    return table(spark, sf, "events").select("event_id", found.alias("edge"))


@query("SELECT event_id, greatest(10.0::DOUBLE, least(value, 50.0::DOUBLE)) AS size FROM events")
def clamp(spark, sf):
    return table(spark, sf, "events").select("event_id", spatial.clamped(F.col("value"), F.lit(10.0), F.lit(50.0)).alias("size"))


@query("SELECT user_id, event_type FROM events GROUP BY user_id, event_type HAVING count(*) % 2 = 1")
def toggle_parity(spark, sf):
    return rel.toggled(table(spark, sf, "events"), ["user_id"], "event_type").select("user_id", "event_type")


@query("SELECT user_id, coalesce(arg_min(event_type, (ts, event_id)) FILTER (WHERE value > 60), arg_min(event_type, (ts, event_id)), 'F1') AS font FROM events GROUP BY user_id")
def first_preferred(spark, sf):
    return rel.first_preferred(table(spark, sf, "events"), _KEYS, F.col("value") > 60, "event_type", _ORDER, F.lit("F1"), "font")


# editing blocks


@query("""
    WITH b AS (SELECT l_orderkey, l_linenumber, min(l_quantity) AS x, min(l_suppkey) % 5 * 10.0::DOUBLE AS y, min(l_returnflag) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber),
    o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY y DESC, x DESC, l_linenumber DESC) AS r, count(*) OVER (PARTITION BY l_orderkey) AS n FROM b)
    SELECT l_orderkey, string_agg(c, ' ' ORDER BY y, x, l_linenumber) AS text, min(x) AS x0, max(CASE WHEN r = 1 THEN x + 5 ELSE x + 8 END) AS x1, min(y) - 8.5 AS y0, max(y) + 1.5 AS y1 FROM o WHERE n > 1 GROUP BY l_orderkey
""")
def block_merge(spark, sf):
    """The lines of each order as blocks of one char; a space of 3 follows each but the last."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("x"), (F.min("l_suppkey") % 5 * 10.0).alias("y"), F.min("l_returnflag").alias("char"))
    keyed = lines.select(F.col("l_orderkey").alias("file_id"), F.lit(0).alias("page_idx"), F.col("l_linenumber").alias("block_idx"), "x", "y", "char")
    chars = keyed.select("*", F.lit(0).alias("seq"), F.lit(5.0).alias("width"), F.lit(10.0).alias("font_size"), F.lit("F1").alias("font_name"), F.array(F.lit(0.0)).alias("fill_color"), F.col("block_idx").alias("op_idx"))
    boxes = keyed.select("file_id", "page_idx", "block_idx", F.col("x").alias("x0"), (F.col("y") - 8.5).alias("y0"))
    selected = keyed.select("file_id", "page_idx", F.lit(0).alias("merge_id"), "block_idx", F.col("block_idx").alias("place"))
    return blocks.merged_blocks(boxes, chars, selected).select(F.col("file_id").alias("l_orderkey"), "text", "x0", "x1", "y0", "y1")


@query("""
    WITH c AS (SELECT n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS seq, length(n_name) AS width FROM nation),
    p AS (SELECT s_suppkey, s_nationkey % 5 AS n_regionkey, abs(s_acctbal) % 60 AS x, s_suppkey % 40 AS y FROM supplier),
    d AS (SELECT s_suppkey, x, seq, seq * 10 + width / 2.0::DOUBLE AS cx, sqrt((x - (seq * 10 + width / 2.0::DOUBLE)) * (x - (seq * 10 + width / 2.0::DOUBLE)) + (y - (seq * 3 + 5.0::DOUBLE)) * (y - (seq * 3 + 5.0::DOUBLE))) AS away FROM p JOIN c USING (n_regionkey)),
    f AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY away, seq) AS r FROM d)
    SELECT s_suppkey, CAST(coalesce(seq + CASE WHEN f.x > cx THEN 1 ELSE 0 END, 0) AS BIGINT) AS cursor FROM p LEFT JOIN (SELECT * FROM f WHERE r = 1) f USING (s_suppkey)
""")
def cursor_place(spark, sf):
    """Nations as the chars of their region's block, suppliers as clicks into it."""
    order = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    chars = table(spark, sf, "nation").select("n_regionkey", (F.row_number().over(order) - 1).cast("bigint").alias("seq"), F.length("n_name").cast("double").alias("width"))
    chars = chars.select("*", (F.col("seq") * 10.0).alias("x"), (F.col("seq") * 3.0).alias("y"), F.lit(10.0).alias("font_size"))
    clicks = table(spark, sf, "supplier").select("s_suppkey", (F.col("s_nationkey") % 5).alias("n_regionkey"), (F.abs("s_acctbal") % 60).alias("x"), (F.col("s_suppkey") % 40).cast("double").alias("y"))
    return blocks.cursors(clicks, chars, "s_suppkey", ["n_regionkey"]).select("s_suppkey", "cursor")
