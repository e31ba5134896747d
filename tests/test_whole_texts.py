"""Queries over whole texts and tables against brute force: texts far longer than any prefix, empty ones, nulls; ids beyond any limit."""

import pytest

from foliant.plans.queries import QUERIES

LONG = "abz 09 é日.\n" * 300
ROWS = [(1, LONG), (2, "x" * 5000 + "(tail)"), (3, ""), (4, None), (5, "ABC"), (6, "abcdefghijklmnopqrstuvwxyz " * 40)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(ROWS, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return path


def _width(t):
    return sum(500 + 10 * (ord(c) - 97) if "a" <= c <= "z" else 600 for c in t) / 1000 * 12


def _codes(t):
    return "".join("0020" if c == " " else f"{ord(c) - 96:04x}" for c in t if c == " " or "a" <= c <= "z") or None


def _utf16(t):
    if t.isascii():
        return "(" + t.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)") + ")"
    return "<feff" + t.encode("utf-16-be").hex() + ">"


WANT = {"string_width": _width, "encode_lookup": _codes, "hex_encode": lambda t: t.encode().hex(), "hex_decode": lambda t: t, "utf16_hex": _utf16}


@pytest.mark.parametrize("name", WANT)
def test_whole(spark, folder, name):
    got = {r[0]: r[1] for r in QUERIES[name](spark, folder).collect()}
    assert got.keys() == {d for d, _ in ROWS}
    for d, t in ROWS:
        want = None if t is None else WANT[name](t)
        if name == "utf16_hex" and t is None:
            continue  # the literal of a null is not defined
        assert got[d] == (pytest.approx(want) if isinstance(want, float) else want), (name, d)


def test_first_hit(spark, tmp_path):
    parts = [(5, 10), (150, 30), (250, 20), (1250, 20), (777, 20), (20_050, 30)]
    events = [(i, float(x), u) for i, (x, u) in enumerate([(22, 51), (22, 78), (33, 52), (12, 7), (45, 99), (28, 150), (20, 50)])]
    spark.createDataFrame(parts, "p_partkey long, p_size long").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(events, "event_id long, value double, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    want = {e: min((k for k, s in parts if s <= x <= s + 8 and k % 100 <= u % 100 <= k % 100 + 6), default=None) for e, x, u in events}
    assert {250, 777, 150, None} <= set(want.values())
    assert {r.event_id: r.hit for r in QUERIES["first_hit"](spark, str(tmp_path)).collect()} == want
