"""Delimited lines: the worked reasons, DuckDB against the exact rules, quotes that are never closed, hot files."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ridgeline.operators.line_rejects import judge, load_lines, read_block, rejected_lines, split_fields, valid_lines
from ridgeline.plans.data_quality import SQL
from ridgeline.streaming.lines import once_each, stream_lines, write_split

CASES = {
    "1,2,3,4,5,6": None, "1,2,3,4,5,6,remark": None, '1,2,3,4,5,6,"north, of two"': None, '"1"," 2 " ,3,4,5,6': None, "+1.,-.5,3e2,4,5,6": None, " 1 ,\t2,3,4,5,6\r": None, "-90,180,-1500,90,-180,30000": None,
    '"1,2,3,4,5,6': "quoting", '1,2"2,3,4,5,6': "quoting", '"1"x,2,3,4,5,6': "quoting", '1,2,3,4,5,"6': "quoting", '"': "quoting", '1,2,3,4,5,6,"a"b': "quoting",
    "": "columns", "   ": "columns", "1,2,3,4,5": "columns", "1,2,3,4,5,6,7,8": "columns", None: "columns", '18.1,110.1,"1724,18.1",110.1,109': "columns",
    "1,2,x,4,5,6": "value", "1_0,2,3,4,5,6": "value", "inf,2,3,4,5,6": "value", "nan,2,3,4,5,6": "value", "1,,3,4,5,6": "value", "１,2,3,4,5,6": "value", "1,2,3,4,5,−6": "value", "1e,2,3,4,5,6": "value", '1,2,"a""b",4,5,6': "value", ",,,,,,": "value", "0x1,2,3,4,5,6": "value",
    "90.01,2,3,4,5,6": "range", "1,-181,3,4,5,6": "range", "1,2,30001,4,5,6": "range", "1,2,3,91,5,6": "range", "1,2,3,4,5,-1": "range", "1,2,3,4,5,1e999": "range",
    "1\n,2,3,4,5,6": "value", "1,2,3,4,5,6\x00": "value",
}


def _run(lines, tmp_path):
    import duckdb

    con = duckdb.connect(config={"threads": 1})
    return read_block(con, str(tmp_path), list(range(len(lines))), ["f"] * len(lines), list(lines)).to_pylist()


def test_worked_reasons(tmp_path):
    for order in (list(CASES), list(CASES)[::-1]):
        got = _run(order, tmp_path)
        assert {line: r["reason"] for line, r in zip(order, got, strict=True)} == CASES
        assert all((r["raw_line"] is None) == (r["reason"] is None) for r in got if r["line_id"] != order.index(None))


def test_unclosed_quotes_take_nothing_with_them(tmp_path):
    rng = random.Random(4)
    lines = [rng.choice(list(CASES)) for _ in range(3000)]
    assert [r["reason"] for r in _run(lines, tmp_path)] == [CASES[x] for x in lines]


def test_reasons_come_from_the_reject_tables(tmp_path, monkeypatch):
    """Without the exact check, lines that DuckDB rejects keep their reason; it would be lost if the reject tables were not read."""
    import ridgeline.operators.line_rejects as module

    monkeypatch.setattr(module, "judge", lambda line: ("unsettled", None, None))
    want = {
        "1,2,3,4,5": "columns", "1,2,3,4,5,6,7,8": "columns", "1,2,x,4,5,6": "value", "1,,3,4,5,6": "value", "1,2,3,4,5,six,remark": "value", '1,2"2,3,4,5,6': "quoting", '"1,2,3,4,5,6': "quoting",
        "90.01,2,3,4,5,6": "range", "1,2,30001,4,5,6,remark": "range", "1,2,3,4,5,6": None, "1,2,3,4,5,6,remark": None, '1,2,3,4,5,6,"a, b"': "unsettled", "inf,2,3,4,5,6": "unsettled",
    }
    got = {line: r for line, r in zip(want, _run(list(want), tmp_path), strict=True)}
    assert {k: r["reason"] for k, r in got.items()} == want
    assert all((r["settled_by"] == "exact") == (r["reason"] == "unsettled") for r in got.values())
    assert all(r["reader_error"] for r in got.values() if r["reason"] in ("columns", "value", "quoting"))
    monkeypatch.setattr(module, "_read", lambda con, paths, n: con.execute("CREATE OR REPLACE TEMP TABLE good AS SELECT 0::BIGINT n, * FROM rows LIMIT 0; CREATE OR REPLACE TEMP TABLE errors AS SELECT * FROM wrong LIMIT 0"))
    assert {r["reason"] for r in _run(list(want), tmp_path)} == {"unsettled"}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet='1.,"- \tx+e\r', max_size=24), min_size=1, max_size=6))
def test_any_lines(tmp_path_factory, lines):
    got = _run(lines, tmp_path_factory.mktemp("csv"))
    for line, r in zip(lines, got, strict=True):
        reason, numbers, remark = judge(line)
        assert r["reason"] == reason
        if numbers:
            assert [r[c] for c in ("lat", "lon", "elevation_ft", "ksaddle_lat", "ksaddle_lon", "prom_ft")] == numbers and (r["remark"] or None) == (remark or None)


def test_split_fields():
    assert split_fields('a,"b ""c"" ,d",, e ') == ["a", 'b "c" ,d', "", " e "]


def test_table_with_clashing_columns_and_empty(spark):
    df = spark.createDataFrame([(k, "f", line, "x") for k, line in enumerate(CASES)], "line_id long, src_file string, raw_line string, reason string")
    loaded = load_lines(df)
    assert loaded.count() == len(CASES) == valid_lines(loaded).count() + rejected_lines(loaded).count()
    assert load_lines(df.limit(0)).count() == 0


def test_sql_agrees(spark, tmp_path):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE kirmse_raw (line_id BIGINT, raw_line VARCHAR)")
    con.executemany("INSERT INTO kirmse_raw VALUES (?, ?)", [(k, x) for k, x in enumerate(CASES) if x is None or "\n" not in x and "\x00" not in x])
    got = dict(con.execute(SQL["p5_found"]).fetchall())
    assert got == {k: CASES[x] for k, x in enumerate(CASES) if CASES[x] and (x is None or "\n" not in x and "\x00" not in x)}


@pytest.mark.filterwarnings("ignore")
def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, "f", "1,2,3,4,5,6"), (2, "f", "x"), (2, "f", "x")], "line_id long, src_file string, raw_line string").selectExpr("*", "timestamp'2024-01-01 00:00:00' AS loaded_at")
    rows.write.parquet(str(tmp_path / "in"))
    q = write_split(once_each(stream_lines(spark, str(tmp_path / "in"))), str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "good")).count() == 1 and [r["reason"] for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == ["columns"]
