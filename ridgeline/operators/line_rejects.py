"""Delimited lines into typed records, with the lines that cannot be read set apart under their reason.

Each task writes the lines it holds to scratch CSV files, one per source file, lets DuckDB read them with reject tables, joins the line-level errors
to the raw lines and gives one row per line. Nothing is shuffled, and a source file that holds a third of all lines is spread over as many tasks as
the scan has splits. The reason of a line is that of its reject entries (too many or missing columns, a field that cannot be cast, by its column; broken
quoting) or, for a line that was read, the limits that its typed numbers break. DuckDB is stricter in some places and more lenient in others than the rules
below: it refuses white space around a quoted field, tabs beside a number and remarks, and takes words like `inf` and digits parted by underscores. So its
verdict stands (`settled_by` is `reader`) where the rule that the entry stands for is confirmed on the raw line; the other lines, mostly good ones
with quotes or tabs, pass an exact check (`exact`). The scratch files lie in a temporary folder of the worker and are gone with the task.

Rules, first that holds: `quoting` - a double quote stands in a field that is not quoted, or a quoted field (which may have white space around it and
doubled quotes inside) is not closed, or more follows it before the comma; `columns` - not six or seven fields; `value` - one of the first six is not
a number of ASCII digits with optional sign, point and exponent; `range` - a latitude, longitude, height or prominence outside its limits. White space
is space, tab and carriage return. A NULL line counts as an empty one (`columns`); an empty table gives an empty result; equal lines are judged alike;
columns of the input other than the three named are ignored, so none can clash.
"""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

FIELDS = ("lat", "lon", "elevation_ft", "ksaddle_lat", "ksaddle_lon", "prom_ft")
LIMITS = ((-90, 90), (-180, 180), (-1500, 30000), (-90, 90), (-180, 180), (0, 30000))
SPACE = " \t\r"
#: Lines that DuckDB reads in one call.
BLOCK = 100_000

SCHEMA = T.StructType(
    [T.StructField("line_id", T.LongType()), T.StructField("src_file", T.StringType())]
    + [T.StructField(f, T.DoubleType()) for f in FIELDS]
    + [T.StructField(f, T.StringType()) for f in ("remark", "reason", "reader_error", "settled_by", "raw_line")]
)
_ARROW = pa.schema(
    [("line_id", pa.int64()), ("src_file", pa.string())] + [(f, pa.float64()) for f in FIELDS] + [(f, pa.string()) for f in ("remark", "reason", "reader_error", "settled_by", "raw_line")]
)

_NUMBER = r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
_NUMBER_RE = re.compile(_NUMBER)
_FIELD = re.compile(r'[ \t\r]*"((?:[^"]|"")*)"[ \t\r]*(?=,|\Z)|([^",]*)(?=,|\Z)')
#: A line whose quoting is right, and the columns of one without quotes.
_QUOTED = r'([ \t\r]*"([^"]|"")*"[ \t\r]*|[^",]*)(,([ \t\r]*"([^"]|"")*"[ \t\r]*|[^",]*))*'
#: The plainest good line; what DuckDB takes and this matches needs no further check of its form.
_PLAIN = rf"[ \t\r]*{_NUMBER}[ \t\r]*(,[ \t\r]*{_NUMBER}[ \t\r]*){{5}}(,[^\",]*)?"


def split_fields(line: str) -> list[str] | None:
    """The fields of a line without quotes; None if its quoting is broken."""
    at, out = 0, []
    while True:
        m = _FIELD.match(line, at)
        if m is None:
            return None
        out.append(m[2] if m[1] is None else m[1].replace('""', '"'))
        at = m.end()
        if at >= len(line):
            return out
        at += 1  # the comma


def judge(line: str | None) -> tuple[str | None, list[float] | None, str | None]:
    """The exact check: (reason, numbers, remark) of one line."""
    fields = split_fields(line or "")
    if fields is None:
        return "quoting", None, None
    if not 6 <= len(fields) <= 7:
        return "columns", None, None
    text = [f.strip(SPACE) for f in fields[:6]]
    if not all(_NUMBER_RE.fullmatch(f) for f in text):
        return "value", None, None
    numbers = [float(f) for f in text]
    if not all(lo <= v <= hi for v, (lo, hi) in zip(numbers, LIMITS, strict=True)):
        return "range", None, None
    return None, numbers, fields[6].strip(SPACE) if len(fields) == 7 else None


_READ = (
    "read_csv(?, columns={cols}, header=false, delim=',', quote='\"', escape='\"', auto_detect=false, store_rejects=true, rejects_table='bad', "
    "rejects_scan='bad_scan', null_padding=false, strict_mode=true, new_line='\\n', nullstr='\\x01none', max_line_size=33554432, parallel=false)"
)


def _columns(n: int) -> str:
    return "{'n': 'BIGINT', " + ", ".join(f"'c{i}': '{'DOUBLE' if i < 6 else 'VARCHAR'}'" for i in range(n)) + "}"


def _read(con, paths: list[str], n: int) -> None:
    """Let DuckDB read the files into `good`; `errors` gets the reject entries of each line by its number: whether there is one of each kind, and the first column that could
    not be cast (1 is lat)."""
    con.execute("DROP TABLE IF EXISTS bad; DROP TABLE IF EXISTS bad_scan")
    con.execute(f"CREATE OR REPLACE TEMP TABLE good AS SELECT * FROM {_READ.format(cols=_columns(n))}", [paths])
    con.execute(
        """CREATE OR REPLACE TEMP TABLE errors AS
           SELECT try_cast(regexp_extract(csv_line, '^([0-9]+),', 1) AS BIGINT) AS n, arg_min(CAST(error_type AS VARCHAR), column_idx) AS error,
                  bool_or(error_type = 'TOO MANY COLUMNS') AS many, bool_or(error_type = 'MISSING COLUMNS') AS few, bool_or(error_type NOT IN ('TOO MANY COLUMNS', 'MISSING COLUMNS', 'CAST')) AS quoting,
                  min(column_idx - 1) FILTER (error_type = 'CAST') AS uncast
           FROM bad GROUP BY 1 HAVING n IS NOT NULL"""
    )


def read_block(con, scratch: str, ids: list[int], files: list[str | None], lines: list[str | None]) -> pa.Table:
    """Judge a block of lines. The scratch files hold the line's number before its text; a line with quotes is followed by a guard line that DuckDB
    rejects, which keeps a quote that is never closed from taking in the lines after it."""
    open_files: dict[str | None, list[str]] = {}
    for n, (f, line) in enumerate(zip(files, lines, strict=True)):
        text = (line or "").rstrip(SPACE)
        if "\n" in text or "\r" in text or "\x00" in text or "\x01" in text:
            continue  # no one line of a file; the exact check alone sees it
        open_files.setdefault(f, []).append(f'{n},{text}\n"x"\n' if '"' in text else f"{n},{text}\n")
    paths = []
    for k, parts in enumerate(open_files.values()):
        paths.append(os.path.join(scratch, f"{k}.csv"))
        with open(paths[-1], "w", encoding="utf-8", errors="surrogatepass", newline="") as out:
            out.writelines(parts)
    raw = pa.table({"n": pa.array(range(len(ids)), pa.int64()), "line_id": pa.array(ids, pa.int64()), "src_file": pa.array(files, pa.string()), "raw_line": pa.array(lines, pa.string())})
    con.register("raw", raw)
    names = ", ".join(f"c{i}" for i in range(6))
    con.execute(f"CREATE OR REPLACE TEMP TABLE rows AS SELECT 0::BIGINT n, {', '.join(f'0.0::DOUBLE c{i}' for i in range(6))}, ''::VARCHAR c6 LIMIT 0")
    con.execute("CREATE OR REPLACE TEMP TABLE wrong (n BIGINT, error VARCHAR, many BOOLEAN, few BOOLEAN, quoting BOOLEAN, uncast BIGINT)")
    if paths:
        _read(con, paths, 6)
        con.execute(f"INSERT INTO rows SELECT n, {names}, NULL FROM good")
        con.execute("INSERT INTO wrong SELECT * FROM errors")
        more = con.execute("SELECT n, raw_line FROM wrong JOIN raw USING (n) WHERE many ORDER BY n").fetchall()
        if more:  # lines with a remark, read again with a seventh column
            again = os.path.join(scratch, "remarks.csv")
            with open(again, "w", encoding="utf-8", errors="surrogatepass", newline="") as out:
                out.writelines(f'{n},{t.rstrip(SPACE)}\n"x"\n' if '"' in t else f"{n},{t.rstrip(SPACE)}\n" for n, t in more)
            _read(con, [again], 7)
            con.execute(f"INSERT INTO rows SELECT n, {names}, c6 FROM good")
            con.execute("DELETE FROM wrong WHERE many")
            con.execute("INSERT INTO wrong SELECT * FROM errors")
            os.remove(again)
    for p in paths:
        os.remove(p)
    within = " AND ".join(f"c{i} BETWEEN {lo} AND {hi}" for i, (lo, hi) in enumerate(LIMITS))
    # The line-level errors joined to the raw lines. `reason` is what the reader's entries say where the raw line bears them out, '' for a line that is plainly good, else NULL.
    joined = con.sql(
        f"""WITH j AS (
                SELECT raw.n, line_id, src_file, raw_line, {names}, trim(c6, ' \t\r') c6, rows.n IS NOT NULL AS taken, error, coalesce(many, false) many, coalesce(few, false) few,
                       coalesce(quoting, false) quoting, uncast, contains(raw_line, '"') AS quotes, len(raw_line) - len(replace(raw_line, ',', '')) AS commas
                FROM raw LEFT JOIN (SELECT * FROM rows QUALIFY count(*) OVER (PARTITION BY n) = 1) rows USING (n) LEFT JOIN wrong USING (n))
            SELECT *, CASE WHEN quotes AND (quoting OR error IS NOT NULL) AND NOT regexp_full_match(raw_line, '{_QUOTED}') THEN 'quoting'
                           WHEN quotes THEN NULL
                           WHEN (few AND commas < 5) OR (many AND commas > 6) THEN 'columns'
                           WHEN commas BETWEEN 5 AND 6 AND uncast BETWEEN 1 AND 6 AND NOT regexp_full_match(string_split(raw_line, ',')[uncast], '[ \t\r]*{_NUMBER}[ \t\r]*') THEN 'value'
                           WHEN taken AND error IS NULL AND regexp_full_match(raw_line, '{_PLAIN}') THEN CASE WHEN {within} THEN '' ELSE 'range' END END AS reason
            FROM j ORDER BY n"""
    ).to_arrow_table()
    con.unregister("raw")
    numbers = [joined[f"c{i}"].to_pylist() for i in range(6)]
    remarks, reasons = joined["c6"].to_pylist(), joined["reason"].to_pylist()
    settled = ["exact" if r is None else "reader" for r in reasons]
    for k, r in enumerate(reasons):
        if r is None:
            reasons[k], found, remarks[k] = judge(lines[k])
        else:
            found = [c[k] for c in numbers] if r == "" else None
            reasons[k], remarks[k] = (None, remarks[k]) if r == "" else (r, None)
        for i in range(6):
            numbers[i][k] = found[i] if found else None
    bad = [None if r is None else line for r, line in zip(reasons, lines, strict=True)]
    return pa.table(
        [joined["line_id"], joined["src_file"], *(pa.array(c, pa.float64()) for c in numbers), pa.array(remarks, pa.string()), pa.array(reasons, pa.string()), joined["error"], pa.array(settled, pa.string()), pa.array(bad, pa.string())],
        schema=_ARROW,
    )


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
    with tempfile.TemporaryDirectory() as scratch:  # read and removed by this task only
        con.execute(f"SET temp_directory='{scratch}'")
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                yield from read_block(con, scratch, *(part.column(i).to_pylist() for i in range(3))).to_batches()
    con.close()


def load_lines(df: DataFrame, line_id: str = "line_id", src_file: str = "src_file", raw_line: str = "raw_line") -> DataFrame:
    """One row per line: typed numbers and remark where it is valid, else its reason, the reader's own error, what settled it and the raw line."""
    picked = df.select(df[line_id].cast("long").alias("line_id"), df[src_file].cast("string").alias("src_file"), df[raw_line].cast("string").alias("raw_line"))
    return picked.mapInArrow(_parse, SCHEMA)


def valid_lines(loaded: DataFrame) -> DataFrame:
    """The typed records."""
    return loaded.filter("reason IS NULL").drop("reason", "reader_error", "settled_by", "raw_line")


def rejected_lines(loaded: DataFrame) -> DataFrame:
    """The lines set apart, with their reason."""
    return loaded.filter("reason IS NOT NULL").select("line_id", "src_file", "raw_line", "reason", "reader_error", "settled_by")
