"""CSV: records across byte ranges, types that lose nothing, ragged records."""

import csv
import io
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tablewright.sources import files, records


def plain_ends_inside(text, inside, delimiter=","):
    """Character by character."""
    at_start, after = not inside, False
    i = 0
    while i < len(text):
        c = text[i]
        if inside:
            if c == '"':
                if text[i + 1:i + 2] == '"':
                    i += 1
                else:
                    inside, after = False, True
        elif at_start and c == '"':
            inside = True
        at_start = not inside and c == delimiter
        i += 1
    return inside


@settings(max_examples=300, deadline=None)
@given(st.text('",ab', max_size=14), st.booleans())
def test_state_of_a_line(line, inside):
    assert records.ends_inside(line, inside, ",") == plain_ends_inside(line, inside)


ALPHABET = ["a", "b,", '"', '""', "\n", "\r\n", "x" * 30, " ", "é", "7", ",", '"quoted"\nline,', ""]


def rows_of_texts(seed, n):
    draw = random.Random(seed)
    text = lambda: "".join(draw.choices(ALPHABET, k=draw.randint(0, 9)))
    return [(str(i), text(), text() if draw.random() < 0.9 else "\n".join(["long, \"cell\""] * 150), text()) for i in range(n)]


def write(path, rows, header=("i", "a", "b", "c"), quoting=csv.QUOTE_ALL, end="\n"):
    out = io.StringIO()
    writer = csv.writer(out, quoting=quoting, lineterminator=end)
    writer.writerows([header, *rows])
    path.write_text(out.getvalue(), encoding="utf-8", newline="")


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("seed,end", [(1, "\n"), (2, "\r\n"), (3, "\n")])
def test_one_file_in_many_ranges(spark, tmp_path, small_ranges, seed, end):
    """Quotes, doubled quotes and breaks at the borders of ranges, records longer than a range: the rows that were written."""
    path = tmp_path / "x.csv"
    rows = rows_of_texts(seed, 150)
    write(path, rows, end=end)
    assert path.stat().st_size > 20 * 700 and not files.one_task_each(spark, str(path))
    df = files.scan_csv(spark, str(path), promote_dates=False)
    assert sorted(tuple(str(v) for v in r) for r in df.collect()) == sorted(rows)
    assert records.lines_of(spark, str(path)).rdd.getNumPartitions() > 20


def test_same_rows_as_the_reader_of_whole_files(spark, tmp_path, small_ranges):
    """Values that are not quoted, quotes inside them, null beside empty, empty lines, a mark at the begin, two files."""
    folder = tmp_path / "many.csv"
    folder.mkdir()
    draw = random.Random(5)
    for k in range(2):
        lines = ['﻿name,"a ""b""\nc",,name']
        for i in range(120):
            lines.append(draw.choice([f'{i},"x\ny, ""{i}""",,z', f'{i},it"s,"",', f'{i}, "b" ,"q" tail,\'', "", f'{i},"","a\n\n\nb",e"']))
        (folder / f"{k}.csv").write_text("\n".join(lines) + "\n")
    got = files.scan_csv(spark, str(folder))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64m")
    assert files.one_task_each(spark, str(folder))
    want = files.scan_csv(spark, str(folder))
    assert got.columns == want.columns and len(got.columns) == 4
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 150


def test_states_are_scanned_over_all_ranges(spark):
    """Every kind of function, one after the other, against their composition in order."""
    draw = random.Random(7)
    kinds = [(False, False), (True, True), (False, True), (True, False)]
    rows = [(f"f{k}", 10 * i, *draw.choice(kinds), draw.random() < 0.5) for k in range(5) for i in range(60)]
    got = {(r.file, r.start): (r.inside, r.owner) for r in records.scanned(
        spark.createDataFrame(rows, "file string, start bigint, f0 boolean, f1 boolean, starts1 boolean")).collect()}
    for k in range(5):
        state, owner = False, None
        for file, start, f0, f1, starts1 in rows[60 * k:60 * k + 60]:
            assert got[file, start] == (state, owner)
            owner = start if not state or starts1 else owner
            state = f1 if state else f0


def test_ragged_records(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("a,b\n1,2\n3,4,5\n6\n7,8\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        files.scan_csv(spark, str(path)).collect()
    for limit in ("64m", "4b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", limit)
        got = files.scan_csv(spark, str(path), ragged="keep")
        assert got.columns == ["a", "b", files.CORRUPT]
        assert sorted(tuple(r) for r in got.collect()) == [(1, 2, None), (3, 4, "3,4,5"), (6, None, "6"), (7, 8, None)]
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    with pytest.raises(ValueError):
        files.scan_csv(spark, str(path), ragged="drop")


COLUMNS = {
    "long_ids": (["12345678901234567890", "12345678901234567891"], "decimal(20,0)"),
    "longs": (["-5", "9223372036854775807", "0"], "bigint"),
    "wide": (["1" * 39, "2"], "string"),
    "prices": (["1.10", "25.00", "0.05"], "decimal(4,2)"),
    "measures": (["1.5", "0.25", "1.0E10"], "double"),
    "mixed": (["5", "2.50"], "string"),
    "small": (["1e-05", "2e-05"], "string"),
    "names": (["NaN", "Infinity"], "string"),
    "gaps": (["NaN", "1.5"], "double"),
    "codes": (["007", "12"], "string"),
    "signs": (["+1", "2"], "string"),
    "zeros": (["-0", "1"], "string"),
    "minus": (["-0.00", "1.25"], "string"),
    "flags": (["true", "false"], "boolean"),
    "loud": (["TRUE", "false"], "string"),
    "times": (["12:30", "7:05"], "string"),
    "offsets": (["2024-01-02T10:00:00+02:00", "2024-01-02T10:00:00+03:00"], "string"),
    "days": (["2024-01-02", "2024-02-29"], "timestamp"),
    "stamps": (["2024-01-02 10:00:00", "2024-02-29T11:12:13.5"], "timestamp"),
    "years": (["2024", "1999"], "bigint"),
    "blanks": ([" 1", "2"], "string"),
    "suffix": (["1d", "2f"], "string"),
}


@pytest.mark.parametrize("limit", ["64m", "150b"])
def test_types_keep_what_was_written(spark, tmp_path, limit):
    path = tmp_path / "x.csv"
    n = max(len(v) for v, _ in COLUMNS.values())
    write(path, [[v[i % len(v)] for v, _ in COLUMNS.values()] for i in range(n)], list(COLUMNS), csv.QUOTE_MINIMAL)
    spark.conf.set("spark.sql.files.maxPartitionBytes", limit)
    df = files.scan_csv(spark, str(path))
    assert {f.name: f.dataType.simpleString() for f in df.schema} == {c: t for c, (_, t) in COLUMNS.items()}
    back = df.selectExpr(*[f"cast({c} as string) {c}" for c in df.columns]).collect()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for c, (values, kind) in COLUMNS.items():
        if kind != "timestamp":
            assert {r[c] for r in back} == set(values)


def test_numbers_by_value_on_request(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("a,b,c,d\n5,1e-05,TRUE,1.12345678901234567\n2.50,3,false,22.5\n")
    df = files.scan_csv(spark, str(path), exact=False)
    assert [f.dataType.simpleString() for f in df.schema] == ["double", "double", "boolean", "decimal(19,17)"]
    assert sorted(r.a for r in df.collect()) == [2.5, 5.0]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(-10**25, 10**25).map(str), st.decimals(-1000, 1000, places=2).map(str), st.floats().map(str),
                          st.text("0123456789.-+eE", max_size=6)), min_size=1, max_size=4))
def test_lattice_by_python(values):
    """States merged in any order give one type, and the type holds every value."""
    import re
    from decimal import Decimal

    def state(v):
        integer = bool(re.match(files.INTEGER, v))
        decimal = bool(re.match(files.DECIMAL, v)) and not re.match("^-0[.]0*$", v)
        number = integer or decimal
        return {"present": 1, "integers": integer, "longs": integer and -2**63 <= int(v) < 2**63, "decimals": decimal,
                "digits": len(v.split(".")[0].lstrip("-")) if number else None,
                "least_scale": len(v.split(".")[1]) if decimal else None, "scale": len(v.split(".")[1]) if decimal else None,
                "doubles": 0, "finite": 0, "values": 0, "booleans": 0, "flags": 0}

    def merge(parts):
        out = {}
        for k in parts[0]:
            own = [p[k] for p in parts if p[k] is not None]
            out[k] = (min if k == "least_scale" else max if k in ("digits", "scale") else sum)(own) if own else None
        return out
    kind = files.type_of(merge([state(v) for v in values]))
    if kind.startswith("decimal"):
        precision, scale = map(int, kind[8:-1].split(","))
        for v in values:
            d = Decimal(v)
            assert format(d.quantize(Decimal(1).scaleb(-scale)), "f") == v and len(d.as_tuple().digits) <= precision <= 38
    elif kind == "bigint":
        assert all(str(int(v)) == v for v in values)
    else:
        assert kind == "string"


def test_large_files_are_parsed_once(spark, tmp_path, small_ranges):
    """Types and values come from stored records: no later pass cuts the file again."""
    rows = rows_of_texts(8, 60)
    write(tmp_path / "x.csv", rows, header=("i", "a", "A", "c"))
    df = files.scan_csv(spark, str(tmp_path / "x.csv"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "from_csv" not in plan
    assert df.columns == ["i", "a1", "A2", "c"]
    assert sorted(map(tuple, df.collect())) == sorted((int(r[0]), *r[1:]) for r in rows)


@pytest.mark.parametrize("exact", [True, False])
def test_states_of_odd_numbers(spark, exact):
    values = ["007", "1.50", "1.0E10", "1e-05", "FALSE", "+5", "text 5"]
    df = spark.createDataFrame([tuple(values)], [f"c{i}" for i in range(len(values))])
    assert list(files.infer_types(df, exact).values()) == [
        "string", "decimal(3,2)", "double", *(["string"] * 2 if exact else ["double", "boolean"]), "string", "string"]
