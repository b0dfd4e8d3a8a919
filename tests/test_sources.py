import csv
import io

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from feedweir.sources import datagen, delimited, uploads


def parsed(data: bytes):
    return [(r.fields() if not r.error else r.error, r.last_line, r.byte_end) for r in delimited.records(io.BytesIO(data), 0, 0)]


def test_records_and_positions():
    assert parsed(b'a,b\r\n\r\n"x\r\ny",2\n5" disk,"say ""hi"""\n') == [(["a", "b"], 1, 5), (["x\r\ny", "2"], 4, 16), (['5" disk', 'say "hi"'], 5, 37)]
    assert parsed(b'a,"b\nc') == [(delimited.UNCLOSED, 2, 6)]
    assert parsed(b"a\rb,c\nd\n")[0][0] == delimited.BARE_CR
    assert parsed(b'"a"b,c\n') == [(["ab", "c"], 1, 7)]
    assert parsed(b"") == [] and parsed(b"\n\n") == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.text(alphabet='ab,"\n ', max_size=5), min_size=1, max_size=4), max_size=8), st.booleans())
def test_written_rows_read_back(rows, crlf):
    rows = [r for r in rows if r != [""]]
    out = io.StringIO()
    csv.writer(out, lineterminator="\r\n" if crlf else "\n").writerows(rows)
    assert [r[0] for r in parsed(out.getvalue().encode())] == rows


def test_source_splits_and_resumes(spark, tmp_path):
    path = str(tmp_path / "a.csv")
    datagen.write_feed(path, rows_wanted=400, bad_rate=0.1, crlf=True, bom=True, shuffle=True)
    whole, broken, header = delimited.read_feed(spark, path, splitBytes=3000)
    rows = whole.orderBy("row_number").collect()
    assert [r["row_number"] for r in rows] == list(range(1, 401)) and broken.count() == 0 and set(header) == {*delimited.REQUIRED}
    assert whole.rdd.getNumPartitions() > 5
    at = rows[99]
    rest, _, _ = delimited.read_feed(spark, path, header, startByte=at["byte_end"], startRow=100, startLine=at["line_number"])
    assert rest.orderBy("row_number").collect() == rows[100:]


def test_headers():
    assert delimited.missing_columns(["sku", "name"]) == ["category", "price", "currency", "stock", "updated_at"]
    with pytest.raises(delimited.UnusableFile):
        delimited.check_header([*delimited.REQUIRED, "sku"])


def test_short_and_long_rows(spark, tmp_path):
    (tmp_path / "b.csv").write_text(",".join(delimited.REQUIRED) + "\nA,n\nB,n,c,1,USD,1,t,extra\n")
    rows, _, _ = delimited.read_feed(spark, str(tmp_path / "b.csv"))
    short, long = rows.orderBy("row_number").collect()
    assert (short["name"], short["category"], short["raw_line"]) == ("n", None, "A,n,,,,,")
    assert (long["updated_at"], long["raw_line"]) == ("t", "B,n,c,1,USD,1,t")


def test_uploads(tmp_path):
    one = uploads.store_upload(io.BytesIO(b"abc"), str(tmp_path), "m")
    assert uploads.store_upload(io.BytesIO(b"abc"), str(tmp_path), "m") == one
    with pytest.raises(uploads.EmptyUpload):
        uploads.store_upload(io.BytesIO(b""), str(tmp_path), "m")
    with pytest.raises(uploads.TooLarge):
        uploads.store_upload(io.BytesIO(b"abcd"), str(tmp_path), "m", max_bytes=3)
    assert [p.name for p in (tmp_path / "m").iterdir()] == [f"{one.sha256}.csv"]


def test_generator(spark, tmp_path):
    a, b = str(tmp_path / "1"), str(tmp_path / "2")
    assert datagen.write_feed(a, rows_wanted=300, bad_rate=0.2, seed=3) == datagen.write_feed(b, rows_wanted=300, bad_rate=0.2, seed=3)
    assert open(a, "rb").read() == open(b, "rb").read()
    assert datagen.parse_size("1.5KB") == 1536 and datagen.parse_size("2gb") == 2 << 30
    draw = datagen.mulberry32(1)
    assert [round(draw() * 2**32) for _ in range(2)] == [2693262067, 11749833]


def test_every_damage_gets_its_code(spark):
    from feedweir.functions import validation

    rows = validation.validate(datagen.spread_feed(spark, 4000, bad_rate=0.3)).select("damage", validation.error_code().alias("code")).distinct().collect()
    assert {(r["damage"], r["code"]) for r in rows} == {*datagen.DAMAGE.items(), (None, None)}


def sequential(path, byte, line):
    """(record end, line) of every record, read in one go."""
    with delimited.open_file(path) as stream:
        stream.seek(byte)
        return [(r.byte_end, r.last_line, r.error) for r in delimited.records(stream, byte, line)]


NASTY = [
    b'a,b\n1,"x\n\n\ny"\n' * 30, b'a,b\r\n' + b'1,"' + b"q\n" * 200 + b'"\r\n2,z\r\n', b'a,b\n' + b'x,5" y\n"",""\n' * 40, b'a,b\n\n\n' + b'"say ""hi""\n""\n",1\n' * 25 + b"\n\n",
    b'a,b\n' + b'1,2\n' * 50 + b'"never closed\n' + b"1,2\n" * 50, b"a,b\n" + b"x\ry,1\nz,2\n" * 30, b'a,b\n' + b'",\n",",\n' * 40, b"a,b", b"a,b\n\n\n", b'a,b\n"\n"\n"\n"', b"\xef\xbb\xbfa,b\n" + "é,ü\n".encode() * 40,
]


@pytest.mark.parametrize("data", NASTY)
@pytest.mark.parametrize("block", [1, 7, 64, 1000])
def test_planned_blocks_equal_a_sequential_scan(tmp_path, data, block):
    path = str(tmp_path / "x.csv")
    (tmp_path / "x.csv").write_bytes(data)
    _, byte, line = delimited.read_header(path)
    edges = [*range(byte, len(data), block), len(data)]
    known = {}
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        for at, *rest in delimited.scan_block(path, a, b) if i else [(a, *delimited.scan_from(path, a, b))]:
            known[i, at] = rest
    found, at, lines, rows = [], byte, line, 0
    for i, edge in enumerate(edges[1:]):
        if at < edge:
            end, n, m = known.get((i, at)) or delimited.scan_from(path, at, edge)
            if end > at:
                with delimited.open_file(path) as stream:
                    stream.seek(at)
                    found += [(r.byte_end, r.last_line, r.error) for r in delimited.records(stream, at, lines, end)]
                at, lines, rows = end, lines + m, rows + n
    want = sequential(path, byte, line)
    assert found == want and rows == sum(e is None for *_, e in want)


def test_planned_by_executors(spark, tmp_path):
    path = str(tmp_path / "y.csv")
    datagen.write_feed(path, rows_wanted=3000, bad_rate=0.1, crlf=True)
    one = delimited.read_records(spark, path).orderBy("byte_end").collect()
    many = delimited.read_records(spark, path, splitBytes=5000)
    assert many.rdd.getNumPartitions() > 20 and many.orderBy("byte_end").collect() == one and len(one) == 3000
    part = delimited.read_records(spark, path, splitBytes=5000, maxBytes=20_000).orderBy("byte_end").collect()
    assert part == one[: len(part)] and one[len(part) - 2]["byte_end"] < 20_000 + len(",".join(delimited.REQUIRED)) + 2 <= one[len(part) - 1]["byte_end"]
