import csv
import io

from hypothesis import given, settings
from hypothesis import strategies as st
import pyarrow as pa

from stylograph.operators import parse_rejects as P

GOOD = ["ECLI:CZ:US:2010:Pl.US.1.10.1", "text", "2012-02-29", "", "Nález", "3", "", "", "", "", "NA", "", "", "12"]


def line(**change):
    row = dict(zip([f.name for f in P.SUBSET_FIELDS], GOOD)) | change
    return ",".join(row.values())


CASES = [
    (line(), None),
    ('"' + GOOD[0] + '","a ""q""\n b",' + ",".join(GOOD[2:]), None),
    (line(text='"open'), "quoting"),
    (line(text='"a"b'), "quoting"),
    (line(text='a "b"'), "quoting"),
    (line(text='"a" '), "quoting"),
    (line() + ",", "columns"),
    ("", "columns"),
    (None, "columns"),
    (line(doc_id="NA"), "value"),
    (line(doc_id="ECLI:CZ:US:2010:12.US.1.10.1"), "value"),
    (line(doc_id=" " + GOOD[0]), "value"),
    (line(text=""), "value"),
    (line(text="a�b"), "value"),
    (line(text='"a\x0bb"'), "value"),
    (line(text='"a\tb\r\nc"'), None),
    (line(date_decision="2011-02-29"), "value"),
    (line(date_decision="2012-2-29"), "value"),
    (line(date_submission="NA"), None),
    (line(importance="3.0"), "value"),
    (line(length_proceeding="-1"), "value"),
    (line(text="x" * 200_000), None),
    (line(text="a\nb"), None),
]


def test_reasons(spark):
    df = spark.createDataFrame([(i, "f", t, "clash") for i, (t, _) in enumerate(CASES)], "raw_id long, file_name string, line string, reason string")
    parsed = P.parse_records(df).cache()
    got = {r.raw_id: r.reason for r in P.rejects(parsed).collect()}
    assert got == {i: r for i, (_, r) in enumerate(CASES) if r}
    valid = {r.raw_id: r for r in P.valid_rows(parsed).collect()}
    assert set(valid) == {i for i, (_, r) in enumerate(CASES) if r is None}
    assert valid[1].text == 'a "q"\n b' and valid[1].importance == 3 and str(valid[0].date_decision) == "2012-02-29"
    assert valid[0].separate_opinion is None and valid[15].text == "a\tb\r\nc" and valid[22].text == "a\nb"
    cells = {(r.raw_id, r.column, r.value) for r in P.failing_cells(parsed).collect()}
    assert (9, "doc_id", None) in cells and (20, "length_proceeding", "-1") in cells


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([(1, line()), (1, line()), (2, "x"), (2, "x")], "raw_id long, line string")
    assert P.parse_records(df.limit(0)).count() == 0
    assert P.rejects(P.parse_records(df)).count() == 2 and P.valid_rows(P.parse_records(df)).count() == 2


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.text(alphabet='a",\n\r ;', max_size=6), min_size=3, max_size=3), min_size=1, max_size=5))
def test_round_trip(rows):
    """What a CSV writer made comes back, whatever it holds."""
    fields = (P.Field("a"), P.Field("b"), P.Field("c"))
    lines = []
    for r in rows:
        out = io.StringIO()
        csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="").writerow(r)
        lines.append(out.getvalue())
    reason, columns = P._parse(pa.array(lines), fields)
    assert list(reason) == [""] * len(rows)
    assert [list(r) for r in zip(*[c.to_pylist() for c in columns])] == rows


def test_records_of_any_characters(spark):
    """Batches that use all private characters, and in the end all characters, are parsed in parts."""
    private = "".join(map(chr, range(0xE000, 0xF900)))
    rows = [line(text='"' + private + '\n"'), line(text='"x\n\ry"'), line(text="a\nb"), line() + ","]
    reasons, columns = P._parse(pa.array(rows), P.SUBSET_FIELDS)
    assert reasons.tolist() == ["", "", "", "columns"] and columns[1].to_pylist()[:3] == [private + "\n", "x\n\ry", "a\nb"]
    every = "".join(c for c in map(chr, range(0xA0, 0x110000)) if not "\ud800" <= c <= "\udfff")
    half = len(every) // 2
    rows = [line(text=every[:half]), line(text="a\nb"), line(text=every[half:]), line(text=every), "x,y"]
    reasons, columns = P._parse(pa.array(rows), P.SUBSET_FIELDS)
    assert reasons.tolist() == ["", "", "", "value", "columns"] and columns[1].to_pylist()[:3] == [every[:half], "a\nb", every[half:]]


def test_parts_and_numbers_out_of_range(spark, monkeypatch):
    rows = [(i, line(text="t" * (i % 7 * 300), importance=str(10**i))) for i in range(1, 15)]
    df = spark.createDataFrame([*rows, (99, None)], "raw_id long, line string")
    whole = sorted(map(tuple, P.parse_records(df).select("raw_id", "reason").collect()))
    assert [r for r in whole if r[1] is None] == [(i, None) for i in range(1, 15) if i % 7]
    monkeypatch.setattr(P, "PART", 1000)
    small = P.parse_records(df)
    assert sorted(map(tuple, small.select("raw_id", "reason").collect())) == whole
    assert sorted(map(tuple, P.out_of_range(small).collect())) == [(i, "importance", str(10**i)) for i in range(10, 14)]
    assert {r.raw_id: r.importance for r in P.valid_rows(small).collect()}[12] is None
