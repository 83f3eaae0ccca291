import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from sparloom.sources import batches, workbook
from sparloom.streaming import progress

_SHEET = '''<?xml version="1.0"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>
<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>CAS</t></is></c><c r="D1" t="s"><v>0</v></c></row>
<row r="3"><c r="A3"><v>12.50</v></c><c r="B3" t="s"><v>1</v></c><c r="C3" t="b"><v>1</v></c><c r="D3" t="e"><v>#N/A</v></c></row>
<row r="4"><c r="B4" t="s"><v>2</v></c><c r="AA4" t="str"><f>A1</f><v>far</v></c></row><row r="6"/><row r="9"><c r="A9"/></row>
</sheetData></worksheet>'''
_STRINGS = '''<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>Name</t></si><si><r><t>50-</t></r><r><t xml:space="preserve">00-0 </t></r><rPh sb="0" eb="1"><t>reading</t></rPh></si><si><t/></si></sst>'''
_BOOK = '''<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Notes" sheetId="1" r:id="a"/><sheet name="Latest" sheetId="2" r:id="b"/></sheets></workbook>'''
_RELS = '''<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="a" Target="worksheets/sheet1.xml"/><Relationship Id="b" Target="/xl/worksheets/other.xml"/></Relationships>'''


def _book():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        empty = "<worksheet xmlns=\"http://schemas.openxmlformats.org/spreadsheetml/2006/main\"><sheetData/></worksheet>"
        for name, text in (("xl/workbook.xml", _BOOK), ("xl/_rels/workbook.xml.rels", _RELS), ("xl/sharedStrings.xml", _STRINGS), ("xl/worksheets/sheet1.xml", empty), ("xl/worksheets/other.xml", _SHEET)):
            z.writestr(name, text)
    return out.getvalue()


def test_cells_of_all_kinds():
    rows = dict(workbook.sheet_rows(_book(), "Latest"))
    assert rows == {1: {0: "Name", 1: "CAS", 3: "Name"}, 3: {0: "12.50", 1: "50-00-0 ", 2: "TRUE", 3: "#N/A"}, 4: {26: "far"}}
    assert list(workbook.sheet_rows(_book())) == []
    with pytest.raises(ValueError, match="no sheet"):
        list(workbook.sheet_rows(_book(), "Old"))


def test_sheets_as_rows(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(_book())
    got = workbook.read_workbook(spark, str(tmp_path), "Latest", "row")
    assert got.columns == ["row", "Name", "CAS", "column 3", "Name.1"]
    assert [tuple(r) for r in got.orderBy("row").collect()] == [(2, None, None, None, None), (3, "12.50", "50-00-0 ", "TRUE", "#N/A"), (4, None, None, None, None)]
    assert workbook.read_workbook(spark, str(tmp_path), "Notes").count() == 0
    assert [r.CAS for r in workbook.read_workbook(spark, str(tmp_path), "Latest", columns=["CAS", "Name", "column 3", "Name.1", "more"]).orderBy("source_row").collect()] == [None, "50-00-0 ", None]
    with pytest.raises(Exception, match="other workbooks lack"):
        workbook.read_workbook(spark, str(tmp_path), "Latest", columns=["CAS"]).count()


def test_workbooks_round_trip(spark, tmp_path):
    rows = [(i, None if i % 3 else f"  a<b>&\n{i}", i * 1.5, "\x01ok") for i in range(2500)]
    df = spark.createDataFrame(rows, "k long, t string, x double, c string")
    path = f"file://{tmp_path}/books"
    workbook.write_workbooks(df.repartition(5), path, F.floor(F.col("k") / 1000), ["k"], "A & B")
    files = sorted((tmp_path / "books").glob("part-*"))
    assert len(files) == 3 and all(zipfile.ZipFile(f).testzip() is None for f in files)
    got = workbook.read_workbook(spark, path, "A & B").collect()
    assert sorted((int(r.k), r.t, float(r.x), r.c, r.source_row) for r in got) == [(k, t, x, "ok", k % 1000 + 2) for k, t, x, _ in rows]
    assert workbook.as_workbooks(df.limit(0), F.lit(0), ["k"]).count() == 0


def _side(folder):
    """A transport that fails by the id for the first attempts, and notes what it was asked in files, since tasks run
    elsewhere."""
    busy, absent, ok = batches.BUSY, batches.ABSENT, batches.OK

    def reply(ids):
        name = folder / "-".join(map(str, ids))
        tries = len(name.read_text()) if name.exists() else 0
        name.write_text("x" * (tries + 1))
        first = ids[0]
        if first % 7 == 0 and tries < 2:
            raise TimeoutError
        if first % 11 == 0:
            return busy, {}
        if first % 13 == 0:
            return absent, {}
        return ok, {i: f"b{i}" for i in ids if i % 2}

    return reply


def _state(first, singly):
    return "failed" if first % 11 == 0 or (first % 13 == 0 and not singly) else "done"


@pytest.mark.parametrize("size, singly", [(4, False), (9, True)])
def test_no_id_is_lost_or_asked_for_twice(spark, tmp_path, size, singly):
    wanted = [*range(1, 160, 3), None, 4, 4]
    quick = batches.Backoff(0, 0)
    ids = spark.createDataFrame([(i, "c") for i in wanted], "cid long, batch string")
    got = {r.cid: r for r in batches.fetch(ids, _side(tmp_path), size=size, backoff=quick, singly=singly, partitions=3).collect()}
    order = sorted({i for i in wanted if i})
    assert sorted(got) == order
    size = 1 if singly else size
    for at in range(0, len(order), size):
        some = order[at : at + size]
        want = _state(some[0], singly)
        tries = 3 if some[0] % 7 == 0 or some[0] % 11 == 0 else 1
        for i in some:
            r = got[i]
            assert (r.batch, r.state, r.attempts) == (at // size, want, tries)
            assert r.body == (None if want == "failed" else f"b{i}" if i % 2 and some[0] % 13 else "")
        assert (tmp_path / "-".join(map(str, some))).read_text() == "x" * tries
    assert batches.fetch(ids.limit(0), _side(tmp_path)).count() == 0


def test_waits_grow_while_the_other_side_is_busy():
    waits = []
    replies = iter([(batches.BUSY, {}), (batches.BUSY, {}), (500, {}), (batches.BUSY, {})])
    said = batches.ask([1], lambda ids: next(replies), 4, batches.Backoff(5, 2, waits.append))
    assert waits == [5, 10, 2] and said[:3] == ("failed", 4, 503)


def _land(path, numbers):
    path.mkdir(exist_ok=True)
    for n in numbers:
        rows = [{"cid": 10 * n + i, "state": "failed" if i == 3 else "done", "body": ("{broken" if i == 4 else "" if i == 5 else json.dumps({"Record": {"Section": []}})) if i != 3 else None} for i in range(6)]
        (path / f"{n}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))


def test_a_lost_run_goes_on_and_a_repeated_batch_changes_nothing(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    _land(tmp_path / "landed", range(4))
    lost = []

    def write(df, folder):
        if folder.endswith("snapshots/batch=1") and not lost:
            lost.append(folder)
            raise RuntimeError("lost between two writes")
        df.write.mode("overwrite").parquet(folder)

    how = dict(path=f"file://{tmp_path}/landed", out=out, checkpoint=f"file://{tmp_path}/progress", files_per_trigger=1)
    with pytest.raises(Exception, match="lost between"):
        progress.ingest(spark, write=write, **how)
    assert progress.finished(spark, out).count() == 4  # rows of the second batch are there, but don't count
    progress.ingest(spark, write=write, **how)
    _land(tmp_path / "landed", range(4, 6))
    progress.ingest(spark, write=write, **how)
    good = sorted(10 * n + i for n in range(6) for i in (0, 1, 2, 5))
    assert sorted(r.cid for r in progress.finished(spark, out).collect()) == good
    assert sorted(r.cid for r in progress.finished(spark, out, "failed").collect()) == sorted(10 * n + i for n in range(6) for i in (3, 4))
    steps = progress.snapshots(spark, out).orderBy("batch").collect()
    assert [(r.batch, r.n_rows, r.n_failed, r.all_rows, r.all_failed) for r in steps] == [(b, 4, 2, 4 * b + 4, 2 * b + 2) for b in range(6)]
    progress.batch_writer(out, ("hazards",))(spark.read.schema("cid long, state string, body string").json(str(tmp_path / "landed" / "0.json")), 0)
    assert progress.finished(spark, out).count() == len(good)
