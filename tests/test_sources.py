import pytest

from sheaf.plans.ingest import discover
from sheaf.sources import pdf
from sheaf.sources.corpus import generate
from sheaf.streaming.progress import ProgressError, follow, iter_ndjson, line


def sheet_pdf(sheet, compress=True):
    pages = []
    for _, number, width, height, rotation in sheet.pages:
        runs = [(t[3], t[4], t[5] + t[8], t[9 - 1], t[10]) for t in sheet.tokens if t[1] == number]
        pages.append((width, height, rotation, runs))
    return pdf.write_pdf(pages, compress)


def test_round_trip_of_a_page():
    sheet = generate()[12]
    for compress in (True, False):
        tokens, pages = pdf.read_pdf(sheet_pdf(sheet, compress))
        shown = [t for t in sheet.tokens if t[3].strip()]
        assert [t[2] for t in tokens] == [t[3] for t in shown]
        for got, want in zip(tokens, shown):
            assert got[3:7] == pytest.approx(want[4:8]) and got[9] == want[10]
        assert pages == [(0, 595.0, 842.0, 0, 0)]


def test_a_turned_page_is_read_upright():
    rotated = next(s for s in generate() if s.pages[0][4] == 90)
    tokens, pages = pdf.read_pdf(sheet_pdf(rotated))
    assert pages == [(0, 595.0, 842.0, 0, 90)]
    assert tokens[0][3:5] == pytest.approx(rotated.tokens[0][4:6])


def test_folder_of_files(spark, tmp_path):
    for s in generate()[:2]:
        (tmp_path / s.name).write_bytes(sheet_pdf(s))
    (tmp_path / "broken.pdf").write_bytes(b"%PDF-1.4 nothing here")
    (tmp_path / "notes.txt").write_text("no")
    tokens, pages, bad = pdf.read_pdfs(spark, f"file://{tmp_path}")
    assert pages.count() == 2 and bad.count() == 1 and tokens.select("doc_id").distinct().count() == 2
    only = tmp_path / "only"
    only.mkdir()
    (only / "x.pdf").write_bytes(b"junk")
    with pytest.raises(ValueError, match="not a PDF"):
        pdf.read_pdfs(spark, f"file://{only}")


def test_content_that_is_not_read_is_an_error():
    page = pdf.write_pdf([(595, 842, 0, [("Total 12", 10, 20, 9, False)])])
    plain = pdf.write_pdf([(595, 842, 0, [("Total 12", 10, 20, 9, False)])], False)
    with pytest.raises(ValueError, match="filter of page content"):
        pdf.read_pdf(page.replace(b"/FlateDecode", b"/ASCII85Decode"))
    drawing = lambda kind: plain.replace(b"/Resources <<", b"/Resources << /XObject << /X 9 0 R >>").replace(b"BT /F0 9", b"/X Do BT /F0 9").replace(
        b"/Length ", b"/Was "
    ) + b"9 0 obj\n<< /Subtype /" + kind + b" /Filter /DCTDecode >>\nstream\n1\nendstream\nendobj\n"
    with pytest.raises(ValueError, match="form objects"):
        pdf.read_pdf(drawing(b"Form"))
    assert [t[2] for t in pdf.read_pdf(drawing(b"Image"))[0]] == ["Total 12"]


def test_empty_pile(spark):
    from sheaf.operators.geometry import PAGES, TOKENS

    found = discover(spark.createDataFrame([], TOKENS), spark.createDataFrame([], PAGES))
    assert found.fields.count() == found.cells.count() == 0


def test_ndjson_in_any_chunks():
    raw = line("parsing", 1, 2, "é £ done") + b"\n" + line("done", 2, 2) + b'{"tail": 1}'
    whole = list(iter_ndjson([raw]))
    assert len(whole) == 3 and whole[0]["message"] == "é £ done"
    for size in range(1, 9):
        assert list(iter_ndjson(raw[i : i + size] for i in range(0, len(raw), size))) == whole
    with pytest.raises(ProgressError, match="bad"):
        list(follow([b'{"error": "bad"}\n']))
    assert list(iter_ndjson([])) == []
