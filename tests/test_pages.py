"""Geometry, tables and fields on small pages; each rule has its own few tokens."""

from sheaf.operators import extract
from sheaf.operators.geometry import Box, Token, columns_of, page_of, vertical_overlap, words_of
from sheaf.sources.corpus import generate, text_width


def token(text, x, y, size=10.0):
    return Token(text, Box(x, y - size, text_width(text, size), size), size)


def page(*tokens, width=595.0, height=842.0):
    return page_of(0, width, height, list(tokens))


def fields(p, recurring=None):
    return {f.label: f.value for f in extract.analyse([p], recurring)[0]}


def test_kerned_runs_are_one_word_and_spaces_divide():
    x, parts = 50.0, []
    for part in ("INV", "-", "2026"):
        parts.append(token(part, x, 100))
        x += text_width(part, 10)
    assert [w.text for w in words_of(parts)] == ["INV-2026"]
    assert len(words_of([token("a ", 10, 50), token("b", 16, 50)])) == 2
    assert vertical_overlap(Box(0, 0, 1, 10), Box(0, 20, 1, 10)) == 0


def test_label_left_above_and_two_columns():
    left = page(token("Invoice No.", 48, 130, 9), token("INV-1", 165, 130), token("Bill To", 48, 150, 9), token("Orenda Systems", 165, 150))
    assert fields(left) == {"Invoice No.": "INV-1", "Bill To": "Orenda Systems"}
    above = page(token("CLIENT", 48, 128, 7.5), token("DATE", 223, 128, 7.5), token("Arbor & Finch", 48, 143), token("04/05/2026", 223, 143))
    # a short text beside a value reads as a label too; over a pile its coverage is too low to become a field
    assert fields(above) == {"CLIENT": "Arbor & Finch", "DATE": "04/05/2026", "Arbor & Finch": "04/05/2026"}
    both = page(token("Issued", 48, 130, 9), token("2026-02-01", 140, 130), token("Customer", 330, 130, 9), token("Tessellate Labs", 420, 130))
    assert fields(both) == {"Issued": "2026-02-01", "Customer": "Tessellate Labs"}


def test_fused_run_prefers_the_clearer_value():
    assert fields(page(token("Receipt R0400217", 20, 48, 8))) == {"Receipt": "R0400217"}
    assert fields(page(token("Amount Payable INR 171120.70", 20, 48, 8))) == {"Amount Payable": "INR 171120.70"}
    assert fields(page(token("Halcyon Retail Pvt Ltd", 20, 48, 8))) == {}


def grid(rows, edges=(48, 330, 547)):
    return [token(s, x, 225 + 18 * i) for i, r in enumerate(rows) for s, x in zip(r, edges)]


def test_tables_are_not_fields_and_totals_are():
    three = page(*grid([("Description", "Qty", "Amount"), ("Tape", "4", "10.00"), ("Wrap", "5", "12.00")]))
    tables = extract.find_tables(three)
    assert [(t.header, len(t.rows), t.columns) for t in tables] == [(["Description", "Qty", "Amount"], 2, 3)]
    totals = page(*grid([("Subtotal", "10.00"), ("Tax", "1.00"), ("Total", "11.00")], (380, 500)))
    assert extract.find_tables(totals) == []
    known = {"Subtotal", "Tax", "Total"}
    assert extract.find_tables(totals, known) == []
    items = page(*grid([("Tape", "10.00"), ("Wrap", "1.00"), ("Film", "2.00"), ("Total", "13.00")], (20, 150)))
    assert [len(t.rows) for t in extract.find_tables(items, known)] == [3]
    assert fields(items, known) == {"Total": "13.00"}


def test_labels_and_titles():
    assert extract.looks_like_label("Amount payable including all applicable taxes due:")
    assert not extract.looks_like_label("INV-2026-01042") and not extract.looks_like_label("...")
    assert not extract.looks_like_label("Grainhouse Cafe", 15, 8)
    p = page(token("Rivermeet Bank", 48, 55, 15), token("Account Statement", 48, 74, 9))
    assert extract.self_description(p) == "Account Statement"
    assert extract.self_description(page(token("Orenda", 48, 55, 15), token("Dear Supplier,", 48, 74, 9))) is None
    assert extract.self_description(page()) is None


def test_columns_need_a_wide_shared_corridor():
    two = page(*[token("a longer run", x, 100 + 20 * i) for i in range(10) for x in (50, 350)])
    assert len(columns_of(two.words, 595)) == 2
    assert columns_of(page(*[token("word", 50, 100 + 20 * i) for i in range(14)]).words, 595) == []


def test_generated_corpus_is_the_same_every_time():
    a, b = generate(), generate()
    assert [s.tokens for s in a] == [s.tokens for s in b]
    assert (len(a), sum(s.kind == "invoice" for s in a)) == (40, 31)
    assert [len(s.pages) for s in a if s.kind == "statement"] == [2, 2]
