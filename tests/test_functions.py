"""Cleaning, classification, dates, redaction, storage and readers on small fixtures."""

import base64
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from docketforge.functions import classify, dates, redact, text
from docketforge.sources import readers, storage


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(fn(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("data/data/data/filename.txt\nDocument content", "Document content"), ("Text with &nbsp; spaces and &amp; ampersands &lt;b&gt;", "Text with spaces and & ampersands <b>"),
        ("Swiss Roman 11pt (HP Roman 8) (Port) (FW)\nDocument text here", "Document text here"), ("1 2 3 4 5 6 7 LAW OFFICE\nkept", "kept"), ("C:\\Data\\0Lorman Seminar\nDocument", "Seminar Document"),
        ("", ""), ("   \n ", ""), ("A", "A"), ("üñìçødé", "üñìçødé"), (None, None),
    ],
)
def test_clean_text(spark, raw, want):
    assert one(spark, raw, text.clean_text) == want


def test_clean_text_is_idempotent_and_can_keep_lines(spark):
    raw = "a  b\n\n\n\nc <i>d</i>"
    once = one(spark, raw, text.clean_text)
    assert one(spark, once, text.clean_text) == once == "a b c d"
    assert one(spark, raw, lambda t: text.clean_text(t, keep_lines=True)) == "a b\n\nc d"


@pytest.mark.parametrize("line, want", [("1 2 3 4 5 6 7 LAW OFFICE", True), ("1 5 10 15 20 25 30", False), ("1 2 3 4", False), ("no", False)])
def test_number_sequences(spark, line, want):
    assert one(spark, line, text.is_sequence) is want


@pytest.mark.parametrize("raw, want", [("a<script>x</script>b", "ab"), ("  x\x00y ", "xy"), ("go javascript:run() on", "go  on"), ("<iframe src=a>b</iframe>", ""), ("<SCRIPT>k</SCRIPT>", "<SCRIPT>k</SCRIPT>")])
def test_sanitise(spark, raw, want):
    assert one(spark, raw, text.sanitise) == want


@pytest.mark.parametrize(
    "raw, kind, cat",
    [("This is a motion to dismiss the case filed by plaintiff against defendant.", "motion_to_dismiss", "Civil Law"), ("This agreement is for the sale of goods.", "notice", "Civil Law"), ("intellectual property of a court order", "order", "Property Law")],
)
def test_rules(spark, raw, kind, cat):
    assert one(spark, raw, lambda t: classify.document_type(t, text.word_count(t), F.lit(2))) == kind
    assert one(spark, raw, classify.legal_category) == cat


def test_error_codes(spark):
    assert one(spark, "insufficient_quota", classify.error_code) == "QUOTA_EXCEEDED"
    assert one(spark, None, classify.error_code) == "unknown"


@pytest.mark.parametrize(
    "raw, want", [("2024-01-05", "2024-01-05"), ("1/5/2024", "2024-01-05"), ("January 5, 2024", "2024-01-05"), ("Jan 5, 2024", "2024-01-05"), ("5 January 2024", "2024-01-05"), ("5-Jan-2024", "2024-01-05"), ("01-05-2024", "2024-01-05"), ("Jan 2024", "2024-01-01"), ("1/2024", "2024-01-01"), ("tomorrow", "2024-07-02"), ("1949-01-01", None), ("junk", None), (None, None), ("on March 3, 2023 at noon", "2023-03-03")],
)
def test_dates(spark, raw, want):
    got = one(spark, raw, lambda t: dates.parse_date(t, "event_date", F.lit("2024-07-01").cast("date")))
    assert (got and str(got)) == want


def test_contextual_dates_and_ranges(spark):
    day = F.lit("2024-07-01").cast("date")
    assert str(one(spark, "Filed: 01/15/2024\nx", lambda t: dates.extract_date(t, "filing_date", day))) == "2024-01-15"
    assert one(spark, "Filed January 5, 2024", lambda t: dates.extract_date(t, "filing_date", day)) is None
    r = one(spark, "trial January 1-3, 2024 and 1/1/2024 to 1/3/2024", lambda t: dates.date_ranges(t, day))
    assert len(r) == 2 and all(x["start"] <= x["end"] for x in r)


def test_redaction(spark):
    df = spark.createDataFrame([(1, "ssn 123456789 mail a.b@x.org"), (2, None), (3, "")], "id int, t string")
    got = [(r.id, r.item_no, r.pii_type, r.hit) for r in redact.hits(df, "id", "t", ["[", "mail"]).collect()]
    assert got == [(1, 1, "ssn", "123456789"), (1, 2, "email", "a.b@x.org"), (1, 3, "bank_account", "123456789"), (1, 4, "custom", "mail")]
    assert one(spark, "é1", redact.mask_of) == "■■■"


@pytest.mark.parametrize("path, want", [("documents/a.pdf", None), ("../x.pdf", "traversal"), ("/x.pdf", "leading_separator"), ("a?.pdf", "invalid_character"), ("x.exe", "extension"), (" ", "empty"), ("a" * 501, "too_long")])
def test_paths(spark, path, want):
    assert one(spark, path, storage.path_error) == want


def test_keys_and_recovery(spark):
    k = one(spark, "documents/cat/2024/05/x.pdf", storage.parsed_key)
    assert (k.is_valid, k.category, k.date, k.filename) == (True, "cat", "2024", "05/x.pdf")
    o = spark.createDataFrame([("documents/doc_9_Report.pdf",), ("documents/other.pdf",)], "path string")
    assert storage.recover(o, "doc_9_Report.pdf").first().path == "documents/doc_9_Report.pdf"
    assert storage.recover(o, "none.pdf").count() == 0


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"hello \xff world")
    with zipfile.ZipFile(tmp_path / "b.docx", "w") as z:
        w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:body></w:document>")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.4\n1 0 obj << /Type /Page >>\nstream\nBT (Hello \\(x\\)) Tj [(A) 3 (B)] TJ ET\nendstream")
    (tmp_path / "d.pdf").write_bytes(b"junk")
    got = {r.path.rsplit("/", 1)[-1]: r for r in readers.extract(spark, str(tmp_path)).collect()}
    assert got["a.txt"].text == "hello \ufffd world" and got["b.docx"].text == "One\nTwo" and got["c.pdf"].text == "Hello (x)\nAB"
    assert not got["d.pdf"].success and "not a PDF" in got["d.pdf"].error
    assert storage.listing(spark, str(tmp_path)).count() == 4


def test_compressed_pdf(spark, tmp_path):
    shown = b"BT (Motion to dismiss) Tj [(gran) -20 (ted \\(in part\\))] TJ ET"
    flate = lambda b: zlib.compress(b)
    pdf = lambda d, b: b"%PDF-1.5\n1 0 obj << /Type /Page >> endobj\n2 0 obj << " + d + b" >>\nstream\n" + b + b"\nendstream endobj\n%%EOF"
    files = {
        "flate.pdf": pdf(b"/Filter /FlateDecode", flate(shown)), "both.pdf": pdf(b"/Filter [/ASCII85Decode /FlateDecode]", base64.a85encode(flate(shown)) + b"~>"),
        "scan.pdf": pdf(b"/Subtype /Image /Filter /DCTDecode", b"\xff\xd8"), "other.pdf": pdf(b"/Filter /LZWDecode", b"x"), "broken.pdf": pdf(b"/Filter /FlateDecode", b"nothing"),
        "part.pdf": pdf(b"/Filter /FlateDecode", flate(shown + b" <0041> Tj")),
    }
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    got = {r.path.rsplit("/", 1)[-1]: r for r in readers.extract(spark, str(tmp_path)).collect()}
    for name in ("flate.pdf", "both.pdf"):
        assert got[name].success and got[name].text == "Motion to dismiss\ngranted (in part)" and got[name].page_count == 1 and got[name].word_count == 6
    for name in ("scan.pdf", "other.pdf", "broken.pdf"):
        assert not got[name].success and got[name].text is None and "read" in got[name].error
    assert not got["part.pdf"].success and got["part.pdf"].text == got["flate.pdf"].text and "glyph" in got["part.pdf"].error
