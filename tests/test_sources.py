import io
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lodestone.sources import files, html, layout, office, transcripts

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def package(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


def as_files(spark, *raw):
    return spark.createDataFrame([(f"f{i}", bytearray(r)) for i, r in enumerate(raw)], "path string, content binary")


def test_delimited(spark):
    raw = b"\xef\xbb\xbfname;city\nRen\xe9;\"a;b\"\nx;y;z\nonly\n;\nTotal;9\n"
    cells = [(r["row"], r["column"], r["value"]) for r in files.delimited_cells(as_files(spark, raw, b"")).orderBy("row", F.desc("column")).collect()]
    assert cells == [(0, "name", "René"), (0, "city", "a;b"), (1, "name", "x"), (1, "city", "y"), (2, "name", "only"), (2, "city", None)]
    report = files.delimited_report(as_files(spark, raw)).first()
    assert report["ragged"] == ["1:3", "2:1"] and report["had_bom"] and report["encoding"] == "cp1252" and report["trailers"] == [";", "Total;9"]
    assert (report["n_rows_raw"], report["n_rows_kept"], report["delimiter"]) == (5, 3, ";")
    assert files.split_fields('a,"b ""c"", d"\r\n\r\n"x\ny",\n', ",") == [["a", 'b "c", d'], ["x\ny", ""]]
    assert [files.sniff_delimiter(t) for t in ("a,b\n1,2", "a\tb\n1\t2", "a|b;c\n1|2", "plain", "")] == [",", "\t", "|", ",", ","]


def test_json_lines(spark):
    lines = spark.createDataFrame([(1, '{"a": 1}'), (2, " "), (3, '{"a": ')], "lineno int, line string")
    good, bad = files.json_lines(lines)
    assert good.count() == 1 and [(r["lineno"], r["snippet"]) for r in bad.collect()] == [(3, '{"a":')]


def test_logs(spark):
    raw = b'{"a": 1}\nTraceback (most recent call last):\n  File "x.py", line 1, in f\n    f()\nZeroDivisionError: division by zero\nplain\n\n'
    got = files.split_logs(as_files(spark, raw)).orderBy("lineno").collect()
    assert [r["kind"] for r in got] == ["json", "trace", "text"]
    assert (got[1]["exception_type"], got[1]["message"], got[1]["frames"], got[1]["lines"]) == ("ZeroDivisionError", "division by zero", 1, 4)


def test_logs_with_chained_tracebacks(spark):
    head, frame = "Traceback (most recent call last):", '  File "x.py", line 1, in f'
    raw = "\n".join([head, frame, "", "    f()", "a.b.KeyError: 'k'", "  left over", head, frame, "no error here", '  {"b": 2}', "{bad"]).encode()
    got = files.split_logs(as_files(spark, raw, b"", b"\xff\xfe")).filter("path = 'f0'").orderBy("lineno").collect()
    assert [(r["kind"], r["lineno"], r["lines"], r["exception_type"], r["message"]) for r in got] == [
        ("trace", 1, 4, "a.b.KeyError", "'k'"), ("text", 6, None, None, None), ("trace", 7, 2, None, None), ("text", 9, None, None, None), ("json", 10, None, None, None), ("text", 11, None, None, None),
    ]


def sheet():
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    r = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    cells = '<row r="1"><c r="A1" t="inlineStr"><is><t>Title</t></is></c></row><row r="3"><c r="A3" t="s"><v>0</v></c><c r="B3" t="inlineStr"><is><t>n</t></is></c></row>'
    cells += '<row r="4"><c r="A4" t="inlineStr"><is><t>x</t></is></c><c r="B4"><v>2</v></c></row><row r="5"><c r="B5" t="e"><f>B4/0</f><v>#DIV/0!</v></c></row>'
    return package(
        {
            "xl/workbook.xml": f'<workbook {s} {r}><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
            "xl/sharedStrings.xml": f"<sst {s}><si><t>name</t></si></sst>",
            "xl/worksheets/sheet1.xml": f'<worksheet {s}><sheetData>{cells}</sheetData><mergeCells><mergeCell ref="A4:A5"/></mergeCells></worksheet>',
        }
    )


def test_workbooks(spark):
    found, merged = files.workbook(sheet())["S"]
    grid = files.grid(found, merged)
    assert grid[2:] == [["name", "n"], ["x", 2], ["x", "#DIV/0!"]]
    assert [(t["title"], t["top"], t["bottom"]) for t in files.table_regions(grid)] == [("Title", 3, 5)]
    odd = files.suspicious_cells(files.sheet_cells(as_files(spark, sheet()))).collect()
    assert [(r["row"], r["kind"], r["quarantine"]) for r in odd] == [(5, "formula", True)]


def test_formats(spark):
    raws = [sheet(), b"PK\x03\x04junk", b"%PDF-1.7", b"{\\rtf1", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", b"abc"]
    got = [r["real_format"] for r in files.formats(as_files(spark, *raws)).orderBy("path").collect()]
    assert got == ["XLSX (OOXML)", "CORRUPT-ZIP", "PDF", "RTF", "OLE2 (legacy MS)", "UNKNOWN"]


def test_docx():
    body = '<w:p><w:r><w:t>Pay in </w:t></w:r><w:ins><w:r><w:t>15 </w:t></w:r></w:ins><w:del><w:r><w:delText>30 </w:delText></w:r></w:del><w:r><w:t>days</w:t></w:r></w:p>'
    body += '<w:p><w:commentRangeStart w:id="10"/><w:r><w:t>Terms.</w:t></w:r><w:commentRangeEnd w:id="10"/></w:p><w:p><w:r><w:txbxContent><w:p><w:r><w:t>Boxed</w:t></w:r></w:p></w:txbxContent></w:r></w:p>'
    for level, text in ((0, "One"), (0, "Two"), (1, "In"), (1, "Again")):
        body += f'<w:p><w:pPr><w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="1"/></w:numPr></w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'
    levels = '<w:lvl w:ilvl="0"><w:lvlText w:val="Section %1"/></w:lvl><w:lvl w:ilvl="1"><w:lvlText w:val="%1.%2"/></w:lvl>'
    raw = package(
        {
            "word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>",
            "word/comments.xml": f'<w:comments {W}><w:comment w:id="10" w:author="A"><w:p><w:r><w:t>check</w:t></w:r></w:p></w:comment></w:comments>',
            "word/footnotes.xml": f'<w:footnotes {W}><w:footnote w:id="-1"><w:p/></w:footnote><w:footnote w:id="2"><w:p><w:r><w:t>Note</w:t></w:r></w:p></w:footnote></w:footnotes>',
            "word/header1.xml": f"<w:hdr {W}><w:p><w:r><w:t>Head</w:t></w:r></w:p></w:hdr>",
            "word/numbering.xml": f'<w:numbering {W}><w:abstractNum w:abstractNumId="0">{levels}</w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num></w:numbering>',
        }
    )
    d = office.Docx(raw)
    accepted, rejected = d.streams()
    assert accepted.startswith("Pay in 15 days\nTerms.") and rejected.startswith("Pay in 30 days") and "Boxed" not in accepted
    assert d.comments() == [{"cid": "10", "author": "A", "text": "check", "anchor": "Terms."}]
    assert {(h["kind"], h["text"]) for h in d.hidden()} == {("textbox", "Boxed"), ("header", "Head"), ("footnote", "Note")}
    assert [n["label"] for n in d.numbered()] == ["Section 1", "Section 2", "2.1", "2.2"]


def mail(mid, parent=None, body="hi"):
    head = f"Message-ID: <{mid}>\r\nSubject: Re: x\r\nDate: Mon, 01 Jan 2024 10:00:00 +0000\r\n"
    head += f"In-Reply-To: <{parent}>\r\n" if parent else ""
    return (head + "Content-Type: text/plain; charset=utf-8\r\n\r\n" + body).encode()


def test_mail(spark):
    body = "Thanks.\n> old\n-- \nMe\nThis is confidential\n"
    df = spark.createDataFrame([("p", body), ("q", "> a\nOn Monday X wrote:\nb\n--\nc"), ("r", "-- \n-- \nd\nno liability\ne")], "path string, body string")
    parts = [(r["path"], r["part"], r["line"]) for r in office.reply_parts(df).filter("line <> ''").orderBy("path", "lineno").collect()]
    assert parts[:4] == [("p", "new", "Thanks."), ("p", "quoted", "> old"), ("p", "signature", "Me"), ("p", "disclaimer", "This is confidential")]
    assert parts[4:] == [("q", "quoted", x) for x in ("> a", "On Monday X wrote:", "b", "--", "c")] + [("r", "signature", "-- "), ("r", "signature", "d"), ("r", "disclaimer", "no liability"), ("r", "disclaimer", "e")]
    mails = office.messages(as_files(spark, mail("t3", "t2"), mail("t1"), mail("t2", "t1"), mail("o", "gone")))
    got = {r["mid"]: (r["root"], r["depth"]) for r in office.threads(mails).collect()}
    assert got == {"<t1>": ("<t1>", 0), "<t2>": ("<t1>", 1), "<t3>": ("<t1>", 2), "<o>": ("<o>", 0)}
    from email.message import EmailMessage

    m = EmailMessage()
    m.set_content("see zip")
    m.add_attachment(package({"in.eml": mail("x", body="inner")}), maintype="application", subtype="zip", filename="a.zip")
    kinds = [(k, p) for p, k, _ in office.mime_rows(m.as_bytes())]
    assert kinds == [("text", "root"), ("container", "root/a.zip"), ("nested-email", "root/a.zip/in.eml"), ("text", "root/a.zip/in.eml")]


def test_threads_of_any_length_and_cycles(spark):
    rows = [(f"m{i}", f"m{i - 1}" if i else None) for i in range(130)] + [("c1", "c3"), ("c2", "c1"), ("c3", "c2"), ("hangs", "c1"), ("self", "self"), ("twice", "m5"), ("twice", "m5")]
    got = [(r["mid"], r["root"], r["depth"]) for r in office.threads(spark.createDataFrame(rows, "mid string, parent string")).collect()]
    assert {x for x in got if x[0].startswith("m")} == {(f"m{i}", "m0", i) for i in range(130)}
    assert {x for x in got if x[0][0] in "chs"} == {(n, None, None) for n in ("c1", "c2", "c3", "hangs", "self")} and got.count(("twice", "m0", 6)) == 2


def test_mime_limits(spark):
    from email.message import EmailMessage

    inner = mail("x", body="innermost")
    for _ in range(9):
        m = EmailMessage()
        m.set_content("outer")
        m.add_attachment(inner, maintype="application", subtype="octet-stream", filename="a.eml")
        inner = m.as_bytes()
    rows = list(office.mime_rows(inner))
    assert rows[-1][1:] == ("container", "[depth limit]") and sum(k == "text" for _, k, _ in rows) == office.MAX_DEPTH + 1
    m = EmailMessage()
    m.set_content("hello")
    m.add_attachment(b"PK broken", maintype="application", subtype="zip", filename="b.zip")
    m.add_attachment(b"123", maintype="image", subtype="png", filename="i.png")
    m.add_attachment(b"12", maintype="application", subtype="pdf", filename="c.pdf")
    assert [(k, c) for _, k, c in office.mime_rows(m.as_bytes())] == [
        ("text", "hello"), ("container", "zip opened (9 bytes)"), ("container", "[bad zip]"), ("image", "[pixels, 3 bytes] route to OCR"), ("other", "application/pdf (2 bytes)"),
    ]


def test_html():
    page = "<html><body><div class='row'><div>Plan</div><div>Seats</div></div><div class='row'><div>A</div><div>5</div></div><script id='__NEXT_DATA__'>{\"a\": 1}</script></body></html>"
    assert html.div_grid(page) == (["Plan", "Seats"], [["A", "5"]])
    assert html.harvest_state(page) == {"a": 1}
    assert html.diagnose(page) == (True, 14, 8, "__NEXT_DATA__")
    long = "word " * 60
    assert html.extract_main(f"<nav>menu</nav><article>{long}</article><div>{long * 3}</div>") == long.strip()
    assert html.extract_main(None) == ""


def test_transcripts(spark):
    raw = "lost\n[00:00:01] SPEAKER_00: um the metphormin is their [inaudible]\nmore\n[00:01:00] SPEAKER_01: ok theek hai\n"
    turns = transcripts.parse_turns(spark.createDataFrame([(1, raw)], "k int, raw string"), "k", "raw")
    got = turns.orderBy("turn").collect()
    assert [(r["speaker"], r["start_sec"]) for r in got] == [("SPEAKER_00", 1), ("SPEAKER_01", 60)] and got[0]["text"].endswith("more")
    chunk = transcripts.build_chunks(turns).orderBy("start_sec").collect()
    assert chunk[0]["text"] == "the metformin is their <INAUDIBLE> more" and chunk[0]["corrections"][0]["to"] == "metformin"
    assert chunk[0]["inaudible_spans"] == 1 and chunk[0]["homophone_flags"][0]["token"] == "their" and chunk[1]["code_switch"]


def test_layout(spark):
    words = [("d", 0, f"L{i}", 72.0, 150.0, 100.0 + 20 * i, 612.0) for i in range(3)] + [("d", 0, f"R{i}", 331.0, 400.0, 100.0 + 20 * i, 612.0) for i in range(3)]
    df = spark.createDataFrame(words, "doc string, page int, text string, x0 double, x1 double, top double, page_w double")
    row = layout.reading_order(df).first()
    assert (row["columns"], row["text"]) == (2, "L0\nL1\nL2\nR0\nR1\nR2")
    tables = spark.createDataFrame([("d", 0, [["a"], ["1"]]), ("d", 1, [["a"], ["2"]]), ("d", 2, [["b"], ["3"]])], "doc string, seq int, rows array<array<string>>")
    got = layout.stitch_tables(tables).orderBy("seq").collect()
    assert [(r["table"], r["record"]) for r in got] == [(1, {"a": "1"}), (1, {"a": "2"}), (2, {"b": "3"})]


def test_images(spark):
    page = np.full((120, 200), 230, np.uint8)
    for y in range(20, 110, 12):
        page[y : y + 4, 20:180:2] = 20
    tilted = layout.rotate(page, 6, 230).astype(np.uint8)
    assert layout.skew(tilted, 10) in (-6.0, -5.0, -7.0)
    assert 20 <= layout.otsu(page) < 230
    df = spark.createDataFrame([("i", 120, 200, bytearray(page.tobytes()))], "id string, height int, width int, pixels binary")
    row = layout.prepare_images(df).first()
    assert row["skew"] == 0 and row["text_regions"] > 0


def test_page_classes(spark):
    df = spark.createDataFrame([(0, 0.9), (500, 0.3), (500, 0.0), (0, 0.1)], "n int, s double")
    assert [r[0] for r in df.select(files.page_class(F.col("n"), F.col("s"))).collect()] == ["IMAGE_ONLY", "MIXED_FIGURE", "NATIVE", "NATIVE"]
    assert isinstance(layout.gutters(pd.DataFrame({"x0": [0.0], "x1": [10.0]}), 600.0), list)
