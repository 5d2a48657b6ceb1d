import io
import struct
import zipfile
import zlib

from pyspark.sql import functions as F

from loomfield.sources import audio, documents, images, mail, pdf, writers
from loomfield.sources.transcripts import wav_seconds

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(body: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", '<Types><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>')
        z.writestr("_rels/.rels", '<Relationships><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>')
        z.writestr("word/styles.xml", f'<w:styles {W}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>')
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def paragraph(text: str, style: str = "") -> str:
    return f"<w:p>{f'<w:pPr><w:pStyle w:val=\"{style}\"/></w:pPr>' if style else ''}<w:r><w:t>{text}</w:t></w:r></w:p>"


def test_docx_text_sections_and_errors(spark):
    cell = lambda t: f"<w:tc>{paragraph(t)}</w:tc>"
    body = paragraph("Before") + paragraph("First", "H1") + paragraph("Some text") + f"<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr><w:tr>{cell('1')}{cell('2')}</w:tr></w:tbl>" + paragraph("Second", "H1") + paragraph("End")
    rows = spark.createDataFrame([(1, docx(body)), (2, b"{\\rtf1 x"), (3, bytes.fromhex("D0CF11E0A1B11AE1")), (4, b"zzzz"), (5, None)], "k int, content binary")
    got = {r.k: r for r in documents.read_documents(rows, "k", "content").collect()}
    text = got[1].text
    assert "# First" in text and "Some text" in text and "| a | b |" in text and text.index("Before") < text.index("# First") < text.index("# Second")
    assert [got[k].error.split(": ")[1] for k in (2, 3, 4)] == ["unsupported", "encrypted", "not-a-document"] and 5 not in got
    parts = documents.read_sections(rows.where("k = 1"), "k", "content", "Doc").orderBy("pos").collect()
    assert [p.label for p in parts][-2:] == ["Doc — First", "Doc — Second"] and "End" in parts[-1].text


def make_pdf(contents: list[bytes], flate: bool = True, extra: bytes = b"") -> bytes:
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (4 + 2 * k) for k in range(len(contents))) + b"] /Count %d /Resources << /Font << /F1 3 0 R >> >> >>" % len(contents), b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"]
    for k, c in enumerate(contents):
        objects.append(b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (5 + 2 * k))
        data = zlib.compress(c) if flate else c
        objects.append(b"<< /Length %d%s >>\nstream\n" % (len(data), b" /Filter /FlateDecode" if flate else b"") + data + b"\nendstream")
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, o) for n, o in enumerate(objects, 1)) + b"trailer << /Root 1 0 R " + extra + b">>\n%%EOF"


def test_pdf_pages(spark):
    first = rb"BT /F1 12 Tf 72 700 Td (Hello \(big\)) Tj 75 0 Td (world) Tj -75 -14 Td [(ti) -20 (ght) -900 (gap)] TJ 0 -60 Td <4142> Tj ET"
    rows = spark.createDataFrame([(1, make_pdf([first, b"", b"BT /F1 10 Tf 1 0 0 1 10 20 Tm 12 TL (a) Tj T* (b) Tj (c\\351) ' ET"])), (2, make_pdf([b""], extra=b"/Encrypt 9 0 R")), (3, b"no"), (4, make_pdf([b"BT /F1 9 Tf (plain) Tj ET"], flate=False))], "k int, content binary")
    got = sorted((r.k, r.page, r.text, r.error) for r in pdf.read_pages(rows.where("k in (1, 4)"), "k", "content").collect())
    assert [g[:2] for g in got] == [(1, 1), (1, 2), (1, 3), (4, 1)]
    assert got[0][2].split("\n") == ["Hello (big) world", "tight gap", "", "AB"] and got[1][2] == "" and got[2][2] == "a\nb\ncé" and got[3][2] == "plain"
    assert [r.error.split(": ")[1] for r in pdf.read_pages(rows.where("k in (2, 3)"), "k", "content").orderBy("k").collect()] == ["encrypted", "not-a-document"]
    assert [r.page for r in pdf.read_pages(rows.where("k = 1"), "k", "content", pages=[3, 1, 3, 9], most=1).collect()] == [1]


def test_unicode_table():
    table = pdf.unicode_table(b"2 beginbfchar <01> <0041> <02> <D83DDE42> endbfchar 2 beginbfrange <10> <12> <0061> <20> <21> [<0078> <0079>] endbfrange")
    assert table == {1: "A", 2: "🙂", 0x10: "a", 0x11: "b", 0x12: "c", 0x20: "x", 0x21: "y"}


def wav(seconds: float) -> bytes:
    n = int(seconds * 8000)
    return b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", n) + bytes(n)


def fixed():
    class Fixed:  # local, so that executors get it by value
        def transcribe(self, data):
            return {"language": "en", "segments": [{"start": 0.0, "end": 2.0, "speaker": "Ann", "text": "Good morning, all of you."}, {"start": 65.0, "end": 70.0, "speaker": None, "text": "The rent is due on Friday"}]}

    return Fixed()


def test_transcripts(spark):
    assert wav_seconds(wav(1.5)) == 1.5
    rows = spark.createDataFrame([(1, wav(1.5)), (2, wav(9)), (3, b"other")], "k int, content binary")
    got = audio.transcribe(rows, "k", "content", fixed(), most_seconds=8).collect()
    assert [r.error for r in got if r.k == 2][0].startswith("AudioError: too_long") and [r.error for r in got if r.k == 3][0].startswith("AudioError: too_long")
    fine = audio.transcribe(rows.where("k = 1"), "k", "content", fixed(), most_seconds=8)
    text = audio.transcript_text(fine, "k").first().text
    assert text == "Duration: 00:00:01\nLanguage: en\nSpeakers: Ann\n\n[00:00:00] Ann: Good morning, all of you.\n[00:01:05] The rent is due on Friday"
    assert audio.said_at(text, "rent is DUE") == 65.0 and audio.said_at(text, "all of you. And more words") == 0.0 and audio.said_at(text, "absent") is None and audio.said_at(text, None) is None
    cached = rows.where("k = 1").select(audio.cache_key(F.col("content")).alias("cache_key"), F.lit("kept").alias("text"))
    hits, misses = audio.with_cache(rows, "content", cached)
    assert [r.k for r in hits.collect()] == [1] and sorted(r.k for r in misses.collect()) == [2, 3]


def test_images(spark):
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", 640, 480) + b"\x08\x02\x00\x00\x00" + bytes(4)
    gif = b"GIF89a" + struct.pack("<HH", 3, 5) + bytes(3)
    rows = spark.createDataFrame([(1, png), (2, gif), (3, b"BM" + bytes(60)), (4, b"")], "k int, content binary")
    got = {r.k: (r.width, r.height) for r in images.read_images(rows, "k", "content").collect()}
    assert got[1] == (640, 480) and got[2] == (3, 5)
    why = {r.k: r.w for r in rows.select("k", images.check(F.col("content")).alias("w")).collect()}
    assert why[1] is None and why[2] is None and why[3].startswith("unsupported") and why[4].startswith("unreadable")
    page = '<meta property="og:image" content="/a.jpg"><img src="logo.png"><img src="b.jpg" width=50><img srcset="c.jpg 100w, d.jpg 900w" alt="D"><img src="/a.jpg"><img src="e.svg">'
    pages = spark.createDataFrame([(1, "https://x.example/p/q", page)], "page_id int, url string, html string")
    assert [(r.pos, r.url, r.alt) for r in images.read_page_images(pages).orderBy("pos").collect()] == [(0, "https://x.example/a.jpg", None), (1, "https://x.example/p/d.jpg", "D")]


def one_split(spark, tmp_path, rows: int) -> str:
    """A file of one row group, which is one split of the reader."""
    path = str(tmp_path / "rows.parquet")
    spark.range(rows).selectExpr("id AS k", "sha2(cast(id AS string), 256) AS t").coalesce(1).write.parquet(path)
    return path


def test_mails_made_of_one_split_are_dealt_out(spark, tmp_path):
    rows = spark.read.parquet(one_split(spark, tmp_path, 3000))
    assert rows.rdd.getNumPartitions() == 1
    made = writers.made(rows, "k", lambda r: writers.message("a@x.example", "b@x.example", r["t"], "own words", [("a.txt", r["t"])]))
    assert made.rdd.getNumPartitions() >= 8
    found, _ = mail.text_attachments(mail.read_messages(made, "k", "content"), "k")
    assert found.select("k", F.regexp_replace("text", "\\s", "")).exceptAll(rows).count() == 0 and found.count() == 3000


def test_pages_of_one_split_are_dealt_out_and_others_left_alone(spark, tmp_path):
    rows = spark.read.parquet(one_split(spark, tmp_path, 3000))
    pages = rows.select(F.col("k").alias("page_id"), F.lit("https://x.example/").alias("url"), F.concat(F.lit('<img src="'), "t", F.lit('.png">')).alias("html"))
    found = images.read_page_images(pages)
    assert found.rdd.getNumPartitions() >= 8
    assert found.select("page_id", F.regexp_extract("url", "/(\\w+)[.]png$", 1)).exceptAll(rows).count() == 0 and found.count() == 3000
    again = spark.createDataFrame(pages.limit(3).collect()).coalesce(1)
    assert images.read_page_images(again).rdd.getNumPartitions() == 1
