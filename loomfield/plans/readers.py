"""Registered queries of the readers: documents are made of table rows, read back, and held against the rows by SQL."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.functions import html
from loomfield.functions import text as texts
from loomfield.operators import coerce as co
from loomfield.operators import content, fluent, mapping, report, validate
from loomfield.plans import codes
from loomfield.plans import schema as s
from loomfield.sources import audio, calendars, delimited, documents, feeds, fetching, images, mail, pdf, writers
from loomfield.sources.rows import spread
from loomfield.streaming import windows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _utc(*parts: int) -> datetime:
    return datetime(*parts, tzinfo=timezone.utc)


def _calendar(*lines: Column | str) -> Column:
    body = F.concat_ws("\r\n", *[F.lit(x) if isinstance(x, str) else x for x in lines])
    return F.concat(F.lit("BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\n"), body, F.lit("\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n"))


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(name), value.cast("string"))


def _busy(rows: DataFrame, key: str, since: datetime, until: datetime, **options) -> DataFrame:
    found = calendars.calendar_ranges(rows, key, "ics", since, until, **options)
    return found.select(key, F.col("start").alias("starts"), F.col("end").alias("ends"), "all_day", "summary")


def calendar_daily(spark, sf_dir):
    """Daily since 1970, seen through a window of ten days in 2026."""
    stamp = F.concat(F.lit("DTSTART:19700101T"), F.lpad(F.pmod("n_nationkey", F.lit(24)).cast("string"), 2, "0"), F.lit("0000Z"))
    rows = table(spark, sf_dir, "nation").select("n_nationkey", _calendar(_line("UID:", F.col("n_nationkey")), _line("SUMMARY:", F.col("n_name")), stamp, "DURATION:PT30M", "RRULE:FREQ=DAILY").alias("ics"))
    return _busy(rows, "n_nationkey", _utc(2026, 1, 1), _utc(2026, 1, 11), merge=False)


def calendar_last_fridays(spark, sf_dir):
    """An order's day and the next three last Fridays of a month."""
    stamp = F.concat(F.lit("DTSTART:"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("T090000Z"))
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"))  # before the texts are made
    rows = orders.select("o_orderkey", _calendar(_line("UID:", F.col("o_orderkey")), stamp, "DURATION:PT2H", "RRULE:FREQ=MONTHLY;BYDAY=-1FR;COUNT=4").alias("ics"))
    return _busy(rows, "o_orderkey", _utc(1980, 1, 1), _utc(2100, 1, 1), merge=False).select("o_orderkey", "starts", "ends")


def calendar_exceptions(spark, sf_dir):
    """Five days: the second is excluded, the third moved by six hours, the fourth cancelled."""
    uid = _line("UID:", F.col("s_suppkey"))
    event = lambda *x: F.concat_ws("\r\n", *[F.lit(y) if isinstance(y, str) else y for y in x])
    master = event(uid, _line("SUMMARY:", F.col("s_name")), "DTSTART:20260105T090000Z", "DURATION:PT1H", "RRULE:FREQ=DAILY;COUNT=5", "EXDATE:20260106T090000Z")
    moved = event("END:VEVENT\r\nBEGIN:VEVENT", uid, "SUMMARY:moved", "RECURRENCE-ID:20260107T090000Z", "DTSTART:20260107T150000Z", "DURATION:PT1H")
    off = event("END:VEVENT\r\nBEGIN:VEVENT", uid, "STATUS:CANCELLED", "RECURRENCE-ID:20260108T090000Z", "DTSTART:20260108T090000Z", "DURATION:PT1H")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", _calendar(master, moved, off).alias("ics"))
    return _busy(rows, "s_suppkey", _utc(2026, 1, 1), _utc(2026, 2, 1), merge=False)


def calendar_clock_change(spark, sf_dir):
    """Weekly three-hour slots in a zone whose clocks change between them."""
    rows = table(spark, sf_dir, "nation").select("n_nationkey", _calendar(_line("UID:", F.col("n_nationkey")), "DTSTART;TZID=Europe/Oslo:20260323T100000", "DTEND;TZID=Europe/Oslo:20260323T130000", "RRULE:FREQ=WEEKLY;COUNT=2").alias("ics"))
    return _busy(rows, "n_nationkey", _utc(2026, 1, 1), _utc(2027, 1, 1), merge=False).select("n_nationkey", "starts", "ends")


def calendar_merged(spark, sf_dir):
    """Whole days that touch become one range with both summaries."""
    day = lambda name, on: F.concat_ws("\r\n", F.lit("UID:x"), _line("SUMMARY:", name), F.lit(f"DTSTART;VALUE=DATE:{on}"))
    ics = _calendar(day(F.col("r_name"), "20260301"), "END:VEVENT\r\nBEGIN:VEVENT", day(F.lit("next"), "20260302"))
    return _busy(table(spark, sf_dir, "region").select("r_regionkey", ics.alias("ics")), "r_regionkey", _utc(2026, 1, 1), _utc(2027, 1, 1))


def calendar_texts(spark, sf_dir):
    stamp = F.concat(F.lit("DTSTART;VALUE=DATE:"), F.date_format("o_orderdate", "yyyyMMdd"))
    ics = _calendar(_line("UID:", F.col("o_orderkey")), _line("SUMMARY:", F.col("o_orderpriority")), stamp, "RRULE:FREQ=MONTHLY;COUNT=3", _line("LOCATION:", F.col("o_orderstatus")), "TRANSP:TRANSPARENT")
    return calendars.read_calendar_texts(table(spark, sf_dir, "orders").select("o_orderkey", ics.alias("ics")), "o_orderkey", "ics").select("o_orderkey", "text")


def calendar_event_texts(spark, sf_dir):
    ics = _calendar(_line("SUMMARY:", F.col("s_name")), "DTSTART:20260315T090000Z", "DTEND:20260315T103000Z", _line("ORGANIZER;CN=Desk:mailto:desk", F.concat(F.col("s_suppkey").cast("string"), F.lit("@x.example"))), "CATEGORIES:a,b", "DESCRIPTION:One\\nTwo")
    return calendars.read_event_texts(table(spark, sf_dir, "supplier").select("s_suppkey", ics.alias("ics")), "s_suppkey", "ics", "Visit").select("s_suppkey", F.col("pos").cast("long").alias("pos"), "label", "text")


FORMATS = s.Schema(
    "Formats",
    "Values of every format",
    {k: s.string().constrain(format=f).optional() for k, f in (("email", "email"), ("url", "url"), ("day", "date"), ("moment", "datetime"), ("country", "iso-country"), ("state", "us-state"), ("state_name", "us-state-name"), ("currency", "currency"))},
)


def _format_values(spark, sf_dir) -> DataFrame:
    """Candidates for each format: codes of letters that keys choose, dates and addresses, some of them broken."""
    k = F.col("c_custkey")
    letter = lambda n: F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (F.pmod(F.floor(k / n), F.lit(26)) + 1).cast("int"), F.lit(1))
    pair, broken = F.concat(letter(1), letter(26)), F.pmod(k, F.lit(3)) == 0
    states = F.array(*map(F.lit, [*sorted(codes.US_STATES.values()), "california", "Calif."]))
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.concat(F.col("c_name"), F.when(broken, " at ").otherwise("@"), F.lit("x.example")).alias("email"),
        F.concat(F.when(broken, "ftp").otherwise("https"), F.lit("://x.example/"), k.cast("string")).alias("url"),
        F.concat(F.lit("2026-02-"), F.lpad((F.pmod(k, F.lit(31)) + 1).cast("string"), 2, "0")).alias("day"),
        F.concat(F.lit("2026-02-01"), F.when(broken, "_").when(F.pmod(k, F.lit(3)) == 1, " ").otherwise("T"), F.lit("14:30:00")).alias("moment"),
        pair.alias("country"),
        pair.alias("state"),
        F.element_at(states, (F.pmod(k, F.size(states)) + 1).cast("int")).alias("state_name"),
        F.concat(pair, letter(7)).alias("currency"),
    )


def format_checks(spark, sf_dir):
    """How many values each format refuses, and the first one."""
    rows = _format_values(spark, sf_dir)
    values = [c for c in rows.columns if c != "c_custkey"]
    found = validate.validate(rows.select("c_custkey", F.to_json(F.struct(*values)).alias("data_json")), FORMATS)
    return found.select("c_custkey", F.explode("issues").alias("i")).select("c_custkey", F.col("i.path").alias("path"))


def _parts_of_regions(spark, sf_dir) -> DataFrame:
    nations = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("nations"))
    return table(spark, sf_dir, "region").join(nations, "r_regionkey").select("r_regionkey", "r_name", "nations")


def _docx(row: dict) -> bytes:
    return writers.docx(row["r_name"], [(n["n_name"], f"Nation {n['n_nationkey']} & more") for n in row["nations"]])


def docx_texts(spark, sf_dir):
    return documents.read_documents(writers.made(_parts_of_regions(spark, sf_dir), "r_regionkey", _docx), "r_regionkey", "content").select("r_regionkey", "text")


def docx_sections(spark, sf_dir):
    found = documents.read_sections(writers.made(_parts_of_regions(spark, sf_dir), "r_regionkey", _docx), "r_regionkey", "content", "Region")
    return found.select("r_regionkey", "label", "text")


def odt_texts(spark, sf_dir):
    made = writers.made(_parts_of_regions(spark, sf_dir), "r_regionkey", lambda row: writers.odt([(n["n_name"], f"Nation {n['n_nationkey']}") for n in row["nations"]]))
    return documents.read_documents(made, "r_regionkey", "content").select("r_regionkey", "text")


def workbook_cells(spark, sf_dir):
    made = writers.made(_parts_of_regions(spark, sf_dir), "r_regionkey", lambda row: writers.xlsx(row["r_name"], [["Key", " Name  of "], *[[n["n_nationkey"], n["n_name"]] for n in row["nations"]]]))
    found = delimited.read_table_column(made, "r_regionkey", "content")
    return found.select("r_regionkey", "sheet", F.col("row_number").cast("long").alias("row_number"), F.col("total_rows").cast("long").alias("total_rows"), F.col("cells")["Key"].alias("key"), F.col("cells")["Name of"].alias("name"))


def workbook_sheets(spark, sf_dir):
    made = writers.made(_parts_of_regions(spark, sf_dir), "r_regionkey", lambda row: writers.xlsx(row["r_name"], [["x"]]))
    return delimited.sheet_names(made, "r_regionkey", "content").select("r_regionkey", F.col("pos").cast("long").alias("pos"), "sheet")


def pdf_page_texts(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    made = writers.made(rows, "s_suppkey", lambda r: writers.pdf([f"{r['s_name']} (first)", f"page 2 of {r['s_suppkey']}"], r["s_name"]))
    return pdf.read_pages(made, "s_suppkey", "content").select("s_suppkey", F.col("page").cast("long").alias("page"), "text")


def image_facts(spark, sf_dir):
    """JPEG headers with EXIF and PNG headers: sizes, what the camera says, and why an image can't be sent."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand", "p_name")

    def make(r: dict) -> bytes:
        side = int(r["p_size"] or 1)
        if r["p_partkey"] % 2:
            return writers.png(side, side + 1)
        plain = writers.jpeg(side, 2 * side)
        return writers.with_exif(plain, writers.exif_block(camera=r["p_brand"], caption=r["p_name"], orientation=6, taken="2026:01:02 03:04:05", place=(-12.5, 30.25)))

    made = writers.made(rows, "p_partkey", make)
    found = images.read_images(made, "p_partkey", "content")
    why = made.select("p_partkey", images.check(F.col("content")).alias("why"))
    fact = lambda name: F.col("facts")[name]
    return found.join(why, "p_partkey").select("p_partkey", F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"), fact("camera").alias("camera"), fact("caption").alias("caption"), fact("taken").alias("taken"), fact("orientation").isNotNull().alias("turned"), fact("latitude").cast("double").alias("latitude"), fact("longitude").cast("double").alias("longitude"), "why")


def image_texts(spark, sf_dir):
    """Photos of even parts told from their headers, and pictures of odd ones that have none."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    photo = lambda r: writers.png(3, 4) if r["p_partkey"] % 2 else writers.jpeg(8, 6, writers.exif_block(camera=r["p_brand"], taken="2026:01:02 03:04:05", place=(1.5, -2.25)))
    made = writers.made(rows, "p_partkey", photo).join(rows.select("p_partkey", "p_brand"), "p_partkey")
    return fetching.metadata_sources(made, "p_partkey", "content", "p_brand").select("p_partkey", "label", "text")


def fetched_images(spark, sf_dir):
    """Addresses of three pictures an item, two of which are fetched; a scripted fetcher answers by the address."""
    small = writers.png(2, 2)

    def answer(url: str, timeout: float, most: int) -> tuple[int, str | None, bytes]:
        k = int(url.rsplit("/", 1)[-1])
        if k % 5 == 4:
            raise TimeoutError
        return [(200, "image/png", small), (404, None, b""), (200, "text/html", b"x"), (200, None, b"unknown")][k % 5]

    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(F.array(*map(F.lit, range(3)))).alias("pos"), F.col("s_name").alias("name"))
    asked = rows.select("s_suppkey", "pos", F.concat(F.lit("https://x.example/"), (F.col("s_suppkey") * 3 + F.col("pos")).cast("string")).alias("url"), F.when(F.col("pos") == 0, F.col("name")).alias("alt"))
    found = fetching.fetch_images(asked, "s_suppkey", fetch=answer, most=2)
    return found.select("s_suppkey", F.col("pos").cast("long").alias("pos"), "label", "media_type", F.substring_index("reason", ":", 1).alias("reason"))


def page_image_list(spark, sf_dir):
    """Images of pages made from parts: relative and absolute addresses, an icon and a small one left out."""
    key = F.col("p_partkey").cast("string")
    page = F.concat(F.lit('<meta property="og:image" content="/cover'), key, F.lit('.jpg"><img src="/icons/logo.png"><img src="a.jpg" width="40"><img alt="'), F.col("p_brand"), F.lit('" src="https://cdn.example/'), key, F.lit('.png">'))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), F.concat(F.lit("https://x.example/p/"), key).alias("url"), page.alias("html"))
    return images.read_page_images(rows).select(F.col("page_id").alias("p_partkey"), F.col("pos").cast("long").alias("pos"), "url", "alt")


def _xml(spark, sf_dir) -> DataFrame:
    item = F.concat(F.lit("<p:part id='"), F.col("p_partkey").cast("string"), F.lit("'><name>"), F.col("p_name"), F.lit(" &amp; co</name><size>"), F.col("p_size").cast("string"), F.lit("</size></p:part>"))
    made = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", item.alias("x")))).alias("x"))
    return made.select("p_brand", F.concat(F.lit("<?xml version='1.0'?><stock xmlns:p='urn:p'><shelf>"), F.array_join(F.transform("x", lambda x: x["x"]), ""), F.lit("</shelf></stock>")).alias("xml"))


def xml_items(spark, sf_dir):
    return feeds.read_xml_items(_xml(spark, sf_dir), "p_brand", "xml", "stock/shelf/part", "Part").select("p_brand", F.col("pos").cast("long").alias("pos"), "label", "text")


def json_items(spark, sf_dir):
    one = F.struct(F.col("o_orderkey").alias("key"), F.struct(F.col("o_orderstatus").alias("status")).alias("is"))
    made = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(one)).alias("list"))
    rows = made.select("o_custkey", F.to_json(F.struct(F.struct("list").alias("data"))).alias("json"))
    return feeds.read_json_items(rows, "o_custkey", "json", "data.list", "Order").select("o_custkey", F.col("pos").cast("long").alias("pos"), "label", "text")


def _mails(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey").cast("string").alias("nation"))
    body = lambda r: f"Own words of {r['s_name']}\n\nOn Thu, 1 Jan 2026 at 10:00, Ann <ann@x.example> wrote:\n> quoted\n> more\n\nand after it\n-- \nAnn\n"
    made = writers.made(rows, "s_suppkey", lambda r: writers.message(f"{r['s_name']} <s{r['s_suppkey']}@x.example>", "desk@x.example", f"Offer {r['s_suppkey']}", body(r), [("terms.txt", f"nation {r['nation']}\n")]))
    return mail.read_messages(made, "s_suppkey", "content")


def mail_bodies(spark, sf_dir):
    return _mails(spark, sf_dir).select("s_suppkey", "subject", "body", F.col("sender.address").alias("sender"), mail.message_text().alias("text"))


def mail_attachments(spark, sf_dir):
    found, _ = mail.text_attachments(_mails(spark, sf_dir), "s_suppkey")
    return found.select("s_suppkey", "filename", "media_type", F.trim(F.regexp_replace("text", "\\s+", " ")).alias("text"))


def mail_forwards(spark, sf_dir):
    """Forwards keep what they forward, one level of quotes less, and lose the history inside."""
    lines = ("See below.", "---------- Forwarded message ---------", "From: Ann <ann@x.example>", "Subject: Old", "", "> forwarded words", "> On Mon, 5 Jan 2026, Bob wrote:", ">> history", "> last words")
    raw = F.concat(F.lit("From: x@x.example\nSubject: Fwd: "), F.col("n_name"), F.lit("\n\nHi "), F.col("n_name"), F.lit("\n" + "\n".join(lines) + "\n"))
    found = mail.read_messages(table(spark, sf_dir, "nation").select("n_nationkey", raw.alias("raw")), "n_nationkey", "raw")
    return found.select("n_nationkey", "body")


def event_sessions(spark, sf_dir):
    return windows.sessions(table(spark, sf_dir, "events"), "ts", "30 minutes", ["user_id"])


def request_keys_agree(spark, sf_dir):
    """Keys made by columns, held against the keys that the plain function makes of the same requests, by SQL."""
    schema = s.Schema("Turn", "A turn", {"mood": s.string()})
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("text", F.lit("")).alias("t"))
    return rows.select("conv_id", "turn", co.request_key("p", schema.json_schema(), F.col("t")).alias("request_key"))


def page_structured_data(spark, sf_dir):
    block = F.concat(F.lit('<title>T &amp; x</title><meta name="Author" content="'), F.col("r_name"), F.lit('"><script type="application/ld+json">{"@type":"Region","key":'), F.col("r_regionkey").cast("string"), F.lit("}</script><script type='application/ld+json'>{broken</script><p>Body"))
    return table(spark, sf_dir, "region").select("r_regionkey", html.page_to_text(block).alias("text"))


def byte_sizes(spark, sf_dir):
    """Sizes, clocks and addresses; its SQL rounds as printf does, which shows from 262,144 orders on."""
    rows = table(spark, sf_dir, "orders")
    n = (F.col("o_orderkey") * 997).cast("long")
    return rows.select("o_orderkey", texts.format_size(n, half_even=True).alias("size"), texts.format_clock((F.col("o_orderkey") % 90_000).cast("double")).alias("clock"), texts.format_address(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")), F.lit("a@x.example")).alias("address"))


def _notes(spark, sf_dir) -> DataFrame:
    """One spoken segment after another: who says which nation's name, ten seconds each."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("r_regionkey"), (F.col("n_nationkey") * 10).cast("double").alias("start"), (F.col("n_nationkey") * 10 + 9).cast("double").alias("end"), F.when(F.col("n_nationkey") % 2 == 0, "Even").otherwise(F.lit(None)).alias("speaker"), F.col("n_name").alias("text"))
    return rows.withColumn("seconds", F.lit(3725.0)).withColumn("language", F.lit("en"))


def transcript_texts(spark, sf_dir):
    return audio.transcript_text(_notes(spark, sf_dir), "r_regionkey")


def wav_lengths(spark, sf_dir):
    """Recordings too long to be sent, by their headers alone."""

    class Silent:
        def transcribe(self, data: bytes) -> dict:
            return {"language": "en", "segments": [{"start": 0.0, "end": 1.0, "speaker": None, "text": f"{len(data)} bytes"}]}

    made = writers.made(table(spark, sf_dir, "nation").select("n_nationkey"), "n_nationkey", lambda r: writers.wav(r["n_nationkey"] / 4))
    return audio.transcribe(made, "n_nationkey", "content", Silent(), most_seconds=3.0).select("n_nationkey", "text", F.col("error").isNotNull().alias("too_long"))


def cached_transcripts(spark, sf_dir):
    made = writers.made(table(spark, sf_dir, "nation").select("n_nationkey"), "n_nationkey", lambda r: writers.wav(r["n_nationkey"] % 5 / 10))
    kept = made.where("n_nationkey < 3").select(audio.cache_key(F.col("content")).alias("cache_key"), F.lit("kept").alias("text"))
    hits, misses = audio.with_cache(made, "content", kept)
    return hits.select("n_nationkey", F.lit(True).alias("cached")).unionByName(misses.select("n_nationkey", F.lit(False).alias("cached")))


EVALUATED = s.Schema("Row", "A row", {"name": s.string(), "nation": s.number().optional()})


def eval_run_totals(spark, sf_dir):
    """Fixtures of suppliers, a third of which expect another nation, run through the scripted provider."""
    rows = table(spark, sf_dir, "supplier")
    wrong = F.when(F.col("s_suppkey") % 3 == 0, 99).otherwise(F.col("s_nationkey"))
    fixtures = rows.select(F.col("s_suppkey").cast("string").alias("name"), F.concat(F.lit("name: "), "s_name", F.lit("\nnation: "), F.col("s_nationkey").cast("string")).alias("input"), F.to_json(F.struct(F.col("s_name").alias("name"), wrong.alias("nation"))).alias("expected"))
    items, _, stats = report.run_eval(fixtures, EVALUATED, co.ScriptedProvider(("name", "nation")))
    return report.totals(items, {"input": 3.0, "output": 15.0}).select(F.col("items").cast("long").alias("items"), F.col("exact").cast("long").alias("exact"), F.col("failed").cast("long").alias("failed")).crossJoin(F.broadcast(report.below(stats, least_precision=0.9).agg(F.max("path").alias("below"))))


def _photos(spark, sf_dir) -> DataFrame:
    """Turns of conversations: what a user says stays text, every third other turn stands for a photo."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("item_id"), F.col("turn").cast("int").alias("pos"), "role", "text")
    photo = (F.col("role") != "user") & (F.col("pos") % 3 == 1)
    return rows.select("item_id", "pos", F.when(photo, "image").otherwise("text").alias("kind"), F.when(F.col("pos") % 2 == 0, F.col("role")).alias("label"), F.when(~photo, F.lit("said </source> so")).alias("text"), F.when(photo, "image/png").alias("media_type"))


def content_blocks(spark, sf_dir):
    found = content.content_blocks(_photos(spark, sf_dir))
    return found.select(F.col("item_id").alias("conv_id"), F.col("block").cast("long").alias("block"), "type", "text", "label", "media_type", F.col("pos").cast("long").alias("pos"))


def source_kinds(spark, sf_dir):
    found = content.kinds_of(_photos(spark, sf_dir))
    return found.select(F.col("item_id").alias("conv_id"), F.array_join("kinds", ",").alias("kinds"))


def mapping_texts(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("r_regionkey"), F.col("n_nationkey").alias("row_number"), F.array(F.lit("Key"), F.lit("Name of it")).alias("headers"), F.array(F.col("n_nationkey").cast("string"), F.col("n_name")).alias("cells"))
    return mapping.mapping_texts(rows, "r_regionkey", sample_rows=3)


def _stamped_pdf(r: dict) -> bytes:
    dated = writers.pdf([f"{r['s_name']} first", "", "last"], r["s_name"])
    return dated.replace(b"<< /Title ", b"<< /CreationDate (D:20260102030405+01'00') /Author (Ann) /Title ")


def pdf_infos(spark, sf_dir):
    made = writers.made(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_suppkey", _stamped_pdf)
    return pdf.read_info(made, "s_suppkey", "content").select("s_suppkey", F.col("pages").cast("long").alias("pages"), F.col("pages_with_text").cast("long").alias("pages_with_text"), "title", "author", "created")


def pdf_texts(spark, sf_dir):
    made = writers.made(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_suppkey", _stamped_pdf)
    return pdf.read_texts(made, "s_suppkey", "content").select("s_suppkey", "text")


def pdf_sources(spark, sf_dir):
    made = writers.made(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_suppkey", _stamped_pdf)
    return pdf.read_sources(made, "s_suppkey", "content", "Offer", metadata=False).select("s_suppkey", "label", "text")


def chained_answers(spark, sf_dir):
    """Two coercions: all of a supplier, then only its nation; the scripted provider reads the first answer."""
    first, second = s.Schema("Full", "All", {"name": s.string(), "nation": s.number(), "balance": s.number().optional()}), s.Schema("Short", "Some", {"nation": s.number()})
    rows = table(spark, sf_dir, "supplier")
    text = F.concat_ws("\n", F.concat(F.lit("name: "), "s_name"), F.when(F.col("s_suppkey") % 4 != 3, F.concat(F.lit("nation: "), F.col("s_nationkey").cast("string"))))
    sources = rows.select(F.col("s_suppkey").alias("item_id"), F.lit(0).alias("pos"), F.lit("text").alias("kind"), F.lit(None).cast("string").alias("label"), text.alias("text"), F.lit(None).cast("string").alias("media_type"), F.lit(None).cast("int").alias("max_chars"))
    found = fluent.chain(sources, provider=co.ScriptedProvider(("name", "nation", "balance"))).coerce_to(first).coerce_to(second, provider=co.ScriptedProvider(("nation",))).answers
    return found.select(F.col("item_id").alias("s_suppkey"), "status", F.when(F.col("status") == "ok", F.get_json_object("data_json", "$.nation").cast("double").cast("long")).alias("nation"))


def stripped_answers(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit('{"name":null,"nation":'), F.col("s_nationkey").cast("string"), F.lit("}")).alias("data_json"))
    return co.strip_nulls(rows, s.Schema("Row", "A row", {"name": s.string().optional(), "nation": s.string()}))


QUERIES = {f.__name__: f for f in (calendar_daily, calendar_last_fridays, calendar_exceptions, calendar_clock_change, calendar_merged, calendar_texts, calendar_event_texts, format_checks, docx_texts, docx_sections, odt_texts, workbook_cells, workbook_sheets, pdf_page_texts, image_facts, page_image_list, xml_items, json_items, mail_bodies, mail_attachments, mail_forwards, event_sessions, request_keys_agree, page_structured_data, byte_sizes, transcript_texts, wav_lengths, cached_transcripts, eval_run_totals, content_blocks, source_kinds, mapping_texts, pdf_infos, pdf_texts, pdf_sources, chained_answers, stripped_answers, image_texts, fetched_images)}

_LF = "chr(10)"
_NATIONS = "SELECT r_regionkey, r_name, n_nationkey, n_name FROM region JOIN nation ON n_regionkey = r_regionkey"
_ORDINAL = "CAST({0} AS VARCHAR) || CASE WHEN {0} IN (11, 12, 13) THEN 'th' WHEN {0} % 10 = 1 THEN 'st' WHEN {0} % 10 = 2 THEN 'nd' WHEN {0} % 10 = 3 THEN 'rd' ELSE 'th' END"


def _in(values) -> str:
    return ", ".join(f"'{v}'" for v in sorted(values))


def _states_list() -> str:
    return ", ".join(f"'{v}'" for v in [*sorted(codes.US_STATES.values()), "california", "Calif."])


def _key_head() -> str:
    """The constant part of a request's canonical JSON."""
    shape = co.canonical(s.Schema("Turn", "A turn", {"mood": s.string()}).json_schema())
    return f'{{"jsonSchema":{shape},"systemPrompt":"p","userInput":'.replace("'", "''")


ORACLE_SQL = {
    "calendar_daily": """
        SELECT n_nationkey, TIMESTAMP '2026-01-01' + INTERVAL 1 DAY * d + INTERVAL 1 HOUR * (n_nationkey % 24) AS starts,
               TIMESTAMP '2026-01-01' + INTERVAL 1 DAY * d + INTERVAL 1 HOUR * (n_nationkey % 24) + INTERVAL 30 MINUTE AS ends, FALSE AS all_day, n_name AS summary
        FROM nation, (SELECT unnest(range(10))::INTEGER AS d)
    """,
    "calendar_last_fridays": """
        WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders),
        m AS (SELECT o_orderkey, d, last_day(d + to_months(CAST(k AS INTEGER))) AS l FROM o, (SELECT unnest(range(5)) AS k)),
        f AS (SELECT o_orderkey, d, l - CAST((dayofweek(l) - 5 + 7) % 7 AS INTEGER) AS f FROM m),
        r AS (SELECT o_orderkey, f, row_number() OVER (PARTITION BY o_orderkey ORDER BY f) AS k FROM f WHERE f > d),
        a AS (SELECT o_orderkey, d AS x FROM o UNION ALL SELECT o_orderkey, f FROM r WHERE k <= 3)
        SELECT o_orderkey, CAST(x AS TIMESTAMP) + INTERVAL 9 HOUR AS starts, CAST(x AS TIMESTAMP) + INTERVAL 11 HOUR AS ends FROM a
    """,
    "calendar_exceptions": """
        SELECT s_suppkey, TIMESTAMP '2026-01-01' + INTERVAL 1 HOUR * h AS starts, TIMESTAMP '2026-01-01' + INTERVAL 1 HOUR * (h + 1) AS ends, FALSE AS all_day, CASE WHEN h = 159 THEN 'moved' ELSE s_name END AS summary
        FROM supplier, (SELECT unnest([105, 159, 201])::INTEGER AS h)
    """,
    "calendar_clock_change": """
        SELECT n_nationkey, TIMESTAMP '2026-03-23' + INTERVAL 1 HOUR * h AS starts, TIMESTAMP '2026-03-23' + INTERVAL 1 HOUR * (h + 3) AS ends FROM nation, (SELECT unnest([9, 176])::INTEGER AS h)
    """,
    "calendar_merged": "SELECT r_regionkey, TIMESTAMP '2026-03-01' AS starts, TIMESTAMP '2026-03-03' AS ends, TRUE AS all_day, r_name || '; next' AS summary FROM region",
    "calendar_texts": f"""
        SELECT o_orderkey, 'Events: 1' || {_LF} || {_LF} || 'Event: ' || o_orderpriority || {_LF} || '  Starts: ' || strftime(o_orderdate, '%Y-%m-%d') || ' (all day)' || {_LF}
               || '  Repeats: every month on the ' || {_ORDINAL.format("day(o_orderdate)")} || ', 3 times (RRULE:FREQ=MONTHLY;COUNT=3)' || {_LF} || '  Location: ' || o_orderstatus || {_LF} || '  Shows as: free (does not block time)' AS text
        FROM orders
    """,
    "calendar_event_texts": f"""
        SELECT s_suppkey, 1::BIGINT AS pos, 'Visit 1' AS label, concat_ws({_LF}, 'Event: ' || s_name, '  Starts: 2026-03-15 09:00 UTC', '  Ends: 2026-03-15 10:30 UTC', '  Length: 1 hour 30 minutes',
               '  Organizer: Desk <desk' || s_suppkey || '@x.example>', '  Categories: a, b', '  Description:', '    One', '    Two') AS text FROM supplier
    """,
    "format_checks": f"""
        WITH c AS (
            SELECT c_custkey, chr(CAST(65 + c_custkey % 26 AS INTEGER)) || chr(CAST(65 + c_custkey // 26 % 26 AS INTEGER)) AS pair, chr(CAST(65 + c_custkey // 7 % 26 AS INTEGER)) AS third,
                   list_value({_states_list()}) AS states, c_custkey % 3 = 0 AS broken FROM customer
        )
        SELECT c_custkey, unnest(['email', 'url', 'moment']) AS path FROM c WHERE broken
        UNION ALL SELECT c_custkey, 'day' FROM c WHERE c_custkey % 31 >= 28
        UNION ALL SELECT c_custkey, 'country' FROM c WHERE pair NOT IN ({_in(codes.COUNTRIES)})
        UNION ALL SELECT c_custkey, 'state' FROM c WHERE pair NOT IN ({_in(codes.US_STATES)})
        UNION ALL SELECT c_custkey, 'state_name' FROM c WHERE states[CAST(c_custkey % len(states) + 1 AS INTEGER)] IN ('california', 'Calif.')
        UNION ALL SELECT c_custkey, 'currency' FROM c WHERE pair || third NOT IN ({_in(codes.CURRENCIES)})
    """,
    "docx_texts": f"""
        SELECT r_regionkey, 'Document metadata:' || {_LF} || 'title: ' || r_name || {_LF} || {_LF} || 'Document text:' || {_LF}
               || string_agg('# ' || n_name || {_LF} || {_LF} || 'Nation ' || n_nationkey || ' & more', {_LF} || {_LF} ORDER BY n_nationkey) AS text
        FROM ({_NATIONS}) GROUP BY r_regionkey, r_name
    """,
    "docx_sections": f"SELECT r_regionkey, 'Region — ' || n_name AS label, '# ' || n_name || {_LF} || {_LF} || 'Nation ' || n_nationkey || ' & more' AS text FROM ({_NATIONS})",
    "odt_texts": f"SELECT r_regionkey, 'Document text:' || {_LF} || string_agg('# ' || n_name || {_LF} || {_LF} || 'Nation ' || n_nationkey, {_LF} || {_LF} ORDER BY n_nationkey) AS text FROM ({_NATIONS}) GROUP BY r_regionkey",
    "workbook_cells": f"""
        SELECT r_regionkey, r_name AS sheet, 1 + row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) AS row_number, count(*) OVER (PARTITION BY r_regionkey) AS total_rows, CAST(n_nationkey AS VARCHAR) AS key, n_name AS name FROM ({_NATIONS})
    """,
    "workbook_sheets": f"SELECT DISTINCT r_regionkey, 0::BIGINT AS pos, r_name AS sheet FROM ({_NATIONS})",
    "pdf_page_texts": "SELECT s_suppkey, p::BIGINT AS page, CASE WHEN p = 1 THEN s_name || ' (first)' ELSE 'page 2 of ' || s_suppkey END AS text FROM supplier, (SELECT unnest([1, 2]) AS p)",
    "image_facts": """
        WITH p AS (SELECT *, p_partkey % 2 = 0 AS camera_made, CAST(p_size AS BIGINT) AS side FROM part)
        SELECT p_partkey, side AS width, CASE WHEN camera_made THEN 2 * side ELSE side + 1 END AS height, CASE WHEN camera_made THEN p_brand END AS camera, CASE WHEN camera_made THEN p_name END AS caption,
               CASE WHEN camera_made THEN '2026-01-02T03:04:05' END AS taken, camera_made AS turned, CASE WHEN camera_made THEN -12.5::DOUBLE END AS latitude, CASE WHEN camera_made THEN 30.25::DOUBLE END AS longitude, CAST(NULL AS VARCHAR) AS why FROM p
    """,
    "page_image_list": """
        SELECT p_partkey, k::BIGINT AS pos, CASE WHEN k = 0 THEN 'https://x.example/cover' || p_partkey || '.jpg' ELSE 'https://cdn.example/' || p_partkey || '.png' END AS url, CASE WHEN k = 1 THEN p_brand END AS alt FROM part, (SELECT unnest([0, 1]) AS k)
    """,
    "xml_items": f"""
        WITH p AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS pos FROM part)
        SELECT p_brand, pos, 'Part ' || pos AS label, concat_ws({_LF}, 'part:', '  @id: ' || p_partkey, '  name: ' || p_name || ' & co', '  size: ' || p_size) AS text FROM p
    """,
    "json_items": f"""
        WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos FROM orders)
        SELECT o_custkey, pos, 'Order ' || pos AS label, concat_ws({_LF}, 'key: ' || o_orderkey, 'is:', '  status: ' || o_orderstatus) AS text FROM o
    """,
    "mail_bodies": f"""
        WITH m AS (SELECT s_suppkey, s_name, 'Own words of ' || s_name || {_LF} || {_LF} || 'and after it' AS body, octet_length(encode('nation ' || s_nationkey || {_LF})) AS n FROM supplier)
        SELECT s_suppkey, 'Offer ' || s_suppkey AS subject, body, 's' || s_suppkey || '@x.example' AS sender, concat_ws({_LF}, 'From: ' || s_name || ' <s' || s_suppkey || '@x.example>', 'To: desk@x.example', 'Subject: Offer ' || s_suppkey,
               'Date: 2026-01-01 10:00:00 UTC', 'Attachment: terms.txt (text/plain, ' || n || ' B)', '', body) AS text FROM m
    """,
    "mail_attachments": "SELECT s_suppkey, 'terms.txt' AS filename, 'text/plain' AS media_type, 'nation ' || s_nationkey AS text FROM supplier",
    "mail_forwards": f"SELECT n_nationkey, concat_ws({_LF}, 'Hi ' || n_name, 'See below.', '---------- Forwarded message ---------', 'From: Ann <ann@x.example>', 'Subject: Old', '', 'forwarded words', 'last words') AS body FROM nation",
    "event_sessions": """
        WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events WHERE ts IS NOT NULL),
        g AS (SELECT user_id, ts, sum(CASE WHEN before IS NULL OR ts > before + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
        SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM g GROUP BY user_id, k
    """,
    "request_keys_agree": f"SELECT conv_id, turn, left(sha256('{_key_head()}' || CAST(to_json(coalesce(text, '')) AS VARCHAR) || '}}'), 24) AS request_key FROM conversations",
    "page_structured_data": f"""
        SELECT r_regionkey, concat_ws({_LF}, 'Page metadata:', 'title: T & x', 'author: ' || r_name, '', 'Structured data (JSON-LD):', '{{"@type":"Region","key":' || r_regionkey || '}}', '', 'Page text:', 'T & x', 'Body') AS text FROM region
    """,
    "byte_sizes": """
        WITH o AS (SELECT o_orderkey, o_orderstatus, o_orderkey * 997 AS n, o_orderkey % 90000 AS s FROM orders)
        SELECT o_orderkey, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN CAST(floor(n / 1024 + 0.5) AS BIGINT) || ' KB' ELSE printf('%.1f MB', n / 1048576) END AS size,
               printf('%02d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) AS clock, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus || ' <a@x.example>' ELSE 'a@x.example' END AS address FROM o
    """,
    "transcript_texts": f"""
        WITH n AS (SELECT n_regionkey, n_nationkey, n_nationkey * 10 AS s, CASE WHEN n_nationkey % 2 = 0 THEN 'Even: ' ELSE '' END || n_name AS t FROM nation)
        SELECT n_regionkey AS r_regionkey, 'Duration: 01:02:05' || {_LF} || 'Language: en' || CASE WHEN count_if(n_nationkey % 2 = 0) > 0 THEN {_LF} || 'Speakers: Even' ELSE '' END || {_LF} || {_LF}
               || string_agg(printf('[%02d:%02d:%02d] ', s // 3600, s // 60 % 60, s % 60) || t, {_LF} ORDER BY s) AS text FROM n GROUP BY n_regionkey
    """,
    "wav_lengths": "SELECT n_nationkey, CASE WHEN n_nationkey / 4 <= 3 THEN (44 + n_nationkey * 2000) || ' bytes' END AS text, n_nationkey / 4 > 3 AS too_long FROM nation",
    "cached_transcripts": "SELECT n_nationkey, n_nationkey % 5 < 3 AS cached FROM nation",
    "eval_run_totals": """
        SELECT count(*) AS items, count_if(s_suppkey % 3 <> 0) AS exact, 0::BIGINT AS failed, CASE WHEN count_if(s_suppkey % 3 <> 0) < 0.9 * count(*) THEN 'nation' END AS below FROM supplier
    """,
    "content_blocks": f"""
        WITH t AS (SELECT conv_id, CAST(turn AS BIGINT) AS pos, role <> 'user' AND turn % 3 = 1 AS photo, CASE WHEN turn % 2 = 0 THEN role END AS label, row_number() OVER (PARTITION BY conv_id ORDER BY turn) > 1 AS later FROM conversations),
        o AS (SELECT *, CASE WHEN later THEN {_LF} || {_LF} ELSE '' END || '<source' || coalesce(' label="' || label || '"', '') || CASE WHEN photo THEN ' type="image/png"' ELSE '' END || '>' || {_LF} AS head, {_LF} || '</source>' AS tail FROM t),
        p AS (
            SELECT conv_id, pos, 0 AS part, 'text' AS type, CASE WHEN photo THEN head ELSE head || 'said <\\/source> so' || tail END AS text, NULL AS label FROM o
            UNION ALL SELECT conv_id, pos, 1, 'image', NULL, label FROM o WHERE photo UNION ALL SELECT conv_id, pos, 2, 'text', tail, NULL FROM o WHERE photo
        ),
        b AS (SELECT *, 2 * sum(CASE WHEN type = 'image' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY pos, part) - CASE WHEN type = 'image' THEN 1 ELSE 0 END AS block FROM p)
        SELECT conv_id, CAST(block AS BIGINT) AS block, type, string_agg(text, '' ORDER BY pos, part) AS text, max(label) AS label, CASE WHEN type = 'image' THEN 'image/png' END AS media_type, CASE WHEN type = 'image' THEN min(pos) END AS pos FROM b GROUP BY conv_id, block, type
    """,
    "source_kinds": """
        WITH t AS (SELECT conv_id, CASE WHEN role <> 'user' AND turn % 3 = 1 THEN 'image' ELSE 'text' END AS kind, min(turn) AS first_at FROM conversations GROUP BY ALL)
        SELECT conv_id, string_agg(kind, ',' ORDER BY first_at) AS kinds FROM t GROUP BY conv_id
    """,
    "mapping_texts": f"""
        WITH n AS (SELECT n_regionkey AS r_regionkey, CAST(n_nationkey AS VARCHAR) AS a, n_name AS b, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k, count(*) OVER (PARTITION BY n_regionkey) AS n FROM nation),
        f AS (SELECT * FROM n WHERE k <= 3), w AS (SELECT r_regionkey, greatest(3, max(length(a))) AS wa, max(n) AS n, count(*) AS shown FROM f GROUP BY r_regionkey)
        SELECT r_regionkey, 'Columns (2):' || {_LF} || '1. Key' || {_LF} || '2. Name of it' || {_LF} || {_LF} || 'Sample rows (' || shown || ' of ' || any_value(w.n) || '):' || {_LF} || rpad('Key', CAST(any_value(wa) AS INTEGER), ' ') || ' | Name of it' || {_LF}
               || string_agg(rtrim(rpad(a, CAST(wa AS INTEGER), ' ') || ' | ' || b, ' '), {_LF} ORDER BY k) AS text
        FROM f JOIN w USING (r_regionkey) GROUP BY r_regionkey, shown
    """,
    "pdf_infos": "SELECT s_suppkey, 3::BIGINT AS pages, 2::BIGINT AS pages_with_text, s_name AS title, 'Ann' AS author, TIMESTAMP '2026-01-02 02:04:05' AS created FROM supplier",
    "pdf_texts": f"""
        SELECT s_suppkey, concat_ws({_LF}, 'Document metadata:', 'title: ' || s_name, 'author: Ann', 'created: 2026-01-02T02:04:05.000Z', 'pages: 3', '', 'Document text:', '--- Page 1 ---', s_name || ' first', '', '--- Page 3 ---', 'last') AS text FROM supplier
    """,
    "pdf_sources": "SELECT s_suppkey, 'Offer (page ' || p || ')' AS label, CASE WHEN p = 1 THEN s_name || ' first' ELSE 'last' END AS text FROM supplier, (SELECT unnest([1, 3]) AS p)",
    "chained_answers": "SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 3 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN s_suppkey % 4 <> 3 THEN CAST(s_nationkey AS BIGINT) END AS nation FROM supplier",
    "stripped_answers": """SELECT s_suppkey, '{"nation":"' || s_nationkey || '"}' AS data_json FROM supplier""",
    "image_texts": f"""
        SELECT p_partkey, p_brand || ' (photo metadata)' AS label, CASE WHEN p_partkey % 2 = 0 THEN concat_ws({_LF}, 'From the image file''s headers, not from the picture:', 'Taken: 2026-01-02T03:04:05', 'Camera''s place: 1.500000, -2.250000 (latitude, longitude)', 'Camera: ' || p_brand, 'Dimensions: 8×6 pixels')
               ELSE concat_ws({_LF}, 'From the image file''s headers, not from the picture:', 'Dimensions: 3×4 pixels', 'Neither a time nor a place is recorded.') END AS text FROM part
    """,
    "fetched_images": """
        WITH a AS (SELECT s_suppkey, p::BIGINT AS pos, s_name, (s_suppkey * 3 + p) % 5 AS k FROM supplier, (SELECT unnest([0, 1, 2]) AS p))
        SELECT s_suppkey, pos, CASE WHEN pos = 0 THEN s_name ELSE 'Image ' || (pos + 1) END AS label, CASE WHEN pos < 2 AND k = 0 THEN 'image/png' END AS media_type,
               CASE WHEN pos = 2 THEN 'count' WHEN k = 1 THEN 'status' WHEN k = 2 THEN 'content_type' WHEN k = 3 THEN 'unsupported' WHEN k = 4 THEN 'timeout' END AS reason FROM a
    """,
}
