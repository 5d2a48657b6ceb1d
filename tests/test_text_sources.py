import random

import pytest
from pyspark.sql import functions as F

from loomfield.functions import html, text
from loomfield.operators import mapping, sources
from loomfield.plans import schema as s


def one(spark, value, build, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(build(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "value,want",
    [("a &amp;lt; b", "a &lt; b"), ("&#65;&#x1F642;&#0;&#x110000;", "A🙂&#0;&#x110000;"), ("&nope; &EURO; &", "&nope; € &"), ("none", "none"), ("&&amp;&amp;", "&&&")],
)
def test_entities(spark, value, want):
    assert one(spark, value, text.decode_entities) == want


def test_html_to_text(spark):
    page = "<html><head><title>x</title></head><body><!-- c --><h1>A&nbsp;b</h1><ul><li>one<li>two</ul><script>no</script><p>x<br/>y</p>\n\n\n<div>  z </div>"
    assert one(spark, page, text.html_to_text) == "A b\n\n- one\n- two\n\nx\ny\n\nz"


def test_page_parts(spark):
    page = """<title> T &amp; U </title><meta property="og:title" content="First"><meta name='og:title' content='Last'><META NAME=author CONTENT=me><meta name=e content=""><script type="application/ld+json">{"b": 1, "a": [2]}</script><script type="application/ld+json">bad{</script><p>body"""
    want = "Page metadata:\ntitle: T & U\nog:title: Last\nauthor: me\n\n" + 'Structured data (JSON-LD):\n{"a":[2],"b":1}\n\n' + "Page text:\nT & U\nbody"
    assert one(spark, page, html.page_to_text) == want


@pytest.mark.parametrize("value,want", [("1,234.50 €", 1234.5), ("EUR 12", 12.0), ("85 m2", None), ("40%", 40.0), ("1e3", 1000.0), ("1d", 1.0), ("NaN", None), ("", None), ("-.5", -0.5), ("1e999", None), ("12 sqm", 12.0)])
def test_numbers(spark, value, want):
    assert one(spark, value, text.parse_number) == want


def test_small_texts(spark):
    assert one(spark, "a; b ;;c", text.split_list) == ["a", "b", "c"]
    assert one(spark, "a\r\nb,c", text.split_list) == ["a", "b,c"]
    assert one(spark, 3725.9, text.format_clock, "double") == "01:02:05"
    assert [one(spark, n, text.format_size, "long") for n in (812, 24_576, 1_363_149)] == ["812 B", "24 KB", "1.3 MB"]
    assert one(spark, "a🙂", text.utf16_length) == 3
    assert one(spark, bytearray.fromhex("89504e470d0a1a0a00"), text.image_type, "binary") == "image/png"
    assert one(spark, bytearray(b"RIFF1234WEBP"), text.image_type, "binary") == "image/webp"
    assert one(spark, bytearray(b"plain"), text.image_type, "binary") is None
    assert one(spark, "Fwd: x", text.is_forward) is True


def test_halves_of_a_tenth_of_a_megabyte(spark):
    """249.25 MB goes up as in the source's rendering; byte_sizes' SQL has printf, to the even tenth."""
    assert one(spark, 997 * 262_144, text.format_size, "long") == "249.3 MB"
    even = [one(spark, n, lambda c: text.format_size(c, half_even=True), "long") for n in (997 * 262_144, 999 * 262_144, 997 * 262_144 + 1, 1_363_149)]
    assert even == ["249.2 MB", "249.8 MB", "249.3 MB", "1.3 MB"] == [f"{997 / 4:.1f} MB", f"{999 / 4:.1f} MB", f"{(997 * 262_144 + 1) / 2**20:.1f} MB", "1.3 MB"]


def plain_cut(t, limit, policy):
    if len(t) <= limit:
        return t
    room = max(0, limit - len(f"[… {len(t):,} characters omitted …]") - 2)
    mark, front = f"[… {len(t) - room:,} characters omitted …]", -(-room // 2)
    back = room - front
    return {"tail": t[:room] + "\n" + mark, "head": mark + "\n" + t[len(t) - room :], "middle": t[:front] + "\n" + mark + "\n" + (t[len(t) - back :] if back else "")}[policy]


def plain_budget(texts, own, budget, policy):
    cut = [plain_cut(t, m, policy) if m is not None else t for t, m in zip(texts, own, strict=True)]
    if sum(map(len, cut)) <= budget:
        return cut
    left, out = budget, list(cut)
    order = sorted(range(len(cut)), key=lambda k: len(cut[k]))
    for rank, k in enumerate(order):
        share = min(len(cut[k]), left // (len(order) - rank))
        left -= share
        out[k] = plain_cut(cut[k], share, policy)
    return out


@pytest.mark.parametrize("policy", ["tail", "head", "middle"])
def test_budget_by_plain_water_filling(spark, policy):
    rng, rows, want = random.Random(policy), [], {}
    for item in range(25):
        texts = ["".join(rng.choice("ab é") for _ in range(rng.randint(0, 900))) for _ in range(rng.randint(1, 5))]
        own = [rng.choice([None, 120, 5]) for _ in texts]
        rows += [(item, 2 * k, "text", None, t, None, m) for k, (t, m) in enumerate(zip(texts, own, strict=True))] + [(item, 1, "image", None, None, "image/png", None)]
        want |= {(item, 2 * k): t for k, t in enumerate(plain_budget(texts, own, 700, policy))}
    frame = spark.createDataFrame(rows, "item_id long, pos int, kind string, label string, text string, media_type string, max_chars int")
    got = {(r.item_id, r.pos): r.text for r in sources.budget_sources(frame, 700, policy).collect() if r.kind == "text"}
    assert got == want


def test_labels_caps_and_rendering(spark):
    rows = [(1, 0, "text", " A\n\"b\" ", "x </ Source> y", None, None), (1, 1, "image", "", None, "image/png", None), (1, 2, "image", None, None, None, None), (2, 0, "text", None, "alone", None, None)]
    frame = spark.createDataFrame(rows, "item_id long, pos int, kind string, label string, text string, media_type string, max_chars int")
    labelled = sources.cap_binary(sources.label_sources(frame), max_images=1)
    assert [(r.label, r.capped) for r in labelled.orderBy("item_id", "pos").collect()] == [('A\n"b"', False), ("Source 2", False), ("Source 3", True), (None, False)]
    got = {r.item_id: r.user_input for r in sources.render_sources(labelled).collect()}
    assert got[1] == '<source label="A &quot;b&quot;">\nx <\\/ Source> y\n</source>\n\n<source label="Source 2" type="image/png" />\n\n<source label="Source 3" type="image" />'
    assert got[2] == "<source>\nalone\n</source>"


def test_mapping_nests_casts_and_overwrites(spark):
    address = s.Schema("Address", "", {"city": s.string(), "zip": s.string().optional()})
    listing = s.Schema("Listing", "", {"name": s.string(), "sleeps": s.number(), "pets": s.boolean(), "tags": s.array(s.string()), "kind": s.enum("House", "Flat"), "address": s.nested(address)})
    rows = spark.createDataFrame([('Sea "view"', " 4 guests ", "YES", "a; b", "flat", "Rome", ""), ("x", "many", "maybe", "", "tent", "", "")], "`Name ` string, Guests string, Pets string, Tags string, Kind string, Town string, Alt string")
    pairs = [("name", "name"), ("Guests", "sleeps"), ("PETS", "pets"), ("Tags", "tags"), ("Kind", "kind"), ("Town", "address.city"), ("Alt", "name"), ("Gone", "address.zip"), ("Kind", None)]
    got = [r.data_json for r in mapping.apply_mapping(rows, pairs, listing).collect()]
    assert got == ['{"name":"Sea \\"view\\"","sleeps":"4 guests","pets":true,"tags":["a","b"],"kind":"Flat","address":{"city":"Rome"}}', '{"name":"x","sleeps":"many","pets":"maybe","kind":"tent"}']


def test_mail_bodies_are_read_by_many_tasks(spark, tmp_path):
    """The query's suppliers in one split of some kilobytes, whose mails are seconds of work."""
    from loomfield.plans import readers

    spark.range(4000).selectExpr("id AS s_suppkey", "sha2(cast(id AS string), 256) AS s_name", "cast(id % 25 AS int) AS s_nationkey").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    found = readers.mail_bodies(spark, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/supplier.parquet").rdd.getNumPartitions() == 1 and found.rdd.getNumPartitions() >= 8
    got = found.selectExpr("count(*) AS n", "count(DISTINCT s_suppkey) AS keys", "count_if(subject = 'Offer ' || s_suppkey AND body LIKE 'Own words of %and after it') AS whole").first()
    assert tuple(got) == (4000, 4000, 4000)
