"""Page metadata, structured data and page text as native columns, and sources from pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfield.functions.text import bare, decode_entities, html_to_text

_SPACES = "[ \\t\\r\\n\\f]+"


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value in double, single or no quotes, decoded; null where it is missing."""
    start = f"(?i)(?:^|[\\s\"']){name}\\s*=\\s*"
    found = [F.regexp_extract(tag, start + quoted, 1) for quoted in ('"([^"]*)"', "'([^']*)'", "([^\\s\"'>]+)")]
    here = [tag.rlike(start + '"'), tag.rlike(start + "'"), tag.rlike(start + "[^\\s\"'>]")]
    return decode_entities(F.when(here[0], found[0]).when(here[1], found[1]).when(here[2], found[2]))


def meta_pairs(html: Column) -> Column:
    """Array of (key, value): the title, then meta tags by property or name; later values replace earlier ones in place."""
    title = F.trim(F.regexp_replace(decode_entities(F.regexp_extract(html, "(?i)<title[^>]*>([\\s\\S]*?)</title>", 1)), _SPACES, " "))
    first = F.when(title != "", F.array(F.struct(F.lit("title").alias("key"), title.alias("value")))).otherwise(F.array().cast("array<struct<key:string,value:string>>"))
    tags = F.regexp_extract_all(html, F.lit("(?i)<meta\\b[^>]*>"), F.lit(0))
    pairs = F.transform(tags, lambda t: F.struct(F.lower(F.trim(F.coalesce(attribute(t, "property"), attribute(t, "name")))).alias("key"), F.trim(attribute(t, "content")).alias("value")))
    every = F.concat(first, F.filter(pairs, lambda p: (F.length(p["key"]) > 0) & (F.length(p["value"]) > 0)))

    def merged(all_: Column) -> Column:
        keys = F.array_distinct(F.transform(all_, lambda p: p["key"]))
        return F.transform(keys, lambda k: F.struct(k.alias("key"), F.element_at(F.filter(all_, lambda p: p["key"] == k), -1)["value"].alias("value")))

    return F.transform(F.array(every), merged)[0]


def json_ld(html: Column) -> Column:
    """Texts of the JSON-LD blocks that parse."""
    blocks = F.regexp_extract_all(html, F.lit("(?i)<script\\b[^>]*type\\s*=\\s*[\"']application/ld\\+json[\"'][^>]*>([\\s\\S]*?)</script>"), F.lit(1))
    return F.filter(F.transform(blocks, lambda b: bare(b)), lambda b: F.try_parse_json(b).isNotNull())


def page_to_text(html: Column, meta: bool = True, structured: bool = True, body: bool = True) -> Column:
    """Metadata, structured data and text under their headings; empty sections are left out."""

    def section(title: str, text: Column) -> Column:
        return F.when(F.length(text) > 0, F.concat(F.lit(f"{title}:\n"), text))

    sections = []
    if meta:
        sections.append(section("Page metadata", F.array_join(F.transform(meta_pairs(html), lambda p: F.concat(p["key"], F.lit(": "), p["value"])), "\n")))
    if structured:
        sections.append(section("Structured data (JSON-LD)", F.array_join(F.transform(json_ld(html), lambda b: F.to_json(F.parse_json(b))), "\n")))
    if body:
        sections.append(section("Page text", html_to_text(html)))
    return F.concat_ws("\n\n", *sections)


def html_sources(pages: DataFrame, item: str = "page_id", html: str = "html", label: str = "Page") -> DataFrame:
    """(item, pos, label, text): structured data and text of each page as two sources, empty ones left out."""
    parts = F.array(
        F.struct(F.lit(f"{label} (structured data)").alias("label"), page_to_text(F.col(html), body=False).alias("text")),
        F.struct(F.lit(label).alias("label"), html_to_text(F.col(html)).alias("text")),
    )
    return pages.select(F.col(item), F.posexplode(F.filter(parts, lambda p: F.length(p["text"]) > 0)).alias("pos", "source")).select(item, "pos", "source.label", "source.text")
