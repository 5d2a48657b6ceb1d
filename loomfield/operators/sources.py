"""Sources of items: labels, character budgets, caps on binary sources, and rendering into one input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomfield.functions.text import omitted_marker, truncate_text

#: Columns of a sources table; ``kind`` is text, image or document.
COLUMNS = ("item_id", "pos", "kind", "label", "text", "media_type", "max_chars")


def label_sources(sources: DataFrame) -> DataFrame:
    """Labels trimmed, blank ones dropped, and unlabelled sources of items with several numbered by position."""
    item = Window.partitionBy("item_id")
    clean = F.nullif(F.trim("label"), F.lit(""))
    number = F.concat(F.lit("Source "), F.row_number().over(item.orderBy("pos")).cast("string"))
    return sources.withColumn("label", F.when(F.count("*").over(item) > 1, F.coalesce(clean, number)).otherwise(clean))


def cap_binary(sources: DataFrame, max_images: int | None = None, max_documents: int | None = None) -> DataFrame:
    """``sources`` with ``capped``: true for images and documents beyond an item's first so many."""
    rank = F.row_number().over(Window.partitionBy("item_id", "kind").orderBy("pos"))
    over = F.lit(False)
    for kind, most in (("image", max_images), ("document", max_documents)):
        if most is not None:
            over = over | ((F.col("kind") == kind) & (rank > most))
    return sources.withColumn("capped", over)


def grants(lengths: Column, budget: Column) -> Column:
    """What each text gets of a budget, shortest first: its length, or an equal share of what is left."""
    order = F.array_sort(F.transform(lengths, lambda n, i: F.struct(n.alias("n"), i.alias("i"))))
    start = F.struct(budget.cast("long").alias("left"), F.size(lengths).alias("waiting"), F.array().cast("array<struct<i:int,given:long>>").alias("out"))

    def give(acc: Column, x: Column) -> Column:
        share = F.least(x["n"].cast("long"), F.floor(acc["left"] / acc["waiting"]))
        return F.struct((acc["left"] - share).alias("left"), (acc["waiting"] - 1).alias("waiting"), F.concat(acc["out"], F.array(F.struct(x["i"].alias("i"), share.alias("given")))).alias("out"))

    given = F.aggregate(order, start, give, lambda acc: F.array_sort(acc["out"]))
    return F.when(F.aggregate(lengths, F.lit(0).cast("long"), lambda a, n: a + n) <= budget, F.transform(lengths, lambda n: n.cast("long"))).otherwise(F.transform(given, lambda g: g["given"]))


def budget_sources(sources: DataFrame, max_chars: int | None, policy: str = "tail") -> DataFrame:
    """Texts within their own limits and their item's budget; ``original_length`` and ``kept_length`` tell of cuts.

    Only lengths are gathered by item, not texts; an item's sources are few by nature.
    """
    text = F.col("kind") == "text"
    capped = sources.withColumn("original_length", F.when(text, F.length("text")))
    capped = capped.withColumn("text", F.when(text & F.col("max_chars").isNotNull(), truncate_text(F.col("text"), F.col("max_chars"), policy)).otherwise(F.col("text")))
    if max_chars is not None:
        item = Window.partitionBy("item_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        lengths = F.collect_list(F.when(text, F.length("text"))).over(item)
        place = F.count(F.when(text, 1)).over(Window.partitionBy("item_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
        sized = capped.withColumn("__lengths", lengths).withColumn("__place", place.cast("int"))
        sized = sized.withColumn("__grant", F.when(text, F.get(grants(F.col("__lengths"), F.lit(max_chars)), F.col("__place"))).cast("int"))
        capped = sized.withColumn("text", F.when(text, truncate_text(F.col("text"), F.col("__grant"), policy)).otherwise(F.col("text"))).drop("__lengths", "__place", "__grant")
    return capped.withColumn("kept_length", F.when(text, F.length("text")))


TAG = "source"


def open_tag(label: Column, kind: Column, media_type: Column, end: str = ">") -> Column:
    """A block's start: its label, and for an image or a document its type."""
    name = F.when(label.isNotNull(), F.concat(F.lit(' label="'), F.regexp_replace(F.regexp_replace(label, "[\\r\\n]+", " "), '"', "&quot;"), F.lit('"'))).otherwise("")
    type_ = F.when(kind != "text", F.concat(F.lit(' type="'), F.coalesce(media_type, kind), F.lit('"'))).otherwise("")
    return F.concat(F.lit(f"<{TAG}"), name, type_, F.lit(end))


def safe_text(text: Column) -> Column:
    """Text that can't close its block early."""
    return F.regexp_replace(text, f"(?i)</(\\s*{TAG}\\b)", "<\\\\/$1")


def rendered(label: Column, text: Column, kind: Column, media_type: Column) -> Column:
    """One source as a block that its own text can't close early."""
    block = F.concat(open_tag(label, kind, media_type), F.lit("\n"), safe_text(text), F.lit(f"\n</{TAG}>"))
    return F.when(kind == "text", block).otherwise(open_tag(label, kind, media_type, " />"))


def render_sources(sources: DataFrame) -> DataFrame:
    """(item_id, user_input): an item's sources in order."""
    block = rendered(F.col("label"), F.col("text"), F.col("kind"), F.col("media_type"))
    rows = sources.select("item_id", F.struct("pos", block.alias("block")).alias("s"))
    return rows.groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["block"]), "\n\n").alias("user_input"))


__all__ = ["COLUMNS", "budget_sources", "cap_binary", "grants", "label_sources", "omitted_marker", "render_sources", "rendered"]
