"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule is a predicate on metrics of a text.  A sample of rows from all partitions tells which rules reject
what; a rule costs what its metrics cost that no earlier rule needs, in nanoseconds a code point (``COSTS``).  Rules
are then ordered one by one, each time the one with most rejections per cost among the sample's rows that are left,
and run in this order inside one CASE, so a document that one rule rejects pays for none behind it.  The order
decides on cost alone: a document is kept if no rule rejects it.  The same table gives the same order.

Defined results: a null text has no words and fails; an empty table gives no rows; extra columns stay in
``filter_documents`` and are ignored by ``assess``; ids may be null or repeat.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfield.llm.common import WORD_SEPARATORS

#: Rows on which selectivities are estimated, as expected, and the seed that draws them.
SAMPLE_ROWS, SEED = 1000, 29
WINDOW = 8
_SPACE = "[\\x20\\x09-\\x0D]"
_SYMBOLS = "#*$%&|<>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where ``body`` uses it inside other lambdas."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(WORD_SEPARATORS))
    return F.when(F.length(bare) > 0, F.split(bare, _SPACE + "+")).otherwise(F.array().cast("array<string>"))


def lines(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))


def repeat_words(w: Column, width: int = WINDOW) -> Column:
    """Words inside windows of ``width`` words that a text holds more than once, the first ones included.

    Windows are compared by 64-bit hashes.  Most texts repeat none, which a hash set tells; for the others
    hashes are sorted with their places, and the places of equal neighbours cover the words counted.
    """

    def covered(h: Column) -> Column:
        def places(s: Column) -> Column:
            at = F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.when((F.get(s, i)["h"] == F.get(s, i - 1)["h"]) | (F.get(s, i)["h"] == F.get(s, i + 1)["h"]), F.get(s, i)["i"]))
            return F.array_sort(F.filter(at, lambda x: x.isNotNull()))

        steps = let(let(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), places), lambda p: F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.least(F.lit(width), b - a)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, x: total + x)

    def counted(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (width - 1)), lambda i: F.xxhash64(F.slice(w, i, width)))
        some = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
        return F.when(F.size(w) > width, some).otherwise(F.lit(0).cast("long"))

    return let(w, counted)


#: Metrics by name, each from the text and its words.
METRICS: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda text, w: F.size(w).cast("long"),
    "word_chars": lambda text, w: F.length(F.translate(text, WORD_SEPARATORS, "")).cast("long"),
    "n_symbols": lambda text, w: (F.length(text) - F.length(F.translate(text, _SYMBOLS, ""))).cast("long"),
    "n_lines": lambda text, w: F.size(lines(text)).cast("long"),
    "n_dup_lines": lambda text, w: let(lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    "n_repeat_words": lambda text, w: repeat_words(w),
    "n_capitals": lambda text, w: F.length(F.regexp_replace(text, "\\P{Lu}+", "")).cast("long"),
    "n_stutters": lambda text, w: let(w, lambda x: F.size(F.filter(F.zip_with(x, F.slice(x, 2, F.size(x)), lambda a, b: a == b), lambda e: e))).cast("long"),
    "n_letters": lambda text, w: F.length(F.regexp_replace(text, "\\P{L}+", "")).cast("long"),
}
#: Nanoseconds a code point, measured on prose; splitting words is paid once by all that need them.
COSTS = {"words": 36, "n_words": 1, "word_chars": 35, "n_symbols": 35, "n_lines": 1, "n_dup_lines": 2, "n_repeat_words": 215, "n_capitals": 4, "n_stutters": 10, "n_letters": 21}
_BY_WORDS = frozenset(("n_words", "n_repeat_words", "n_stutters"))
#: What the contract's base columns need, in its order.
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """``rejects`` gets a function from a metric's name to its column."""

    name: str
    rejects: Callable[[Callable[[str], Column]], Column]


RULES = (
    Rule("few_words", lambda m: m("n_words") < 20),
    Rule("repeated_windows", lambda m: m("n_repeat_words") * 100 > m("n_words") * 30),
    Rule("symbols", lambda m: m("n_symbols") * 10 > m("n_words")),
    Rule("repeated_lines", lambda m: m("n_dup_lines") * 2 > m("n_lines")),
    Rule("capitals", lambda m: m("n_capitals") * 10 > m("word_chars") * 4),
    Rule("stutters", lambda m: m("n_stutters") * 10 > m("n_words") * 3),
    Rule("word_length", lambda m: (m("word_chars") < m("n_words") * 2) | (m("word_chars") > m("n_words") * 15)),
    Rule("letters", lambda m: m("n_letters") * 10 < m("word_chars") * 4),
)


def needs(rule: Rule) -> set[str]:
    """The metrics of a rule, and ``words`` where one of them splits the text."""
    names: set[str] = set()
    rule.rejects(lambda name: names.add(name) or F.lit(0))
    return names | ({"words"} if names & _BY_WORDS else set())


def order_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS, known: Iterable[str] = ()) -> list[Rule]:
    """Rules by rejections per cost among what is left; ties and empty samples keep the given order.

    Metrics in ``known`` cost nothing.  Sampled rows are counted by the rules that reject them, so the driver gets
    a row for each combination of rules at most.
    """
    some = docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).sample(min(1.0, rows / max(1, docs.count())), SEED)
    w = words(F.col("text"))
    hits = F.concat(*[F.coalesce(r.rejects(lambda name: METRICS[name](F.col("text"), w)), F.lit(False)).cast("int").cast("string") for r in rules])
    left = [(r["hits"], r["n"], r["size"]) for r in some.select(hits.alias("hits"), F.length("text").alias("n")).groupBy("hits").agg(F.count("*").alias("n"), F.sum("n").alias("size")).collect()]
    paid, ordered, rest = {*known, *({"words"} if set(known) & _BY_WORDS else ())}, [], list(range(len(rules)))
    while rest:
        size = sum(x for _, _, x in left)

        def worth(k: int) -> float:
            cost = 1 + size * sum(COSTS.get(name, max(COSTS.values())) for name in needs(rules[k]) - paid)  # noqa: B023 - used at once
            return sum(n for hit, n, _ in left if hit[k] == "1") / cost  # noqa: B023

        best = max(rest, key=worth)
        rest.remove(best)
        ordered.append(rules[best])
        paid |= needs(rules[best])
        left = [x for x in left if x[0][best] == "0"]
    return ordered


def verdict(ordered: list[Rule], metric: Callable[[str], Column]) -> Column:
    """The name of the first rule that rejects, or null: later rules aren't evaluated."""
    found = F.when(ordered[0].rejects(metric), ordered[0].name)
    for rule in ordered[1:]:
        found = found.when(rule.rejects(metric), rule.name)
    return found


def assess(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the base metrics, base_failed, failed_rule and kept for every row."""
    ordered = order_rules(docs, text, rules, known=BASE)
    # base metrics are results here; what else a rule needs is computed only when the cascade comes to it
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", words(F.col("text")).alias("w"))
    rows = rows.select("doc_id", "text", "w", *[METRICS[n](F.col("text"), F.col("w")).alias(n) for n in BASE])
    failed = verdict(ordered, lambda n: F.col(n) if n in BASE else METRICS[n](F.col("text"), F.col("w")))
    base = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    rows = rows.select("doc_id", *BASE, base.alias("base_failed"), failed.alias("failed_rule"))
    return rows.withColumn("kept", ~F.col("base_failed") & F.col("failed_rule").isNull())


def filter_documents(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that no rule rejects, with all their columns."""
    ordered = order_rules(docs, text, rules)
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    # bound inside the expression: a column of words would be split again for each rule, as filters move below projections
    failed = let(words(whole), lambda w: verdict(ordered, lambda n: METRICS[n](whole, w)))
    return docs.where(failed.isNull())
