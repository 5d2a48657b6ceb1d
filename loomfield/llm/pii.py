"""Personal data: pattern spans, and terms that disclose them by corpus co-occurrence; DataFrame functions only.

Base spans are e-mail addresses, IP addresses, card and phone numbers.  Protected entities are their values and
the classes that values belong to: an address's domain, a network, a card's issuer, a phone number's area.  A term
of the documents that hold an entity, however far from it, discloses it where their pointwise mutual information
comes within a factor ``ALPHA`` of the entity's own information: PMI(e, t) >= IC(e) / ALPHA, all probabilities
being shares of the corpus's documents.  Such terms are removed from the documents that hold the entity, where
they occur with nothing else, or generalised to a placeholder.  Evidence is a pair seen in ``SUPPORT`` different
texts: in a single one every rare word stands with every value, which tells nothing; its class still counts.

Spans are computed once and kept.  The terms of all documents are counted first, combined before the shuffle; a
text's terms meet its entities where these counts allow that they disclose them.

Patterns are written so that a long run is looked at once: possessive repeats and look-behind allow no
other match than the plain ones.  Positions are code points and come from the lengths of what lies between
matches.  Counts are combined before every shuffle, so that copies of a text make no group large.

Defined results: a null text is empty; rows may repeat and ids be null; extra columns stay in ``sanitise``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfield.llm.common import FEW_ROWS, few, fresh, keep
from loomfield.llm.quality import let

KINDS = ("email", "ip", "card", "phone")
ALPHA, SUPPORT = 1.25, 2
_LOCAL = "[A-Za-z0-9._%+-]"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
PATTERNS = {
    "email": f"(?:\\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    "card": "[0-9](?:[\\x20-]?+[0-9])++",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
#: Cheap necessary conditions.
_MAYBE = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9][\\x20-]?[0-9][\\x20-]?[0-9]", "phone": "\\+[0-9]"}
_TERM = "\\p{L}++"
_SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"
_CHUNK = 128


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


_VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(f"^{_PART}(?:\\.{_PART}){{3}}$"),
    "card": lambda v: F.length(_digits(v)).between(13, 19) & F.call_function("luhn_check", _digits(v)),
    "phone": lambda v: F.length(_digits(v)).between(9, 15),
}


def located(text: Column, pattern: Column, kind: str) -> Column:
    """Spans of all matches: where the pattern splits the text, lengths add up to positions.

    Sums run over whole chunks and then inside one, so thousands of matches in a text stay cheap.
    """

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0), lambda a, b: a + b)

    def spans(m: Column) -> Column:
        n = F.size(m)

        def placed(between: Column) -> Column:
            sums = F.transform(F.sequence(F.lit(0), (n / _CHUNK).cast("int")), lambda c: total(F.slice(between, c * _CHUNK + 1, _CHUNK)))

            def put(s: Column) -> Column:
                def one(value: Column, k: Column) -> Column:
                    c = (k / _CHUNK).cast("int")
                    # ``between`` holds, for each match, the text before it and the match itself
                    end = total(F.slice(s, F.lit(1), c)) + total(F.slice(between, c * _CHUNK + 1, k - c * _CHUNK + 1))
                    return F.struct(F.lit(kind).alias("kind"), (end - F.length(value)).alias("start"), end.alias("end"), value.alias("value"))

                return F.transform(m, one)

            return let(sums, put)

        pieces = F.slice(F.split(text, pattern, -1), F.lit(1), n)
        return let(F.zip_with(pieces, m, lambda p, v: F.length(p) + F.length(v)), placed)

    return let(F.regexp_extract_all(text, pattern, F.lit(0)), spans).cast(_SPAN)


def base_spans(text: Column) -> Column:
    """Valid spans by kind as listed, then start."""
    found = []
    for kind in KINDS:
        valid = _VALID[kind]
        spans = F.filter(located(text, F.lit(PATTERNS[kind]), kind), lambda s: valid(s["value"]))  # noqa: B023 - built at once
        maybe = text.contains("@") if kind == "email" else text.rlike(_MAYBE[kind])
        found.append(F.when(maybe, spans).otherwise(F.array().cast(_SPAN)))
    return F.concat(*found)


def terms_of(text: Column) -> Column:
    """The distinct whole words of a text, without those of addresses."""
    return F.array_distinct(F.regexp_extract_all(F.regexp_replace(text, "\\S*@\\S*", " "), F.lit(_TERM), F.lit(0)))


def _class(span: Column) -> Column:
    """What a value shares with others of its kind."""
    value, digits = span["value"], _digits(span["value"])
    domain, network = F.lower(F.regexp_extract(value, "@(.*)$", 1)), F.regexp_extract(value, "^([0-9]+\\.[0-9]+)", 1)
    return F.when(span["kind"] == "email", domain).when(span["kind"] == "ip", network).when(span["kind"] == "card", F.substring(digits, 1, 6)).otherwise(F.substring(digits, 1, 4))


def entities_of(spans: Column) -> Column:
    """The distinct entities of base spans: values, and their classes."""
    values = F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["value"]))
    return F.array_distinct(F.concat(values, F.transform(spans, lambda s: F.concat(s["kind"], F.lit("~"), _class(s)))))


def disclosing_terms(rows: DataFrame) -> DataFrame:
    """(h, terms, gone) for a kept table (h, text, spans): a text's disclosing terms, and those that occur with nothing else."""
    held = rows.where(F.size("spans") > 0).select("h", entities_of(F.col("spans")).alias("es"), terms_of(F.col("text")).alias("ts"))
    # copies of a text are one row with their number
    texts = keep(held.groupBy("h").agg(F.first("es").alias("es"), F.first("ts").alias("ts"), F.count("*").alias("c")), "texts")
    holds = texts.select("h", "c", F.explode("es").alias("e"))
    n = rows.count()
    bound = F.log2(F.lit(float(max(n, 1))) / F.col("n_e")) * (1 - 1 / ALPHA)
    entities = holds.groupBy("e").agg(F.sum("c").alias("n_e"), F.count("*").alias("texts")).where(F.col("texts") >= SUPPORT)
    # a term is with an entity at most as often as that occurs, so what is in more documents than ``most`` can't disclose it
    entities = entities.select("e", F.monotonically_increasing_id().alias("k"), bound.alias("bound"), (F.col("n_e") * F.pow(F.lit(2.0), bound) * (1 + 1e-9)).alias("most"))
    entities = keep(entities, "entities")
    top = entities.agg(F.max("most")).head()[0] or 0.0
    shared = holds.join(few(entities), "e").groupBy("h").agg(F.max("most").alias("most"), F.collect_list(F.struct("k", "bound", F.col("most").alias("most_k"))).alias("es"))
    shared = keep(shared, "shared")
    # the terms of all documents are counted before entities multiply any rows, so the shuffle grows as the input does
    each = rows.where(F.lit(top > 0)).select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(_TERM), F.lit(0)))).alias("t"))
    terms = keep(each.groupBy("t").agg(F.count("*").alias("n_t")).where(F.col("n_t") >= SUPPORT), "terms")
    words = texts.join(few(shared.select("h", "most")), "h").select("h", "c", "most", F.explode("ts").alias("t"))
    common = terms.where(F.col("n_t") > top).select("t")
    if common.count() <= FEW_ROWS:  # words that can disclose nothing are not shuffled
        words = words.join(F.broadcast(common), "t", "left_anti")
    rare = words.join(terms, "t").where(F.col("n_t") <= F.col("most")).select("h", "c", "t", "n_t")
    context = rare.join(few(shared.select("h", "es")), "h").select("h", "c", "t", "n_t", F.inline("es")).where(F.col("n_t") <= F.col("most_k"))
    context = keep(context.drop("most_k"), "context")
    together = context.groupBy("k", "t").agg(F.sum("c").alias("n_et"), F.count("*").alias("texts"), F.first("bound").alias("bound"), F.first("n_t").alias("n_t")).where(F.col("texts") >= SUPPORT)
    loss = F.log2(F.col("n_t") / F.col("n_et"))  # IC(e) - PMI(e, t)
    flagged = keep(together.where(loss <= F.col("bound")).select("k", "t", (F.col("n_t") == F.col("n_et")).alias("only")), "flagged")
    # a text's own terms meet the flagged ones, so that rows stay in proportion to the texts, whatever an entity has of either
    found = context.select("h", "k", "t").join(flagged, ["k", "t"]).groupBy("h", "t").agg(F.bool_or("only").alias("only"))
    return keep(found.groupBy("h").agg(F.array_sort(F.collect_set("t")).alias("terms"), F.array_sort(F.collect_set(F.when(F.col("only"), F.col("t")))).alias("gone")), "disclosing")


def _found(docs: DataFrame, doc_id: str, text: str, t: str, spans: str, terms: str) -> DataFrame:
    """``docs`` with the text (never null), its base spans and its term spans."""
    h = fresh(docs, "h")
    never_null = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = keep(docs.withColumn(spans, base_spans(never_null)).withColumn(h, F.xxhash64(never_null)), "spans").withColumn(t, never_null)
    told = disclosing_terms(rows.select(F.col(h).alias("h"), F.col(t).alias("text"), F.col(spans).alias("spans")))
    # only texts with entities may have terms
    some = rows.where(F.size(spans) > 0)
    joined = some.join(told, some[h] == told["h"], "left")
    pattern = F.concat(F.lit("(?<!\\p{L})(?:"), F.array_join(told["terms"], "|"), F.lit(")(?!\\p{L})"))
    own = F.when(told["terms"].isNotNull(), F.transform(located(some[t], pattern, "term"), lambda s: F.struct(F.when(F.array_contains(told["gone"], s["value"]), "gone").otherwise("term").alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))).otherwise(F.array().cast(_SPAN))
    with_terms = joined.select(*[some[f"`{c}`"] for c in docs.columns], some[t], some[spans], own.alias(terms))
    rest = rows.where(F.size(spans) == 0)
    return with_terms.unionByName(rest.select(*[rest[f"`{c}`"] for c in docs.columns], rest[t], rest[spans], F.array().cast(_SPAN).alias(terms)))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def by_kind(spans: Column) -> Column:
    return F.array_sort(spans)


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base, terms): base spans and term spans of every row, each (kind, start, end, value).

    Term spans are of kind ``term`` (to be generalised) or ``gone`` (to be removed).
    """
    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return _found(slim, "doc_id", "text", "t", "base", "terms").select("doc_id", "base", "terms")


def sanitise(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every span's text replaced by its kind in brackets, or nothing for terms to be removed.

    Overlapping spans become one; texts without spans, and null texts, stay as they are.
    """
    t, b, own = fresh(docs, "text"), fresh(docs, "base"), fresh(docs, "terms")
    rows = _found(docs, doc_id, text, t, b, own)

    def step(done: Column, s: Column) -> Column:
        mark = F.when(s["kind"] == "gone", F.lit("")).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        piece = F.array(F.substring(F.col(t), done["at"] + 1, s["start"] - done["at"]), mark)
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), F.when(s["start"] >= done["at"], F.concat(done["out"], piece)).otherwise(done["out"]).alias("out"))

    ordered = F.array_sort(F.transform(F.concat(b, own), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("later"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    clean = F.aggregate(ordered, start, step, lambda d: F.concat(F.array_join(d["out"], ""), F.substring(F.col(t), d["at"] + 1, F.length(F.col(t)))))
    spotted = (F.size(b) > 0) | (F.size(own) > 0)
    return rows.select(*[F.when(spotted, clean).otherwise(F.col(f"`{c}`")).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
