"""Language identification by Bayesian fusion of text, declared language, address suffix and host.

Text likelihoods come from character n-grams of words, trained here on a bounded sample of labelled rows.
A first pass scores every row by its text alone.  Grouped sums of those posteriors give the host priors,
smoothed in steps: all rows, then the address suffix, then the host.  A small table of what is declared for
texts of each language gives the weight of a declaration.  The second step adds the logarithms and
normalises; hosts meet their priors in a join that adaptive execution splits where one host is hot.

A model knows the languages of its labels alone, so a text is unfamiliar, and has no language, where its n-grams
are less likely, in its best language, than that language's own by more than ``UNFAMILIAR`` nats each and the
spread that so many n-grams have.  Labels and declarations count by their primary subtag.

Defined results: a text without letters (null or empty ones too) or an unfamiliar one has language ``und`` and is
rejected, as is one whose best language is less likely than ``LEAST`` or isn't wanted; without a host, a suffix
or a declaration that evidence is left out; a label or declaration that has no language subtag counts as none;
repeated rows count each time; an empty table, or one without labels, gives ``und``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomfield.llm import html_extract
from loomfield.llm.common import fresh, frugal, keep, pieces, utf8

#: Labelled texts that the text model is fitted on, chosen by their hash in every language.
TRAIN_ROWS = 2000
#: Fewest texts of a language, where it has so many, and fewest that its share of hashes aims at.
LEAST_ROWS, FEW = 20, 200
_SHARES = 1 << 30
#: Weight of earlier levels in a host's prior, in rows.
STRENGTH = 20.0
#: n-grams of a text overlap, so their joint evidence is tempered; and how sure a result must be.
TEMPER, LEAST = 0.3, 0.5
#: Nats an n-gram may be less likely than a language's own on average, and spreads of that average besides.
UNFAMILIAR, SPREADS = 2.0, 4.0
#: Most languages of a model, those with most texts.
LANGUAGES = 200
_WORD = re.compile(r"[^\W\d_]+")
_CACHE = 300_000


@dataclass(frozen=True)
class TextModel:
    languages: tuple[str, ...]
    grams: dict[str, int]
    weights: np.ndarray  # a row of log probabilities for each gram; the last is that of unknown grams
    usual: np.ndarray = field(default_factory=lambda: np.zeros((2, 0)))  # each language's mean of a gram's log probability, and its deviation


def word_grams(word: str) -> Iterator[str]:
    w = f"^{word}$"
    for n in (1, 2, 3):
        for k in range(len(w) - n + 1):
            yield w[k : k + n]


def primary(label: Column) -> Column:
    """The primary language subtag of a label such as ``en-US``, or null."""
    return F.nullif(F.regexp_extract(F.lower(F.trim(label)), "^([a-z]{2,3})(?:[-_].*)?$", 1), F.lit(""))


def train(docs: DataFrame, text: str = "text", label: str = "lang", rows: int = TRAIN_ROWS) -> TextModel:
    """n-gram frequencies by language over a bounded sample; the counts collected are bounded by it too."""
    labelled = docs.select(primary(F.col(f"`{label}`")).alias("lang"), F.col(f"`{text}`").alias("text")).where("lang is not null")
    hashed = labelled.where("text is not null").withColumn("h", F.xxhash64("text"))
    # each language has its part of the rows; by distinct texts, the hash lets about twice as many through, so that
    # only those are shuffled, and all of a language with few
    sizes = {r["lang"]: r["n"] for r in hashed.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    total = sum(sizes.values())
    parts = {lang: max(LEAST_ROWS, -(-rows * n // max(1, total))) for lang, n in sizes.items()}
    shares = {lang: min(_SHARES, -(-2 * max(parts[lang], FEW) * _SHARES // max(1, n))) for lang, n in sizes.items()}
    if not sizes:
        hashed, shares, parts = hashed.limit(0), {"": 0}, {"": 0}

    def of(table: dict[str, int]) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), F.col("lang"))

    some = hashed.where(F.pmod("h", F.lit(_SHARES)) < of(shares)).groupBy("h", "lang").agg(F.min("text").alias("text"))
    ranked = some.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    sample = ranked.where(F.col("k") <= of(parts)).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        for batch in batches:
            for lang, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(_WORD.findall(body.lower()))
        found: dict[tuple[str, str], int] = {}
        for lang, own in words.items():
            for w, n in own.items():
                for g in word_grams(w):
                    found[lang, g] = found.get((lang, g), 0) + n
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(found.values(), pa.int64())], names=["lang", "gram", "n"])

    counts = sample.mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    languages = tuple(sorted(set(counts["lang"])))
    grams = {g: k for k, g in enumerate(sorted(set(counts["gram"])))}
    table = np.zeros((len(grams) + 1, len(languages)))
    for lang, g, n in zip(counts["lang"], counts["gram"], counts["n"], strict=True):
        table[grams[g], languages.index(lang)] = n
    smooth = table + 0.5
    if not languages:
        return TextModel(languages, grams, smooth)
    weights, shares = np.log(smooth / smooth.sum(axis=0)), table / np.maximum(1, table.sum(axis=0))
    mean = (shares * weights).sum(axis=0)
    return TextModel(languages, grams, weights, np.stack([mean, np.sqrt(np.maximum(0, (shares * weights**2).sum(axis=0) - mean**2))]))


class _Scores(dict):
    """Word to its row in a growing table of log likelihoods."""

    def __init__(self, model: TextModel):
        super().__init__()
        # the last column is the word's number of n-grams
        self.model, self.table = model, np.zeros((1024, len(model.languages) + 1))

    def __missing__(self, word: str) -> int:
        k, m = len(self), self.model
        if k >= len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        get, unknown = m.grams.get, len(m.grams)
        at = [get(g, unknown) for g in word_grams(word)]
        self.table[k, :-1], self.table[k, -1] = m.weights[at].sum(axis=0), len(at)
        self[word] = k
        return k

    def score(self, text: str) -> list[float] | None:
        if len(self) > _CACHE:
            self.clear()
        # the index list comes first: it may grow the table
        at = [self[w] for w in _WORD.findall(text.lower())]
        if not at:
            return None
        *found, n = self.table[at].sum(axis=0).tolist()
        best = int(np.argmax(found))
        mean, spread = self.model.usual[:, best]
        return found if found[best] / n >= mean - UNFAMILIAR - SPREADS * spread / math.sqrt(n * TEMPER) else None


def with_scores(docs: DataFrame, model: TextModel, text: str, out: str) -> DataFrame:
    """``docs`` with each language's log likelihood, null for texts without letters and unfamiliar ones."""
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample
    kind = pa.list_(pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _Scores(sent.value)
        for batch in batches:
            for part in pieces(batch, at):
                found = [scores.score((x or b"").decode()) if sent.value.languages else None for x in utf8(part.column(at))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, kind)], names=[*part.schema.names, out])

    return docs.mapInArrow(frugal(run), schema)


def host_of(address: Column) -> Column:
    """The host of an address, or the whole of a name that isn't one."""
    bare = F.lower(F.regexp_replace(address, "^[A-Za-z][A-Za-z0-9+.-]*://", ""))
    return F.nullif(F.regexp_replace(F.regexp_replace(bare, "[/?#].*$", ""), ":[0-9]*$", ""), F.lit(""))


def suffix_of(host: Column) -> Column:
    return F.nullif(F.regexp_extract(host, "\\.([a-z]{2,})$", 1), F.lit(""))


def declared_in_markup(html: Column) -> Column:
    """The primary language subtag that a page's root element declares."""
    return F.nullif(F.lower(F.regexp_extract(html, "(?i)<html[^>]*\\slang\\s*=\\s*[\"']?([a-z]{2,3})", 1)), F.lit(""))


def _softmax(x: Column) -> Column:
    raised = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    return F.transform(raised, lambda v: v / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))


def fuse(scored: DataFrame, model: TextModel, ll: str, declared: str, address: str, prefix: str = "__l") -> DataFrame:
    """``scored``, a kept table, with columns <prefix>language and <prefix>confidence."""
    n, languages = len(model.languages), model.languages
    out = [F.col(f"`{c}`") for c in scored.columns]
    if not n:
        return scored.select(*out, F.lit("und").alias(f"{prefix}language"), F.lit(0.0).alias(f"{prefix}confidence"))
    said, host, post = f"{prefix}said", f"{prefix}host", f"{prefix}post"
    claim = primary(F.col(f"`{declared}`"))
    claim = F.when(claim.isNotNull(), F.when(claim.isin(*languages), claim).otherwise("other"))
    rows = scored.select(*out, claim.alias(said), host_of(F.col(f"`{address}`")).alias(host))
    alone = rows.where(F.col(ll).isNotNull()).select(said, host, F.transform(ll, lambda x: x * TEMPER).alias("x")).select(said, host, _softmax(F.col("x")).alias(post))
    sums = [F.sum(F.col(post)[k]).alias(f"s{k}") for k in range(n)]
    # at most one row for each language, for other claims and for none
    claims = {r[said]: [r[f"s{k}"] for k in range(n)] for r in alone.groupBy(said).agg(*sums).collect()}
    everything = [sum(c[k] for c in claims.values()) for k in range(n)]
    total = sum(everything)
    world = [(x + 1) / (total + n) for x in everything]
    told = [sum(c[k] for s, c in claims.items() if s is not None) for k in range(n)]
    names = [*languages, "other"]
    weight = {s: [math.log((claims.get(s, [0.0] * n)[k] + 1) / (told[k] + len(names))) for k in range(n)] for s in names}

    hosts = keep(alone.where(F.col(host).isNotNull()).groupBy(host).agg(*sums), "hosts").withColumn("suffix", suffix_of(F.col(host)))
    suffixes = hosts.groupBy(F.coalesce("suffix", F.lit("")).alias("suffix")).agg(*[F.sum(f"s{k}").alias(f"t{k}") for k in range(n)])
    in_suffix, in_host = sum((F.col(f"t{k}") for k in range(n)), F.lit(0.0)), sum((F.col(f"s{k}") for k in range(n)), F.lit(0.0))
    by_suffix = suffixes.select("suffix", *[((F.col(f"t{k}") + STRENGTH * world[k]) / (in_suffix + STRENGTH)).alias(f"p{k}") for k in range(n)])
    priors = hosts.withColumn("suffix", F.coalesce("suffix", F.lit(""))).join(by_suffix, "suffix").select(F.col(host).alias(f"{prefix}h"), F.array(*[F.log((F.col(f"s{k}") + STRENGTH * F.col(f"p{k}")) / (in_host + STRENGTH)) for k in range(n)]).alias(f"{prefix}prior"))
    joined = rows.join(keep(priors, "priors"), rows[host] == F.col(f"{prefix}h"), "left")
    prior = F.coalesce(f"{prefix}prior", F.array(*[F.lit(math.log(x)) for x in world]))
    by_claim = F.element_at(F.create_map(*[y for s in names for y in (F.lit(s), F.array(*map(F.lit, weight[s])))]), F.col(said))
    by_claim = F.coalesce(F.when(F.col(said).isNotNull(), by_claim), F.array(*[F.lit(0.0)] * n))
    evidence = F.zip_with(F.zip_with(F.transform(ll, lambda x: x * TEMPER), prior, lambda a, b: a + b), by_claim, lambda a, b: a + b)
    sure = joined.select(*out, F.when(F.col(ll).isNotNull(), evidence).alias(post)).select(*out, _softmax(F.col(post)).alias(post))
    best = F.array_max(post)
    named = F.element_at(F.array(*map(F.lit, languages)), F.array_position(post, best).cast("int"))
    return sure.select(*out, F.when(best >= LEAST, named).otherwise("und").alias(f"{prefix}language"), F.coalesce(best, F.lit(0.0)).alias(f"{prefix}confidence"))


def _kept(language: Column, wanted: tuple[str, ...] | None) -> Column:
    return language.isin(*wanted) if wanted is not None else language != "und"


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", declared: str = "lang", address: str = "source", model: TextModel | None = None, wanted: tuple[str, ...] | None = None) -> DataFrame:
    """(doc_id, language, confidence, kept) for every row; with ``wanted`` only rows of those languages are kept."""
    model = model or train(docs, text, declared)
    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.col(f"`{declared}`").alias("declared"), F.col(f"`{address}`").alias("address"))
    scored = keep(with_scores(slim, model, "text", "ll").drop("text"), "scores")
    found = fuse(scored, model, "ll", "declared", "address")
    return found.select("doc_id", F.col("__llanguage").alias("language"), F.col("__lconfidence").alias("confidence"), _kept(F.col("__llanguage"), wanted).alias("kept"))


def filter_documents(docs: DataFrame, text: str = "text", declared: str = "lang", address: str = "source", model: TextModel | None = None, wanted: tuple[str, ...] | None = None) -> DataFrame:
    """The rows whose language is known, and among ``wanted`` where those are given, with all their columns."""
    model = model or train(docs, text, declared)
    ll, prefix = fresh(docs, "ll"), fresh(docs, "id")
    scored = keep(with_scores(docs, model, text, ll), "scores")
    found = fuse(scored, model, ll, declared, address, prefix)
    return found.where(_kept(F.col(f"{prefix}language"), wanted)).select(*[F.col(f"`{c}`") for c in docs.columns])


def identify_pages(pages: DataFrame, page_id: str = "page_id", html: str = "html", address: str = "url", wanted: tuple[str, ...] | None = None) -> DataFrame:
    """(page_id, language, confidence, kept) of web pages: their main text, what their markup declares, and their address."""
    texts = html_extract.extract(pages.withColumn("__declared", declared_in_markup(F.col(f"`{html}`"))), html, (page_id, address, "__declared"))
    found = identify(keep(texts, "pages"), page_id, "text", "__declared", address, wanted=wanted)
    return found.withColumnRenamed("doc_id", "page_id")
