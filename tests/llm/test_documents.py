import math
import random
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import xxhash
from data import documents, frame

from loomfield.llm import graph, langid, pii, quality, shingles, simhash
from loomfield.llm.common import keep

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_print(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORD.findall(low)
    if not w:
        return 0
    s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in nodes:
        for b in nodes:
            if linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_fingerprints_and_components_by_brute_force(spark):
    rows = documents()
    prints = {k: plain_print(r[1]) for k, r in enumerate(rows)}
    found = plain_components(sorted(set(prints.values())), lambda a, b: (a ^ b).bit_count() <= 2)
    least = defaultdict(list)
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[found[prints[k]]].append(r[0])
    want = Counter((r[0], prints[k], min(least[found[prints[k]]], default=None)) for k, r in enumerate(rows))
    got = simhash.near_duplicates(frame(spark)).collect()
    assert Counter((r.doc_id, r.fingerprint % (1 << 64), r.component_id) for r in got) == want
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_ball_edges_link_all_within_two_bits(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(20)]
    prints = {b ^ sum(1 << x for x in rng.sample(range(64), rng.randint(0, 3))) for b in base for _ in range(8)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = simhash.ball_edges(spark.createDataFrame([(p,) for p in signed], "fingerprint long"))
    roots = {r.node: r.component for r in graph.connected_components(edges).collect()}
    want = plain_components(sorted(signed), lambda a, b: ((a ^ b) % (1 << 64)).bit_count() <= 2)
    assert {p: roots.get(p, p) for p in signed} == want


def test_components_of_chains_stars_and_loops(spark, monkeypatch):
    rng = random.Random(5)
    names = rng.sample(range(10**6), 600)
    edges = list(zip(names[:300], names[1:301], strict=True)) + [(names[301], x) for x in names[302:590]] + [(7, 7), (None, 3)]
    want = {}
    for part in (names[:301], names[301:590]):
        want |= {x: min(part) for x in part}
    for limit in (10_000, 5):
        monkeypatch.setattr(graph, "ONE_TASK_EDGES", limit)
        got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
        assert {x: got.get(x, x) for x in want} == want
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_deduplicate_keeps_one_of_each_component(spark):
    docs = frame(spark)
    kept = simhash.deduplicate(docs)
    assert kept.schema == docs.schema
    found = [r.doc_id for r in kept.collect()]
    want = {r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert sorted(found) == sorted(want)


def test_deduplicate_odd_names_and_types(spark):
    rows = [(k, "the very same text of five words and more" if k % 2 else f"text {k} of its own " * 5, {"a": str(k)}) for k in range(8)] + [(1, "the very same text of five words and more", {"a": "1"})]
    docs = spark.createDataFrame(rows, "`my.id` long, `my.text` string, m map<string,string>")
    kept = simhash.deduplicate(docs, "my.id", "my.text")
    assert kept.schema == docs.schema and sorted(r["my.id"] for r in kept.collect()) == [0, 1, 2, 4, 6]
    assert simhash.near_duplicates(docs, "my.id", "my.text").count() == 9


def plain_shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(w[k : k + 5]) for k in range(len(w) - 4)} or ({" ".join(w)} if w else set())


def test_deduplicate_links_similar_shingles(spark):
    rng = random.Random(12)
    base = [[f"w{rng.randint(0, 3000)}" for _ in range(150)] for _ in range(12)]
    texts = [" ".join(w) for w in base]
    for w in base[:6]:
        for changes in (1, 2, 3, 4, 5, 8):
            new = list(w)
            for k in rng.sample(range(150), changes):
                new[k] = f"x{rng.randint(0, 10**6)}"
            texts.append(" ".join(new))
    texts += [" ".join([*base[7][:40], *base[8][:120]]), "one two", "one two", ""]
    rng.shuffle(texts)
    prints, sets = [plain_print(t) for t in texts], [plain_shingles(t) for t in texts]

    def linked(a, b):
        return (prints[a] ^ prints[b]).bit_count() <= 2 or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) > 0

    docs = frame(spark, [(k, t, *[None] * 8) for k, t in enumerate(texts)])
    found = {r.doc_id for r in simhash.deduplicate(docs, similar=True).collect()}
    assert found == set(plain_components(range(len(texts)), linked).values())
    assert found < {r.doc_id for r in simhash.deduplicate(docs).collect()}


def test_large_bands_lose_no_link(spark, monkeypatch):
    rng = random.Random(21)
    base = [f"w{rng.randint(0, 3000)}" for _ in range(120)]
    texts = [" ".join(base)]
    for _ in range(160):
        new = list(base)
        for k in rng.sample(range(120), rng.choice((0, 1, 2, 3, 4, 6, 9, 14))):
            new[k] = f"x{rng.randint(0, 40)}"
        texts.append(" ".join(new))
    # texts that share a passage and little else, and pairs of near copies among them
    for _ in range(60):
        own = [f"y{rng.randint(0, 10**6)}" for _ in range(60)]
        texts += [" ".join([*base[:90], *own]), " ".join([*base[:90], *own[:-2], "z"])]
    texts = sorted(set(texts))
    rng.shuffle(texts)
    sets = [plain_shingles(t) for t in texts]
    want = plain_components(range(len(texts)), lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    docs = spark.createDataFrame([(k, k, t) for k, t in enumerate(texts)], "c long, t long, text string")
    none = spark.createDataFrame([], "a long, b long")
    for most in (64, 8, 1):
        monkeypatch.setattr(shingles, "MOST", most)
        monkeypatch.setattr(shingles, "CHUNK_SHINGLES", 200_000 if most == 64 else 2000)
        roots = {r.node: r.component for r in graph.connected_components(shingles.edges(docs, none)).collect()}
        assert {k: roots.get(k, k) for k in range(len(texts))} == want
    assert 20 < len(set(want.values())) < len(texts) - 50


def plain_quality(text):
    w = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    c, covered = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7)), set()
    for k in range(len(w) - 7):
        if c[tuple(w[k : k + 8])] > 1:
            covered.update(range(k, k + 8))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_quality_metrics_and_verdicts(spark):
    extra = ["a b c d e f g h " * 3 + "tail", "x\nx\n \n x\nx", "One LINE of words " * 9, "## ** $$ %% " * 9, "WE ARE SHOUTING HERE " + " ".join(f"W{k}X" for k in range(30)), "a1 " * 7 + "b2 " * 7 + "c3 " * 7]
    rows = documents() + [(900 + k, t, *[None] * 8) for k, t in enumerate(extra)]
    got = quality.assess(frame(spark, rows)).collect()
    want = Counter((r[0], *plain_quality(r[1])) for r in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (not r.base_failed and r.failed_rule is None)
    assert not any(r.kept for r in got if r.doc_id in (903, 904, 905))
    docs = frame(spark, rows)
    kept = quality.filter_documents(docs)
    assert kept.schema == docs.schema
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.kept)
    assert quality.assess(frame(spark, [])).count() == 0


def test_order_of_rules_by_rejections_per_cost(spark):
    texts = ["word " * 8] * 5 + ["WE SHOUT " + " ".join(f"W{k}X" for k in range(30))] * 30 + [" ".join(f"a{k} ##" for k in range(40))] * 3 + [" ".join(f"plain{k}" for k in range(60))] * 60
    docs = frame(spark, [(k, t, *[None] * 8) for k, t in enumerate(texts)])
    left, paid, rest, want = texts, set(), list(quality.RULES), []
    got = {(r.doc_id, r.failed_rule) for r in quality.assess(docs, rules=(quality.RULES[4],)).collect()}
    rejects = {"capitals": {texts[k] for k, x in got if x}}
    for rule in quality.RULES:
        rejects[rule.name] = {texts[r.doc_id] for r in quality.assess(docs, rules=(rule,)).collect() if r.failed_rule}
    while rest:
        cost = {r.name: 1 + sum(map(len, left)) * sum(quality.COSTS[m] for m in quality.needs(r) - paid) for r in rest}
        best = max(rest, key=lambda r: sum(t in rejects[r.name] for t in left) / cost[r.name])  # noqa: B023
        want.append(best.name)
        rest.remove(best)
        paid |= quality.needs(best)
        left = [t for t in left if t not in rejects[best.name]]
    for _ in range(2):
        assert [r.name for r in quality.order_rules(docs)] == want
    assert want[0] == "capitals"
    assert [r.name for r in quality.order_rules(frame(spark, []))] == [r.name for r in quality.RULES]


def plain_kept(text):
    """Whether no rule rejects: the rules' thresholds over plain counts."""
    text = text or ""
    n, chars, symbols, dup, repeats = plain_quality(text)
    w = WORD.findall(text)
    lines = sum(1 for line in text.split("\n") if WORD.search(line))
    capitals, letters = (sum(1 for c in text if ok(unicodedata.category(c))) for ok in (lambda c: c == "Lu", lambda c: c[0] == "L"))
    stutters = sum(a == b for a, b in zip(w, w[1:], strict=False))
    return not (n < 20 or 100 * repeats > 30 * n or 10 * symbols > n or 2 * dup > lines or 10 * capitals > 4 * chars or 10 * stutters > 3 * n or chars < 2 * n or chars > 15 * n or 10 * letters < 4 * chars)


def test_verdicts_by_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    found = {r.doc_id: r.kept for r in quality.assess(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    assert found == {r.doc_id: plain_kept(r.text) for r in rows}
    assert 0 < sum(found.values()) < len(found)


KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    d = [int(c) for c in digits][::-1]
    return (sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in match.split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def plain_spans(text):
    return [(k, m.start(), m.end()) for k, p in KINDS.items() for m in re.finditer(p, text or "") if valid(k, m[0])]


PERSONAL = [
    "mail a.b+c@d-e.co.uk, x@y, _p@q.r_s@t.u and a@b.c.d@e.f; 🙂 me@x.org",
    "1.2.3.4 256.1.1.1 01.002.3.255 1.2.3.4.5.6.7.8 12.1",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112, 5500000000000004 and 1 2 3",
    "+1 (743) 555-3824 +49 30 1234567 +1-2 +123456789012345678 ++1 234 567 890",
    "+4111 1111 1111 1111 a@b.co" * 300,
    "9" * 20_000 + "@" + ".".join("ab" for _ in range(9000)),
    "%" * 5000 + "." * 5000,
]


def test_base_spans_by_brute_force(spark):
    rng = random.Random(6)
    texts = PERSONAL + ["".join(rng.choice("0123456789 -.+()@ab_%é🙂") for _ in range(rng.randint(0, 80))) for _ in range(600)]
    rows = [(k, t, *[None] * 8) for k, t in enumerate(texts)] + [(None, None, *[None] * 8)]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.base] for r in pii.find(frame(spark, rows)).collect()}
    assert got == {r[0]: plain_spans(r[1]) for r in rows}
    assert pii.find(frame(spark, [])).count() == 0


def test_disclosing_terms_and_sanitised_texts(spark):
    rng = random.Random(8)
    common = ["plain", "words", "about", "nothing", "much", "that", "many", "texts", "hold"]
    rows = [(k, " ".join(rng.choice(common) for _ in range(30)), *[None] * 8) for k in range(80)]
    rows += [(100 + k, f"plain words Zanzibarian about boss@corp.example that {rng.choice(common)} {k} hold", *[None] * 8) for k in range(4)]
    rows += [(200, "Nothing here", *[None] * 8), (201, None, *[None] * 8), (202, "call +49 30 1234567 now", *[None] * 8)]
    found = {r.doc_id: [(s.kind, s.value) for s in r.terms] for r in pii.find(frame(spark, rows)).collect()}
    assert all(("gone", "Zanzibarian") in found[100 + k] for k in range(4))
    assert not any("plain" == v for k in range(4) for _, v in found[100 + k])
    docs = frame(spark, rows)
    clean = pii.sanitise(docs)
    assert clean.schema == docs.schema
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert texts[200] == "Nothing here" and texts[201] is None and texts[202] == "call [PHONE] now"
    assert texts[100].startswith("plain words  about [EMAIL] that") and len(texts) == len(rows)
    assert all(texts[k] == rows[k][1] for k in range(80))


def test_terms_disclose_far_off_and_in_two_texts(spark):
    rng = random.Random(14)
    common = ["plain", "words", "about", "nothing", "much", "that", "many", "texts", "hold"]

    def filler():
        return " ".join(rng.choice(common) for _ in range(60))

    texts = [filler() for _ in range(80)] + [f"Lee {filler()} rare@corp.example {filler()}" for _ in range(2)] + [f"{filler()} once@corp.example Single"]
    found = {r.doc_id: {(s.kind, s.value) for s in r.terms} for r in pii.find(frame(spark, [(k, t, *[None] * 8) for k, t in enumerate(texts)])).collect()}
    assert [found[k] for k in (80, 81, 82)] == [{("gone", "Lee")}, {("gone", "Lee")}, set()]
    assert not any(found[k] for k in range(80))


def plain_entities(text):
    found = set()
    for kind, a, b in plain_spans(text):
        value = text[a:b]
        digits = re.sub("[^0-9]", "", value)
        found |= {f"{kind}:{value}", f"{kind}~" + {"email": value.split("@")[-1].lower(), "ip": ".".join(value.split(".")[:2]), "card": digits[:6], "phone": digits[:4]}[kind]}
    return found


def plain_terms(texts):
    """Each text's disclosing terms, by the definition: PMI(e, t) >= IC(e) / ALPHA over documents, pairs in two different texts or more."""
    n, held = len(texts), [plain_entities(t) for t in texts]
    inside = [set(re.findall(r"[^\W\d_]+", t)) for t in texts]
    bare = [set(re.findall(r"[^\W\d_]+", re.sub(r"\S*@\S*", " ", t))) for t in texts]
    n_t = Counter(x for w in inside for x in w)
    n_e, pairs, different = Counter(), Counter(), defaultdict(set)
    for k in range(n):
        for e in held[k]:
            n_e[e] += 1
            different[e].add(texts[k])
            for x in bare[k]:
                pairs[e, x] += 1
                different[e, x].add(texts[k])
    flagged = set()
    for (e, x), c in pairs.items():
        if len(different[e, x]) >= 2:
            pmi, ic = math.log2(n * c / (n_e[e] * n_t[x])), math.log2(n / n_e[e])
            if pmi >= ic / pii.ALPHA - 1e-9:
                flagged.add((e, x))
    return [{x for e in held[k] for x in bare[k] if (e, x) in flagged} for k in range(n)]


def test_terms_by_plain_pmi(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    # classes and values of our own beside the table's
    rng = random.Random(3)
    words = [w for _, t in rows[:50] for w in t.split()[:20]]
    for k in range(60):
        said = " ".join(rng.choice(words) for _ in range(40))
        rows.append((10**6 + k, f"{said} Quibbledom user{k % 7}@corp{k % 3}.example {said[:50]} from 10.{k % 4}.3.{k}"))
    want = plain_terms([t for _, t in rows])
    found = {r.doc_id: {s.value for s in r.terms} for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {k: w for (k, _), w in zip(rows, want, strict=True)}
    assert sum(map(bool, want)) >= 50


def test_only_terms_that_may_disclose_meet_entities(spark, monkeypatch):
    # with tables too large for broadcasts: words that all documents hold don't multiply by the entities of a text
    kept, keep = {}, pii.keep
    monkeypatch.setattr(pii, "keep", lambda df, name: kept.setdefault(name, keep(df, name)))
    monkeypatch.setattr(pii, "few", lambda df: df)
    monkeypatch.setattr(pii, "FEW_ROWS", 0, raising=False)
    texts = [f"all of these words stand here {'too ' * (k % 5)}" for k in range(300)]
    texts += [f"all of these words stand here Lee me@a.example +49 30 {k}234567 1.2.3.{k}" for k in range(3)] + ["here Lee and alone 9.9.9.9"]
    found = {r.doc_id: {s.value for s in r.terms} for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert found == dict(enumerate(plain_terms(texts))) and found[300] == {"Lee"}
    assert {r.t for r in kept["context"].select("t").distinct().collect()} == {"Lee"}


def test_terms_of_the_whole_table(spark):
    found = pii.find(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    assert found.where("size(terms) > 0").count() > 0
    assert found.where("size(terms) > 0 and size(base) = 0").count() == 0


def test_languages_of_awkward_rows(spark):
    rng = random.Random(9)
    say = {"en": "the house and they were with that thing which would".split(), "de": "das Haus und sie waren mit dem Ding welches würde".split()}
    rows = [(k, " ".join(rng.choice(say[lang]) for _ in range(40)), lang, f"https://h{k % 4}.example.{'de' if lang == 'de' else 'com'}/x?y#z", *[None] * 6) for k in range(60) for lang in [rng.choice(["en", "de"])]]
    rows += [(70, None, "en", None, *[None] * 6), (71, " 123 !", None, "", *[None] * 6), (72, " ".join(say["de"]), "en", "h", *[None] * 6), (None, " ".join(say["en"]), None, None, *[None] * 6), rows[0]]
    docs = frame(spark, rows)
    got = Counter((r.doc_id, r.language, r.kept) for r in langid.identify(docs).collect())
    want = Counter((r[0], r[2], True) for r in rows if r[0] is not None and r[0] < 60 or r[0] == 0)
    want += Counter([(70, "und", False), (71, "und", False), (72, "de", True), (None, "en", True)])
    assert got == want
    kept = langid.filter_documents(docs)
    assert kept.schema == docs.schema and kept.count() == len(rows) - 2
    assert langid.identify(frame(spark, [])).count() == 0
    unlabelled = [(1, "some text", None, None, *[None] * 6)]
    assert [r.language for r in langid.identify(frame(spark, unlabelled)).collect()] == ["und"]


def test_unfamiliar_unwanted_and_dirty_labels(spark):
    rng = random.Random(10)
    say = {"en": "the house and they were with that thing which would".split(), "de": "das Haus und sie waren mit dem Ding welches würde".split()}
    labels = {"en": ["en", "en-US", " EN_gb"], "de": ["de", "de-AT", "?"]}
    rows = [(k, " ".join(rng.choice(say[lang]) for _ in range(40)), rng.choice(labels[lang]), None, *[None] * 6) for k in range(80) for lang in [rng.choice(["en", "de"])]]
    rows += [(90, "это совсем другой язык и другие буквы " * 5, "en", None, *[None] * 6), (91, "日本語の文章です。" * 9, None, None, *[None] * 6), (92, " ".join(say["de"]), "xx-yy", None, *[None] * 6)]
    docs = frame(spark, rows)
    assert langid.train(docs).languages == ("de", "en", "xx")
    docs = frame(spark, rows[:-1])
    assert langid.train(docs).languages == ("de", "en")
    found = {r.doc_id: (r.language, r.kept) for r in langid.identify(docs).collect()}
    assert found[90] == found[91] == ("und", False)
    assert all(found[r[0]] == ("de" if "Haus" in r[1] or "das" in r[1] else "en", True) for r in rows[:80])
    only = {r.doc_id for r in langid.identify(docs, wanted=("de",)).where("kept").collect()}
    assert only == {k for k, (lang, _) in found.items() if lang == "de"}
    assert {r.doc_id for r in langid.filter_documents(docs, wanted=("de",)).collect()} == only


def plain_fusion(rows, model):
    """(language, confidence) of (log likelihoods or None, claim or None, host or None) rows."""
    n, names = len(model.languages), [*model.languages, "other"]

    def softmax(x):
        e = [math.exp(v - max(x)) for v in x]
        return [v / sum(e) for v in e]

    post = [softmax([v * langid.TEMPER for v in ll]) if ll else None for ll, *_ in rows]
    claims = [None if c is None else c if c in model.languages else "other" for _, c, _ in rows]
    suffix = [(re.search(r"\.([a-z]{2,})$", h or "") or ["", ""])[1] for *_, h in rows]

    def total(chosen):
        return [sum(p[k] for p, ok in zip(post, chosen, strict=True) if p and ok) for k in range(n)]

    world = total([True] * len(rows))
    world = [(x + 1) / (sum(world) + n) for x in world]
    told = total([c is not None for c in claims])
    out = []
    for (ll, _, host), claim, end in zip(rows, claims, suffix, strict=True):
        if not ll:
            out.append(("und", 0.0))
            continue
        prior = world
        if host:
            in_suffix = total([h is not None and x == end for (*_, h), x in zip(rows, suffix, strict=True)])
            prior = [(x + langid.STRENGTH * p) / (sum(in_suffix) + langid.STRENGTH) for x, p in zip(in_suffix, prior, strict=True)]
            in_host = total([h == host for *_, h in rows])
            prior = [(x + langid.STRENGTH * p) / (sum(in_host) + langid.STRENGTH) for x, p in zip(in_host, prior, strict=True)]
        said = total([c == claim for c in claims])
        evidence = [v * langid.TEMPER + math.log(p) + (math.log((s + 1) / (t + len(names))) if claim else 0.0) for v, p, s, t in zip(ll, prior, said, told, strict=True)]
        sure = softmax(evidence)
        best = max(range(n), key=lambda k: sure[k])
        out.append((model.languages[best] if sure[best] >= langid.LEAST else "und", sure[best]))
    return out


def test_fusion_by_plain_sums(spark):
    rng = random.Random(17)
    model = langid.TextModel(("de", "en", "fr"), {}, np.zeros((1, 3)), np.zeros((2, 3)))
    rows = []
    for k in range(120):
        ll = [rng.uniform(-40, -30) for _ in range(3)] if k % 9 else None
        rows.append((ll, rng.choice([None, "de", "en", "it"]), rng.choice([None, "a.example.de", "b.example.de", "c.example.fr", "plain"])))
    table = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, ll array<double>, said string, address string")
    got = sorted((r.k, r["__llanguage"], r["__lconfidence"]) for r in langid.fuse(keep(table), model, "ll", "said", "address").collect())
    for (_, language, confidence), (want, sure) in zip(got, plain_fusion(rows, model), strict=True):
        assert language == want and abs(confidence - sure) < 1e-9


def test_languages_of_pages(spark):
    rng = random.Random(19)
    say = {"en": "the house and they were with that thing which would".split(), "de": "das Haus und sie waren mit dem Ding welches würde".split()}
    pages = []
    for k in range(60):
        lang = rng.choice(["en", "de"])
        pages.append((k, f"https://h{k % 3}.example.{'de' if lang == 'de' else 'com'}/x", f"<html lang='{lang if k % 5 else 'de'}'><body><nav><a href=/>start</a></nav><article><p>{' '.join(rng.choice(say[lang]) for _ in range(40))}.</p></article></body>", lang))
    pages += [(100, None, None, "und"), (101, "u", "<html><body></body>", "und")]
    got = {r.page_id: r.language for r in langid.identify_pages(spark.createDataFrame(pages, "page_id long, url string, html string, truth string")).collect()}
    assert got == {p[0]: p[3] for p in pages}


def test_languages_of_few_texts_with_many_copies(spark):
    say = {"en": "the house and they were with that thing which would", "de": "das Haus und sie waren mit dem Ding welches würde", "fr": "la maison et ils étaient avec cette chose qui serait"}
    rows = [(k, f"{say[lang]} {k % 3}", lang, None, *[None] * 6) for k in range(9000) for lang in [("en", "de", "fr")[min(2, k % 100)] if k % 100 < 2 else "fr"]]
    docs = frame(spark, rows)
    for most in (4, 2000):
        model = langid.train(docs, rows=most)
        assert model.languages == ("de", "en", "fr")
    assert langid.identify(docs).where("not kept").count() == 0


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    train, rest = docs.where("doc_id < 100"), docs.where("doc_id >= 100")
    model = langid.train(train)
    found = langid.identify(rest.withColumn("declared", rest.lang.cast("string")), declared="declared", model=model).join(rest, "doc_id")
    assert found.where("language = lang").count() >= 0.98 * found.count()


def test_page_evidence(spark):
    from pyspark.sql import functions as F

    page = spark.createDataFrame([("<HTML class=x lang='de-AT'>", "https://a.b.Example.de:80/p?q")], "h string, u string")
    r = page.select(langid.declared_in_markup(F.col("h")).alias("d"), langid.host_of(F.col("u")).alias("o"), langid.suffix_of(langid.host_of(F.col("u"))).alias("s")).first()
    assert (r.d, r.o, r.s) == ("de", "a.b.example.de", "de")
