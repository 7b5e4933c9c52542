"""Packing, tokens, windows, likelihoods, languages, quality, pages and WARC against plain versions."""

import collections
import gzip
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orrerium.llm import decontaminate, html, language, lm, packing, quality, warc
from orrerium.llm.lattice import Pieces, marginals
from orrerium.llm.queries import oracle_sql
from orrerium.llm.tokens import WordBpe

public = pytest.importorskip("public_tokenizers")
WORDS, PIECES = public.path("word_bpe_49k.json"), public.path("piece_bpe_32k.model")
ODD = ["", "It's Ωmega ΣΑΣ <|endoftext|> x", "a\x1cb\x85c\xa0d", "İ ²3½ ºª don't 'sh ''re _x_ a_b ...!!", "'s", "'re'll' d", "I'M 'D'", "12 3a'4's", "x" * 100, "ß ẞ ŉ", "ÀÉ×÷Ü ÿ", None, "  ", "'", "a'"]


def test_ids_are_the_librarys(spark, sf_dir):
    bpe = WordBpe(WORDS)
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(60).collect()] + ODD
    for text, ids in zip(texts, bpe.encode(pa.array(texts)), strict=True):
        assert ids.tolist() == bpe.library.encode(text or "", add_special_tokens=False).ids


def test_packing_is_gapless_and_tight(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (5, "again")], "doc_id long, text string")).withColumn("length", F.lit(9))
    got = packing.pack_documents(docs, WORDS).toPandas().sort_values(["sequence_id", "offset"])
    assert ((got.groupby("sequence_id")["length"].cumsum() - got["length"]) == got["offset"]).all()
    assert got.groupby("sequence_id")["length"].sum().max() <= 2048
    assert got["sequence_id"].nunique() <= 1.02 * math.ceil(got["length"].sum() / 2048) + 1
    bpe = WordBpe(WORDS)
    for r in docs.limit(20).collect():
        full = np.append(next(bpe.encode(pa.array([r.text]))), 0).astype("<u4")
        mine = got[got["doc_id"] == r.doc_id].sort_values("piece")
        if len(mine) == -(-len(full) // 2048):
            assert mine["ids_crc32"].tolist() == [zlib.crc32(full[s : s + 2048].tobytes()) for s in range(0, len(full), 2048)]


@pytest.mark.parametrize("histogram", [{}, {2048: 3}, {1: 5000}, {1025: 7, 1023: 7}, {700: 100, 600: 50, 3: 10}, {n: 3 for n in range(1, 2049, 7)}])
def test_plan_places_every_document_once(histogram):
    plan = packing.Plan(dict(histogram))
    placed = collections.Counter()
    for n, a, b, _, _ in plan.rows:
        placed[n] += b - a
    assert placed == collections.Counter({k: v for k, v in histogram.items() if v})
    assert plan.used >= math.ceil(sum(k * v for k, v in histogram.items()) / 2048)


def windows_by_hand(docs, items, n=10):
    alnum = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

    def words(t):
        return alnum.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))

    known = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(len(w) - n + 1, 1) if w else 0):
            known[tuple(w[k : k + n])].add(i)
    out = {}
    for d, t in docs:
        w = words(t)
        hit, found = set(), set()
        for size in {len(k) for k in known}:
            for k in range(len(w) - size + 1):
                who = known.get(tuple(w[k : k + size]))
                if who is not None:
                    hit |= set(range(k, k + size))
                    found |= who
        out[d] = (len(w), len(hit), len(found - {None}), bool(hit))
    return out


@pytest.mark.parametrize("bound", [1 << 20, 0])
def test_decontamination(spark, bound):
    rnd = random.Random(2)
    vocab = ["Alpha", "beta", "gamma", "Δelta", "é", "x1"]
    items = [(k, " ".join(rnd.choice(vocab) for _ in range(rnd.randrange(1, 16)))) for k in range(12)] + [(50, None), (51, "..."), (None, "gamma gamma gamma gamma")]
    docs = [(k, " ".join(rnd.choice(vocab) for _ in range(rnd.randrange(0, 60))) + ", " + (rnd.choice(items)[1] or "")) for k in range(30)] + [(90, None), (91, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("h", F.lit(1))
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontaminate.decontaminate(df, spark.createDataFrame(items, "item_id long, text string"), broadcast_bytes=bound).collect()}
    assert got == windows_by_hand(docs, items)


def test_kept_text_has_no_hits(spark):
    docs = spark.createDataFrame([(1, "keep this, Foo bar BAZ! and that")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "foo bar baz")], "item_id long, text string")
    assert decontaminate.decontaminate(docs, items).first().kept == "keep this, ! and that"


def test_lattice_sums_all_segmentations():
    p = Pieces(PIECES)
    known = {r: p.start[k] for k, r in enumerate(p.raw)}
    word = b"theinrea"
    full = b" " + word
    total = 0.0
    for cuts in itertools.product([0, 1], repeat=len(full) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(full)]
        parts = [full[a:b] for a, b in itertools.pairwise(at)]
        if all(x in known for x in parts):
            total += math.exp(sum(known[x] for x in parts))
    buf = np.frombuffer(word, np.uint8)
    ll, counts = marginals(p, p.start, buf, np.array([0]), np.array([len(word)]), np.array([1.0]))
    assert ll[0] == pytest.approx(math.log(total))
    assert sum(c * len(p.raw[k]) for k, c in enumerate(counts)) == pytest.approx(len(full))


def test_likelihoods(spark):
    rnd = random.Random(4)
    docs = [(k, " ".join(rnd.choice(["The", "tion", "inea", "é", f"w{rnd.randrange(40)}"]) for _ in range(rnd.randrange(0, 50)))) for k in range(60)] + [(70, None), (71, ""), (None, "the")]
    got = lm.score(spark.createDataFrame(docs, "doc_id long, text string").withColumn("part", F.lit(1)), PIECES).collect()
    up = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = {d: [*(w for w in re.split(r"[\x20\x09-\x0d]+", (t or "").translate(up)) if w), "<end>"] for d, t in docs}
    held = {d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1 for d in words}
    c = collections.Counter(w for d in words if not held[d] for w in words[d])
    n, v = sum(c.values()), len(c)
    for r in got:
        want = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(words[r.doc_id]), sum(c[w] > 0 for w in words[r.doc_id]), n)
        assert r.base_score == pytest.approx(want) and math.isfinite(r.score) and r.score < 0
    assert lm.score(spark.createDataFrame([], "doc_id long, text string"), PIECES).count() == 0


def scored_by_hand(docs, path):
    """One step of expectation-maximisation on the vocabulary, then each word's paths through its lattice, all of them walked."""
    p = Pieces(path)
    up = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = {d: [w.encode() for w in re.split(r"[\x20\x09-\x0d]+", (t or "").translate(up)) if w] for d, t in docs}
    train = [d for d in words if d is None or zlib.crc32(str(d).encode()) % 5 != 1]
    c = collections.Counter(w for d in train for w in words[d])

    def paths(full):
        for cuts in itertools.product([0, 1], repeat=len(full) - 1):
            at = [0, *(i + 1 for i, x in enumerate(cuts) if x), len(full)]
            yield [full[a:b] for a, b in itertools.pairwise(at)]

    place = {r: k for k, r in enumerate(p.raw)}
    expected = np.zeros(len(p.raw))
    for w, n in c.items():
        all_ = [[place[x] for x in parts] for parts in paths(b" " + w) if all(x in place for x in parts)]
        weight = np.array([math.exp(sum(p.start[k] for k in parts)) for parts in all_])
        for parts, x in zip(all_, weight / weight.sum() * n, strict=True):
            for k in parts:
                expected[k] += x
    ends = len(train)
    logp = np.log((expected + 0.1) / (expected.sum() + 0.1 * len(expected) + ends + 1))
    n, kinds = sum(c.values()) + ends, len(c) + 1
    counts = [*c.values(), ends]
    ones, twos = counts.count(1), counts.count(2)
    discount = ones / (ones + 2 * twos) if ones else 0.5
    out = {}
    for d, ws in words.items():
        total = math.log10(max(ends - discount, 0) / n)
        for w in ws:
            spelt = sum(math.exp(sum(logp[place[x]] for x in parts)) for parts in paths(b" " + w) if all(x in place for x in parts))
            total += math.log10(max(c[w] - discount, 0) / n + discount * kinds / n * spelt)
        out[d] = total
    return out


def test_scores_are_sums_over_all_paths_however_documents_are_dealt(spark):
    rnd = random.Random(9)
    docs = [(k, " ".join(rnd.choice(["The", "tion", "ine", "é", f"w{rnd.randrange(30)}"]) for _ in range(rnd.randrange(0, 20)))) for k in range(40)] + [(70, None), (71, "")]
    want, old = scored_by_hand(docs, PIECES), spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("2", "11"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            for r in lm.score(spark.createDataFrame(docs, "doc_id long, text string"), PIECES).collect():
                assert r.score == pytest.approx(want[r.doc_id], abs=1e-9)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def rare_languages(spark):
    words = {"en": "the house and street with them".split(), "fr": "une maison dans les rues avec".split(), "fi": "yksi talo kadulla heidän kanssaan".split(), "eu": "etxe bat kalean haiekin batera".split()}
    rows, n = [], 0
    for lang, many in (("en", 800), ("fr", 300), ("fi", 4), ("eu", 3)):
        for k in range(many):
            rows.append((n := n + 1, " ".join(words[lang][(k * 7 + j * (1 + k % 4)) % len(words[lang])] for j in range(30)), lang, "h.example"))
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_rare_languages_are_told(spark):
    rows, docs = rare_languages(spark)
    got = language.identify(docs.withColumn("said", F.lit(None).cast("string")), language.train(docs), "said").collect()
    assert len(got) == len(rows) and all(r.language == r.lang and r.accepted for r in got)


def test_languages_beyond_the_bound_stay_as_declared(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANGUAGES", 2)
    _, docs = rare_languages(spark)
    got = language.identify(docs, language.train(docs)).collect()
    assert all(r.language == r.lang and r.accepted for r in got) and {r.text_lang for r in got if r.lang in ("fi", "eu")} == {"other"}


def test_languages_of_held_out_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    train, test = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    blind = test.withColumn("said", F.lit(None).cast("string")).withColumn("host", F.lit(None).cast("string"))
    got = language.identify(blind, language.train(train), "said", "host")
    assert got.where("language = lang").count() >= 0.95 * got.count()
    assert set(test.columns) <= set(got.columns)


def test_language_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, "the and of " * 20, "en", "a.com"), (2, "le la de et " * 20, "fr", "b.fr"), (3, None, "en", None), (4, "  ", None, "x"), (5, "ok", "fr", "b.fr"), (5, "ok", "xx", "b.fr")], "doc_id long, text string, lang string, source string")
    got = language.identify(docs, language.train(docs)).collect()
    assert len(got) == 6
    by = {r.doc_id: r for r in got}
    assert (by[1].language, by[2].language, by[3].accepted, by[4].accepted) == ("en", "fr", False, False)
    empty = docs.limit(0)
    assert language.identify(empty, language.train(empty)).count() == 0


def test_language_replaces_columns_of_its_names_and_leaves_a_text_out_of_its_priors(spark):
    words = {"en": "the house and street with them", "fr": "une maison dans les rues avec"}
    rows = [(k, words[x], x, f"{x}.example", "was", 7) for k, x in enumerate(["en", "fr"] * 40)] + [(100, words["fr"], "en", "lone.example", "was", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, language string, confidence int")
    got = language.identify(docs, language.train(docs))
    assert sorted(got.columns) == sorted({*docs.columns, "text_lang", "accepted"})
    by = {r.doc_id: r for r in got.collect()}
    assert by[0].language == "en" and by[1].language == "fr" and 0 < by[100].confidence < 1
    declared = language.identify(docs.drop("lang"), language.train(docs), declared="language")
    assert declared.count() == len(rows)


def identified_by_hand(rows, names, logp):
    """(language, confidence) of each row: text, declared value and leave-one-out host priors, number by number."""
    n = len(names)
    ll, guess = [], []
    for text, _, _ in rows:
        buf = np.frombuffer((text or "").encode(), np.uint8)
        _, t = language._trigrams(buf, np.array([0, len(buf)]))
        ll.append(logp[:, t].sum(1) * language.TEMPER)
        guess.append(int(ll[-1].argmax()) if len((text or "").strip(" ").encode()) > 2 else None)
    said = [-1 if d is None else names.index(d.lower()) + 1 if d.lower() in names else 0 for _, d, _ in rows]
    table = np.full((n + 2, n), 0.5)
    for g, d in zip(guess, said, strict=True):
        if g is not None:
            table[d, g] += 1
    table = np.log(table / table.sum(0))
    hosts = [(h or "").lower() for _, _, h in rows]
    suffix = [h.rpartition(".")[2] if "." in h else "" for h in hosts]
    whole = np.array([sum(g == k for g in guess) for k in range(n)]) + 1.0
    whole /= whole.sum()
    out = []
    for i in range(len(rows)):
        def counts(keys):
            return np.array([sum(1 for j in range(len(rows)) if j != i and keys[j] == keys[i] and guess[j] == k) for k in range(n)], float)

        parent = (counts(suffix) + language.SMOOTHING * whole) / (counts(suffix).sum() + language.SMOOTHING)
        prior = (counts(hosts) + language.SMOOTHING * parent) / (counts(hosts).sum() + language.SMOOTHING)
        score = ll[i] + table[said[i]] + np.log(prior)
        out.append((names[int(score.argmax())], float(1 / np.exp(score - score.max()).sum())))
    return out


def test_language_is_the_fusion_of_its_evidence(spark):
    rnd = random.Random(2)
    words = {"en": "the house and street with them".split(), "fr": "une maison dans les rues avec".split(), "de": "das haus und die strasse mit".split()}
    rows = []
    for _ in range(90):
        x = rnd.choice(list(words))
        rows.append((" ".join(rnd.choice(words[rnd.choice(list(words)) if rnd.random() < 0.3 else x]) for _ in range(rnd.randrange(0, 5))), rnd.choice([x, x, "EN", None, "xx"]), rnd.choice([f"{x}.example", f"a.{x}", "local", None])))
    rows += [(None, "fr", "a.fr"), ("ok", None, None)]
    docs = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string")
    names, logp = language.train(docs)
    got = {r.doc_id: (r.language, r.confidence) for r in language.identify(docs, (names, logp)).collect()}
    for k, (name, sure) in enumerate(identified_by_hand(rows, names, logp)):
        assert got[k][1] == pytest.approx(sure) and (got[k][0] == name or sure < 0.51)


def test_em_finds_faults_that_do_not_overlap():
    rng = np.random.default_rng(0)
    fault = rng.integers(0, 15, 6000)  # faults 0 to 2, each a fifteenth of all
    v = np.stack([np.where(fault == k, -1, np.where(rng.random(6000) < 0.8, 1, 0)) for k in range(3)], 1)
    noise = rng.integers(0, 2, (6000, 1))
    share, table, post = quality.accuracies(np.hstack([v, noise]), np.ones(6000))
    assert ((post < 0.5) == (fault < 3)).mean() > 0.99
    assert share > 0.65 and abs(table[3, 0] - table[3, 1]).max() < 0.1


def test_quality_against_labels(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").unionByName(spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long"))
    got = quality.score(docs)
    assert got.count() == docs.count()
    told = got.join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    good, bad = told.where("quality = 1"), told.where("quality = 0")
    assert good.where("kept").count() >= 0.97 * good.count()
    assert bad.where("not kept").count() >= 0.6 * bad.count()


PAGE = "<!DOCTYPE html><html><head><title>t</title></head><body><nav>menu</nav><div class='ad'>buy</div>{}<p>Every page says so.</p><footer>foot</footer></body></html>"


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("<article><h1>A &amp; B</h1><p>x\n y<p>z<script>var a='</p>';</script><aside>no</aside></article>", "A & B x y z"),
        ("<main><p>one<br>two</main><div>not this</div>", "one two"),
        ("<article><p><b>bo<i>ld</i></b>er&nbsp;text</p><div class='comments'>hi</div></article>", "bolder text"),
    ],
)
def test_extract(body, want):
    assert html.extract(html.parse(PAGE.format(body)), set()) == want


@pytest.mark.parametrize("page", ["", "<", "<p", "</p></div>", "<div" * 500, "<div>" * 3000 + "x", "<script>never closed", "<!-- never", "a < b & c"])
def test_extract_never_fails(page):
    assert isinstance(html.extract(html.parse(page), {1}), str)


def test_site_templates_go(spark):
    rows = [(k, f"http://Host.example/{k}", PAGE.format(f"<div><p>story {k}</p></div>")) for k in range(20)] + [(90, None, None), (91, "http://host.example/x", ""), (90, None, None)]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("hashes", F.lit(1))).collect()}
    assert got[3] == "story 3" and got[90] == "" and len(got) == 22


def test_templates_within_articles_go(spark):
    box = "<div class='x1'><h3>Join us</h3><p>Ten letters a year.</p></div>"
    more = "<ul><li><a href='/1'>First</a><li><a href='/2'>Second</a></ul>"
    rows = [(k, f"http://host.example/{k}", f"<body><article><div><h2>Why</h2><p>story {k} of <a href='/f'>France</a> it is.</p><ul><li>salt<li>item {k}</ul>{box}</div>{more}</article>") for k in range(8)]
    rows += [(100 + k, f"http://host2.example/copy/{k}", "<body><main><p>One text.</p><p>Under many addresses.</p></main>") for k in range(9)]
    seen = "<p>Seen by all.</p><div>Set apart.</div><blockquote>Said by all.</blockquote><ul><li>salt</ul>"
    rows += [(200 + k, f"http://big.example/{k}", f"<article><p>tale {k}</p>{seen}{more if k < 30 else box if k < 90 else ''}</article>") for k in range(150)]
    rows += [(900, "http://other.example/", f"<article><p>kept</p>{box}</article>")]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Why story 3 of France it is. salt item 3" and got[104] == "One text. Under many addresses."
    texts = "Seen by all. Set apart. Said by all. salt"
    assert got[202] == f"tale 2 {texts} First Second" and got[250] == f"tale 50 {texts}" and got[349] == f"tale 149 {texts}"  # a fifth, two fifths
    assert got[900] == "kept Join us Ten letters a year." and len(got) == len(rows)


def test_articles_lose_nothing(spark, sf_dir):
    """Every page whose article is a document's text gives that text, with template removal as without it."""
    pages = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/pages.parquet")
    plain = {r.page_id: html.extract(html.parse(r.html or ""), set()) for r in pages.collect()}
    docs = {" ".join((r.text or "").split()) for r in spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet").select("text").collect()}
    got = {r.page_id: r.text for r in html.main_text(pages).collect()}
    whole = [k for k, t in plain.items() if any(t[m.end() :] in docs for m in re.finditer(r"^|(?<= )", t[:300]))]
    assert len(whole) > 0.9 * len(plain) and all(got[k] == plain[k] for k in whole)


def test_revisits(spark):
    def row(i, url, ts, kind, status, headers, body):
        return (i, url, ts, kind, status, headers, body)

    rows = [
        row("r1", "http://a.com/x?utm_source=q", 10, "response", 200, {"etag": "1", "content-type": "t", "x": "old"}, b"one"),
        row("r2", "https://www.A.com/x/#f", 20, "response", 200, {"etag": "2", "content-type": "t"}, b"two"),
        row("e", "http://a.com/x", 25, "response", 404, {}, b"no"),
        row("v1", "http://a.com/x", 15, "revisit", 304, {"etag": "1", "x": "new", "content-type": "bad"}, None),
        row("v2", "http://a.com/x", 30, "revisit", 304, {"etag": "1"}, None),
        row("v3", "http://a.com/x", 10, "revisit", 304, {"etag": "1"}, None),
        row("v4", "http://a.com/x", 31, "revisit", 304, None, None),
        row("v5", None, 31, "revisit", 304, {}, None),
    ]
    df = spark.createDataFrame(rows, warc.RECORD)
    got = {r.record_id: r for r in warc.resolve(df).collect()}
    assert {k: v.state for k, v in got.items()} == {"v1": "resolved", "v2": "mismatched", "v3": "unmatched", "v4": "unvalidated", "v5": "unmatched"}
    assert got["v1"].headers == {"etag": "1", "content-type": "t", "x": "new"} and bytes(got["v1"].body) == b"one"
    assert warc.resolve(df.limit(0)).count() == 0


def test_warc_round_trip(spark, tmp_path):
    raw = b"".join(warc.warc_record(f"<{k}>", f"http://a/{k}", "2024-01-01T00:00:00Z", kind, 200, {"etag": str(k)}, body) for k, kind, body in ((1, "response", b"<p>\r\n\r\nx"), (2, "revisit", None)))
    (tmp_path / "a.warc.gz").write_bytes(raw)
    (tmp_path / "b.warc").write_bytes(gzip.decompress(raw)[:-40])
    got = warc.read_warc(spark, f"file://{tmp_path}/a.warc.gz").orderBy("record_id").collect()
    assert [(r.url, r.type, r.headers["etag"], r.body and bytes(r.body)) for r in got] == [("http://a/1", "response", "1", b"<p>\r\n\r\nx"), ("http://a/2", "revisit", "2", None)]
    assert warc.read_warc(spark, f"file://{tmp_path}/b.warc").count() == 1


def test_damaged_warc_files_end_where_they_are_damaged(spark, tmp_path):
    one, two = (warc.warc_record(f"<{k}>", f"http://a/{k}", date, "response", 200, {}, b"x") for k, date in ((1, "no date"), (2, "2024-01-01T00:00:00Z")))
    (tmp_path / "a.warc.gz").write_bytes(one + two[:20] + b"garbage" + two[27:])
    (tmp_path / "b.warc").write_bytes(gzip.decompress(one) + gzip.decompress(two).replace(b"Content-Length: ", b"Content-Length: x"))
    (tmp_path / "c.warc").write_bytes(b"")
    for name, n in (("a.warc.gz", 1), ("b.warc", 1), ("c.warc", 0)):
        got = warc.read_warc(spark, f"file://{tmp_path}/{name}").collect()
        assert [(r.record_id, r.ts) for r in got] == [("<1>", None)][:n]


def test_revisits_match_the_latest_earlier_response(spark):
    rnd = random.Random(6)
    rows = [(f"r{k:03d}", f"http://a.com/{rnd.randrange(6)}", rnd.randrange(40), "response", 200, {"etag": str(rnd.randrange(3))}, b"b") for k in range(120)]
    rows += [(f"v{k:03d}", f"http://a.com/{rnd.randrange(7)}", rnd.randrange(45), "revisit", 304, {"etag": str(rnd.randrange(3))}, None) for k in range(200)]
    got = {r.record_id: (r.state, r.source_id) for r in warc.resolve(spark.createDataFrame(rows, warc.RECORD)).collect()}
    for i, url, ts, kind, _, headers, _ in rows:
        if kind == "revisit":
            earlier = max(((r[2], r[0], r[5]["etag"]) for r in rows if r[3] == "response" and r[1] == url and r[2] < ts), default=None)
            want = ("unmatched", None) if earlier is None else ("resolved" if earlier[2] == headers["etag"] else "mismatched", earlier[1])
            assert got[i] == want


def test_empty_tables_and_very_long_texts(spark):
    long = " ".join(f"word{k}" for k in range(400_000))
    docs = spark.createDataFrame([(1, long), (2, None), (3, "")], "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "score": F.lit(1)})
    items = spark.createDataFrame([(7, "word5 word6 word7 word8 word9 word10 word11 word12 word13 word14 word15")], "item_id long, text string")
    assert {r.doc_id: r.n_hit for r in decontaminate.decontaminate(docs, items).collect()} == {1: 11, 2: 0, 3: 0}
    assert {r.doc_id: r.n_tokens for r in lm.score(docs, PIECES).collect()} == {1: 400_001, 2: 1, 3: 1}
    packed = packing.pack_documents(docs, WORDS).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("length").alias("m")).collect()
    assert {r.doc_id for r in packed} == {1, 2, 3} and max(r.m for r in packed) == 2048
    assert quality.score(docs).count() == 3 and language.identify(docs, language.train(docs)).count() == 3
    none = docs.limit(0)
    assert decontaminate.decontaminate(none, items.limit(0)).count() == packing.pack_documents(none, WORDS).count() == quality.score(none).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html.main_text(pages).count() == 0


def test_sql_names_are_queries():
    from orrerium.llm.queries import queries

    assert set(oracle_sql()) <= set(queries())
