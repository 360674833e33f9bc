"""Each operator against a plain version, on small whole tables and on planted odd cases."""

import base64
import hashlib
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tracewell.llm import bpe, decontaminate, html_text, language_id, ngram_join, registry, suffix_dedup, toxicity, url_filter, vector_join, warc

SF = brute.SF


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


@pytest.fixture(scope="module")
def documents(spark):
    return rows(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id", "text")


def frame(spark, data, schema):
    """With an extra column whose name clashes with the operators' own."""
    return spark.createDataFrame(data, schema).withColumn("key", F.lit("x")).withColumn("n", F.lit(7)).withColumn("host", F.lit("h"))


def test_language_held_out_accuracy(spark):
    got = registry.op1_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == 1000
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.98
    assert got.score.between(0, 1).all()


def test_language_odd_cases(spark):
    base = [(i, t, l) for i in range(9) for t, l in (("the cat and the dog were here", "en"), ("der hund und die katze waren hier", "de"))]
    odd = [(None, "the dog", None), (101, None, "en"), (102, "", "en"), (103, "123 !?", "de"), (104, "the dog", None), (104, "the dog", None)]
    got = {r.doc_id: r for r in language_id.identify(frame(spark, base + odd, "doc_id long, text string, lang string")).collect()}
    assert [got[i].lang_pred for i in (101, 102, 103)] == ["und"] * 3 and got[104].lang_pred == "en" and got[None].held_out is False
    mixed = "the cat and the dog were here " * 4 + "der hund und die katze waren hier " * 5
    chosen = language_id.identify(frame(spark, [*base, (200, mixed, None)], "doc_id long, text string, lang string")).filter("doc_id = 200").first()
    assert chosen.lang_pred == "de" and chosen.languages.count(":") == 2
    assert language_id.identify(frame(spark, [], "doc_id long, text string, lang string")).count() == 0


def test_toxicity_catches_and_spares(spark):
    d = "/root/testdata/sf0.1"
    got = registry.op2_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic"), "doc_id").filter("held_out").toPandas()
    bad, good = got[got.toxic == 1], got[got.toxic == 0]
    assert (bad.predicted == 1).mean() > 0.8 and (good.predicted == 0).mean() > 0.99


def test_toxicity_interaction_and_odd_cases(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(40)]
    data, labels = [], []
    for i in range(600):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        data.append((i, " ".join(rng.sample(words, 8) + ["insultword"] * a + ["groupname"] * b)))
        labels.append((i, int(a and b)))
    data += [(900, None), (901, ""), (902, ""), (None, "x")]
    got = {r.doc_id: r for r in toxicity.detect(frame(spark, data, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (5000, 1), (3, None)], "doc_id long, toxic int")).collect()}
    wrong = sum(got[i].predicted != y for i, y in labels)
    assert wrong <= 6 and got[900].score == got[901].score
    none = toxicity.detect(frame(spark, data, "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.predicted for r in none.collect()} == {0}


def test_url_rules(spark):
    urls = ["http://x.example.com/en/1", "https://www.example.com/en/", "https://example.com/de?x", "http://a.net/es/1", "http://A.NET/fr/", "http://a.net", "net/es/", None, "", "http://com/", "http://xcom/", "http://casino-win.org/", "http://m.free-bets.net:80/x", "http://x.org/a/wp-login.php", "ftp://Com?x://y", "http://example.com#/en/", "http://a.b/://com/"]
    pages = frame(spark, [(i, u) for i, u in enumerate(urls)] + [(None, urls[0])], "page_id long, url string")
    a = sorted(map(str, url_filter.judge(pages, url_filter.CONTRACT + url_filter.PATTERNS).collect()))
    b = sorted(map(str, url_filter.judge(pages, url_filter.CONTRACT + url_filter.PATTERNS, inline=0).collect()))
    assert a == b
    got = {r.page_id: r for r in url_filter.judge(pages, url_filter.CONTRACT + url_filter.PATTERNS).collect()}
    assert [got[i].rule for i in range(6)] == ["example.com/en/", "www.example.com/en/", "com/", "net/es/", "net/fr/", None]
    assert [got[i].verdict for i in range(6)] == ["block", "allow", "allow", "block", "block", "allow"]
    assert (got[6].host, got[6].path, got[7].host) == ("", "", "") and got[9].rule == "com/" and got[10].rule is None
    assert [got[i].verdict for i in (11, 12, 13)] == ["block"] * 3 and got[14].host == "com" and got[14].rule is None
    assert got[16].host == "a.b" and got[16].path == "/://com/"


def test_ngram_groups_match_brute_force(spark, documents):
    got = sorted(rows(registry.op5_ngram_jaccard(spark, SF), "doc_id", "n_shingles", "component_id"))
    assert got == brute.jaccard_groups(documents)


def test_ngram_groups_with_hot_blocks(spark):
    rng = random.Random(4)
    line = " ".join(f"c{i}" for i in range(40))
    data = [(i, line + " " + " ".join(f"u{rng.randrange(30)}" for _ in range(rng.randrange(12)))) for i in range(900)]
    base = [f"w{i}" for i in range(120)]
    for i in range(900, 1300):
        w = list(base)
        for _ in range(rng.randrange(8)):
            w[rng.randrange(120)] = f"z{rng.randrange(999)}"
        data.append((i, " ".join(w)))
    data += [(2000, None), (2001, ""), (2002, " \t"), (2003, "One two"), (2004, "one TWO"), (2005, "one two three"), (2006, "x " * 5000), (2007, "x x x x x")]
    rng.shuffle(data)
    got = sorted(rows(ngram_join.groups(frame(spark, data, "doc_id long, text string")), "doc_id", "n_shingles", "component_id"))
    assert got == brute.jaccard_groups(data)
    assert ngram_join.groups(frame(spark, [], "doc_id long, text string")).count() == 0


def test_signature_tree_loses_no_link():
    rng = np.random.RandomState(2)
    base = rng.randint(0, 1 << 62, 400).astype(np.uint64)
    sets = []
    for _ in range(150):
        keep = base[rng.rand(400) < rng.choice([0.8, 0.95, 1.0])]
        sets.append(np.unique(np.concatenate((keep, rng.randint(0, 1 << 62, rng.randint(1, 60)).astype(np.uint64)))))
    raw = [s.tobytes() for s in sets]
    tree = ngram_join.SignatureTree(np.array([len(s) for s in sets]), np.arange(150), [ngram_join.signature(r) for r in raw])
    i, j, _ = tree.pairs()
    found = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    assert {(a, b) for a in range(150) for b in range(a + 1, 150) if ngram_join.similar(raw[a], raw[b])} <= found


def thue_morse(n=1024):
    """A word and its complement, which any polynomial hash modulo 2**64 takes for equal."""
    word = "".join("ab"[k.bit_count() & 1] for k in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_that_polynomial_hashes_confuse(spark):
    import public_tokenizers as P

    x, y = thue_morse()
    docs = [(1, x), (2, y), (3, f"{x} one two three four five"), (4, f"{y} one two three four five"), (5, x)]
    df = frame(spark, docs, "doc_id long, text string")
    assert sorted(rows(ngram_join.groups(df), "doc_id", "n_shingles", "component_id")) == brute.jaccard_groups(docs)
    items = [("i", x)]
    got = decontaminate.find(df, frame(spark, items, "item_id string, text string"))
    assert sorted(rows(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) == brute.contamination(docs, items)
    assert sorted(rows(suffix_dedup.find(df), *REPEAT)) == brute.repeats(docs)
    own = bpe.load(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    assert [own.decode(i).decode() for i in own.encode_batch([x, y, x + " " + y])] == [x, y, x + " " + y]


def test_equal_hashes_do_not_make_equal_pieces(monkeypatch):
    raw = b"abcabcxyzab"
    monkeypatch.setattr(bpe, "span_hash", lambda buf, starts, ends: np.zeros(len(starts), np.uint64))
    starts = np.array([0, 3, 6, 9])
    first, inverse = bpe._distinct(np.frombuffer(raw + bytes(8), np.uint8), starts, np.append(starts[1:], 11))
    assert [raw[s : s + n] for s, n in zip(starts[first][inverse], (3, 3, 3, 2), strict=True)] == [b"abc", b"abc", b"xyz", b"ab"] and len(first) == 3


def test_sets_alone_and_ranges(spark, monkeypatch):
    """Few tokens a run and a range give the same groups."""
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    monkeypatch.setattr(ngram_join, "HEAVY", 4)
    rng = random.Random(8)
    base = [[f"b{k}w{i}" for i in range(60)] for k in range(3)]
    data = []
    for i in range(400):
        w = list(base[i % 3])
        for _ in range(rng.randrange(4)):
            w[rng.randrange(60)] = f"z{rng.randrange(50)}"
        data.append((i, " ".join(w)))
    data += [(500 + i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(80))) for i in range(50)] + [(600 + i, data[7][1]) for i in range(40)]
    rng.shuffle(data)
    got = sorted(rows(ngram_join.groups(frame(spark, data, "doc_id long, text string")), "doc_id", "n_shingles", "component_id"))
    assert got == brute.jaccard_groups(data)


def test_contamination_matches_brute_force(spark, documents):
    items = rows(spark.read.parquet(f"{SF}/benchmark.parquet"), "item_id", "text")
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = brute.contamination(documents, items)
    assert sorted(rows(registry.op6_decontamination(spark, SF), *cols)) == want and any(r[5] for r in want)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    parts = decontaminate.find(spark.read.parquet(f"{SF}/documents.parquet"), bench, bench_words=300, shard_bytes=100_000)
    assert sorted(rows(parts, *cols)) == want


def test_contamination_odd_cases(spark):
    p = " ".join(f"p{i}" for i in range(20))
    items = [("b", p), ("a", p), ("a", p), ("s", "two words"), ("e", ""), ("n", None)]
    docs = [(1, None), (2, ""), (3, f"x {p} y {p}"), (3, f"x {p} y {p}"), (4, "Two, WORDS two words"), (5, "p1 " * 3000 + p), (6, p + " " + p[:-3])]
    got = sorted(rows(decontaminate.find(frame(spark, docs, "doc_id long, text string"), frame(spark, items, "item_id string, text string")), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"))
    assert got == brute.contamination(docs, items)
    none = decontaminate.find(frame(spark, docs, "doc_id long, text string"), frame(spark, [], "item_id string, text string"))
    assert {r.n_hit for r in none.collect()} == {0}


def test_warc_round_trip(spark):
    big = "<p>" + "ab" * 700 + "</p>"
    data = [(1, "http://a/", big), (2, "http://b/\r\nx", big), (3, None, big), (4, "u", None), (5, "u", ""), (6, "u", "small"), (7, "u", "small"), (8, "u", "é" * 600), (None, "u", big), (9, "u", "WARC/1.1\r\n\r\n" * 200)]
    got = {r.page_id: r for r in warc.round_trip(frame(spark, data, "page_id long, url string, html string").repartition(3)).collect()}
    assert len(got) == len(data)
    for i, _, h in data:
        b = (h or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(b), hashlib.sha1(b).hexdigest())
        kind = ("revisit", 3) if h == big and i != 3 else ("response", None)
        assert (got[i].record_type, got[i].refers_to) == kind
        assert got[i].payload is None if kind[0] == "revisit" else bytes(got[i].payload) == b
    assert warc.round_trip(frame(spark, [], "page_id long, url string, html string")).count() == 0


def test_warc_matches_pages(spark):
    got = registry.op7_warc(spark, SF)
    want = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("b"), F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("d"))
    assert sorted(rows(got, "page_id", "payload_bytes", "payload_digest")) == sorted(map(tuple, want.collect()))


def embed(vectors):
    x = np.array([v for _, v in vectors])
    c = (x @ x.T) / np.outer(np.sqrt((x * x).sum(1)), np.sqrt((x * x).sum(1)))
    f, n = brute.Find(), (c >= 0.9).sum(1) - 1
    for i, j in zip(*np.nonzero(c >= 0.9), strict=True):
        f.join(vectors[i][0], vectors[j][0])
    return sorted((v, int(n[k]), f.root(v), f.root(v) == v) for k, (v, _) in enumerate(vectors))


def test_vectors_match_brute_force(spark):
    cols = ("vec_id", "n_links", "component_id", "kept")
    for d in (SF, "/root/testdata/sf0.1"):
        vectors = rows(spark.read.parquet(f"{d}/embeddings.parquet"), "vec_id", "embedding")
        assert sorted(rows(registry.op8_embedding_near_dedup(spark, d), *cols)) == embed(vectors)


def test_vectors_dense_and_odd(spark):
    rng = np.random.RandomState(5)
    centre = rng.randn(6, 12)
    data = [(i, (centre[i % 6] + rng.randn(12) * rng.choice([0.05, 0.3])).tolist()) for i in range(900)]
    data += [(1000 + i, data[3][1]) for i in range(300)]
    odd = [(5000, None), (5001, []), (5002, [0.0] * 12), (5003, [1.0] * 11 + [float("nan")]), (5004, [1.0] * 11 + [None]), (5005, [1.0, 2.0])]
    got = sorted(rows(vector_join.near_duplicates(frame(spark, data + odd, "vec_id long, embedding array<double>")), "vec_id", "n_links", "component_id", "kept"))
    assert got == sorted(embed(data) + [(i, 0, i, True) for i, _ in odd])
    assert vector_join.near_duplicates(frame(spark, [], "vec_id long, embedding array<double>")).count() == 0


def test_html_text(spark):
    page = "<html><head><title>T</title><style>p{}</style></head><body><nav>menu</nav><article><h1>Head &amp; line</h1><p>One <b>tw</b>o<p>three&nbsp;x<div class='ad'>buy</div><script>var a='</p>';</script><form>f</form><section class=comments>no</section></article><aside>s</aside><footer>f</footer></body></html>"
    data = [(1, "http://h/1", page), (2, "http://h/2", None), (3, None, ""), (4, "http://h/4", "plain &lt;b&gt; text"), (1, "http://h/1", page), (5, "http://h/5", "<p>" + "long " * 50_000)]
    menu = " ".join(f"<li>item{i}</li>" for i in range(12))
    data += [(10 + i, f"http://k/{i}", f"<div>{menu}</div><p>unique{i} text{i} of{i} page{i}</p>") for i in range(6)]
    got = {r.page_id: r for r in html_text.extract(frame(spark, data, "page_id long, url string, html string")).collect()}
    assert got[1].text == "Head & line One two three x" and got[1].n_chars == len(got[1].text)
    assert got[2].text == got[3].text == "" and got[4].text == "plain <b> text" and got[5].n_chars == 249_999
    assert [got[10 + i].text for i in range(6)] == [f"unique{i} text{i} of{i} page{i}" for i in range(6)]
    assert html_text.extract(frame(spark, [], "page_id long, url string, html string")).count() == 0


def test_html_shards_do_not_change_results(spark, monkeypatch):
    """Boilerplate on two pages of a large host, copies of one page, and a notice in most articles."""
    rng = random.Random(9)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    notice = [words(12) for _ in range(30)]
    own = [words(30) for _ in range(60)]
    data = [(i, f"http://open/{i}", f"<p>{own[i]}</p><p>{notice[i // 2]}</p>") for i in range(60)]
    data += [(100 + i, f"http://art/{i}", f"<article><p>{own[i]}</p>" + (f"<p>{notice[0]}</p>" if i % 10 else "") + "</article>") for i in range(60)]
    data += [(200 + i, "http://copy/x", "<p>gone away</p>") for i in range(60)] + [(300 + i, None, None) for i in range(20)]
    pages = frame(spark, data, "page_id long, url string, html string").repartition(3)
    want = {100 * k + i: own[i] for k in (0, 1) for i in range(60)} | {200 + i: "gone away" for i in range(60)} | {300 + i: "" for i in range(20)}
    for shard, size in ((2000, 1 << 20), (3, 1 << 20), (2000, 700)):
        assert {r.page_id: r.text for r in html_text.extract(pages, shard, size).collect()} == want
    monkeypatch.setattr(html_text, "BROADCAST_RUNS", 2)
    assert sorted(rows(html_text.extract(pages, 7), "page_id", "text")) == sorted(want.items())


def test_html_near_copies_keep_their_text(spark):
    words = [f"word{i}" for i in range(61)]
    pages = [" ".join(words), " ".join(words[:30] + ["other"] + words[31:])]
    data = [(i, f"http://two/{i}", f"<p>{t}</p>") for i, t in enumerate(pages)] + [(10 + i, f"http://many/{i}", f"<p>{t}</p>") for i, t in enumerate(pages)]
    data += [(20 + i, f"http://many/x{i}", "<p>" + " ".join(f"p{i}w{k}" for k in range(40)) + "</p>") for i in range(20)]
    got = {r.page_id: r.text for r in html_text.extract(frame(spark, data, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in (0, 1, 10, 11)] == pages * 2 and len(got[25].split()) == 40


def test_html_malformed_markup_takes_linear_time():
    for piece in ("<p ", '<a x="', "<a x='", "<", "</", "<!", "<!--", "<script>", "<a b", "<a ' \"> ", "<svg/>a"):
        page = piece * (1_000_000 // len(piece))
        began = time.time()
        html_text.blocks(page)
        assert time.time() - began < 5, piece
    assert html_text.blocks("a<svg/>b<!-- c -->d<a x='>'>e</a><title>f</title>g < h") == [(False, "abdeg < h")]


def test_html_task_sends_a_page_once(spark):
    """Copies of a page, equal in html or in stream only, leave a task as one row; shards are cut by bytes too."""
    data = [(i, "http://h/1", f"<head><title>{i % 7}</title></head><p>gone away</p>") for i in range(900)] + [(i, None, None) for i in range(500)]
    pages = frame(spark, data, "page_id long, url string, html string").coalesce(1)
    assert sorted(rows(html_text.parse(pages, True), "host", "stream")) == [("", ""), ("h", "gone away")]
    assert html_text.extract(pages, 100, 300).groupBy("text").count().count() == 2
    long_ = frame(spark, [(i, "http://h/1", f"<p>{i} " + "word " * 2000) for i in range(40)], "page_id long, url string, html string")
    assert html_text.shards(html_text.parse(long_), 2000, 20_000).first().shards == 21


def test_html_keeps_what_only_looks_like_chrome():
    text = lambda page: html_text.main_blocks(page)[1].replace(" \x01 ", "|")
    page = "<article><h2 id='market-share'>A</h2><section id='related-work'>B</section><p id=social-policy>C</p><a title='the hidden cost'>D</a><div data-id=menu>E</div>"
    assert text(page + "<div class='share-buttons big'>no</div><div id=comments>no</div><p hidden>no</p><div class='ad-300x250'>no</div></article>") == "A|B|C|D|E"
    assert text("<div class='blog-nav-x2'>no</div><h2 id='market-share'>A</h2><div id='site-footer'>no</div>") == "A"
    head = "<html><head><meta charset=utf-8><title>T</title><link rel=x>"
    for rest, want in (("<body><p>A</p>", "A"), ("<p>A</p><p>B</p>", "A|B"), ("\n A", "A"), ("</head>\n<body>A", "A"), ("<body><nav>no</nav><article>A</article>", "A"), ("</head><body><div>A</div></body>", "A")):
        assert text(head + rest) == want


def test_bpe_equals_the_reference_library(spark, documents):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = bpe.load(path, P.PATTERN)
    rng = random.Random(3)
    parts = ["'s", "'re", "'ll", "'", " ", "  ", "\n", "\t", "a", "Zé", "1", "२", "½", "!", "..", "🙂", "中", "re", "\x85", "\u3000"]
    odd = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(3000)] + ["a" * 4000, "ab" * 2000, "aaab" * 3000, " " * 500, "", "中文" * 700]
    for t, ids in zip(odd, own.encode_batch(odd), strict=True):
        assert ids.tolist() == enc.encode_ordinary(t)
        assert own.decode(ids) == t.encode()
    got = {r.doc_id: r for r in registry.op10_byte_bpe(spark, SF).collect()}
    for d, t in documents:
        ids = enc.encode_ordinary(t or "")
        assert (got[d].n_tokens, got[d].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert got[d].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    ids = bpe.encode(frame(spark, [(1, "hello"), (2, None), (2, None)], "doc_id long, text string"), path, P.PATTERN)
    assert sorted(bytes(r.decoded) for r in bpe.decode(ids, path, P.PATTERN).collect()) == [b"", b"", b"hello"]


REPEAT = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_repeats_match_brute_force(spark, documents):
    assert sorted(rows(registry.op4_suffix_dedup(spark, SF), *REPEAT)) == brute.repeats(documents)


def test_repeats_odd_cases(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdé ") for _ in range(rng.randrange(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, data = text(60), []
    for i in range(150):
        a, b = sorted(rng.sample(range(len(passage)), 2))
        data.append((i, text(rng.randrange(30)) + passage[a:b] + text(rng.randrange(30)) + (passage if i % 3 == 0 else "")))
    data += [(200, "a" * 700), (201, "ab" * 400), (202, None), (203, ""), (204, passage), (205, passage), (206, text(9000)), (207, "x" + passage[:100]), (208, "x" + passage[:99])]
    data += [(300 + i, passage[: 90 + i] + data[i][1]) for i in range(30)]
    rng.shuffle(data)
    assert sorted(rows(suffix_dedup.find(frame(spark, data, "doc_id long, text string")), *REPEAT)) == brute.repeats(data)
    assert suffix_dedup.find(frame(spark, [], "doc_id long, text string")).count() == 0
    twice = suffix_dedup.find(frame(spark, [(1, passage), (1, passage), (None, passage)], "doc_id long, text string"))
    assert sorted(r.n_removed for r in twice.collect()) == [0] + [len(passage.encode())] * 2


def test_passage_in_every_document(spark):
    """A passage in all documents, its edges different in each, and a text longer than a block of windows."""
    rng = random.Random(12)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, long_ = text(260), text(700_000)
    data = [(i, text(rng.randrange(120)) + passage + text(rng.randrange(120))) for i in range(300)] + [(400, long_), (401, text(50) + long_[300_000:600_000])]
    assert sorted(rows(suffix_dedup.find(frame(spark, data, "doc_id long, text string")), *REPEAT)) == brute.repeats(data)


def test_loser_tree_merges_with_common_prefixes():
    rng = random.Random(1)
    runs = [sorted((bytes(rng.choice(b"ab") for _ in range(rng.randrange(12))), b"", i, k, 0) for k in range(rng.randrange(40))) for i in range(7)]
    got = list(suffix_dedup.LoserTree([suffix_dedup._decode(suffix_dedup._front_code(r)) if r else iter(()) for r in runs]))
    assert [r for _, r in got] == sorted(r for run in runs for r in run)
    for (_, x), (k, y) in zip(got, got[1:], strict=False):
        assert k == suffix_dedup.common(x[0], y[0], 0)
