"""Extraction, token ids, quality, packing, language and personal data on small tables."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prepspark.llm import bpe, html, language, packing, pii, quality, urls

ODD = [
    (1, "plain words here", 7), (2, None, None), (3, "", 1), (None, "no key", 2), (4, "same", 3), (4, "same", 3), (5, "é " * 3000 + "x" * 5000, 4), (6, "\x0b\t \n", 5),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, and columns whose names the operators use inside."""
    df = spark.createDataFrame(ODD, "doc_id bigint, text string, n bigint")
    return df.withColumns({c: F.lit("own") for c in ("key", "words", "fp", "h", "shard", "ids", "lang")})


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


# ---- quality rules

def plain_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, covered = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i:i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered |= {i + k for i in at for k in range(8)}
    lines, told, dup = (text or "").split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in told
            told.add(x)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered))


def test_quality_measurements(spark, odd, none):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice(["a ", "b ", "cé ", "\n", "# ", "a b a b a b a b\n"]) for _ in range(rng.randrange(60)))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for frame in (df, odd):
        got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.ledger(frame).collect()), key=repr)
        want = sorted(((r.doc_id, *plain_quality(r.text)) for r in frame.collect()), key=repr)
        assert got == want
    assert quality.ledger(none).count() == 0 and quality.ablation(quality.ledger(none)).agg(F.sum("failing")).first()[0] == 0


def test_quality_policies_and_ablation(spark):
    good = " ".join(f"word{i}" for i in range(40))
    df = spark.createDataFrame([(1, good), (2, "few words"), (3, good + " " + good + " " + good), (4, " ".join("a#$%&" for _ in range(30)))], "doc_id bigint, text string")
    book = quality.apply_policy(quality.ledger(df)).cache()
    assert {r.doc_id: (r.base_failed, r.kept) for r in book.collect()} == {1: (False, True), 2: (True, False), 3: (True, False), 4: (True, False)}
    assert quality.ledger(df).where(quality.passes("base")).count() == 1
    told = {r.rule: r for r in quality.ablation(book).collect()}
    assert told["short"].failing_alone == 1 and told["short"].kept_without == 2 and told["symbols"].failing == 1


# ---- HTML

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>"</script></head><body class="has-sidebar">
<header><a href=/>Home</a> Site name</header><nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav>
<div class="cookie-notice">We use cookies to make this site better for everyone who reads it.</div>
<article><h1>The &eacute;t&eacute; &amp; us</h1><p>First   paragraph<br>with a break and enough words to count as text.<p>Be.<p>Second one with <b>bold</b> words, unclosed.
<form><label>Name</label><input><button>Send</button></form></article>
<aside><p>Related things that nobody asked for, told in one long sentence here.</p></aside>
<section id="comments"><article class="comment"><p>A reader wrote this comment with quite a lot of words in it.</p></article></section>
<footer>&copy; 2020 all rights</footer></body></html>"""


def test_main_text_of_a_page():
    assert html.main_text([PAGE]) == ["The été & us First paragraph with a break and enough words to count as text. Be. Second one with bold words, unclosed."]
    assert html.main_text(["", "<nav><a href=x>only a menu</a></nav>", "<p>cut of", "<script>a<b", "&#xD800;"])[:2] == ["", ""]
    long = "<article>" + "<p>word word word word word</p>" * 20_000
    assert html.main_text([long])[0].count("word") == 100_000


def test_extract_keeps_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (2, "v", "")], "page_id bigint, url string, html string").withColumn("text", F.lit("own"))
    out = html.extract(df.drop("text"), ["page_id", "url"])
    assert out.count() == 4 and out.where("n_chars = length(text)").count() == 4 and out.where("text = ''").count() == 2
    assert html.extract(df.limit(0), ["page_id"]).count() == 0


def test_tree_learns_its_table():
    table = np.array(html.LABELLED, dtype=float)
    assert (html.classify(html.tree(), table[:, :-1]) == (table[:, -1] == 1)).all()


def test_linked_text_of_an_article_stays():
    long, head = "word " * 60, "A linked headline of seven words here"
    item = f"<li><a href=x>{head}</a></li>"
    page = f"<article><h1><a href=x>{head}</a></h1><p>{long}</p><p><a href=x>{head}</a></p><ul>{item * 3}</ul><p>{long}</p></article>"
    got = html.main_text([page])[0]
    assert got.count(head) == 5 and got.count("word ") + got.endswith("word") == 120
    assert html.main_text([f"<ul>{item * 3}</ul><p>{long}</p><ul>{item * 3}</ul>"]) == [long.strip()]
    assert html.main_text([f"<p>{long}</p><p>Only a short closing paragraph.</p>"])[0].endswith("closing paragraph.")


@pytest.mark.parametrize("mark", ["class='layout has-sidebar'", "class='with-sidebar'", "class=no-sidebar", "id='search-result-page'", "class='page-with-comments'"])
def test_containers_of_the_article_are_no_furniture(mark):
    long = ("word " * 60).strip()
    teaser = f"<div class=related><article><h2>Another</h2><p>{'other ' * 30}</p></article></div><div class=sidebar><p>{'side ' * 30}</p></div>"
    for holder in ("article", "main"):
        for more in ("", teaser):
            body = f"<{holder}><h1>A title</h1><p>{long}</p></{holder}>{more}"
            assert html.main_text([f"<body><div {mark}><div class=inner>{body}</div></div></body>"])[0].startswith(f"A title {long}")
    assert html.main_text([f"<main><div {mark}><article><p>{long}</p></article>{teaser}</div></main>"]) == [long]
    assert html.main_text([f"<article><p>{long}</p></article>{teaser}<div id=comments><article><p>{long}</p></article></div>"]) == [long]


def test_a_closed_drawing_ends_at_its_tag():
    long = ("word " * 60).strip()
    for mark in ("<svg/>", "<math />", "<SVG class='a>b' width='5' />"):
        assert html.main_text([f"<article>{mark}<p>{long}</p><svg><text>x</text></svg></article>"]) == [long]
    assert html.main_text([f"<article><svg width='5'><path d='M0'/></svg><p>{long}</p></article>"]) == [long]


# ---- token ids

@pytest.fixture(scope="module")
def lib():
    return bpe.codec(bpe.default_path()).tok


def check_ids(rows, lib):
    for r in rows:
        want = lib.encode(r.text or "", add_special_tokens=False).ids
        assert list(r.ids) == want and r.n_tokens == len(want)
        assert r.decoded == lib.decode(want, skip_special_tokens=False)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()


@pytest.mark.parametrize("long,piece", [(bpe.LONG, bpe.PIECE), (500, 64), (30, 5)])
def test_encoding_equals_the_library(spark, odd, none, lib, long, piece):
    rng = random.Random(long)
    rows = [(i, "".join(rng.choice(["the ", "ein", "ß", "É", "İ", "Σ", "1", "'s ", "!!", "\n", "\t", "\u00a0", "日本", "e\u0301", "<|endoftext|>", "ab" * 40]) for _ in range(rng.randrange(80)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for frame in (df, odd):
        out = bpe.encode_decode(frame, ["doc_id", "text"], outputs=tuple(bpe.TYPES), long=long, piece=piece)
        got = out.collect()
        assert len(got) == frame.count()
        check_ids(got, lib)
    assert bpe.encode_decode(none, ["doc_id"], long=long).count() == 0
    back = bpe.decode(bpe.encode_decode(df, ["doc_id"], outputs=("ids", "decoded")).withColumnRenamed("decoded", "told"), ["doc_id", "told"])
    assert back.where("NOT told <=> decoded").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcdeinorst", min_size=1, max_size=400), st.integers(2, 40))
def test_joined_halves_equal_the_whole(text, leaf):
    c = bpe.codec(bpe.default_path())
    assert c.word(text, leaf) == c.stretch(text, True)


# ---- packing

def test_best_fit_decreasing_against_a_scan():
    rng = random.Random(0)
    for length in (1, 7, 64, 2048):
        for _ in range(30):
            sizes = [rng.randint(1, length) for _ in range(rng.randrange(80))]
            rows, rooms = packing.pack(sizes, length), []
            for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
                fits = [i for i, r in enumerate(rooms) if r >= sizes[k]]
                if fits:
                    rooms[min(fits, key=lambda i: rooms[i])] -= sizes[k]
                else:
                    rooms.append(length - sizes[k])
            assert sorted(k for r in rows for k in r) == list(range(len(sizes)))
            assert sorted(length - sum(sizes[k] for k in r) for r in rows) == sorted(rooms)


def test_packed_ids_come_back(spark, odd, none):
    length = 37
    out = packing.packed(odd, length=length, shard_tokens=900).cache()
    enc = packing.encoding(packing.default_path())
    got = {}
    for r in packing.unpacked(out, length).collect():
        got.setdefault(r.doc_id, []).append((r.segment, tuple(r.ids)))
    want = {}
    for r in odd.collect():
        ids = enc.encode_ordinary(r.text or "")
        want.setdefault(r.doc_id, []).extend((s, tuple(ids[a:a + length])) for s, a in enumerate(range(0, len(ids), length)))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items() if v}
    for r in out.collect():
        places = np.frombuffer(r.positions, "<u2").reshape(r.n_rows, length)
        for k in range(r.n_rows):
            ends = r.cu_seqlens[r.row_offsets[k]:r.row_offsets[k + 1]]
            assert ends[0] == 0 and ends[-1] <= length
            assert all((places[k, a:b] == np.arange(b - a)).all() for a, b in zip(ends, ends[1:]))
    assert packing.packed(none, length=length).count() == 0


def test_long_blanks_are_encoded():
    enc = packing.encoding(packing.default_path())
    text = "a" + " " * 1_000_000 + "b"
    assert enc.decode(packing.ids_of(enc, text).tolist()) == text


# ---- language

def test_language_accuracy_and_odd_texts(spark, table, odd, none):
    docs = table("documents")
    out = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").cache()
    assert out.where("held_out AND lang = lang_pred").count() >= 0.97 * out.where("held_out").count()
    assert out.where("score < 0 OR score > 1").count() == 0
    got = language.identify(odd.drop("lang").withColumn("lang", F.when(F.col("doc_id") == 1, "xx"))).collect()
    assert len(got) == len(ODD) and {r.lang_pred for r in got if r.doc_id in (2, 3, 6)} == {"und"}
    assert {r.lang_pred for r in language.identify(odd.drop("lang").withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.identify(none).count() == 0


def test_sample_of_a_language_is_not_thinned_by_copies(spark):
    rng = random.Random(4)
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(12))
    own = {"aa": "aeioklm", "bb": "uyprstn", "cc": "bdfghjq"}
    rows = [(make(own[k]), k, n) for k, texts, n in (("aa", 25, 400), ("bb", 1000, 1), ("cc", 25, 400)) for _ in range(texts)]
    df = spark.createDataFrame(rows, "text string, lang string, n int").selectExpr("text", "lang", "explode(sequence(1, n)) AS copy").drop("copy")
    model = language.fit(df, per_lang=20)
    assert all(language.answer(model, make(own[k]))[0] == k for k in own for _ in range(50))


def test_prediction_reads_text_only(table):
    docs = table("documents").limit(80)
    model = language.fit(docs.where(~language.held_out(F.col("doc_id"))).select("text", "lang"))
    a = language.predict(docs, model, ["doc_id"]).orderBy("doc_id").collect()
    b = language.predict(docs.withColumns({"lang": F.lit("zz"), "source": F.lit("s")}), model, ["doc_id"]).orderBy("doc_id").collect()
    assert a == b
    assert abs(language.temperature(np.array([[2.0, 0.0]] * 4), np.array([0, 0, 0, 1])) - 2 / np.log(3)) < 1e-3


# ---- personal data

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, rule in RULES.items():
        for m in re.finditer(rule, text):
            d = re.sub(r"[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False,
                  "card": 16 <= len(d) <= 19 and pii.luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            out += [(kind, *m.span())] * ok
    return out


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="a1@.+-( )%92", max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_base_spans_of_long_runs():
    assert pii.base_spans("1" * 300_000 + "a" * 300_000 + "." * 100_000) == []


def test_network_slopes():
    rng = np.random.default_rng(0)
    m = {k: v.astype(float) for k, v in pii.new_model().items()}
    x = rng.integers(0, 20, (2, 6))
    y = np.array([[0, 1, 2, 0, 3, 4], [7, 8, 0, 0, 0, 5]])
    loss = lambda: pii.crf_slopes(pii.forward(m, x)[0].astype(float), m["trans"] + pii._FIXED, y)[0]
    e, saved = pii.forward(m, x, keep=True)
    _, d, dt = pii.crf_slopes(e, m["trans"] + pii._FIXED, y)
    slopes = pii.backward(m, d, saved) | {"trans": dt}
    for name, at in (("emb", (0, x[0, 2], 3)), ("rec", (1, 2, 5)), ("out", (3, 1)), ("bias", (2,)), ("trans", (1, 2))):
        old, eps = m[name][at], 1e-2
        m[name][at] = old + eps
        up = loss()
        m[name][at] = old - eps
        down = loss()
        m[name][at] = old
        assert abs((up - down) / (2 * eps) - slopes[name][at]) < 1e-3


def test_detection_and_redaction(spark, table, odd, none):
    docs = table("documents")
    model = pii.fit(docs)
    assert model is not None
    for r in pii.detect(docs, model, ["doc_id", "text"]).collect():
        base = plain_spans(r.text)
        assert r.base_sha256 == hashlib.sha256(pii.told(base).encode()).hexdigest()
        assert set(filter(None, r.spans.split(","))) >= set(filter(None, pii.told(base).split(",")))
        assert r.n_email == sum(k == "email" for k, *_ in base) and (r.spans.count(":") // 2) == len(base) + r.n_added
    got = pii.redact(spark.createDataFrame([(1, "mail a.b@c.org now", 18), (2, None, None), (3, "", 0)], "doc_id bigint, text string, n_chars bigint"), None, size="n_chars")
    assert {r.doc_id: (r.text, r.n_chars) for r in got.collect()} == {1: ("mail <EMAIL> now", 16), 2: (None, None), 3: ("", 0)}
    assert pii.fit(none) is None and pii.detect(none, None, ["doc_id"]).count() == 0
    assert pii.detect(odd, pii.fit(odd), ["doc_id"]).count() == len(ODD)


def test_reconciling_takes_the_best_set():
    a, b, c = ("card", 0, 10), ("card", 8, 20), ("phone", 12, 18)
    assert pii.reconcile([(a, 3.0), (b, 4.0), (c, 2.0)]) == [a, c]
    assert pii.reconcile([(b, 3.0), (b, 3.0), (a, 3.0), (c, 2.0)]) == [b]


# ---- URLs

def test_hosts_paths_and_rules(spark):
    cases = [
        ("http://A.Example.NET/en/1?x#y", "a.example.net", "/en/1", "example.net/en/", "allow"), ("https://x.net", "x.net", "", None, "allow"), ("https://x.net/", "x.net", "/", "net/", "block"),
        ("https://example.com/de/a", "example.com", "/de/a", "example.com/de/", "block"), ("https://notexample.com/de/a", "notexample.com", "/de/a", None, "allow"),
        ("ftp://b.org/fr/", "b.org", "/fr/", "org/fr/", "allow"), ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("a://b://c/d", "b:", "//c/d", None, "allow"), ("x://É.org?q", "É.org", "", None, "allow"),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)] + [(0, cases[0][0])], "page_id bigint, url string").withColumns({c: F.lit(1) for c in ("host", "path", "template", "n")})
    got = urls.judge(df, ["page_id"]).collect()
    assert len(got) == len(cases) + 1
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == cases[r.page_id][1:]
    assert urls.judge(df.limit(0), ["page_id"]).count() == 0


def test_templates_are_rejected_by_purity(spark):
    """A branch that rules block almost everywhere takes its unlabelled addresses with it; a clean one stays."""
    rows = [(f"http://h.example.com/de/{i}", ) for i in range(60)] + [("http://h.example.com/de2/1",)] * 1 + [(f"http://h.example.com/en/{i}",) for i in range(60)]
    rules = [("block", "example.com/de/1"), ("block", "example.com/de/2"), ("block", "example.com/de/3"), ("block", "example.com/de/4"), ("block", "example.com/de/5"), ("block", "example.com/de/6")]
    out = {r.path: r for r in urls.judge(spark.createDataFrame(rows, "url string"), ["url"], rules=rules).collect()}
    assert out["/de/7"].rule is None and out["/de/7"].verdict == "block" and out["/de/7"].purity > 0.8
    assert out["/en/7"].verdict == "allow" and out["/en/7"].template == "/en/*"


def test_short_pages_keep_their_text():
    """Without an article element and without running text, what is neither furniture nor links is the text."""
    pages = {
        "<p>Hi</p>": "Hi", "<body><div><h1>Title</h1><p>Short para.</p><p>Another short one.</p></div></body>": "Title Short para. Another short one.",
        "<nav><a href=x>Home</a></nav><p>Hello there</p><footer>All rights</footer>": "Hello there", "<nav>Only menu</nav>": "",
        "<ul><li><a href=a>One</a><li><a href=b>Two</a></ul><p>Only this.</p>": "Only this.",
        "<div class=comments><p>First!</p></div><p>One line</p><p>One line</p>": "One line One line",
    }
    assert html.main_text(list(pages)) == list(pages.values())


def test_extraction_equals_a_plain_rule_on_the_given_pages(table):
    """The given pages mark their article: text between furniture elements of it, found by a plain parser."""
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__()
            self.stack, self.blocks, self.now = [], [], []

        def flush(self):
            text = " ".join("".join(self.now).split())
            self.blocks += [text] if text else []
            self.now = []

        def inside(self):
            names = [n for n, _ in self.stack]
            return ("article" in names or "main" in names) and not any(bad for _, bad in self.stack)

        def handle_starttag(self, name, attrs):
            if name in html.BLOCK:
                self.flush()
            if name not in html.VOID:
                said = html.furniture_words(" ".join(v or "" for k, v in attrs if k in ("class", "id")))
                self.stack.append((name, name in html.FURNITURE or name in html.RAW or bool(said)))
            elif name == "br":
                self.now.append(" ")

        def handle_endtag(self, name):
            if any(n == name for n, _ in self.stack):
                if name in html.BLOCK:
                    self.flush()
                while self.stack.pop()[0] != name:
                    pass

        def handle_data(self, data):
            if self.inside():
                self.now.append(data)

    rows = [r["html"] or "" for r in table("pages").select("html").collect()]
    want = []
    for page in rows:
        p = Plain()
        p.feed(page)
        p.close()
        p.flush()
        want.append(" ".join(p.blocks))
    assert html.main_text(rows) == want
