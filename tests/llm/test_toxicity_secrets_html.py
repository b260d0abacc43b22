import hashlib
import math
import random
import re
import time

import numpy as np
import pytest

from tests.llm.data import docs, plain, rows, words
from vantage.llm import html_text, secrets, toxicity
from vantage.llm.arrays import mix
from vantage.llm.automata import Automaton, Letters


def test_toxicity_on_held_out_rows(spark):
    r = random.Random(1)
    texts, labels = [], []
    for k in range(1500):
        bad = k % 5 == 0
        w = words(40, k).split()
        for _ in range(4 if bad else 0):
            w[r.randrange(len(w))] = r.choice(["idiot", "scum", "moron"])
        texts.append(" ".join(w))
        labels.append((k, int(bad)))
    texts += [None, "", texts[0]]
    own = spark.createDataFrame([(k, t, 0.1, 9) for k, t in enumerate(texts)], "doc_id long, text string, toxic double, score int")
    marks = spark.createDataFrame([(*x, "clash") for x in labels] + [(5, None, ""), (10**9, 1, "")], "doc_id long, toxic int, text string")
    found = {x.doc_id: x for x in toxicity.judge(own, marks).collect()}
    assert len(found) == len(texts)
    held = [(found[k], y) for k, y in labels if found[k].held_out]
    assert len(held) > 200 and sum(x.predicted == y for x, y in held) / len(held) > 0.97
    assert found[1500].score == found[1501].score and found[1502].score == found[0].score
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in found.values())
    kept = toxicity.drop_toxic(own, marks)
    with pytest.raises(ValueError, match="score"):
        toxicity.score(own, marks)
    assert kept.columns == own.columns and {r.score for r in kept.collect()} == {9} and kept.count() == sum(not x.predicted for x in found.values())


def plain_ftrl(examples, epochs=2, alpha=1.0, beta=1.0, l1=5.0, l2=0.5):
    """FTRL-proximal with a dictionary entry a feature: examples are (hash, features, label)."""
    z, n = {}, {}
    weight = lambda f: 0.0 if abs(z.get(f, 0.0)) <= l1 else -(z[f] - math.copysign(l1, z[f])) / ((beta + math.sqrt(n[f])) / alpha + l2)
    for epoch in range(epochs):
        for k in sorted(range(len(examples)), key=lambda k: int(mix(np.array([examples[k][0]], np.int64).view(np.uint64) + np.uint64(epoch))[0])):
            _, some, label = examples[k]
            w = {f: weight(f) for f in some}
            g = 1 / (1 + math.exp(-sum(w.values()))) - label
            for f in some:
                z[f] = z.get(f, 0.0) + g - (math.sqrt(n.get(f, 0.0) + g * g) - math.sqrt(n.get(f, 0.0))) / alpha * w[f]
                n[f] = n.get(f, 0.0) + g * g
    return {f: weight(f) for f in z}


def test_toxicity_scores_are_those_of_a_plain_fit(spark):
    r = random.Random(21)
    common, bad = "ka lo mi ne su ta ri po we".split(), "scum moron".split()
    texts = [" ".join(r.choice(bad if k % 4 == 0 and r.random() < 0.15 else common) for _ in range(r.randrange(5, 60))) for k in range(400)]
    labels = {k: int(any(w in bad for w in t.split())) for k, t in enumerate(texts)}
    rows = [(k, t) for k, t in enumerate(texts)] + [(400, "")]
    own = spark.createDataFrame(rows, "doc_id long, text string")
    hashes = {x.doc_id: (x.h, x.c) for x in own.selectExpr("doc_id", "xxhash64(doc_id) h", "crc32(cast(cast(doc_id as string) as binary)) % 5 c").collect()}

    def features(text):
        w = text.split()
        return {"constant", *w, *((s, a, b) for s in (1, 2, 3) for a, b in zip(w, w[s:], strict=False))}

    weights = plain_ftrl([(hashes[k][0], features(texts[k]), y) for k, y in labels.items() if hashes[k][1]])
    shift = weights["constant"] + min(math.log(5), max(-weights["constant"] / 2, 0))
    found = toxicity.judge(own, spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")).collect()
    assert len(found) == len(rows) and len({round(x.score, 6) for x in found}) > 20
    for x in found:
        total = shift + sum(weights.get(f, 0.0) for f in features(dict(rows)[x.doc_id]) - {"constant"})
        assert abs(x.score - 1 / (1 + math.exp(-total))) < 1e-3
        assert x.held_out == (hashes[x.doc_id][1] == 0)


def test_toxicity_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {x.score for x in toxicity.judge(docs(spark), none).collect()} == {0.0}
    assert toxicity.judge(docs(spark, []), none).count() == 0


ASSIGN = r"""(?ia)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def base(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out)]


def test_secrets_against_plain_patterns(spark):
    r = random.Random(2)
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    upper = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(n))
    texts = [f"{words(8, k)} PASSWORD='{hexes(18)}' é {words(3, k)} AKIA{upper(16)} {hexes(40)} token: short" for k in range(60)]
    texts += [None, "", "secret=1234567", "api_key = abcdefgh AKIA12", hexes(31), hexes(33), f"{words(5, 5)} {hexes(18)} {words(5, 6)} 4111111111111111", "passwordtoken==secret:aaaaaaaa"] + [words(60, 300 + k) + f" averyveryverylongword {r.randrange(10**15, 10**16)}" for k in range(40)]
    found = {x.doc_id: x for x in secrets.secret_digest(plain(spark, texts)).collect()}
    for k, t in enumerate(texts):
        want = base(t or "")
        assert found[k].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [found[k].n_assign, found[k].n_access, found[k].n_hex] == [sum(x.startswith(n) for x in want) for n in ("assign", "access", "hex")]
        assert [x for x in found[k].spans.split(",") if x and not x.startswith("format")] == want
    bare = texts.index(f"{words(5, 5)} " + texts[66].split(" ")[5] + f" {words(5, 6)} 4111111111111111")
    assert found[bare].n_format == 1 and found[70].n_format == 0
    assert secrets.secret_digest(docs(spark, [])).count() == 0
    assert all(x.spans == "" for x in secrets.secret_digest(docs(spark)).collect())


def test_automata_keep_lengths_and_prefixes():
    r = random.Random(3)
    keys = ["AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)) for _ in range(200)]
    a = Automaton(keys)
    good, short, wrong = keys[0], keys[0][:-6], "BKIA" + keys[0][4:]
    one = a.scores([good, wrong, short])
    assert one[0] > one[1] + 2 and one[0] / 20 > one[2] / 14
    assert Automaton([]).scores(["abc"])[0] < 0 and len(a.scores([])) == 0


def test_scores_of_many_texts_are_those_of_a_walk():
    r = random.Random(4)
    string = lambda alphabet, n: "".join(r.choice(alphabet) for _ in range(n))
    for fixed, alphabet in (("AKIA", "ABCDEF234567"), ("é", "0123456789abcdef"), ("", "abcxyz./+=-_")):
        samples = [fixed + string(alphabet, r.randrange(6, 20)) for _ in range(150)]
        for a in (Automaton(samples), Automaton(samples, join=False), Automaton([])):
            for n in (1, 5, 40):
                texts = samples[:n] + [string(alphabet + "éÿ 日😀Z", k * k) for k in range(n)] + ["", string(alphabet, 3000)]
                for text, found in zip(texts, a.scores(texts), strict=True):
                    at, want = 0, 0.0
                    for c in text:
                        x, at = a.step(at, c)
                        want += x
                    assert abs(found - want - a.end(at)) < 1e-6


def test_disguised_credentials_are_found_and_words_left_alone(spark):
    """Credentials that no pattern names: 12 to 90 characters of learned formats, in other texts than the labelled ones."""
    r = random.Random(11)
    draw = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    hexes, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    made = lambda k: draw(hexes, 12) if k % 3 == 0 else "sk-" + draw(mixed, 24) if k % 3 == 1 else draw(mixed, 90)
    texts = [f"{words(30, k)} token = '{made(k)}' {words(5, k)}" for k in range(400)]
    hidden = {400 + k: made(k) for k in range(90)}
    texts += [f"{words(30, k)} {x} {words(8, k + 1)}" for k, x in hidden.items()]
    clean = len(texts)
    texts += [f"{words(60, 5000 + k)} {draw('0123456789', 16)} 10.{k}.0.{k} mail{k}.example.com well-known.words and" for k in range(100)]
    found = {x.doc_id: x.spans for x in secrets.find_secrets(plain(spark, texts)).collect()}
    caught = [k for k, x in hidden.items() if any(s.kind == "format" and texts[k][s.start : s.end] == x and s.score > 0.5 for s in found[k])]
    wrong = [s for k in range(clean, len(texts)) for s in found[k]]
    assert len(caught) >= 0.9 * len(hidden), len(caught)
    assert len(wrong) <= 5
    assert all(s.score is not None for k in range(400) for s in found[k]) and all(len(found[k]) > 0 for k in range(400))


def test_main_text_of_pages(spark):
    page = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><header>Site name</header>
    <nav><ul><li><a href="/a">Home</a><li><a href="/b">News, all of it.</a></ul></nav><div class="cookie-notice"><p>We use cookies, and more cookies, for you.</p></div>
    <article><h1>A   title</h1><p>First <b>bo</b>ld, &amp; more&nbsp;text. It goes on, and on.<p>Second paragraph, which is long enough; it has marks.<br>After a break.</p>
    <form>Name <input></form><aside>Side, with words, of its own.</aside></article><section id="comments"><p>Great, great article! I read it, twice, and more.</p></section><footer>&copy; 2020, all rights.</footer></body></html>"""
    want = "A title First bold, & more text. It goes on, and on. Second paragraph, which is long enough; it has marks. After a break."
    some = [(1, "u", page, "clash"), (2, None, None, ""), (3, "v", "", ""), (4, "w", "only text", ""), (5, "u", page, ""), (6, "x", "<p>", ""), (7, "y", "<" * 3000, "")]
    found = {r.page_id: r for r in html_text.extract(spark.createDataFrame(some, "page_id long, url string, html string, text string")).collect()}
    assert found[1].text == found[5].text == want and found[1].n_chars == len(want)
    assert [found[k].text for k in (2, 3, 4, 6)] == ["", "", "only text", ""] and found[2].url is None and len(found) == 7
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pages_without_article_tag():
    page = "<body><div class=menu><a href=1>One</a> <a href=2>Two</a></div><div class=main>" + "".join(f"<p>Sentence {k}, with a comma. And another one.</p>" for k in range(5)) + "</div><div class=sidebar>Links</div></body>"
    assert html_text.main_text(page) == " ".join(f"Sentence {k}, with a comma. And another one." for k in range(5))


def test_rows_stay(spark):
    assert len(rows()) == docs(spark).count()


def test_class_words_do_not_overrule_the_scores():
    body = "".join(f"<p>Sentence {k} of the article, which is long enough, with a comma. And another one, as long.</p>" for k in range(5))
    want = " ".join(f"Sentence {k} of the article, which is long enough, with a comma. And another one, as long." for k in range(5))
    menu, ad = "<div class=menu><a href=1>One</a> <a href=2>Two</a></div>", '<div class="ad"><p>Buy this now, and buy more, for less money.</p></div>'
    talk = '<div class="post-comments"><p>Great, great article! I read it, twice, and more.</p></div><div class="comment-list"><p>Me too, and twice, if I may say so.</p></div>'
    for name in ("content has-sidebar", "post no-comments", "search-result-article", "page sidebar"):
        assert html_text.main_text(f'<body>{menu}<div class="{name}">{body}{ad}</div>{talk}</body>') == want
    first, rest = body[: body.index("<p>Sentence 3")], body[body.index("<p>Sentence 3") :]
    assert html_text.main_text(f'<body>{menu}<div class=post>{first}<section id="related-work">{rest}</section>{ad}</div>{talk}</body>') == want


def made_words(n, seed):
    return " ".join(f"w{(seed * 7919 + k * 31) % 997}" for k in range(n))


def plain_page(k):
    """A page without telling tags or names: links, a short claim, paragraphs, short lines at the end."""
    paragraphs = [f"{made_words(25, k + j)}, {made_words(10, k)}. {made_words(8, j)}, and {made_words(6, j)}." for j in range(3 + k % 4)]
    links = "".join(f'<div class="r2"><a href="/{j}">{made_words(2, j)}</a></div>' for j in range(5 + k % 5))
    more = "".join(f'<div class="r7">{made_words(3, j)}</div>' for j in range(4))
    body = "".join(f"<p>{x}</p>" for x in paragraphs)
    title = made_words(6, k)
    return f'<html><body><div class="r1">{links}</div><div class="r3"><h2>{title}</h2>{body}</div><div class="r5">{more}</div></body></html>', " ".join([title, *paragraphs])


def test_ratios_alone_find_articles_in_plain_pages():
    pages = [plain_page(k) for k in range(30)]
    assert all(html_text.main_text(page) == want for page, want in pages)
    # without the ratios the short lines stay
    assert not any(html_text.main_text(page, share=0.0) == want for page, want in pages)


def brute_ratios(nodes):
    paths = list(dict.fromkeys(n.path for n, _ in nodes))
    own = [[(n, t) for n, t in nodes if n.path == p] for p in paths]
    text = [sum(max(0, len(t) - n.linked) for n, t in some) / len(some) for some in own]
    mark = [sum(c in ".,;:!?…。、，！？；：" for _, t in some for c in t) / len(some) for some in own]

    def smooth(x, k):
        return (x[k] + 0.1 * x[max(0, k - 1)] + 0.1 * x[min(len(x) - 1, k + 1)]) / 1.2

    linked = [sum(min(len(t), n.linked) for n, t in some) / len(some) for some in own]
    return {p: (smooth(text, k) * (1 + smooth(mark, k))) ** 0.5 if text[k] > linked[k] else 0.0 for k, p in enumerate(paths)}


@pytest.mark.parametrize("k", range(5))
def test_path_scores_equal_their_definition(k):
    nodes = [(n, t) for n in html_text.text_nodes(plain_page(k)[0])[0] if (t := " ".join("".join(n.parts).split()))]
    assert html_text.ratios(nodes) == pytest.approx(brute_ratios(nodes))


def test_pages_without_an_article_and_regions_by_tag():
    assert html_text.main_text("<body><nav><a href=x>One</a></nav><footer>All rights, of all, are kept. Yes.</footer></body>") == ""
    page = "<body><form><nav><a href=x>Menu</a></nav><div class=m><h1>Head</h1><p>One, two, three and four. Five, six.</p><p>Short.</p></div><aside>Old words, of old days.</aside></form></body>"
    assert html_text.main_text(page) == "Head One, two, three and four. Five, six. Short."


@pytest.mark.parametrize("page", ["<a " * 300_000, "<div>x" * 150_000, "<b>" + "<div>" * 100_000 + "</b>" * 100_000, "<b>x" * 100_000 + "<li>y" * 100_000, '<a x=">>>' * 100_000, "<!--" * 250_000])
def test_hostile_pages_take_time_in_proportion(page):
    start = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - start < 15


def test_linked_text_of_an_article_stays():
    menu = "<nav><ul><li><a href=/>Home of all things</a></li></ul></nav>"
    page = menu + "<article><h1>Title here</h1><p>Some words of the text, and some more of them.</p><ul><li><a href=x>linked item</a></li><li>plain item</li></ul><figure><figcaption><a href=y>A linked caption</a></figcaption></figure><p><a href=z>A paragraph that is one link, from end to end.</a></p></article><footer>Made by us.</footer>"
    assert html_text.main_text(page) == "Title here Some words of the text, and some more of them. linked item plain item A linked caption A paragraph that is one link, from end to end."
    assert html_text.main_text(menu + "<article><p><a href=z>One link, and nothing else.</a></p></article>") == "One link, and nothing else."


def planted_formats(each=6, seed=99):
    """(format, string): strings of formats that no pattern names, drawn apart from the examples that are learned."""
    r = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    both = letters + letters.upper() + "0123456789"
    some = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    made = {
        "hex": lambda: some("0123456789abcdef", 24), "unique id": lambda: "-".join(some("0123456789abcdef", n) for n in (8, 4, 4, 4, 12)), "12": lambda: some(both, 12), "24": lambda: some(both, 24),
        "40": lambda: some(both, 40), "ghp": lambda: "ghp_" + some(both, 36), "sk": lambda: "sk_live_" + some(both, 24), "base 64": lambda: some(both + "+/", 43) + "=", "access": lambda: "AKIA" + some(letters.upper() + "0123456789", 10),
    }
    return [(name, f()) for name, f in made.items() for _ in range(each)]


def test_formats_beyond_the_patterns_are_found(spark):
    planted = planted_formats()
    clean = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    odd = ["www.example.com/some-long-path/index.html", "averylongfilename_with_parts.tar.gz", "4111-1111-1111-1111", "state-of-the-art", "foo_bar_baz_qux", "INTERNATIONALIZATION"]
    rows_ = [(10**9 + k, f"Some words stand before {v} and some after it.") for k, v in enumerate([v for _, v in planted] + odd)]
    both = clean.unionByName(spark.createDataFrame(rows_, "doc_id long, text string"))
    found = {r.doc_id: [(s.start, s.end) for s in r.spans if s.kind == "format"] for r in secrets.find_secrets(both).collect()}
    caught = [k for k, (_, v) in enumerate(planted) if found[10**9 + k] == [(24, 24 + len(v))]]
    assert len(caught) >= 0.9 * len(planted)
    assert not [k for k, s in found.items() if s and not 10**9 <= k < 10**9 + len(planted)]


def test_given_credentials_make_a_format(spark):
    r = random.Random(3)
    own = lambda: "zq" + "".join(r.choice("xyzwv") for _ in range(14))
    given = spark.createDataFrame([("house", own()) for _ in range(200)] + [(None, "lost"), ("house", None), ("house", "")], "kind string, value string")
    texts = [f"{words(20, k)} " + (own() if k < 20 else "") for k in range(200)]
    found = {x.doc_id: x.spans for x in secrets.find_secrets(plain(spark, texts), given=given).collect()}
    assert sum(len(found[k]) == 1 for k in range(20)) >= 18 and sum(len(found[k]) for k in range(20, 200)) == 0


def test_letters_score_each_letter_by_its_share():
    m = Letters(["aab", "b"])
    a, b = m.scores(["a", "b"]).tolist()
    assert a == b and abs(m.scores(["aabb"])[0] - (4 * (a - m.last) + m.last)) < 1e-9
    assert m.scores(["é"])[0] < a and m.scores([""])[0] == m.last and len(m.scores([])) == 0 and len(Letters([]).scores(["x"])) == 1
