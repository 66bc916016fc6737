import html
import itertools
import re
import time

import numpy as np

from taulab.llm.html import BoostedTrees, Pages, decode, extract, features, main_text, trained, training_pages


def text_of(page):
    return extract([page], trained())[0]


PARTS = (
    '<nav><ul><li><a href="/a">Home</a></li><li><a href=/b>News</a></li></ul></nav><div class="ad">Buy the thing now.</div>',
    "<article><h1>Heading here</h1><p>One &amp; two\n  words of a first paragraph, long enough to be read.<p>Second <a href=x>linked</a> par<b>t</b> ends here.<br>Same block.</article>",
    '<aside class="sidebar"><p>Other stories</p></aside><section id="comments"><div class="comment"><p>I liked it a lot.</p></div></section><footer>&copy; 2020 site</footer>',
)
WANTED = "Heading here\nOne & two words of a first paragraph, long enough to be read.\nSecond linked part ends here. Same block."


def test_article_without_what_is_around_it():
    page = '<!doctype html><html><head><title>T</title><script>var x="</p><p>no";</script><style>p{}</style></head><body><!-- <p>no</p> -->' + "".join(PARTS) + "</body></html>"
    assert text_of(page) == WANTED
    assert text_of(page.replace("<article>", '<div class="post-content">').replace("</article>", "</div>")) == WANTED


def test_odd_markup():
    assert text_of(None) == ""
    assert text_of("<html><body><nav><a href=x>Only</a></nav></body></html>") == ""
    broken = "<article><p>It says a < b and b > c in plain words here.</b></i><p class='x>y'>Quoted \"attribute\" is fine, as you see.</article"
    assert text_of(broken).startswith("It says a < b and b > c in plain words here.")
    long = "<article>" + "<p>Many words stand in this paragraph, and they stay.</p>" * 3000 + "</article>"
    assert text_of(long).count("\n") == 2999
    assert text_of("<div>" * 5000 + "x" + "</div>" * 5000) in ("", "x")


ARTICLE = "<article><h1>Heading here</h1><p>A first paragraph of plain words, long enough to be read.{} It goes on here, in more words.</p><p>The last one ends here, in plain words.</p></article>"


def test_elements_that_an_article_may_hold():
    plain = text_of(ARTICLE.format(""))
    assert plain.count("\n") == 2
    gone = ("<svg/>", '<svg a="/>"/>', "<svg><title>No</title><path d=x></svg>", "<button>No</button>", "<select><option>No</select>", "<noscript><div>No</div></noscript>", "<script>a <!-- b</script>", "<video src=x/>", "<!-- <p> -->")
    for inside in gone:
        assert text_of(ARTICLE.format(inside)) == plain
    # without an end tag they drop nothing; a formula and what stands for an object are text
    for inside in ("<button>word", "<video src=x>word", "<math><mi>word</mi></math>", "<object data=x>word</object>", "<a title=it's>word</a>"):
        assert text_of(ARTICLE.format(inside)) == plain.replace("read.", "read.word")
    assert text_of(ARTICLE.format("&#0000000065;&#99999999999;&#" + "9" * 9000 + ";&#" + "0" * 9000 + "66;")) == plain.replace("read.", "read.A\uFFFD\uFFFDB")


def test_elements_without_their_end_tag_lose_nothing():
    after = "</p><p>A further paragraph stands here, in more plain words.</p><p>It goes on"
    plain = text_of(ARTICLE.format("word " + after))
    assert "A further paragraph stands here" in plain
    for tag in ("button", "select", "label", "option", "canvas", "video", "audio", "form", "fieldset", "dialog", "figure", "noscript", "template"):
        for start in (f"<{tag}>", f'<{tag} class="promo">'):
            got = text_of(ARTICLE.format(f"{start}word {after}"))
            assert "".join(got.split()) == "".join(plain.split()), tag
    assert text_of(ARTICLE.format("<button><select><option>No</button>")) == text_of(ARTICLE.format(""))


def test_time_is_linear_in_the_length_of_a_page():
    parts = ("<a ", "<b>x</i>", '<a ">" ', "<p>x ", "<!-- ", "<button>x", "a<b>", "&#9", "<a b='", "</", "<li>x", "<td>x<div>", "<svg>x</svg>", "<form>x<label>", "<select><option>x", "<i><div><b></i>")
    trained()
    for part in parts:
        page = part * (1_000_000 // len(part))
        start = time.perf_counter()
        extract([page], trained())
        assert time.perf_counter() - start < 40, part


def best_set(parent, decides, value):
    """By trying all sets of deciding nodes in which no kept node has a dropped ancestor; others follow their parents."""
    free = [x for x in range(1, len(parent)) if decides[x]]
    best = None
    for chosen in itertools.product((False, True), repeat=len(free)):
        kept, ok = [True] * len(parent), True
        for x in range(1, len(parent)):
            up = kept[parent[x]]
            kept[x] = up and (chosen[free.index(x)] if decides[x] else True)
            ok = ok and not (decides[x] and chosen[free.index(x)] and not up)
        total = sum(value[x] for x in range(len(parent)) if decides[x] and kept[x])
        if ok and (best is None or total > best):
            best = total
    return best


def test_decoder_finds_the_best_set():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = int(rng.integers(2, 10))
        p = Pages()
        p.tag, p.parent, p.decides = ["div"] * n, [-1, *(int(rng.integers(0, x)) for x in range(1, n))], [True, *(bool(b) for b in rng.random(n - 1) < 0.8)]
        value = np.where(p.decides, rng.normal(size=n), 0.0)
        kept = decode(p, value)
        assert all(kept[x] <= kept[p.parent[x]] for x in range(1, n))
        assert abs(sum(value[x] for x in range(n) if kept[x] and p.decides[x]) - best_set(p.parent, p.decides, value)) < 1e-9


def test_pages_that_were_not_trained_on():
    p = Pages()
    for page in training_pages(120, seed=77):
        p.add(page)
    kept, label = decode(p, np.where(p.decides, trained().margin(features(p)), 0.0)), np.array(p.label)
    asked = np.array(p.decides) & (label >= 0)
    assert (kept[asked] == (label[asked] > 0)).mean() > 0.97
    assert all(kept[x] <= kept[max(0, up)] for x, up in enumerate(p.parent))


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3)).astype(np.float32)
    y = ((x[:, 0] > 0) & (x[:, 1] > 0)).astype(float)
    trees = BoostedTrees.fit(x, y, np.ones(len(y)), rounds=20)
    z = rng.normal(size=(500, 3)).astype(np.float32)
    assert ((trees.margin(z) > 0) == ((z[:, 0] > 0) & (z[:, 1] > 0))).mean() > 0.95


def test_the_table_against_its_article_elements(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    wrong = 0
    source = {r.page_id: r.html for r in pages.collect()}
    out = main_text(pages).collect()
    for r in out:
        body = re.search(r"<article>(.*?)</article>", source[r.page_id], re.S)[1]
        blocks = (re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", "", b))).strip() for b in re.split(r"</?(?:p|h1)\b[^>]*>", body.replace("<br>", " ")))
        wrong += r.text != "\n".join(b for b in blocks if b)
        assert r.n_chars == len(r.text)
    assert len(out) == len(source) and wrong <= 0.01 * len(out)


def test_nulls_repeats_and_an_empty_table(spark):
    schema = "page_id long, url string, html string, text string"
    page = "<body>" + "".join(PARTS) + "</body>"
    rows = [(1, "u", page, "x"), (1, "u", page, "x"), (None, None, page, "x"), (2, "v", None, "x")]
    pages = spark.createDataFrame(rows, schema)
    assert sorted((r.page_id or 0, r.text) for r in main_text(pages).collect()) == [(0, WANTED), (1, WANTED), (1, WANTED), (2, "")]
    assert main_text(pages.limit(0)).collect() == []
