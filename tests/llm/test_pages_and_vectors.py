"""WARC, main text and vector search against brute force, with odd rows."""

import gzip
import hashlib

import numpy as np
import pytest

from graphloom.llm import ann, htmltext, topk, warc
from graphloom.scratch import Scratch

from .conftest import CLASHES, table

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head><body class="content">
<header><p>Site name and motto</p></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<div class="ad">Buy our very good things today for little money, you will like them a lot.</div>
<article><h1>The   title</h1><p>First <b>bold</b> paragraph with enough words &mdash; and a <a href="#">link</a> in it.<br><p>Sh is.</p>
<aside>Related things that nobody needs to read here at all, really.</aside><p>Last one&nbsp;&copy;</p><div id="comments"><p>I think that this is a reader's comment of some length.</p></div></article>
<form><label>Name</label><input></form><div class="cookie-notice">We use cookies to make this page work better for all of you.</div><footer>&copy; nobody</footer>"""


@pytest.fixture(scope="module")
def pages(spark):
    big = "<p>" + "word " * 400 + "</p>"
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (9, "http://a/9", big), (3, None, "small"), (4, "http://a/ 4\n", "small"), (5, "http://a/5", None), (6, "", ""), (7, "u", PAGE), (7, "u", PAGE), (None, "n", big), (None, None, None), (9, "http://a/9", big), (10, "é", "<p>é" + "x" * 2_000_000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)


@pytest.fixture(scope="module")
def no_pages(spark):
    return spark.createDataFrame([], "page_id long, url string, html string")


def test_warc_round_trip(pages, no_pages):
    found = warc.warc_round_trip(pages).collect()
    rows = pages.collect()
    assert len(found) == len(rows) and all(r["verified"] for r in found)
    kinds = {(r["page_id"], r["payload_digest"]): r for r in found}
    for p in rows:
        raw = (p["html"] or "").encode()
        r = kinds[p["page_id"], hashlib.sha1(raw).hexdigest()]
        assert r["payload_bytes"] == len(raw)
        assert (r["record_type"], r["refers_to"]) == (("revisit", 9) if p["page_id"] in (1, 2) else ("response", None))
    assert warc.warc_round_trip(no_pages).collect() == []
    extra = pages.selectExpr("*", *[f"{v} as `{k}`" for k, v in CLASHES.items()])
    assert table(warc.warc_round_trip(extra)) == table(warc.warc_round_trip(pages))


def test_records_keep_texts_and_urls(spark, pages):
    where = Scratch(spark, "test").path("warc")
    manifest = warc.archive_pages(pages, where, roll=1000).collect()
    assert sum(r["records"] for r in manifest) == pages.count() and len(manifest) > 3
    back = warc.read_warc(spark, where)
    texts = {r["html"] or "" for r in pages.collect()}
    assert {bytes(r["payload"]).decode() for r in back.where("record_type = 'response'").collect()} == texts
    assert back.where("target_uri = 'http://a/%204%0A'").count() == 1


def test_reader_is_incremental_and_strict():
    made = b"".join(warc.page_record(f"urn:page:{i}:0", "u", b"x" * i, hashlib.sha1(b"x" * i).hexdigest(), None, "2000-01-01T00:00:00Z") for i in (0, 5, 100_000))
    for size in (1, 7, 1 << 20):
        got = list(warc.read_records(made[i : i + size] for i in range(0, len(made), size)))
        assert [len(warc.payload_of(h, b)) for h, b, _ in got] == [0, 5, 100_000] and all(ok for *_, ok in got)
    assert gzip.decompress(made).count(b"WARC/1.1") == 3
    with pytest.raises(EOFError):
        list(warc.read_records([made[:-20]]))
    raw = gzip.decompress(made[: len(made)])
    broken = gzip.compress(raw.replace(b"xxxxx\r\n\r\nWARC", b"xxxxy\r\n\r\nWARC", 1))
    assert [ok for *_, ok in warc.read_records([broken])] == [True, False, True]


def test_main_text(pages, no_pages):
    tree = htmltext.trained_tree()
    assert htmltext.main_text(PAGE, tree).split("\n") == ["The title", "First bold paragraph with enough words — and a link in it.", "Sh is.", "Last one ©"]
    found = htmltext.extract_text(pages).collect()
    assert len(found) == pages.count() and all(r["n_chars"] == len(r["text"]) for r in found)
    assert {r["text"] for r in found if r["page_id"] in (5, 6)} == {""}
    assert htmltext.extract_text(no_pages).collect() == []


def test_options_without_end_tags_hide_nothing_after_them():
    tree = htmltext.trained_tree()
    article = "<article><p>" + "word " * 40 + "</p></article>"
    for choices in (
        "<datalist id=q><option value=a><option value=b></datalist>",
        "<datalist id=q><option value=a>",
        "<form><input list=q><datalist id=q><optgroup><option>one<optgroup><option>two</datalist></form>",
        "<div><option>one</div>",
        "<p><span><option>one</span>",
        "<option>one",
        "<option>one</option>",
    ):
        for page in (choices + article, choices + article + "<div><option>late</option></div>"):
            assert htmltext.main_text(page, tree).split() == ["word"] * 40, page
            assert not {"one", "two", "late"} & {w for b in htmltext.blocks_of(page) for w in b.text.split()}, page
    assert [b.text for b in htmltext.blocks_of("<div>a<span><option>b<b>c</span>d<option>e</option>f<br>g</div>")] == ["a d f g"]


def test_main_text_without_marks():
    tree = htmltext.trained_tree()
    body = "This is a long paragraph of an article whose page has no telling elements at all and it goes on for more than twenty words."
    page = f"<div><a href=1>Home</a></div><div><a href=2>News</a></div><h1>A headline here</h1><div>{body}</div><div>{body}</div><div><a href=3>More</a></div><div><a href=4>Legal</a></div>"
    assert htmltext.main_text(page, tree).split("\n") == ["A headline here", body, body]
    for broken in ("<p>a<b", "<p title='x>y", "<!-- open", "<script>x", "a < b > c", "<article><p>" + "<b>" * 5000 + "deep"):
        htmltext.main_text(broken, tree)


def _page(rng):
    """A page with marks of many kinds, and the text of its article."""
    words = lambda a, b: " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "&amp;"]) for _ in range(rng.randint(a, b)))
    menu = "".join(f"<li><a href=x>{words(1, 4)}</a>" for _ in range(rng.randint(3, 8)))
    before = rng.choice([f"<header><p>{words(1, 12)}</header>", f'<div class="masthead">{words(2, 9)}</div>', ""]) + f"<nav><ul>{menu}</ul></nav>"
    before += rng.choice([f'<div class="ad">{words(3, 70)}</div>', f'<div class="cookie-notice"><p>{words(8, 60)}</div>', f"<form>{words(2, 10)}<button>{words(1, 2)}</form>", ""])
    title = words(4, 14)
    inner, kept = "", [title]
    for _ in range(rng.randint(2, 9)):
        text, kind = words(1, 150), rng.random()
        if kind < 0.8:
            kept.append(text)
            inner += f"<p>{text}" if kind < 0.6 else f"<h2>{text}</h2>"
        else:
            inner += rng.choice([f"<aside>{words(5, 60)}</aside>", f'<div class="advert">{words(5, 40)}</div>', f'<div class="share"><a href=x>{words(2, 2)}</a></div>'])
    article = rng.choice(["<article><h1>{}</h1>{}</article>", "<main><h1>{}</h1>{}</main>", '<div class="post-content"><h1>{}</h1>{}</div>']).format(title, inner)
    after = rng.choice([f'<aside class="sidebar"><h3>{words(2, 2)}</h3><ul>{menu}</ul><p>{words(10, 60)}</aside>', f'<section id="comments"><p>{words(10, 90)}<p>{words(3, 50)}</section>', ""])
    return f"<html><body>{before}{article}{after}<footer><p>{words(4, 30)}</footer></body></html>", "\n".join(kept).replace("&amp;", "&")


def test_tree_reads_words_and_links_first_and_knows_pages_it_was_not_trained_on():
    import random

    rng, tree = random.Random(1), htmltext.trained_tree()
    top = tree.root
    assert top[0] not in htmltext.MARKS and all(side[0] not in htmltext.MARKS for side in top[2:] if isinstance(side, tuple))
    pages = [_page(rng) for _ in range(300)]
    assert sum(htmltext.main_text(page, tree) == truth for page, truth in pages) >= 297


def test_main_text_equals_a_parse_by_the_standard_library():
    import pyarrow.parquet as pq
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__()
            self.depth, self.blocks, self.now = 0, [], ""

        def flush(self):
            if self.depth and self.now.split():
                self.blocks.append(" ".join(self.now.split()))
            self.now = ""

        def handle_starttag(self, tag, attrs):
            if tag in htmltext.BLOCK:
                self.flush()
            self.depth += tag == "article"
            self.now += " " if tag == "br" else ""

        def handle_endtag(self, tag):
            if tag in htmltext.BLOCK:
                self.flush()
            self.depth -= tag == "article"

        def handle_data(self, data):
            self.now += data

    tree = htmltext.trained_tree()
    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist():
        parser = Article()
        parser.feed(page)
        parser.close()
        parser.flush()
        assert htmltext.main_text(page, tree) == "\n".join(parser.blocks)


def test_hard_pages_take_linear_time():
    import time

    for page in ("<a" * 500_000, "<div>" * 200_000 + "x" + "</b>" * 200_000, "<p>x<b>" * 50_000, "<a \"'>" * 100_000, "<title>" * 100_000, "<option>" * 100_000 + "<div>a", "<button>a" * 100_000, "&" * 1_000_000):
        began = time.time()
        htmltext.blocks_of(page)
        assert time.time() - began < 10, page[:20]


def test_unclosed_elements_end_with_their_parent():
    tree = htmltext.trained_tree()
    article = "<article><p>" + "word " * 40 + "</p></article>"
    for opened in ("<div><button>no</div>", "<form><svg><text>no</form>", "<div><select><option>no</div>", "<div><canvas>no</div>", "<select><option>no"):
        assert htmltext.main_text(opened + article, tree).split() == ["word"] * 40, opened


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 16))
    x[700:760] = x[20]  # many equal vectors
    x[800:900] = x[40] + rng.normal(size=(100, 16)) * 0.05
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32).astype(float))]
    rows += [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [1.0] * 15 + [None]), (2080, [1.0, 2.0]), (2081, [2.0, 1.0]), (None, [1.0] * 16), rows[40], (60, [1.0] * 16), (2100, [])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)


def brute(rows, every, k, score, usable):
    good = [(r["vec_id"], tuple(r["embedding"])) for r in rows if r["vec_id"] is not None and r["embedding"] is not None and usable(r["embedding"])]
    good = sorted(set(good))
    out = []
    for i, q in good:
        if i % every == 0:
            near = sorted((-score(q, v), j) for j, v in good if j != i and len(v) == len(q))[:k]
            out.append([(i, n + 1, j, -s) for n, (s, j) in enumerate(near)])
    return out


def _sum(a, b):
    total = 0.0
    for x, y in zip(a, b, strict=True):
        total += x * y
    return total


def test_nearest(spark, vectors):
    finite = lambda v: all(x is not None and np.isfinite(x) for x in v) and any(v)
    expected = brute(vectors.collect(), 20, 20, _sum, finite)
    got = [tuple(r) for r in ann.nearest(vectors, shard_rows=400, block_rows=20).collect()]
    assert len(got) == sum(map(len, expected))
    hits = len({(a, c, d) for a, _, c, d in got} & {(a, c, d) for q in expected for a, _, c, d in q})
    assert hits / len(got) > 0.95
    equal = [x for q in expected for x in q if q[0][0] == 20]
    assert [x for x in sorted(got) if x[0] == 20][:19] == equal[:19]
    assert ann.nearest(vectors.limit(0)).collect() == []
    extra = vectors.selectExpr("*", "1 as id", "2 as v", "3 as score", "4 as rank")
    assert table(ann.nearest(extra, shard_rows=400)) == table(ann.nearest(vectors, shard_rows=400))


def test_exact_top(spark, vectors):
    finite = lambda v: all(x is not None and np.isfinite(x) for x in v)
    whole = lambda a, b: sum(int(np.floor(256 * x)) * int(np.floor(256 * y)) for x, y in zip(a, b, strict=True))
    expected = sorted(x for q in brute(vectors.collect(), 50, 5, whole, finite) for x in q)
    got = sorted(tuple(r) for r in topk.top_scores(vectors, shard_rows=300, block_rows=10).collect())
    assert got == expected
    assert topk.top_scores(vectors.limit(0)).collect() == []


def test_bit_sliced_scores():
    rng = np.random.default_rng(4)
    rows = rng.integers(-300, 300, (200, 9))
    index = topk.BitSlicedIndex(rows)
    for _ in range(20):
        w = rng.integers(-50, 50, 9)
        order = sorted(range(200), key=lambda r: (-int(rows[r] @ w), r))
        assert set(index.top(w, 7, index.all)) == set(order[:7])
    huge = topk.BitSlicedIndex(topk.quantised(np.array([[1e30, 1.0], [2e30, 1.0], [-1e30, 5.0]])))
    assert huge.top(topk.quantised(np.array([[1.0, 1.0]]))[0], 1, huge.all) == [1]


def test_scores_beyond_64_bits_are_ranked_exactly(spark):
    rows = [(0, [1e160, 1.0]), (1, [1e305, 0.0]), (2, [1.7e308, 0.0]), (3, [1.1e305, 0.0]), (4, [-1e307, 0.0]), (5, [-1e306, 0.0]), (6, [0.0, 3.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_scores(frame, k=6).collect())
    assert [r[2] for r in got] == [2, 3, 1, 6, 5, 4]
    assert got[0][3] == (1 << 63) - 1 and got[5][3] == -(1 << 63) + 1 and got[3][3] == 256 * 256 * 3


def test_many_vectors_under_one_id(spark):
    rng = np.random.default_rng(8)
    rows = [(20, v.tolist()) for v in rng.normal(size=(600, 4))] + [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 4)), 100)]
    frame = spark.createDataFrame(rows + rows[:50], "vec_id long, embedding array<double>")
    got = ann.nearest(frame, shard_rows=200, block_rows=20).collect()
    assert len(got) == (600 + 15) * 20 and all(r["vec_id"] != 20 for r in got if r["query_id"] == 20)


def test_forest_prunes_and_finds():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(6000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    asked = x[::100]
    share, hits = 0, 0
    for q, found in zip(asked, ann.PrefixForest(x).candidates(asked, 800), strict=True):
        best = np.argsort(-(x @ q))[:21]
        share += len(found) / len(x)
        hits += np.isin(best, found).mean()
    assert hits / len(asked) > 0.95 and share / len(asked) < 0.25
