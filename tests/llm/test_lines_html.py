import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from threatscan.llm import dedup_lines as D
from threatscan.llm import html as H


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    line = lambda n=None: " ".join(f"w{rng.randrange(3000)}" for _ in range(n or rng.randint(3, 20)))
    shared = [line() for _ in range(12)]
    passage = line(80)
    docs = {}
    for i in range(60):
        ls = [line() for _ in range(rng.randint(2, 12))]
        if i % 3 == 0:
            at = rng.randint(0, len(ls))
            ls[at:at] = shared
        if i % 4 == 0:
            ls.insert(rng.randint(0, len(ls)), passage)
        docs[i] = "\n".join(ls)
    docs[100] = docs[1]
    return docs, shared, passage


def run(spark, rows, schema="doc_id long, text string"):
    return {r.doc_id: r for r in D.dedup_lines(spark.createDataFrame(rows, schema)).collect()}


def brute(rows):
    """Texts left by (doc_id, text): runs are compared as texts, in order of id, text hash and line."""
    order = sorted({r for r in rows if r[0] is not None and r[1] is not None}, key=lambda r: (r[0], tk(r[1])))
    first, gone = {}, {r: set() for r in order}
    spans = {r: D.runs(x := r[1].encode().split(b"\n"), D.line_hashes(x, 0), D.EVERY, D.PASSAGE) for r in order}
    for r in order:
        for a, b in spans[r]:
            place = first.setdefault("\n".join(r[1].split("\n")[a:b]), (r, a))
            if place != (r, a):
                gone[r] |= set(range(a, b))
    return {r: "\n".join(x for i, x in enumerate(r[1].split("\n")) if i not in gone[r]) for r in order}


def tk(text):
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def test_repeats_go_and_the_first_place_stays(spark, corpus):
    docs, shared, passage = corpus
    got = run(spark, list(docs.items()))
    assert {i: r.text for i, r in got.items()} == {r[0]: t for r, t in brute(docs.items()).items()}
    assert [i for i, r in got.items() if passage in (r.text or "").split("\n")] == [0]
    assert not any(x in shared for i, r in got.items() if i > 3 and i % 4 for x in r.text.split("\n"))  # over 50 words: the rims go too
    assert set(shared) <= set(got[0].text.split("\n"))
    assert got[100].text == "" and got[100].lines_removed == len(docs[1].split("\n"))
    for i, text in docs.items():  # what stays is a subsequence, and every line stays somewhere
        it = iter(text.split("\n"))
        assert not got[i].text or all(x in it for x in got[i].text.split("\n"))
    assert {x for t in docs.values() for x in t.split("\n")} == {x for r in got.values() for x in r.text.split("\n")} - {""}


def test_real_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert {(r.doc_id): r.text for r in D.op4(spark, "/root/testdata/sf0.001").collect()} == {r[0]: t for r, t in want.items()}


def test_passages_of_short_lines_go_whole(spark):
    rng = random.Random(11)
    line = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passages = [[line(n) for n in ns] for ns in ([12] * 5, [20, 35], [51], [5] * 11, [49, 2], [1] * 60)]
    rows = []
    for n in range(40):
        own = [line(rng.randint(1, 12)) for _ in range(8)]
        at = rng.randint(0, 8)
        rows.append((n, "\n".join(own[:at] + passages[n % 6] + own[at:])))
    got = run(spark, rows)
    for k, p in enumerate(passages):
        assert [i for i, r in got.items() if set(p) & set(r.text.split("\n"))] == [k]
    own = lambda t: [x for x in t.split("\n") if not any(x in p for p in passages)]
    assert all(own(got[i].text) == own(t) for i, t in rows)


def test_unique_texts_of_a_repeated_id_stay(spark):
    texts = ["\n".join(f"{c} line {j} with some words of its own" for j in range(8)) for c in "abc"]
    rows = [(3, texts[0]), (4, texts[0]), (4, texts[1]), (5, texts[2]), (5, texts[2])]
    got = sorted((r.doc_id, r.text) for r in D.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([(3, texts[0]), (4, ""), (4, texts[1]), (5, texts[2]), (5, texts[2])])


def test_chunk_ends_resist_shifts():
    rng = random.Random(2)
    lines = [f"line {rng.random()}".encode() for _ in range(400)]
    for at in (0, 57, 200, 399):
        moved = [*lines[:at], b"a new line", *lines[at:]]
        h = [D.line_hashes(x, 0) for x in (lines, moved)]
        was, now = ([(tuple(x[a:b])) for a, b in zip([0, *e], e)] for x, e in ((y, D.chunk_ends(z, 2)) for y, z in zip((lines, moved), h)))
        assert len(set(was) - set(now)) <= 8 and len(set(now) - set(was)) <= 8
    sizes = np.diff([0, *D.chunk_ends(D.line_hashes(lines, 0), 2)])
    assert sizes[:-1].min() >= 2 and 2.5 < sizes.mean() < 4


def test_a_hash_clash_starts_again_with_another_seed(spark, monkeypatch):
    same = "\n".join(f"shared line {j} of many words" for j in range(6))
    docs = spark.createDataFrame([(i, i, f"own {i} one\nown {i} two\n{same}") for i in range(4)], "doc_id long, tk long, text string")
    seeds, real = [], D._evidence

    def clashing(met, seed):
        seeds.append(seed)
        rows = real(met, seed)
        return rows.unionAll(rows.limit(1).select("of", "h", F.lit(b"other").alias("bytes"))) if seed == 0 else rows

    monkeypatch.setattr(D, "_evidence", clashing)
    assert D.repeated_runs(docs).count() > 0 and seeds == [0, 1]


def test_unique_texts_are_untouched(spark):
    docs = {i: "\n".join(f"line {i} {j} of its own with words" for j in range(9)) for i in range(20)}
    got = run(spark, list(docs.items()))
    assert {i: r.text for i, r in got.items()} == docs and all(r.lines_removed == 0 for r in got.values())


def test_odd_rows(spark):
    same = "\n".join(["one two three four five six"] * 6)
    rows = [(1, None, "a"), (2, "", "b"), (3, same, "c"), (None, same, "d"), (4, "\n\n\n", "e"), (5, "x" * 100_000, "f")]
    out = D.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, lines string"))
    got = {r.lines: r for r in out.collect()}
    assert got["a"].text is None and got["b"].text == "" and got["d"].text == same and got["e"].text == "\n\n\n" and got["f"].text == "x" * 100_000
    assert "one two three four five six" in got["c"].text
    assert D.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy</div><div id="cookie-notice">Cookies</div>
<article><header><h1>Title &amp; more</h1></header><p><b>First<br>line.<p>Second&nbsp; para &lt;x&gt; caf&#233;</p><aside>Aside</aside><form><input><label>Name</label></form>
<section class="comments"><p>Nice!</p></section><p>Last <i>in</i>line</p></article><footer>&copy; me</footer></body></html>"""


def test_markup():
    assert [t for t, k in H.lines(PAGE) if k == H.ARTICLE] == ["Title & more", "First line.", "Second para <x> café", "Last inline"]
    assert H.lines(None) == [] and H.lines("") == [] and H.lines("<p") == [("<p", H.OPEN)]
    assert [t for t, _ in H.lines("a<!-- x <p>b</p>")] == ["a"]
    assert [t for t, _ in H.lines("<div>a</span></div><script>x")] == ["a"]


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_alignment_is_a_longest_common_subsequence():
    rng = random.Random(4)
    for _ in range(300):
        a, b = (np.array([rng.randrange(6) for _ in range(rng.randint(1, 25))]) for _ in range(2))
        i, j = H._positions(a, b)
        assert len(i) == lcs(a.tolist(), b.tolist())
        assert (a[i] == b[j]).all() and (np.diff(i) > 0).all() and (np.diff(j) > 0).all()


def article(body):
    return [t for t, kind in H.lines(f"<html><body><article>{body}</article></body></html>") if kind == H.ARTICLE]


def test_inline_boilerplate_leaves_its_block():
    assert article('<p>Real text <span class="ad">BUY NOW</span> goes on') == ["Real text goes on"]
    assert article("<p>a <button>Subscribe</button>b <span hidden>secret</span>c</p>") == ["a b c"]
    assert article('<p>News <a class="share">Tweet</a></p><div><button>Share this</button></div>') == ["News"]
    assert article("<p>x <span style='display: none'>y <b>z</b></span>w <i aria-hidden=true>v</i></p>") == ["x w"]
    assert article("<p>one <select><option>A<option>B</select>two") == ["one two"]
    assert H.lines('<p>open <span class="ad">BUY</span> text') == [("open text", H.OPEN), ("BUY", H.BOILERPLATE)]


def test_implied_end_tags():
    assert article('<p class="notice">n<p>Body') == ["Body"]
    assert article('<ul><li class="share">x<li>real item</ul>') == ["real item"]
    assert article('<ul><li>a<ul><li class="share">x</ul>b<li>c</ul>') == ["a", "b", "c"]
    assert article('<dl><dt class="related">x<dd>real<dt>too</dl>') == ["real", "too"]
    assert article('<table><tr><td class="ad">x<td>cell<tr><td>row</table>') == ["cell", "row"]
    assert article('<p class="notice">n<div>Body</div>') == ["Body"] and article('<p class="ad">n</p><p>a<h2>b</h2>') == ["a", "b"]
    assert article('<p class="ad">x <span>y<p>Body') == ["Body"]


def test_articles_are_known_and_kept_open():
    assert [k for _, k in H.lines("<div role='main'><p>a</p></div><p>b</p>")] == [H.ARTICLE, H.OPEN]
    assert [k for _, k in H.lines("<div role = main><p>a</p></div>")] == [H.ARTICLE]
    assert article("<p>a</div><p>b</section><p>c") == ["a", "b", "c"]
    assert [t for t, k in H.lines("<div><article><p>a</div><p>b</p></article><p>c") if k == H.ARTICLE] == ["a", "b"]


def test_pages_with_inline_adverts_match_brute_force(spark):
    """Articles whose blocks are known beforehand, with boilerplate put at random places inside and between them."""
    import random

    rng = random.Random(3)
    words = lambda n: " ".join(rng.choice(["alpha", "beta", "g&amp;h", "d\u00e9j\u00e0", "x<br>y"]) for _ in range(n))
    inline = ['<span class="ad">BUY</span>', "<button>Go</button>", "<span hidden>no</span>", '<a class="share">Tweet</a>', "<!-- c -->", "<script>var p='<p>';</script>"]
    between = ['<div class="advert"><p>BUY<p>NOW</div>', "<nav><ul><li>Home<li>News</ul></nav>", '<p class="notice">n', "<aside>see</aside>", '<section class="comments"><p>me too</section>', "<form><p>Name <input></form>"]
    rows, want = [], {}
    for i in range(60):
        blocks = [[words(rng.randint(1, 4)) for _ in range(rng.randint(1, 3))] for _ in range(rng.randint(1, 5))]
        body = ""
        for b in blocks:
            body += rng.choice(between) if rng.random() < 0.5 else ""
            shut = rng.choice(["</p>", ""])
            body += "<p>" + "".join(f"{x} {rng.choice(inline) if rng.random() < 0.6 else ''}" for x in b) + shut
        rows.append((i, f"http://h{i % 7}.example/{i}", f"<html><body><header>Top</header><article>{body}</article><footer>End</footer></body></html>"))
        plain = lambda b: " ".join(x.replace("<br>", " ").replace("&amp;", "&") for x in b)
        want[i] = "\n".join(plain(b) for b in blocks)
    got = H.extracted(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r.page_id: r.text for r in got.collect()} == want


def test_real_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    from html import unescape

    want = {}
    for r in pages.collect():
        body = r.html.split("<article>", 1)[1].split("</article>", 1)[0]
        blocks = re.split(r"</?(?:p|h1)>", body)
        lines = (" ".join(unescape(re.sub("<[^>]*>", " ", b)).split()) for b in blocks)
        want[r.page_id] = "\n".join(x for x in lines if x)
    got = {r.page_id: r for r in H.op2(spark, "/root/testdata/sf0.001").collect()}
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())


def page(i, own, host="h.example"):
    return (i, f"http://{host}/a/{i:04}", f"<body><div>Menu of all pages</div>{''.join(f'<div>{x}</div>' for x in own)}<div>Imprint and legal</div></body>", "x")


def test_differencing_decides_without_an_article(spark):
    rows = [page(i, [f"own text {i} {j}" for j in range(4)]) for i in range(40)]
    rows += [page(90, ["copied one", "copied two", "copied three", "copied four", "copied five", "copied six", "seven", "eight"], "c.example"), page(91, ["copied one", "copied two", "copied three", "copied four", "copied five", "copied six", "seven", "eight"], "c.example")]
    rows += [(100, None, None, "x"), (101, "http://[bad", "", "x"), (102, "http://h.example/a/0001", rows[1][2], "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, lines string")
    out = {r.page_id: r for r in H.extracted(df).collect()}
    got = {i: r.text for i, r in out.items()}
    assert len(out) == len(rows) and (out[5].n_lines, out[5].n_deleted) == (6, 2)
    for i in range(40):
        if i != 1:
            assert got[i] == "\n".join(f"own text {i} {j}" for j in range(4))
    assert "copied one" in got[90] and "copied one" in got[91]  # copies say nothing about each other
    assert got[100] == "" and got[101] == ""
    assert H.extracted(df.limit(0)).count() == 0


def test_copies_do_not_hide_the_page_behind_them(spark):
    """Pages stand beside their copies; the template goes by the next page with other lines."""
    body = lambda own: "".join(f"<p>{x}</p>" for x in ["Top menu", *own, "All rights kept"])
    a, b = [f"own line {i} of a" for i in range(12)], [f"line {i} of b" for i in range(5)]
    rows = [(1, "http://h.example/a1", body(b)), (2, "http://h.example/a2", body(a)), (3, "http://h.example/a3", body(a)), (4, "http://h.example/a4", body(a)), (5, "http://other.example/a4", body(a))]
    got = {r.page_id: r.text for r in H.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "\n".join(b), **dict.fromkeys((2, 3, 4), "\n".join(a)), 5: "\n".join(["Top menu", *a, "All rights kept"])}


def test_neighbours_meet_across_ranges(spark):
    rng = random.Random(7)
    rows = [(i, f"h{i % 3}", f"/{rng.randrange(40):03}", [rng.randrange(8) for _ in range(rng.randint(0, 9))]) for i in range(120)]
    df = spark.createDataFrame(rows, "rid long, host string, path string, hashes array<long>")
    want: dict = {}
    first: dict = {}  # pages of the very same lines are one page
    for r in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        first.setdefault((r[1], tuple(r[3])), r)
    order = list(first.values())
    for a, b in zip(order, order[1:]):
        if a[1] == b[1]:
            for rid, s in zip((a[0], b[0]), H.shared(np.array(a[3]), np.array(b[3]))):
                want.setdefault(rid, set()).update(s)
    want = {r[0]: want.get(first[r[1], tuple(r[3])][0]) for r in rows}
    was = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    try:
        for parts in ("1", "7", "200"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            spark.conf.set("spark.sql.adaptive.enabled", "false")
            got: dict = {}
            for r in H.neighbours_share(df).collect():
                got.setdefault(r.rid, set()).update(r.shared)
            assert got == {k: v for k, v in want.items() if v}, parts
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was[0])
        spark.conf.set("spark.sql.adaptive.enabled", was[1])


def test_articles_go_through_the_alignment(spark):
    """Every page meets its marks: shared lines of articles are found, and the check brings them back."""
    body = lambda i: f"<div>Menu</div><article><p>copied passage</p><p>own {i}</p><p>more of {i}</p></article><div>Imprint</div>"
    rows = [(i, f"http://h.example/{i:03}", body(i)) for i in range(30)] + [(50, "http://h.example/001", body(1)), (1, "http://h.example/001", body(1)), (60, "http://alone.example/", body(60))]
    got = H.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    for r in got:
        i = 1 if r.page_id == 50 else r.page_id
        assert r.text == f"copied passage\nown {i}\nmore of {i}" and (r.n_lines, r.n_deleted, r.n_restored) == (5, 0, int(i != 60))


def test_near_copies_do_not_hide_the_pages_around_them(spark):
    """Runs of near copies, also across ranges: each page is aligned with the page before its run and the one behind it."""
    near = [f"line {i} of all copies" for i in range(20)]
    body = lambda own, foot: "".join(f"<p>{x}</p>" for x in ["Top menu", *own, foot])
    rows = [(0, "http://h.example/a", body(["first page", "x"], "Left foot")), (90, "http://h.example/z", body(["last page", "y"], "Right foot")), (91, "http://h.example/m50", "")]
    own = {i: [f"own {i}", *near] for i in range(1, 61)}
    rows += [(i, f"http://h.example/m{i:02}", body(x, "Left foot" if i % 2 else "Right foot")) for i, x in own.items()]
    rows += [(100 + i, f"http://only.example/{i}", body([f"own {i}", *near], "Foot")) for i in range(5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    was = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    try:
        for parts in ("1", "7", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            spark.conf.set("spark.sql.adaptive.enabled", "false")
            got = {r.page_id: r.text for r in H.extracted(df).collect()}
            want = {i: "\n".join(x) for i, x in own.items()} | {0: "first page\nx", 90: "last page\ny", 91: ""}
            want |= {100 + i: "\n".join(["Top menu", f"own {i}", *near, "Foot"]) for i in range(5)}
            assert got == want, parts
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was[0])
        spark.conf.set("spark.sql.adaptive.enabled", was[1])
