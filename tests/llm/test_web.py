"""Text extraction, archives and address rules."""

import gzip
import hashlib
import random
from pathlib import Path

import pytest

from feedweir.llm import html_text, url_rules, warc
from feedweir.llm.common import new_dir

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><p>no</p>";</script></head><body>
<header><a href="/">Site</a></header><nav><ul><li><a>Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Title &amp; more</h1><p><b>First line<br><p>Second&nbsp;  <i>line</i> &lt;b&gt;</p><div class="ad">Buy</div><ul><li>one<li>two</ul><form><input>Go</form><p>{0}</p>
<section id="comments"><p>nice</p></section></article><aside class="sidebar">more</aside><footer>&copy; me</footer></body></html>"""


def test_article_only():
    assert html_text.main_blocks(PAGE.format("End"), {}) == ["Title & more", "First line", "Second line <b>", "one", "two", "End"]


@pytest.mark.parametrize("page", ["", "<", "plain", "<p", "<script>x", "</div></p>", "<!-- open", "<article>" * 50, "<table><tr><td>a<td>b<tr><td>c", "<![CDATA[x<y]]>", "&#xZZ;&bogus;", "<p>" * 2000])
def test_broken_markup(page):
    blocks = html_text.main_blocks(page, {})
    assert all(isinstance(b, str) and b == " ".join(b.split()) and b for b in blocks)


def test_style_tree_finds_unmarked_boilerplate(spark):
    """Without any telling name, what repeats on a host goes, and what differs stays."""
    page = '<body><div class="q1"><p>Our great site</p><p>Read all about it</p></div><div class="q2"><p>Story {0} begins</p><p>and {0} ends</p></div></body>'
    rows = [(i, f"http://h{i % 2}.example.com/{i}", page.format(i * 7 + 1)) for i in range(24)] + [(99, "http://lone.example.com/", page.format("x"))]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    for limit in (500_000, -1):  # broadcast, and joined by host
        found = {r["page_id"]: r["text"] for r in html_text.extract_text(docs, max_broadcast_nodes=limit).collect()}
        assert found[3] == "Story 22 begins\nand 22 ends"
        assert found[99].startswith("Our great site")  # one page tells nothing


def test_importance_equals_brute_force(spark):
    import math

    pages = [("h", f'<div class="a"><p>{t}</p></div>') for t in ("same", "same", "other", "third")]
    pages = [(h, p + f"<div>{i}</div>") for i, (h, p) in enumerate(pages)]
    rows = html_text.importance(spark.createDataFrame(pages, "host string, html string")).collect()
    path = next(p for p, _ in html_text.parse(pages[0][1])[1])
    inner = {r["path"]: r for r in rows}
    node = html_text._hash(f"{html_text._hash('')}>div.a")
    want = 0.1 * 0 + 0.9 * (1 - (math.log(2) + 0 + 0) / 3 / math.log(4))
    assert path in inner and abs(inner[node]["importance"] - want) < 1e-9 and inner[node]["pages"] == 4


def test_repeated_article_stays(spark):
    docs = spark.createDataFrame([(i, "http://a.example.com/x", PAGE.format("End")) for i in range(30)] + [(None, None, None), (None, None, "")], "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as host")
    found = html_text.extract_text(docs).collect()
    assert [r["n_chars"] for r in found if r["page_id"] is None] == [0, 0]
    assert {r["text"] for r in found if r["page_id"] is not None} == {"Title & more\nFirst line\nSecond line <b>\none\ntwo\nEnd"}
    assert html_text.extract_text(docs.limit(0)).collect() == []


def archive_rows():
    draw = random.Random(1)
    big = "<p>" + "é" * 700
    rows = [(i, f"http://x/{i}", "".join(draw.choice("ab<>é\r\n ") for _ in range(draw.randrange(3000)))) for i in range(60)]
    return rows + [(100, "u\r\nEvil: 1", big), (101, None, big), (7, "again", big), (102, "s", "tiny"), (103, "s", "tiny"), (104, "n", None), (None, "null", big), (3, rows[3][1], rows[3][2])]


def test_archives_round_trip(spark):
    rows = archive_rows()
    docs = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as shard", "2 as digest").repartition(4)
    where = new_dir(spark, "test-warc")
    manifest = warc.write_archives(docs, where, file_bytes=3000, min_shards=3).collect()
    assert sum(m["records"] for m in manifest) == len(rows) and len(manifest) > 6
    found = warc.read_archives(spark, where, with_payload=True).collect()
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        top = max((k for k, _, h in rows if (h or "").encode() == data and k is not None), default=None)
        revisit = len(data) >= 1000 and i != top
        want.append((-1 if i is None else i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", top if revisit else -1, None if revisit else data))
    key = lambda r: r[:5]
    got = [(-1 if r["page_id"] is None else r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], -1 if r["refers_to"] is None else r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in found]
    assert sorted(got, key=key) == sorted(want, key=key)
    folder = Path(where.removeprefix("file://"))
    files = {p.name: p.read_bytes() for p in folder.glob("*.warc.gz")}
    assert set(files) == {m["file"] for m in manifest} and not list(folder.glob("*.tmp"))
    assert all(hashlib.sha256(files[m["file"]]).hexdigest() == m["sha256"] and gzip.decompress(files[m["file"]]).count(b"WARC/1.1\r\n") == m["records"] for m in manifest)
    again = new_dir(spark, "test-warc")
    warc.write_archives(docs.repartition(9), again, file_bytes=3000, min_shards=3)
    assert {p.name: p.read_bytes() for p in Path(again.removeprefix("file://")).glob("*.warc.gz")} == files


def test_no_pages_no_archive(spark):
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_damaged_archive_is_noticed():
    raw = warc.make_record(1, "u", b"payload", None, False, "2000-01-01T00:00:00Z")
    assert warc.parse_record(raw)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.parse_record(raw.replace(b"payload", b"paylord"))


def test_rules_equal_brute_force(spark):
    draw = random.Random(2)
    labels, paths = ["a", "b", "com", "net", "x-y", ""], ["/", "/a/", "/a/b", ""]
    rules = sorted({(".".join(draw.choice(labels[:5]) for _ in range(draw.randint(1, 3))), draw.choice(paths), draw.choice(["allow", "block"])) for _ in range(40)})
    rules = [r for i, r in enumerate(rules) if r[:2] not in {x[:2] for x in rules[:i]}]
    urls = [f"http://{'.'.join(draw.choice(labels) for _ in range(draw.randint(1, 4))).upper()}{draw.choice(paths)}{draw.choice(['', 'z', '?q=/a/', '#f', '/b'])}" for _ in range(400)]
    urls += [None, "", "no scheme", "://", "HTTP://a.COM", "http://a.com/x://b.net/", "http://co.m/"] + ["http://hot.a.com/a/"] * 300

    def judge(u):
        if u is None or "://" not in u:
            host = path = ""
        else:
            rest = u.split("://", 1)[1]
            n = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
            host, tail = rest[:n].lower(), rest[n:]
            path = tail[: min((tail.index(c) for c in "?#" if c in tail), default=len(tail))]
        fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fits, key=lambda r: (len(r[0] + r[1]), r[2] == "block", r[0] + r[1]), default=None)
        return host, path, best and best[0] + best[1], best[2] if best else "allow"

    docs = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "3 as part", "4 as key")
    found = {r["page_id"]: tuple(r)[1:] for r in url_rules.judge_urls(docs, rules, rows_per_range=40).collect()}
    assert found == {i: judge(u) for i, u in enumerate(urls)}
    assert url_rules.judge_urls(docs.limit(0), rules).collect() == []


def test_characters_that_grow_when_lowered_shift_nothing():
    page = f"<p>{'İ' * 40}</p><p>x<span class='ad'>{'İ' * 9}</span></p><script>x</SCRIPT><p>abc def</p><ſcript><p>last words of the article</p>"
    assert html_text.main_blocks(page, {}) == ["İ" * 40, "x", "abc def", "<ſcript>", "last words of the article"]


def test_names_that_only_may_mean_noise_leave_the_verdict_to_the_tree():
    page = '<article><p>a</p><div class="login-story"><p>b</p></div><div id="share-price">c</div><div class="cookie-notice-box">d</div><span class="social-work">e</span></article>'
    assert html_text.main_blocks(page, {}) == ["a", "b", "c", "e"]
    path = next(x.path for b in html_text.parse(page)[0] for x in b.branches if b.text == "b" and x.prior == "doubtful")
    assert html_text.main_blocks(page, {path: 0.8}) == ["a", "c", "e"]


def test_text_beside_a_small_article_is_judged_like_any():
    main = '<div class="q"><p>The long main text of this page lies here.</p></div>'
    assert html_text.main_blocks(f"<article>teaser</article>{main}", {}) == ["teaser", "The long main text of this page lies here."]


@pytest.mark.parametrize("piece", ['<span class="ad">', "<a title=\"x>", "<b '", "<", "<p", "<div>x", "</div>", "<!--", "<script>", "<li>", '<div class="a"><p>', "&", "<td>", "</b class=ad>", "<span class='ad'></i>"])
def test_a_megabyte_of_broken_markup_takes_seconds(piece):
    import time

    begin = time.time()
    page = piece * (1_000_000 // len(piece))
    assert html_text.main_blocks(f"<p>first</p>{page}", {})[0].startswith("first")
    assert time.time() - begin < 20


def brute_texts(rows, threshold, weight, min_pages):
    """The same decisions from plain dictionaries."""
    import math
    from collections import defaultdict

    pages = defaultdict(set)
    for host, page in rows:
        for h, path, kind, feature, signature in html_text.style_rows(host, page):
            pages[h, path, kind, feature].add(signature)
    by_node = defaultdict(lambda: ([], []))
    for (h, path, kind, _), seen in pages.items():
        by_node[h, path][kind].append(len(seen))
    found = defaultdict(dict)
    for (h, path), (styles, texts) in by_node.items():
        m = sum(styles)
        if m >= max(2, min_pages) and texts:
            looks = -sum(c / m * math.log(c / m, m) for c in styles)
            reads = max(0.0, 1 - sum(math.log(c, m) for c in texts) / len(texts))
            found[h][path] = (1 - weight) * looks + weight * reads
    return ["\n".join(html_text.main_blocks(page, found[host], threshold, priors)) for host, page in rows for priors in (True, False)]


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").is_dir(), reason="no test tables")
def test_extraction_equals_brute_force_and_the_tree_decides(spark):
    from feedweir.llm.common import table
    from feedweir.llm.url_rules import host_of

    pages = table(spark, "/root/testdata/sf0.1", "pages").where("page_id < 1200")
    rows = pages.select("page_id", host_of(pages["url"]).alias("host"), "html").orderBy("page_id").collect()
    texts = lambda **options: [r["text"] for r in html_text.extract_text(pages, **options).orderBy("page_id").collect()]
    want = brute_texts([(r["host"], r["html"]) for r in rows], html_text.THRESHOLD, 0.5, 5)
    alone = texts(priors=False)
    assert texts() == want[::2] and alone == want[1::2]
    without = texts(priors=False, threshold=-1.0)
    assert sum(a != b for a, b in zip(alone, without)) > 100  # pages from which the tree alone takes something


def test_the_tree_decides_inside_a_marked_article(spark):
    """An unnamed box that repeats goes, repeated paragraphs and lists stay."""
    page = '<article><h1>Story {0}</h1><p>All rights explained.</p><div class="zz">Get our app now</div><ul><li>as always</li></ul><p>It was {0}.</p></article>'
    docs = spark.createDataFrame([(i, "http://a.example.com/x", page.format(i)) for i in range(30)], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html_text.extract_text(docs).collect()} == {i: f"Story {i}\nAll rights explained.\nas always\nIt was {i}." for i in range(30)}
    assert "Get our app now" in html_text.extract_text(docs, threshold=-1.0).first()["text"]


def test_a_very_long_page_is_read_whole(spark):
    text = "\n".join(f"paragraph {i} of the long page" for i in range(60_000))
    page = "<article>" + "".join(f"<p>{x}</p>" for x in text.split("\n")) + "</article>"
    found = html_text.extract_text(spark.createDataFrame([(1, "http://a.b/", page)], "page_id long, url string, html string")).first()
    assert found["text"] == text and found["n_chars"] == len(text)
