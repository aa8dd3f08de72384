import io
import random

import numpy as np
import pyarrow as pa

from rasterflow.llm import op4_warc, op5_html_text
from rasterflow.llm.op4_warc import Gap, Record, gzip_member, record_bytes, salvage, sha1_base32
from rasterflow.llm.op5_html_text import extract, main_text

PAGES = "page_id long, url string, html string, first string"


def read(b):
    return list(salvage(lambda at, n: b[at : at + n], len(b)))


def archive(n, plain=False):
    rnd = random.Random(n)
    parts = [record_bytes("response", f"<urn:x:{i}>", bytes(rnd.randrange(256) for _ in range(rnd.choice([0, 10, 3000]))), more={"X-Page-Id": str(i)}) for i in range(n)]
    return parts if plain else [gzip_member(p) for p in parts]


def ids(found):
    return [int(x.headers["x-page-id"]) for x in found if isinstance(x, Record)]


def test_round_trip_of_both_kinds():
    for plain in (False, True):
        parts = archive(12, plain)
        found = read(b"".join(parts))
        assert ids(found) == list(range(12)) and not any(isinstance(x, Gap) for x in found)
        assert all(sha1_base32(x.payload) == x.headers["warc-payload-digest"][5:] for x in found)


def test_damage_costs_only_its_own_record():
    for plain in (False, True):
        parts = archive(10, plain)
        for k in range(10):
            broken = bytearray(parts[k])
            broken[len(broken) // 2] ^= 0x55
            found = read(b"".join([*parts[:k], bytes(broken), *parts[k + 1 :]]))
            assert set(range(10)) - {k} <= set(ids(found))
            gaps = [x for x in found if isinstance(x, Gap)]
            if k not in ids(found):
                assert [(g.start, g.end) for g in gaps] == [(sum(map(len, parts[:k])), sum(map(len, parts[: k + 1])))]


def test_truncated_member_and_rubbish_between():
    parts = archive(5)
    b = b"rubbish\x1f\x8b\x08" + parts[0] + parts[1][:40] + parts[2] + b"\0" * 300_000 + parts[3] + parts[4][:-9]
    found = read(b)
    assert ids(found) == [0, 2, 3, 4]  # the last lacks only its check sum, its digest holds
    assert len([x for x in found if isinstance(x, Gap)]) == 4
    assert read(b"") == [] and [type(x) for x in read(b"abc")] == [Gap]


def test_several_records_in_a_member_and_other_versions():
    parts = [x.replace(b"WARC/1.1", v, 1) for x, v in zip(archive(9, True), [b"WARC/1.1", b"WARC/0.18", b"WARC/1.0"] * 3, strict=True)]
    assert ids(read(b"".join(parts))) == list(range(9))
    whole = gzip_member(b"".join(parts))
    assert ids(read(whole)) == list(range(9)) and not any(isinstance(x, Gap) for x in read(whole))
    assert ids(read(gzip_member(b"".join(parts[:4])) + gzip_member(b"".join(parts[4:])))) == list(range(9))
    # a member cut short gives those of its records whose digests hold, and what is behind it all
    found = read(gzip_member(b"".join(parts[:6]), 0)[:-3000] + gzip_member(b"".join(parts[6:])))
    assert ids(found)[-3:] == [6, 7, 8] and 0 in ids(found) and sum(isinstance(x, Gap) for x in found) == 1
    damaged = bytearray(b"".join(parts))
    damaged[len(parts[0]) + len(parts[1]) // 2] ^= 1
    found = read(gzip_member(bytes(damaged)))
    assert set(ids(found)) >= {0, 2, 3, 4, 5, 6, 7, 8} and (1 in ids(found)) != any(isinstance(x, Gap) for x in found)


def test_records_inside_a_damaged_payload_are_none_of_the_archive():
    inner = record_bytes("response", "<urn:x:99>", b"inner", more={"X-Page-Id": "99"})
    outer = bytearray(record_bytes("response", "<urn:x:1>", b"before " + inner + b" after", more={"X-Page-Id": "1"}))
    outer[outer.index(b"before")] ^= 1
    last = record_bytes("response", "<urn:x:2>", b"last", more={"X-Page-Id": "2"})
    found = read(bytes(outer) + last)
    assert ids(found) == [2] and [(x.start, x.end) for x in found if isinstance(x, Gap)] == [(0, len(outer))]
    found = read(gzip_member(bytes(outer) + last))
    assert ids(found) == [2] and sum(isinstance(x, Gap) for x in found) == 1


def test_headers_and_members_of_any_length():
    long = record_bytes("response", "<urn:x:1>", b"p", more={"X-Page-Id": "1", "X-Long": "v" * (3 << 20)})
    big = record_bytes("response", "<urn:x:2>", b"q" * (9 << 20), more={"X-Page-Id": "2"})
    assert ids(read(long + big)) == [1, 2]
    assert ids(read(gzip_member(long + big))) == [1, 2]
    assert ids(read(b"WARC/1.0\r\nX" * 100_000 + long)) == []  # no header ends before the last one's, whose frame is broken by them


def test_pages_through_archives(spark, tmp_path):
    rows = [(5, "http://a/ü\r\n", "same", "x"), (2, None, "same", "x"), (9, "u", "same", "x"), (1, "u", None, "x"), (7, "u", "", "x"), (8, "u", "é" * 50_000, "x"), (8, "u", "é" * 50_000, "x")]
    pages = spark.createDataFrame(rows, PAGES)
    out = f"file://{tmp_path}/warc"
    manifest = op4_warc.write_archives(pages, out, roll=200).cache()
    assert manifest.count() > 1 and manifest.groupBy().sum("records").first()[0] == len(rows)
    got = sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["kind"], r["refers_to"]) for r in op4_warc.read_archives(manifest, out).collect())
    digest = lambda s: sha1_base32((s or "").encode())
    first = {"same": 2, "": 1, "é" * 50_000: 8}
    want = [(p, len((h or "").encode()), digest(h), "response" if first[h or ""] == p else "revisit", None if first[h or ""] == p else first[h or ""]) for p, _, h, _ in rows]
    assert got == sorted(want)
    manifest.unpersist()


def test_archives_of_other_writers_have_nulls(spark, tmp_path):
    one = record_bytes("response", "<urn:x:1>", b"p", more={"X-Page-Id": "page-one", "X-Refers-To-Page-Id": "9" * 30})
    block = b"HTTP/1.1 200 OK\r\nContent-Length: many\r\n\r\n"
    two = b"WARC/1.1\r\nWARC-Type: revisit\r\nWARC-Record-ID: <urn:x:2>\r\nX-Page-Id: 7\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(block), block)
    (tmp_path / "a.warc.gz").write_bytes(gzip_member(one) + gzip_member(two))
    rows = op4_warc.read_archives(spark.createDataFrame([(str(tmp_path / "a.warc.gz"),)], "path string"), f"file://{tmp_path}").orderBy("start").collect()
    assert [(r["kind"], r["page_id"], r["refers_to"]) for r in rows] == [("response", None, None), ("revisit", 7, None)]
    assert rows[0]["payload_bytes"] == 1 and rows[1]["payload_bytes"] is None


def test_small_payloads_are_all_responses_below_the_bound(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab", ""), (2, "u", "ab", "")], PAGES)
    out = f"file://{tmp_path}/warc"
    kinds = [r["kind"] for r in op4_warc.read_archives(op4_warc.write_archives(pages, out, least=3).cache(), out).collect()]
    assert kinds == ["response"] * 2


def test_empty_pages(spark, tmp_path):
    pages = spark.createDataFrame([], PAGES)
    out = f"file://{tmp_path}/warc"
    assert op4_warc.read_archives(op4_warc.write_archives(pages, out), out).count() == 0
    assert extract(pages).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>
<div class="cookie-notice">We use cookies.</div>
<div id=main><article class="post with-sidebar"><h1>Head &amp; tail</h1><p><b>First line<br>goes  on&nbsp;here<p>Short.<p>A third paragraph, with <a href=x>a link</a> and
more text in it than the rest of the page has.</p><ul><li>one<li>two</ul><aside>Related things</aside><div class="ad">Buy now</div>
<pre>x &lt; y</pre></article><section id="comments"><p>Reader: a rather long comment that should not be part of the text at all.</p></section></div>
<form><label>Name</label><input></form><footer>&copy; someone</footer></body></html>"""


def test_article_without_its_surroundings():
    assert main_text(PAGE).split("\n") == ["Head & tail", "First line goes on here", "Short.", "A third paragraph, with a link and more text in it than the rest of the page has.", "one", "two", "x < y"]


def test_articles_inside_other_things():
    text = "<p>A paragraph of the page itself, with enough words to stand out.</p>" * 3
    page = f"<body><form><div><nav><a href=1>x</a><article><header><h1>Title</h1></header>{text}</article></div></form><section class=comments><article class=comment><p>{'A long remark by a reader. ' * 20}</p></article></section></body>"
    assert main_text(page).split("\n") == ["Title"] + ["A paragraph of the page itself, with enough words to stand out."] * 3


def test_page_without_article_element():
    body = "".join(f"<p>Paragraph {i} has a good deal of text in it, enough to stand out.</p>" for i in range(6))
    html = f"<html><body><div class=nav><a href=1>a</a> <a href=2>b</a></div><div class=content>{body}<p>End.</p></div><div class=footer>foot</div></body></html>"
    assert main_text(html).split("\n") == [f"Paragraph {i} has a good deal of text in it, enough to stand out." for i in range(6)] + ["End."]


def test_odd_pages(spark):
    for html in ("", "<", "<p", "<!--", "<nav>a", "<script>x", "&#xD800;", "</p></p>", "<article>" * 300 + "x"):
        assert isinstance(main_text(html), str)
    assert main_text("<div>text " * 20_000 + "</div>" * 20_000).count("text") >= 18_000
    assert main_text("plain words only") == "plain words only"
    rows = [(1, None, None, ""), (None, "u", "<p>a</p>", ""), (1, None, None, ""), (2, "u", "<article>" + "<p>long text</p>" * 20_000 + "</article>", "")]
    got = sorted(((r["page_id"], r["n_chars"]) for r in extract(spark.createDataFrame(rows, PAGES)).collect()), key=str)
    assert got == [(1, 0), (1, 0), (2, 20_000 * 10 - 1), (None, 1)]
    assert isinstance(io.BytesIO(b""), io.BytesIO) and pa.__version__


def sentence(rnd, n):
    return " ".join("".join(rnd.choice("abcdefgé") for _ in range(rnd.randint(2, 9))) for _ in range(n)) + "."


def golden(rnd):
    """A page made around a known text; half of them without article or main."""
    content = [sentence(rnd, rnd.choice([2, 6, 30, 60])) for _ in range(rnd.randint(4, 12))] + [sentence(rnd, 70), sentence(rnd, 50)]
    rnd.shuffle(content)
    content.insert(0, sentence(rnd, 5))
    links = "".join(f'<li><a href="/{k}">{sentence(rnd, 2)}</a></li>' for k in range(rnd.randint(3, 9)))
    body = f"<h1>{content[0]}</h1>" + "".join(f"<p>{x}</p>" if rnd.random() < 0.8 else f"<blockquote><p>{x}</p></blockquote>" for x in content[1:])
    if rnd.random() < 0.4:  # a list of other articles, without any name
        body += "<ul>" + "".join(f'<li><a href="/{k}">{sentence(rnd, 4)}</a></li>' for k in range(rnd.randint(5, 9))) + "</ul>" + f"<p>{content[-1]}</p>"
        content.append(content[-1])
    tag = rnd.choice(["article", "main", "div", "section"])
    inner = f'<{tag} class="{rnd.choice(["", "post", "post-share content", "search-results", "no-sidebar"])}">{body}</{tag}>'
    tools = "".join(f"<div><span>{sentence(rnd, 1)}</span><span><b>{sentence(rnd, 1)}</b></span><i>{sentence(rnd, 1)}</i></div>" for _ in range(rnd.choice([0, 8, 80])))
    side = f'<div class="sidebar"><p>{sentence(rnd, 12)}</p></div>' if rnd.random() < 0.5 else ""
    page = f'<div id="wrap" class="with-sidebar"><div>{tools}</div>{inner}{side}</div>'
    foot = rnd.choice([f"<footer>{sentence(rnd, 9)}</footer>", f'<div class="comments"><p>{sentence(rnd, 200)}</p></div>', f'<form>{sentence(rnd, 4)}<input></form>'])
    return f"<html><head><title>t</title><script>x()</script></head><body><nav><ul>{links}</ul></nav>{page}{foot}</body></html>", "\n".join(content)


def test_golden_pages():
    rnd = random.Random(8)
    pages = [golden(rnd) for _ in range(200)]
    assert [main_text(h) for h, _ in pages] == [t for _, t in pages]


def test_ratios_decide(monkeypatch):
    rnd = random.Random(8)
    pages = [golden(rnd) for _ in range(200)]
    monkeypatch.setattr(op5_html_text, "smoothed", lambda ratios, sigma: np.ones(len(ratios)))
    assert sum(main_text(h) != t for h, t in pages) >= 40


def test_classes_that_name_the_layout_keep_their_text_and_inner_ones_go():
    long = "Words of the text that go on and on for a good while, as they do in articles. " * 4
    page = f'<body><div class="search-results sidebar-left"><p>{long}</p><div class="sidebar"><p>Recent posts of others.</p></div><p>Short.</p><p>{long}</p></div></body>'
    assert main_text(page) == f"{long.strip()}\nShort.\n{long.strip()}"


def test_classes_that_name_a_state_keep_their_text():
    long = "Words of the text that go on and on for a good while, as they do in articles. " * 4
    for tag in ("article", "div", "section"):
        for name in ("post comments-open", "no-comments", "has-reply", "ad-free", "sponsored-free", "post comments", "share"):
            page = f'<body><nav><a href=1>x</a></nav><div class="ad">Buy this.</div><{tag} class="{name}"><h1>Title</h1><p>{long}</p><p>Short.</p><p>{long}</p></{tag}><footer>foot</footer></body>'
            assert main_text(page) == f"Title\n{long.strip()}\nShort.\n{long.strip()}", (tag, name)
    comments = f'<section class="comments"><p>{long * 3}</p></section>'
    assert main_text(f"<body><article><p>{long}</p><p>{long}</p></article>{comments}</body>") == f"{long.strip()}\n{long.strip()}"


def test_clusters_decide_lines_of_the_region():
    long = "Words of the text that go on and on for a good while, as they do in articles. " * 4
    menu = "".join(f"<li><a href=/{i}>Another article {i}</a></li>" for i in range(6))
    page = f'<body><article><p>{long}</p><p><a href=1>The study itself</a></p><p>{long}</p><p class="notice">{long}</p><p class="notice">Advert.</p><p class="share">Share this</p><p>{long}</p><ul>{menu}</ul></article></body>'
    assert main_text(page) == "\n".join([long.strip(), "The study itself", *[long.strip()] * 3])


def test_deep_nesting_has_no_bound_and_linear_time():
    import time

    text = "A sentence that is long enough to be the text of a page, and then some more of it."
    began = time.perf_counter()
    deep = "<div>" * 60_000 + f"<p>{text}</p>" + "</section>" * 60_000 + "</div>" * 60_000
    assert main_text(f"<body>{deep}</body>") == text
    assert main_text("<body>" + "<article><p>" + "<b>" * 50_000 + text + "</p>" * 50_000 + "</article></body>") == text
    assert time.perf_counter() - began < 20
