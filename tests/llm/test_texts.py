import hashlib
import re

import pytest
from pyspark.sql import functions as F

from flowspark.llm import chat_format, decontaminate, html_extract, quality_rules, sentencepiece_codec, token_counts, url_filter
from flowspark.llm.queries import URL_RULES

from .helpers import SCHEMA, awkward, base_rules, hits

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_base_rules(spark):
    rows = awkward() + [(900, "x\nx\n \n\n y y y y #|<> ©\nx", "", "", 0), (901, "a b c " * 30, "", "", 0)]
    out = quality_rules.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out), key=str)
    assert got == sorted(((r[0], *base_rules(r[1])) for r in rows), key=str)
    assert not any(r.kept for r in out if r.base_failed)
    assert quality_rules.quality_rules(spark.createDataFrame([], SCHEMA)).collect() == []


def test_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b", 2, 3, 4, 5, "k")], "_text long, text string, _w long, _lines long, _d int, c0 int, kept string")
    out = quality_rules.quality_rules(docs)
    assert out.columns[:6] == docs.columns[:6] and tuple(out.first())[:7] == (1, "a b", 2, 3, 4, 5, 2) and out.first().kept is False


def test_lines_decide(spark):
    prose = " ".join(f"word{k}" for k in range(30)) + "."
    bad = "Home | News | About | Contact us and more of these menu words here"
    notice = " ".join(f"n{k}" for k in range(20)) + " all rights reserved, privacy policy."
    rows = [(1, f"{prose}\n{prose[::-1].strip('.')}x.\n{bad}"), (2, f"{prose}\n{bad}\n{notice}\n{notice}x\n{bad}z"), (3, f"{prose} {prose.replace('word', 'other')}\nshort line")]
    out = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1].kept and bad not in out[1].cleaned and prose in out[1].cleaned
    assert not out[2].kept and out[2].cleaned == prose
    assert out[3].n_lost == 2 and out[3].kept


def test_token_counts_use_the_cache(spark, tmp_path):
    import sentencepiece

    rows = awkward()
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs, cache = spark.createDataFrame(rows, SCHEMA), str(tmp_path / "cache")
    for _ in range(2):  # the second run finds all in the cache
        out = token_counts.token_counts(docs, MODEL, cache).collect()
        want = sorted(((r[0], len((r[1] or "").encode()), len(model.encode(r[1] or ""))) for r in rows), key=str)
        assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in out), key=str) == want
    stored = spark.read.parquet(cache)
    assert stored.count() == len({r[1] or "" for r in rows}) == stored.select("digest").distinct().count()
    assert token_counts.token_counts(docs.limit(0), MODEL, cache).collect() == []


def test_sentencepiece_equals_the_library(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = awkward() + [(k, t, "", "", 0) for k, t in enumerate(["  a  b\n\tc é漢😀  ", "<s> x</s> <0x41>", "\0 z", "  many      spaces   ", "ㅤ\x7f\x80￿", "a" * 500])]
    out = sentencepiece_codec.decode(sentencepiece_codec.encode(spark.createDataFrame(rows, SCHEMA), MODEL), MODEL).collect()
    assert len(out) == len(rows)
    for r in out:
        assert list(r.token_ids) == model.encode(r.text or "")
        assert r.decoded == (r.text or "")
    assert sentencepiece_codec.encode(spark.createDataFrame([], SCHEMA), MODEL).collect() == []


def test_units_of_any_length_equal_the_library():
    """Units of 200,000 letters without a space: one letter, few letters, many letters, marks; each ends in seconds."""
    import random

    import numpy as np
    import sentencepiece

    rng, model = random.Random(3), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    draw = lambda letters, n=200_000: "".join(rng.choice(letters) for _ in range(n))
    texts = ["a" * 200_000, draw("ACGT"), draw("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"), draw([chr(0x4E00 + k) for k in range(5000)]), "▁" * 3000, draw("ab") + " " + draw("ab"), None, ""]
    encoder = sentencepiece_codec.Encoder(MODEL)
    ids, bounds = encoder(texts)
    want = [model.encode(t or "") for t in texts]
    assert np.diff(bounds).tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert encoder.decode(ids, bounds).to_pylist() == [model.decode(w) for w in want]


def test_one_pass_decodes_what_it_encodes(spark):
    docs = spark.createDataFrame(awkward(), SCHEMA)
    one = sentencepiece_codec.encode(docs, MODEL, decoded_col="decoded")
    two = sentencepiece_codec.decode(sentencepiece_codec.encode(docs, MODEL), MODEL)
    assert one.columns == two.columns and one.exceptAll(two).count() == 0 == two.exceptAll(one).count()
    ids = spark.createDataFrame([([228, 259, 200],), (None,), ([],), ([300, 5],)], "token_ids array<int>")
    assert [r.decoded is None for r in sentencepiece_codec.decode(ids, MODEL).collect()] == [False, True, False, False]


def test_url_rules(spark):
    urls = [
        "http://a.com/x", "http://Example.COM/en/1", "https://www.example.com/en/", "http://m.www.example.com/en/1", "http://example.com/english", "http://example.com", "http://notexample.com/en/",
        "http://x.net/es/1?q#f", "http://x.net/fr/", "http://x.net/de/", "no scheme", None, "http://", "x://h/p://q", "http://u@h:8/p\n?x", "http://net/es/a",
    ]
    pages = spark.createDataFrame([(k, u, None, "z") for k, u in enumerate(urls)], "page_id long, url string, html string, host string")
    got = {r.url: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(pages, URL_RULES).collect()}
    assert got["http://Example.COM/en/1"] == ("example.com", "/en/1", "example.com/en/", "block")
    assert got["http://m.www.example.com/en/1"][2:] == ("www.example.com/en/", "allow")
    assert got["http://example.com/english"][2:] == ("com/", "allow")
    assert got["http://example.com"] == ("example.com", "", None, "allow")
    assert got["http://x.net/es/1?q#f"] == ("x.net", "/es/1", "net/es/", "block")
    assert got["x://h/p://q"][:2] == ("h", "/p://q") and got["http://u@h:8/p\n?x"][:2] == ("u@h:8", "/p\n")
    assert got[None] == ("", "", None, "allow") and got["no scheme"][:2] == ("", "")
    assert url_filter.url_filter(pages.limit(0), URL_RULES).collect() == []


def test_distrust_travels_back_along_links(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/x">x</a>' for h in hosts)
    rows = [(1, "http://bad.net/es/1", ""), (2, "http://farm.org/1", link("bad.net", "bad.net")), (3, "http://good.com/1", link("fine.org")), (4, "http://fine.org/1", link("good.com")), (5, "http://lone.org/1", None)]
    out = url_filter.url_filter(spark.createDataFrame(rows, "page_id long, url string, html string"), URL_RULES).collect()
    assert {r.page_id: r.verdict for r in out} == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow"}


def dense_ranks(edges, seeds, rounds=400):
    """Power iteration over a matrix."""
    import numpy as np

    names = sorted({x for e in edges for x in e[:2]} | set(seeds))
    at = {x: k for k, x in enumerate(names)}
    src, dst, w = np.array([at[e[0]] for e in edges]), np.array([at[e[1]] for e in edges]), np.array([e[2] for e in edges])
    share = w / np.bincount(src, w, len(names))[src]
    seed = np.array([seeds.get(x, 0.0) for x in names])
    rank = seed
    for _ in range(rounds):
        moved = 0.85 * np.bincount(dst, rank[src] * share, len(names))
        rank = moved + (1 - moved.sum()) * seed
    return dict(zip(names, rank, strict=True))


def test_personalised_pagerank_against_dense(spark):
    edges = [("a", "b", 1.0), ("a", "c", 3.0), ("b", "c", 1.0), ("c", "a", 1.0), ("d", "a", 2.0)]
    seeds = {"a": 0.5, "d": 0.5}
    frames = spark.createDataFrame(edges, "src string, dst string, weight double"), spark.createDataFrame(list(seeds.items()), "host string, share double")
    got = url_filter.personalised_pagerank(*frames, tolerance=1e-6)
    assert {r.host: r["rank"] for r in got.collect()} == pytest.approx({k: v for k, v in dense_ranks(edges, seeds).items() if v}, abs=1e-6)
    with pytest.raises(RuntimeError):
        url_filter.personalised_pagerank(*frames, rounds=2, tolerance=1e-9)
    assert url_filter.personalised_pagerank(frames[0].limit(0), frames[1]).count() == 2


def test_verdicts_over_a_generated_graph(spark):
    """Pages of 400 hosts with some 20,000 links between them, hubs and dead ends included: each host's verdict is
    that of a dense power iteration."""
    import random
    from collections import Counter

    rng = random.Random(8)
    hosts = [f"h{k}.{'net' if k % 9 == 0 else 'org'}" for k in range(400)]
    rows, links = [], Counter()
    for k, host in enumerate(hosts):
        for page in range(5):
            there = {hosts[int(400 * rng.random() ** 3)] if k % 4 else hosts[9 * rng.randrange(45) % 400] for _ in range(rng.randrange(0, 20))} if k % 7 else set()
            html = "".join(f'<a href="{rng.choice(["http:", "https:", ""])}//{h.upper() if rng.random() < 0.2 else h}/x">' for h in there) + '<a href="/own">'
            rows.append((len(rows), f"http://{host}/{'es' if k % 18 == 0 else 'de'}/{page}", html))
            links.update((host, h) for h in there if h != host)
    rules = [("allow", "h1.org/"), ("allow", "h2.org/"), ("block", "net/es/")]
    out = url_filter.url_filter(spark.createDataFrame(rows, "page_id long, url string, html string"), rules)
    got = {r.host: r.verdict for r in out.where("rule is null").collect()}
    edges = [(a, b, float(n)) for (a, b), n in links.items()]
    bad = [h for k, h in enumerate(hosts) if k % 18 == 0]
    trust = dense_ranks(edges, {"h1.org": 0.5, "h2.org": 0.5})
    distrust = dense_ranks([(b, a, n) for a, b, n in edges], {h: 1 / len(bad) for h in bad})
    scores = {h: (400 * distrust.get(h, 0), 400 * trust.get(h, 0)) for h in got}
    sure = {h: d >= 1 and d > t for h, (d, t) in scores.items() if abs(d - 1) > 0.05 and abs(d - t) > 0.05}
    assert {h: got[h] == "block" for h in sure} == sure and len(sure) > 300 and 20 < sum(sure.values()) < len(sure) - 20


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""), ("", ""), ("<p>a<p>b</p>c<div class='ad'>x</div>", "a\nb\nc"), ("<div><ul><li>a<li>b</ul></div>", "a\nb"), ("<p>x &lt;b&gt; &#233;&nbsp; y<br>z", "x <b> é y z"),
        ("<nav><div>menu</nav><article><h1>T</h1><p><b>one<br><p>two</p></article><footer>f</footer>", "T\none\ntwo"),
        ("<body><div id=side class=sidebar><p>s, s, s</p></div><div><h2>H</h2><p>" + "long text, with commas. " * 9 + "</p><p>short</p></div><div class='comments'><p>hi, hi</p></div>", "H\n" + ("long text, with commas. " * 9).strip() + "\nshort"),
        ("<script>var a='</p>';</script><style>p{}</style><!-- c --><p>t</p><form><p>no</p></form>", "t"),
    ],
)
def test_main_text(page, text):
    assert html_extract.main_text(page) == text


@pytest.mark.parametrize(
    "page, text",
    [
        ("<article><p>a</p><p class=ad>x<p>b</p><p>c</p></article><p>d</p>", "a\nb\nc\nd"), ("<article><p class=ad>x <b>y<p>b</p><h2>c</h2></article>", "b\nc"), ("<article><p>a</p><p class=ad>x</article><p>b</p>", "a\nb"),
        ("<article><ul><li>a<li class=share>x<li>b</ul><p>c</p></article>", "a\nb\nc"), ("<article><ul><li>a<li class=share>x</ul><p>c</p></article>", "a\nc"), ("<article><dl><dt class=ad>x<dd>b</dl><p>c</p></article>", "b\nc"),
        ("<article><table><tr><td>a<td hidden>x<td>b<tr><td>c</table><p>d</p></article>", "a\nb\nc\nd"), ("<article><table><tr hidden><td>x<tr><td>b</table><p>c</p></article>", "b\nc"),
        ("<article><table><thead hidden><tr><th>x<tbody><tr><td>b</table><p>c</p></article>", "b\nc"), ("<div><div><aside>x<p>y</div><p>b</p></div>", "b"),
        # what is inside a cut element stays cut
        ("<article><dialog><p>x</p><p>y</p></dialog><p>a</p></article>", "a"), ("<article><div><a class=share><p>x</p></a><p>a</p></div></article>", "a"), ("<article><p>a <button><div>x</div></button> b</p></article>", "a b"),
        ("<article><ul><li>a<nav><li>x</nav> b</ul></article>", "a b"), ("<article><span>a<aside>x</span>y</aside>b</span></article>", "ab"), ("<article><p>a<svg><g><path/></g></svg>b</p></article>", "ab"),
    ],
)
def test_cut_elements_end_where_browsers_end_them(page, text):
    assert html_extract.main_text(page) == text


PROSE = "".join(f"<p>Paragraph {k} of the page, which says a few things, at some length, so that it counts as prose.</p>" for k in range(8))
SAID = "\n".join(f"Paragraph {k} of the page, which says a few things, at some length, so that it counts as prose." for k in range(8))


@pytest.mark.parametrize(
    "page",
    [
        f'<div class="layout has-sidebar">{PROSE}</div>', f'<div class="site-content no-sidebar">{PROSE}</div>', f'<div class="with-banner">{PROSE}</div>', f'<div class="post-header-fixed">{PROSE}</div>', f'<form id=aspnetForm><div>{PROSE}</div></form>',
        f'<div class="sidebar-layout">{PROSE}<div class="sidebar"><p>a, b, c and some more of a side bar</p></div></div>', f"<div class=ad>{PROSE}", f"<p>Paragraph x.</p><div class=ad>unclosed<div>{PROSE}</div>".replace("<p>Paragraph x.</p>", "").replace("unclosed", ""),
        f'<div class="header"><main>{PROSE}</main></div>', f'<body class="footer nav">{PROSE}<div class="cookie-banner"><p>We use cookies, many of them, to know you.</p></div></body>', f'<div>{PROSE}</div><div class="articleComments"><p>Nice text, dear author, truly, and more words</p></div>',
    ],
)
def test_ordinary_class_names_keep_the_page(page):
    assert html_extract.main_text(page) == SAID


def test_comments_are_cut_however_long():
    talk = "<div class='comments'>" + "<p>I have read this, and I think, at length, that it is so.</p>" * 40 + "</div>"
    assert html_extract.main_text(f"<div><h2>T</h2><p>A short text, that is all, of some words.</p></div>{talk}") == "T\nA short text, that is all, of some words."


def test_built_pages(tmp_path):
    """Pages built around a known article, in many frames, with boxes of every kind in any place."""
    import random

    rng = random.Random(5)
    say = lambda n: " ".join("".join(rng.choice("abcdeilmnorstuéß") for _ in range(rng.randrange(2, 9))) for _ in range(n)) + "."
    boxes = ["<nav><ul><li><a href=x>{}</a></ul></nav>", "<div class='ad-slot'><p>{}</p></div>", "<aside><p>{}</p></aside>", "<div id='cookie-notice'><p>{}</p></div>", "<form><label>{}</label></form>", "<script>{}</script>", "<div class='share'>{}</div>", "<section class='comment-list'><p>{}</p></section>", "<!-- {} -->", "<style>{}</style>", "<footer><p>{}</p></footer>"]
    frames = ["{}{}{}", "<div class='page has-sidebar'>{}<article>{}</article>{}</div>", "<div>{}<main><div>{}</div></main>{}</div>", "<form id='f'>{}<div class='content'>{}</div>{}</form>", "<table><tr><td>{}<tr><td>{}<tr><td>{}</table>"]
    for _ in range(150):
        parts, want = [], []
        for k in range(rng.randrange(3, 12)):
            text = say(rng.randrange(18, 60))
            want.append(text)
            shown = text.replace("é", rng.choice(["é", "&eacute;", "&#233;", "&#xE9;"])).replace(" ", rng.choice([" ", "  ", "\n", "\t "]), 3)
            parts.append(rng.choice(["<p>{}</p>", "<p>{}", "<div>{}</div>", "<p><b>{}</b></p>", "<blockquote>{}</blockquote>"]).format(shown))
        box = lambda: rng.choice(boxes).format(say(rng.randrange(3, 12)))
        at = rng.randrange(len(parts))
        middle = "".join(parts[:at]) + (box() if rng.random() < 0.5 else "") + "".join(parts[at:])
        page = f"<html><head><title>{say(3)}</title></head><body>" + rng.choice(frames).format(box(), middle, box()) + "</body></html>"
        assert html_extract.main_text(page) == "\n".join(want), page


def test_broken_pages_of_any_size_end():
    import time

    n = 100_000
    made = ["<a " * n, "<b>" * n + "</i>" * n, "<b>" * n + "<div></div>" * n, "<div>" + "<b>" * n + "<li></li>" * n, "<b>" * n + "<td></td>" * n, "<a '" * n + ">", "<i><div>" + "<b>" * n + "</i>" * n, "<p>" * n, "<" * n, "<!--" * n, "<div class=ad>" * n, "<h1><b>" * n]
    began = time.time()
    for page in made:
        html_extract.main_text(page)
    assert time.time() - began < 120


def test_links_lose_to_prose():
    links = "<div>" + "<p><a href=x>some long enough link text, here it is</a></p>" * 12 + "</div>"
    prose = "<div>" + "<p>Some prose that is long enough, and has commas, as prose has.</p>" * 4 + "</div>"
    assert "link" not in html_extract.main_text(f"<body>{links}{prose}</body>")


def test_extract_keeps_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a", 1), (1, "u", "<p>a", 1), (None, None, None, None)], "page_id long, url string, html string, text long")
    assert sorted(((r.page_id, r.text) for r in html_extract.extract(pages).collect()), key=str) == [(1, "a"), (1, "a"), (None, "")]
    assert html_extract.extract(pages.limit(0)).collect() == []


def test_decontaminate_against_brute_force(spark):
    rows = awkward()
    long = next(r[1] for r in rows if r[1] and len(r[1]) > 5000).split()
    items = [(1, " ".join(long[40:70])), (2, "ONE, two three FOUR"), (3, ""), (4, None), (5, " ".join(long[45:57])), (None, "a b c d e"), (6, "é Über"), (7, "the " * 13), (2, "w1")]
    docs = [*rows, (901, " ".join(["A-b", *long[40:53], "zz"]), "", "", 0)]
    out = decontaminate.decontaminate(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = sorted(((r.doc_id, int(r.n_words), r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.contaminated) for r in out), key=str)
    named = [x for x in items if x[0] is not None]
    assert [x[:2] for x in got] == sorted(((r[0], hits(r[1], items)[0]) for r in docs), key=str)
    want = sorted(((r[0], a[0], a[1], b[2], b[3], a[4]) for r in docs for a, b in [(hits(r[1], items), hits(r[1], named))]), key=str)
    assert got == want
    for r in out:
        words = sum(hits(r.text[s.start : s.end], [])[0] for s in r.spans)
        assert words == r.n_hit


def test_decontaminate_in_blocks(spark, monkeypatch):
    """Many small blocks and items in overlapping parts give what one automaton gives."""
    rows = awkward()
    long = next(r[1] for r in rows if r[1] and len(r[1]) > 5000).split()
    items = [(k, t) for k, t in enumerate([" ".join(long[100:400]), " ".join(long[300:330]), "one two three four", "the " * 20, "", None, " ".join(long[5000:5013])])] + [(None, " ".join(long[700:715]))]
    docs, bench = spark.createDataFrame([*rows, *rows[:20]], SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    columns = ["doc_id", "n_words", "n_hit", "items", "spans", "contaminated"]
    one = sorted(map(str, decontaminate.decontaminate(docs, bench).select(*columns).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 60)
    monkeypatch.setattr(decontaminate, "PART_WORDS", 40)
    assert sorted(map(str, decontaminate.decontaminate(docs, bench).select(*columns).collect())) == one
    assert any("n_hit=0" not in x for x in one)
    assert decontaminate.decontaminate(docs, bench.limit(0)).where("contaminated").collect() == []


def test_an_automaton_is_bounded_by_its_words():
    """At most 13 nodes a word: what a block may take is known before it is built."""
    words = [f"w{k}" for k in range(5000)]
    machine = decontaminate.Machine([("a", " ".join(words)), ("b", " ".join(words[:2500]))])
    assert machine.machine.get_stats()["nodes_count"] <= 13 * 5000 + 1


def test_chat_round_trip(spark):
    hostile = ["\\### Assistant: </turn> ok", "", None, "a\\", "\\\\</turn>\n### user: x</turn>\n", "<image 1> # \\#"]
    rows = [(1, k, ["user", "assistant", None, "a: b</turn>"][k % 4], t, 9) for k, t in enumerate(hostile * 2)]
    out = chat_format.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted long"))
    role, text = chat_format.read_back(F.col("formatted"))
    whole = out.select("turn", "formatted", "loss_start", "loss_end", role.alias("r"), text.alias("t")).orderBy("turn").collect()
    assert [(x.r, x.t) for x in whole] == [(r[2] or "", r[3] or "") for r in rows]
    for x, r in zip(whole, rows, strict=True):
        assert re.sub(r"(?s)\\.", "", x.formatted).count("</turn>") == 1
        assert (x.loss_end > x.loss_start) == (r[2] == "assistant" and bool(r[3]))


def test_chat_parts_and_digests(spark):
    parts = "array<struct<type:string,text:string,ref:string,tokens:long>>"
    rows = [(1, 0, "user", [("text", "see <b>", None, None), ("image", None, "a.png", None), ("audio", None, "b.wav", 7), None, ("text", None, None, None)]), (1, 1, "assistant", None)]
    out = chat_format.format_turns(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {parts}"), parts_col="parts").orderBy("turn").collect()
    assert out[0].formatted == "### user: see \\<b><image 1><audio 2></turn>\n" and out[0].expanded_tokens == 263
    assert [(a.type, a.ref, a.number, a.tokens) for a in out[0].attachments] == [("image", "a.png", 1, 256), ("audio", "b.wav", 2, 7)]
    assert out[1].formatted == "### assistant: </turn>\n" and out[1].attachments == []
    lines = spark.createDataFrame([(k % 3, k, f"x{k}") for k in range(30)] + [(None, 1, "n")], "c long, o long, p string")
    got = {r.c: r.p for r in chat_format.running_digests(lines, "c", ["o"], ["p"]).collect()}
    want = {c: "".join(f"x{k}" for k in range(30) if k % 3 == c) for c in range(3)} | {None: "n"}
    assert got == {c: hashlib.sha256(t.encode()).hexdigest() for c, t in want.items()}
    named = spark.createDataFrame([("k", 0, "a"), ("k", 1, None), ("k", 2, "b"), (None, 0, None)], "c string, o long, p string")
    assert {r.c: r.p for r in chat_format.running_digests(named, "c", ["o"], ["p"]).collect()} == {"k": hashlib.sha256(b"ab").hexdigest(), None: hashlib.sha256(b"").hexdigest()}


def test_parts_of_no_type_lose_no_turn(spark):
    parts = "array<struct<type:string,text:string,ref:string,tokens:long>>"
    rows = [(1, 1, "user", [("text", "a", None, None), (None, "b<", None, None), (None, None, "r", 5), (None, None, None, None), None])]
    out = chat_format.format_turns(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {parts}"), parts_col="parts").first()
    assert out.formatted == "### user: ab\\<<unknown 1></turn>\n"
    assert [tuple(a) for a in out.attachments] == [("unknown", "r", 1, 5)] and out.expanded_tokens == 5


def test_chat_query_visits_parts(spark, monkeypatch):
    from flowspark.llm import queries

    seen, visit = [], chat_format._visit
    monkeypatch.setattr(chat_format, "_visit", lambda parts: seen.append(1) or visit(parts))
    queries.op10_chat_format(spark, "/root/testdata/sf0.001")
    assert seen
