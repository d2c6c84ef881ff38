"""Conversations, pages, vectors and labels."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from fleetlake.llm import chat, hamming, html, toxicity

TURNS = "conv_id long, turn long, role string, text string, ix string, piece string"


def test_chat_round_trip(spark):
    rows = [(1, 1, "assistant", "yes \\e \\l <|im_end|>\n"), (1, 0, "user", "<|im_start|>user\nhi<|im_sep|>"), (1, 2, "assistant", "more"), (1, 2, "assistant", "more"),
            (2, None, "a\nb", None), (None, 0, None, "x"), (3, 0, "user", ""), (4, 0, "assistant", "é漢" * 3000)]
    got = {r.conv_id: r for r in chat.chat_query(spark.createDataFrame([(*r, "x", "y") for r in rows], TURNS)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        learned = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(mine), sha("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in mine)), len(learned), sha(learned))
    merged = {r.conv_id: r.formatted for r in chat.format_conversations(spark.createDataFrame([(*r, "x", "y") for r in rows], TURNS)).collect()}
    assert merged[1].count("<|im_start|>") == 2 and merged[1].count("<|im_sep|>") == 2
    assert [r.conv_id for r in chat.chat_query(spark.createDataFrame([], TURNS)).collect()] == [-1]


def test_chat_of_many_turns(spark):
    # longer than one run of the fold, with blocks of one role over its ends
    rng = random.Random(5)
    rows = [(1, i, "user" if 900 < i < 1100 else rng.choice(["user", "assistant"]), f"<{i}>é") for i in range(2500)] + [(2, i, "user", "x") for i in range(2000)]
    got = {r.conv_id: r for r in chat.format_conversations(spark.createDataFrame([(*r, "x", "y") for r in rows], TURNS)).collect()}
    for conv in (1, 2):
        want, spans, last = b"", [], None
        for _, _, role, text in (r for r in rows if r[0] == conv):
            want += b"<|im_sep|>" if role == last else (b"<|im_end|>\n" if last else b"") + f"<|im_start|>{role}\n".encode()
            body = text.replace("<", "\\l").encode()
            if role == "assistant":
                spans.append((len(want), len(body)))
            want, last = want + body, role
        assert got[conv].formatted == (want + b"<|im_end|>\n").decode() and [tuple(s) for s in got[conv].loss] == spans


def test_html_extraction(spark):
    page = "<html><body><nav><a href=/>home</a></nav><div class='cookie-notice'>We use cookies</div><div class='post-{0}'><h1>Title {0}</h1><p>Fish &amp; chips&nbsp; are <b>good</b> <div class=ad>Buy now</div><p>Second\n  block of text {0}<ul><li>one<li>two</ul></div><aside>side</aside><div id=comments><p>" + "great post " * 30 + "</p></div><footer>f</footer></body></html>"
    rows = [(i, "http://A.example/x", page.format(i), "clash", "clash") for i in range(5)] + [(9, None, None, "", ""), (10, "nothing", "", "", ""), (11, "http://b.example", "<p>just text", "", ""), (11, "http://b.example", "<p>just text", "", "")]
    schema = "page_id long, url string, html string, path string, host string"
    got = html.main_text(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == len(rows)
    for r in got:
        want = f"Title {r.page_id}\n\nFish & chips are good\n\nSecond block of text {r.page_id}\n\none\n\ntwo" if r.page_id < 9 else "just text" if r.page_id == 11 else ""
        assert r.text == want and r.n_chars == len(want)
    assert html.main_text(spark.createDataFrame([], schema)).count() == 0
    paths = {r.host: r.path for r in html.winning_paths(spark.createDataFrame(rows, schema)).collect()}
    assert paths["a.example"] == "html/div.post-"


def test_a_page_without_its_hosts_container_uses_its_own(spark):
    rows = [(i, "http://h.example/", f"<body><main><p>text {i} goes on and on</p></main></body>") for i in range(3)] + [(7, "http://h.example/", "<body><div class=story><p>another layout of this page</p></div></body>")]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[7] == "another layout of this page" and got[1] == "text 1 goes on and on"


def test_no_text_beside_or_inside_of_containers_is_lost(spark):
    part = "a part with quite a lot of plain text in it, "
    links = "<div><p><a href=/1>one</a> | <a href=/2>two</a></p></div>"
    pages = [
        (f"<h1>Head</h1><p>Lead</p><div class=part><p>{part}1</p></div>{links}<div class=part><p>{part * 9}2</p></div>", ["Head", "Lead", part + "1", "one | two", part * 9 + "2"]),
        (f"<div class='layout has-sidebar'><article><p>{part}3</p></article></div>", [part + "3"]),
        (f"<div class=page-with-comments><p>{part}4</p></div>", [part + "4"]),
        (f"<div id=sidebar><article><h2>A</h2><p>{part}5</p></article></div><p>end</p>", ["A", part + "5", "end"]),
        (f"<h1>Two</h1><article><p>{part}6</p></article><article><p>{part * 9}7</p></article>", ["Two", part + "6", part * 9 + "7"]),
        (f"<div class=story><p>{part * 9}8</p></div><div class=related><p>Read on</p></div><div class=more><p>{part}9</p></div>", [part * 9 + "8", part + "9"]),
    ]
    rows = [(i, f"http://h{i}.example/", f"<body>{page}</body>") for i, (page, _) in enumerate(pages)]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: "\n\n".join(t.strip() for t in texts) for i, (_, texts) in enumerate(pages)}
    # the host's path, with what stands directly beside its elements, in page order
    split = f"<body><div class=wrap><h1>Head</h1><section class=s><p>{part}1</p></section><div class=x><p>not of the path</p></div><section class=s><p>{part}2</p></section></div></body>"
    assert html.extract(split, "html/div.wrap/section.s").split("\n\n") == ["Head", part + "1", part + "2"]


PART = "a part with quite a lot of plain text in it, "


@pytest.mark.parametrize("body, want", [
    # names of parts of an article that only look like boilerplate
    (f"<article><h2 class=related-work>Related work</h2><p>{PART}</p></article>", ["Related work", PART]),
    (f"<article><p>{PART}</p><table class=share-price><tr><td>Price<td>3</table></article>", [PART, "Price", "3"]),
    (f"<article><p class=notice-period>Three months</p><p>{PART}</p></article>", ["Three months", PART]),
    (f"<article><p>{PART}</p><p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math> <label>holds</label></p></article>", [PART, "So x=1 holds"]),
    (f"<article><h2>Discussion</h2><section id=discussion><p>{PART}</p></section><p>{PART}</p></article>", ["Discussion", PART, PART]),
    (f"<div class=page><p>{PART}</p><section id=discussion><p>{PART}</p></section></div>", [PART, PART]),
    # and boilerplate
    (f"<div class=page><p>{PART}</p></div><div id=discussion><div><time>1 May</time><p>Great post</p></div></div>", [PART]),
    (f"<article><p>{PART}</p><p class=ad>Buy now</p></article>", [PART]),
    (f"<article><p>{PART}</p></article><div id=responses><p>Great post</p><p>So true</p></div>", [PART]),
    (f"<article><p>{PART}</p></article><div class=reactions><div><b>joe</b><p>Great post</p></div></div>", [PART]),
    (f"<article><p>{PART}</p><div class=reactions><div><span class=user-name>joe</span><p>Great post</p></div></div></article>", [PART]),
    (f"<article><p>{PART}</p></article><form><label>Name</label><p>Send</p></form>", [PART]),
])
def test_names_of_parts_of_articles_and_of_boilerplate(body, want):
    whole = f"<body>{body}</body>"
    expected = "\n\n".join(t.strip() for t in want)
    assert html.extract(whole, html.vote(whole)[0]) == expected and html.extract(whole, None) == expected


def test_lists_tables_and_quotes_beside_the_hosts_container_are_kept():
    page = f"<body><div class=wrap><h1>Head</h1><ul><li>one</ul><section class=s><p>{PART}</p></section><blockquote>said</blockquote><table><tr><td>cell</table><ul><li><a href=/1>link</a></ul></div></body>"
    assert html.extract(page, "html/div.wrap/section.s").split("\n\n") == ["Head", "one", PART.strip(), "said", "cell"]


def test_of_paths_with_equal_votes_the_first_wins(spark):
    rows = [(1, "http://t.example/", f"<main><p>{PART}</p></main>"), (2, "http://t.example/", f"<article><p>{PART}</p></article>")]
    assert [r.path for r in html.winning_paths(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()] == ["html/article"]


def test_very_long_pages(spark):
    page = "<body><nav>home</nav>" + "<div>" * 3000 + f"<p>{PART}</p>" * 20000 + "</div>" * 3000 + "</body>"
    [row] = html.main_text(spark.createDataFrame([(1, "http://l.example/", page)], "page_id long, url string, html string")).collect()
    assert row.text == "\n\n".join([PART.strip()] * 20000) and row.n_chars == len(row.text)


def test_hamming_search_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(24)], "x") for i in range(300)]
    rows += [(1000 + i, rows[20][1], "x") for i in range(40)]  # one common vector
    rows += [(20, rows[20][1], "x"), (None, rows[3][1], "x"), (2000, None, "x"), (2020, [], "x"), (2040, [1.0] * 7, "x")]
    got = {}
    for r in hamming.search_query(spark.createDataFrame(rows, "vec_id long, embedding array<float>, code string")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.distance, r.neighbor_id))
    known = {i: tuple(x > 0 for x in v) for i, v, _ in rows if i is not None and v}
    for q, code in known.items():
        if q % 20 == 0:
            want = sorted((sum(a != b for a, b in zip(code, c)), i) for i, c in known.items() if i != q and len(c) == len(code))[:10]
            assert sorted(got.get(q, [])) == [(n + 1, d, i) for n, (d, i) in enumerate(want)]
    assert hamming.search_query(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(4)
    plain = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    bad, junk = ["vile", "rotten", "awful", "nasty"], ["zzqq", "qqzz"]
    def row(i):
        toxic, low = rng.random() < 0.3, rng.random() < 0.3
        return i, " ".join(rng.sample(plain, 30) + (rng.sample(bad, 2) if toxic else []) + (junk if low else [])), int(toxic), 1 - int(low)
    rows = [row(i) for i in range(900)]
    docs = spark.createDataFrame([(r[0], r[1], "x") for r in rows] + [(5000, None, "x"), (5001, "", "x"), (5002, "vile rotten " * 20000, "x"), (None, "nasty vile", "x")], "doc_id long, text string, words string")
    labels = spark.createDataFrame([(r[0], r[3], r[2]) for r in rows[:600]] + [(0, rows[0][3], rows[0][2]), (1, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity_query(docs, labels).collect()}
    assert len(got) == 904
    hits = sum(got[r[0]].toxic == bool(r[2]) for r in rows[600:])
    assert hits >= 285
    assert got[5002].toxic and got[None].toxic and not got[5000].toxic and not got[5001].toxic
    chain = toxicity.fit_chain(docs.join(labels, "doc_id").withColumn("low_quality", 1 - F.col("quality")), ["low_quality", "toxic"])
    assert [link.before for link in chain.links] == [[], ["low_quality"]]
    assert toxicity.score(docs.limit(0), chain, F.col("doc_id")).count() == 0
