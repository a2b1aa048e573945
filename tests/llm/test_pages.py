import random

import duckdb
from pyspark.sql import functions as F

from basewright.llm import extract, revisit, url_filter


def test_extraction_cases():
    page = (
        "<html><head><title>T</title></head><body><header><h1>Site</h1><a href=/>Home</a></header><div id='main-menu'><ul><li><a>x</a></ul></div>"
        "<div class=content><h2>Title, here</h2><p>First para is long enough, really &amp; truly,\n to  count as text.<p>Second one, with <a href=x>a link</a> inside it, and more words."
        "<ul><li>point one<li>point two</ul><div class='comments'><p>I hate this, you fool, it is bad.</div></div>"
        "<div class='sidebar-right'><p>Other things, many, many, commas, here, and, so on, and on, for long text that is long.</p></div>"
        "<form><p>Your name, please, and so on and on</p></form><div class='cookie-notice'>We use cookies, ok</div><footer>(c)</footer><script>var a='<p>no, no, no</p>'</script>"
    )
    want = ["Title, here", "First para is long enough, really & truly, to count as text.", "Second one, with a link inside it, and more words.", "point one", "point two"]
    assert extract.main_text(page) == "\n\n".join(want)
    article = "<nav><a>Menu</a></nav><div class=ad>Buy, buy, buy, this is a long advert, with many, many commas, to win, if it could, by points.</div><article><h1>Sh</h1><p><b>Short.<br><p></article><footer>&copy; x</footer>"
    assert extract.main_text(article) == "Sh\n\nShort."
    assert extract.main_text("<article><p>a<!-- <p>hidden --> b<style>p{}</style> c&nbsp;d</p><p hidden>no</p><p>open <i>end") == "a b c d\n\nopen end"
    assert extract.main_text("") == "" and extract.main_text("<p> </p>") == "" and extract.main_text("1 < 2 &lt; 3") == "1 < 2 < 3"


def test_long_sections_do_not_drop_the_rest():
    para = "A sentence with words, commas, and more words that go on and on, until it is long enough to count. " * 3
    links = "".join(f"<li><a href=/{i}>Another headline {i}</a></li>" for i in range(9))
    for n in (1, 12, 40):
        long = f"<p>{para}</p>" * n
        want = ["The title", "Short lead.", *[para.strip()] * n, "Small section", "Few words here.", "The end."]
        inside = f"<h1>The title</h1><p>Short lead.</p><div class=a>{long}</div><section><h3>Small section</h3><p>Few words here.</p></section><div>The end.</div>"
        for page in (f"<body><article>{inside}</article><div><ul>{links}</ul></div></body>", f"<body><main><div>{inside}</div></main><ul>{links}</ul></body>", f"<body><div>{inside}</div><div><ul>{links}</ul></div></body>"):
            assert extract.main_text(page) == "\n\n".join(want)


def test_names_leave_out_no_article_text():
    para = "A sentence with words, commas, and more words that go on and on, until it is long enough to count. " * 3
    p = f"<p>{para}</p>"
    want = [para.strip()]
    text = lambda x: extract.main_text(x).split("\n\n")
    assert text(f"<article>{p}<div class='form-factor'>Small is fine.</div><section id='social-history'>Long ago.</section></article>") == [*want, "Small is fine.", "Long ago."]
    assert text(f"<body><div class='page has-sidebar'>{p}{p}</div><div class='sidebar'>{p}</div></body>") == want * 2
    assert text(f"<body><div class='sidebar widget'><div>{p}{p}</div></div></body>") == want * 2
    assert text(f"<body><form><div class='comments'>{p}</div>{p}{p}</form></body>") == want * 2
    links = "<li><a href=/1>First source</a><li><a href=/2>Second source</a>"
    assert text(f"<article><h2><a href=/x>Linked heading</a></h2>{p}<h3>Sources</h3><ul>{links}</ul></article>") == ["Linked heading", *want, "Sources", "First source", "Second source"]
    assert text(f"<body><div>{p}{p}<h3>Sources</h3><ul>{links}</ul></div></body>")[-3:] == ["Sources", "First source", "Second source"]
    assert text(f"<body><div>{p}{p}{p}</div><section>Short last part</section><div>And an end.</div></body>")[-2:] == ["Short last part", "And an end."]
    assert text(f"<article>{p}<p>a <math><mi>x</mi></math> and <button>press</button></p></article>")[-1] == "a x and press"


PARA = "A sentence with words, commas, and more words that go on and on, until it is long enough to count. " * 3


def test_side_matter_by_names_with_other_words():
    said = "I do not agree with this at all, said a reader, and went on for a while about other things."
    names = "reader-comments article-comments post-comments user-comments comment-thread google-ads article-sidebar cookie-law-info related-reading share-this subscribe-now breadcrumb-trail promo-card left-rail qwertz-comments"
    for name in names.split():
        side = f"<div class='{name}'><p>{said}</p></div>"
        for page in (f"<article><p>{PARA}</p>{side}<p>{PARA}</p></article>", f"<body><div><p>{PARA}</p><p>{PARA}</p></div>{side}</body>"):
            assert extract.main_text(page).split("\n\n") == [PARA.strip()] * 2, name


def test_parts_of_an_article_with_such_names_stay():
    for name in "discussion respond notice share menu related signup alert footer social".split():
        part = f"<section id='{name}'><p>{PARA}</p></section>"
        assert extract.main_text(f"<article><p>{PARA}</p>{part}</article>").split("\n\n") == [PARA.strip()] * 2, name
        part = f"<div class='{name}'><h2>A part</h2><p>{PARA}</p></div>"
        assert extract.main_text(f"<article><p>{PARA}</p>{part}<p>End.</p></article>").split("\n\n") == [PARA.strip(), "A part", PARA.strip(), "End."], name
    for name in "no-sidebar has-ads without-comments cookie-recipe rail-transport share-price form-factor".split():
        assert extract.main_text(f"<article><p>{PARA}</p><div class='{name}'><p>{PARA}</p></div></article>").split("\n\n") == [PARA.strip()] * 2, name


def test_entries_of_readers_by_structure():
    rng = random.Random(3)
    for _ in range(40):
        word = "".join(rng.choice("bcdfghjklm") for _ in range(7))
        entries = "".join(f"<div class='{word}'><p>{rng.choice(['Ann', 'Bo'])} {rng.choice(['2021-03-04', 'at 12:30', '3 days ago'])}</p><p>I think, {rng.choice(['well', 'hm'])}, that this is right.</p></div>" for _ in range(rng.randrange(2, 6)))
        page = f"<article><h1>Title</h1><p>{PARA}</p><p>{PARA}</p><div class='{word}x'>{entries}</div></article>"
        assert extract.main_text(page).split("\n\n") == ["Title", *[PARA.strip()] * 2]
    events = "".join(f"<li>1{i}:30 opening of part {i}</li>" for i in range(4))
    assert len(extract.main_text(f"<article><p>{PARA}</p><ul>{events}</ul></article>").split("\n\n")) == 5


def random_page(rng):
    """A page and its main text."""
    sentence = lambda: " ".join(rng.choice(["word", "other", "thing", "more"]) + rng.choice(["", "", ","]) for _ in range(rng.randrange(6, 20))).rstrip(",") + "."
    want, body = [], []

    def block(tag, text):
        want.append(text)
        return f"<{tag}>{text}</{tag}>"

    body.append(block("h1", "Title of it"))
    for _ in range(rng.randrange(2, 6)):
        inner = block("h2", "Part of it") if rng.random() < 0.5 else ""
        inner += "".join(block("p", " ".join(sentence() for _ in range(rng.randrange(1, 5)))) for _ in range(rng.randrange(1, 5)))
        if rng.random() < 0.3:
            inner += "<ul>" + "".join(block("li", sentence()) for _ in range(3)) + "</ul>"
        body.append(rng.choice(["{}", "<section>{}</section>", "<div class='part share-price'>{}</div>", "<div class='%s'>{}</div>" % "".join(rng.choice("bcdfgh") for _ in range(6))]).format(inner))
        if rng.random() < 0.4:
            name = rng.choice(["ad", "comments", "share-buttons", "related-posts", "newsletter signup", "sidebar-right", "%s-comments" % "".join(rng.choice("bcdfgh") for _ in range(6))])
            body.append(f"<div class='{name}'><p>{sentence()}</p></div>")
        if rng.random() < 0.2:
            body.append(rng.choice(["<form><p>{}</p></form>", "<aside>{}</aside>", "<script>{}</script>", "<nav>{}</nav>"]).format(sentence()))
    page = rng.choice(["<article>{}</article>", "<main><div>{}</div></main>", "<div id=content>{}</div>"]).format("".join(body))
    page = rng.choice(["{}", "<div class='wrapper no-sidebar'>{}</div>"]).format(page)
    links = "<ul>" + "".join(f"<li><a href=/{i}>Go there {i}</a></li>" for i in range(8)) + "</ul>"
    before = rng.choice([f"<nav>{links}</nav>", f"<div class=menu>{links}</div>", f"<header>{links}<p>{sentence()}</p></header>"])
    after = rng.choice([f"<footer><p>{sentence()}</p></footer>", f"<div id=site-footer>{sentence()}</div>", f"<div class='cookie-notice'><p>{sentence()}</p></div>"])
    return f"<html><head><title>t</title></head><body>{before}{page}{after}</body></html>", "\n\n".join(want)


def test_pages_with_known_main_text():
    rng = random.Random(11)
    for _ in range(400):
        page, want = random_page(rng)
        assert extract.main_text(page) == want, page


def test_links_do_not_win():
    links = "".join(f"<li><a href=/{i}>A rather long headline, number {i}, with commas, and words</a></li>" for i in range(30))
    page = f"<body><div><ul>{links}</ul></div><div><p>The only real paragraph, which is of some length, stands here, and says something.</p></div>"
    assert extract.main_text(page) == "The only real paragraph, which is of some length, stands here, and says something."


def test_odd_markup_is_quick_and_whole(spark):
    for page in ("<a" * 50_000, "<div>" * 20_000 + "x", '<p>x<b "' * 20_000, "<!--" * 50_000, "<" * 50_000, "<p a='" * 30_000):
        extract.main_text(page)
    long = "<article>" + "".join(f"<p>para {i}</p>" for i in range(5000)) + "</article>"
    df = spark.createDataFrame([(1, "u", long), (None, None, None), (2, "v", "<p>x"), (2, "v", "<p>x")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = extract.extract(df).collect()
    assert len(got) == 4 and max(r["n_chars"] for r in got) == len("\n\n".join(f"para {i}" for i in range(5000)))
    assert [tuple(r) for r in got if r["page_id"] is None] == [(None, None, "", 0)]
    assert extract.extract(df.limit(0)).count() == 0


def brute_rule(url, rules):
    if not url or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :]
    path = path.split("#")[0].split("?")[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h), len(p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fit)[2:]) if fit else (host, path, None, "allow")


def test_url_rules_against_brute_force(spark):
    rng = random.Random(0)
    part = lambda: rng.choice(["a", "b", "net", "example", "É"])
    urls = ["".join(["http://", ".".join(part() for _ in range(rng.randrange(1, 5))), rng.choice(["", "/", "?q=/x/", "#f"]), *(f"{part()}/" for _ in range(rng.randrange(0, 4))), rng.choice(["", "a", "?x://y", "#z"])]) for _ in range(400)]
    urls += [None, "", "nothing", "://", "HTTP://A.NET/b/", "x://a.net:80/b/", "http://a..net/b/", "y://a.net\n/b/"]
    rules = [*url_filter.RULES, ("net", "/a/", "allow"), ("a", "", "block"), ("b.net", "/a/b/", "allow"), ("b", "/ex", "block"), ("example", "/b/a", "allow")]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn("host", F.lit("clash"))
    want = [(i, *brute_rule(u, rules)) for i, u in enumerate(urls)]
    for most in (url_filter.MOST_SENT, 0):  # rules broadcast, and joined by salted shuffle
        got = url_filter.judge(df, url_filter.rule_table(spark, rules), most_sent=most).orderBy("page_id").collect()
        assert [tuple(r) for r in got] == want
    none = url_filter.judge(df, url_filter.rule_table(spark, rules).limit(0)).collect()
    assert len(none) == len(urls) and {r["verdict"] for r in none} == {"allow"}
    both = url_filter.rule_table(spark, [("a.net", "/", "allow"), ("A.net", "/", "block"), (None, "/", "block")])
    assert url_filter.judge(df.where("page_id = 404"), both).first()["verdict"] == "block"
    assert url_filter.judge(df.limit(0), both).count() == 0


def resolved(records):
    out = []
    for r in records:
        if r["kind"] != "revisit":
            continue
        key = r["url"]
        earlier = [x for x in records if x["kind"] == "response" and key is not None and x["url"] == key and x["ts"] is not None and r["ts"] is not None and x["ts"] < r["ts"]]
        if not earlier:
            out.append((r["record_id"], "no_earlier", None))
            continue
        last = max(earlier, key=lambda x: (x["ts"], x["record_id"]))
        bare = lambda t: t[2:] if t and t.startswith("W/") else t
        if r["etag"] is None and r["last_modified"] is None:
            out.append((r["record_id"], "no_validator", None))
        elif bare(r["etag"]) == bare(last["etag"]) if r["etag"] is not None else r["last_modified"] == last["last_modified"]:
            out.append((r["record_id"], "resolved", last["record_id"]))
        else:
            out.append((r["record_id"], "mismatch", None))
    return sorted(out, key=str)


def test_revisits_against_brute_force(spark):
    rng = random.Random(3)
    records = [
        {"record_id": i, "url": rng.choice(["a", "a", "a", "b/x", "", None]), "ts": rng.choice([None, *range(1, 60)]), "kind": rng.choice(["response", "revisit", "revisit", "warcinfo", None]), "etag": rng.choice([None, '"1"', 'W/"1"', '"2"']), "last_modified": rng.choice([None, "m", "n"]), "headers": None}
        for i in range(400)
    ]
    schema = "record_id long, url string, ts long, kind string, etag string, last_modified string, headers map<string,string>"
    df = spark.createDataFrame([tuple(r.values()) for r in records], schema).withColumn("status", F.lit("clash"))
    for seconds in ((7,), (5, 20), revisit.BLOCK_SECONDS):
        got = sorted(((r["record_id"], r["status"], r["response_id"]) for r in revisit.resolve(df, seconds).collect()), key=str)
        assert got == resolved(records)
    assert revisit.resolve(df.limit(0)).count() == 0


def test_headers_and_keys(spark):
    rows = [(1, "http://WWW.A.com:80/p/#f", 1, "response", '"e"', None, {"Content-Type": "t", "ETag": '"e"', "DATE": "1"}), (2, "https://a.com/p", 2, "revisit", 'W/"e"', None, {"date": "2", "Content-Type": "no", "Vary": "v"})]
    schema = "record_id long, url string, ts long, kind string, etag string, last_modified string, headers map<string,string>"
    r = revisit.resolve(spark.createDataFrame(rows, schema)).first()
    assert (r["url_key"], r["status"], r["headers"]) == ("a.com/p", "resolved", 'content-type: t\ndate: 2\netag: "e"\nvary: v')


def test_revisit_query_meets_every_status(spark):
    import os

    import pytest

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    found = {r["status"]: r["count"] for r in revisit.op3_revisits(spark, d).groupBy("status").count().collect()}
    assert set(found) == {"resolved", "mismatch", "no_validator", "no_earlier"} and min(found.values()) >= 2


def test_page_queries_against_sql(spark):
    import os

    import pytest

    from basewright.llm.queries import ORACLE_SQL, QUERIES

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in ("pages", "documents", "labels", "benchmark", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    for name in ORACLE_SQL:
        df, want = QUERIES[name](spark, d), c.sql(ORACLE_SQL[name])
        names = sorted(df.columns)
        assert names == sorted(want.columns)
        at = [want.columns.index(x) for x in names]
        assert sorted(str([r[x] for x in names]) for r in df.collect()) == sorted(str([r[i] for i in at]) for r in want.fetchall())
