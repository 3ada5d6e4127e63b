"""Page adapters, H2-H21."""

from __future__ import annotations

from evigraph.functions import text
from evigraph.sources import pages
from evigraph.sources.dom import parse
from pyspark.sql import functions as F

LONG = "This is a sentence of the article. " * 6


def item(html, adapter="article", url="https://site.example/a", **more):
    return pages.item({"html": html, "adapter": adapter, "final_url": url, "status_code": 200, "success": True, **more})


def test_dom():
    root = parse('<ul class="a b"><li id=x>one<li>two <b>bold</b></ul><p>p1<p>p2<table><tr><td>c1<td>c2</table><pre>  a\n  b</pre><script>no</script>')
    assert [n.text() for n in root.all("ul.a.b > li")] == ["one", "two bold"] and root.one("li#x").text() == "one" and root.one("[id=x] b, .none") is None
    assert root.text() == "one\ntwo bold\np1\np2\nc1\nc2\na\nb"


def test_article():
    ld = '<script type="application/ld+json">{"@graph": [{"@type": "WebPage"}, {"@type": "NewsArticle", "headline": "Head | Site", "author": [{"name": "A"}, "B"], "datePublished": "2026-01-02T03:04:05+01:00"}]}</script>'
    got = item(f"<title>x</title>{ld}<article><p>{LONG}</p><div class=more>Other story</div><p>Recommended Stories<br>list of 2 items<br>one<br>end of list</p></article>", exclude_selectors=[".more"])
    assert got["title"] == "Head | Site" and got["author"] == "A, B" and got["published_at"].isoformat() == "2026-01-02T02:04:05+00:00"
    assert got["body"] == LONG.strip() + "\n" and [s["id"] for s in got["segments"]] == ["title", "body"] and got["segments"][0]["text"] == "Head"
    assert "Removed embedded recommendation list(s) from the article body" in got["warnings"]
    by_meta = item(f'<meta name="author" content="M"><meta property="og:title" content="T"><time datetime="2026-01-01T00:00:00">x</time><main>{LONG}</main>')
    assert (by_meta["title"], by_meta["author"], by_meta["published_at"]) == ("T", "M", None) and "Publication time has no timezone; retained as raw metadata" in by_meta["warnings"]
    assert item("<article>short</article>")["reason"].startswith("empty_content") and item(None)["reason"].startswith("empty_content")
    assert item("", status_code=404)["reason"] == "http_error: 404" and item("", success=False, error="timeout: x")["reason"] == "timeout: x"
    assert item(LONG, is_listing=True)["reason"].startswith("listing_page") and item("<title>Just a moment...</title>")["reason"].startswith("access_blocked")


def test_reddit():
    html = """<shreddit-post id="t3_p" post-title="Title" author="op" created-timestamp="2026-01-01T00:00:00Z"><div slot="text-body">Post text</div></shreddit-post>
    <shreddit-comment thingid="t1_a" author="[deleted]" parentid="t3_p"><div slot="comment">[deleted]</div>
      <shreddit-comment thingid="t1_b" author="bo" permalink="/r/x/comments/p/_/b"><div slot="comment">Reply</div></shreddit-comment></shreddit-comment>
    <shreddit-comment thingid="t1_c" author="[removed]" parentid="t3_p"><div slot="comment">Third</div></shreddit-comment>"""
    got = item(html, "reddit", "https://old.reddit.com/r/X/comments/Abc/title/")
    assert got["source_url"] == "https://www.reddit.com/r/x/comments/abc/" and got["fetched_url"] == "https://old.reddit.com/r/X/comments/Abc/title/"
    assert [(s["id"], s["author"], s["parent_id"], s["text"]) for s in got["segments"]] == [("t3_p", "op", None, "Post text"), ("t1_b", "bo", "t1_a", "Reply"), ("t1_c", None, "t3_p", "Third")]
    assert got["segments"][1]["url"] == "https://www.reddit.com/r/x/comments/p/_/b" and item("<p>x</p>", "reddit")["reason"].startswith("unsupported_structure")
    old = '<div class="thing link" data-fullname="t3_q"><a class="title">Old</a><p class="author">al</p></div><div class="thing comment" data-fullname="t1_z" id="t1_z"><div class="entry"><a class="author">cy</a><div class="usertext-body"><div class="md">Hi</div></div></div></div>'
    got = item(old, "reddit", "https://www.reddit.com/r/x/comments/q/")
    assert [(s["id"], s["text"], s["author"]) for s in got["segments"]] == [("t3_q", "Old", "al"), ("t1_z", "Hi", "cy")]


def test_hackernews():
    row = '<tr class="athing comtr" id="{0}"><td class="ind" indent="{1}"></td><td><span class="comhead"><a class="hnuser">u{0}</a><span class="age" title="2026-01-01T00:00:00 1767225600"></span></span><div class="commtext">{2}<div class="reply">reply</div></div></td></tr>'
    rows = "".join(row.format(i, level, t) for i, level, t in ((101, 0, "one"), (102, 1, "two"), (103, 2, "[flagged]"), (104, 3, "four"), (105, 0, "five")))
    html = f'<table><tr class="athing submission" id="100"><td><span class="titleline"><a href="https://x.example/y">Story</a></span></td></tr><tr><td class="subtext"><span class="subline"><a class="hnuser">op</a><span class="age" title="2026-01-01T00:00:00"></span></span></td></tr>{rows}</table>'
    got = item(html, "hackernews", "https://news.ycombinator.com/item?id=100&p=2")
    assert {s["id"]: s["parent_id"] for s in got["segments"]} == {"100": None, "101": "100", "102": "101", "104": "103", "105": "100"}
    assert got["source_url"] == "https://news.ycombinator.com/item?id=100" and got["segments"][1]["text"] == "one" and got["segments"][1]["published_at"].year == 2026
    assert any(w.startswith("Discussion of external link") for w in got["warnings"]) and item("<tr class='athing'></tr>", "hackernews")["reason"].startswith("unsupported_structure")
    many = pages.item({"html": html, "adapter": "hackernews", "final_url": "https://news.ycombinator.com/item?id=100"}, most_comments=2)
    assert len(many["segments"]) == 3 and many["truncated"] and "Comment count capped by configuration" in many["warnings"]


def test_x_and_mastodon_and_forum():
    post = '<article data-testid="tweet"><a href="/a/status/{0}">t</a><div data-testid="User-Name">A @a</div><div data-testid="tweetText">{1}</div></article>'
    got = item(post.format(1, "no") + post.format(22, "yes"), "x", "https://x.com/a/status/22")
    assert got["body"] == "yes" and got["author"] == "A @a" and item(post.format(1, "no"), "x", "https://x.com/a/status/22")["reason"].startswith("access_or_structure")
    status = '<div class="status" data-id="{0}"><span class="display-name__account">@u{0}</span><div class="status__content__text">{1}</div></div>'
    main = '<div class="detailed-status"><span class="display-name__account">@me</span><div class="status__content__text"><p>Hi <a class="mention" href="https://m/@b">@<span>bob</span></a> see <a href="https://e.example/x?q=1"><span class="invisible">https://</span>e.example</a></p><p>two<br>lines</p></div></div>'
    got = item(status.format(1, "<p>before</p>") + main + status.format(3, "<p>after</p>") + status.format(4, ""), "mastodon", "https://m.example/@me/2")
    assert [(s["id"], s["kind"], s["parent_id"], s["text"]) for s in got["segments"]] == [("1", "context", None, "before"), ("2", "post", None, "Hi @bob see https://e.example/x\ntwo\nlines"), ("3", "reply", "2", "after")]
    assert [s["text"] for s in item('<div class="s-prose">q</div><div class="s-prose"> </div><div class="s-prose">a</div>', "forum")["segments"]] == ["q", "a"]


def test_caps():
    parts = [pages.Part(str(i), "x" * 40) for i in range(5)]
    kept, many, cut = pages.capped(parts, "article", 1, 100)
    assert [len(p.text) for p in kept] == [40, 40, 16] and not many and cut


def test_normalize_table(spark):
    rows = [(1, "https://a.example/x", f"<article>{LONG}</article>"), (2, None, None), (3, "https://a.example/y", "<title>Access denied</title>")]
    got = {r.page_id: r for r in pages.articles(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].body and got[1].segments[0].id == "body" and got[1].reason is None and got[2].reason.startswith("empty_content") and got[3].reason.startswith("access_blocked")
    assert pages.articles(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_text_columns(spark):
    rows = [("a\x0bb c \t d\r\ne\x85f", "2026-01-02T03:04:05+02:00"), (" Straße X  ", "Fri, 2 Jan 2026 03:04:05 +0000"), ("", "2026-01-02T03:04:05"), (None, "soon")]
    got = spark.createDataFrame(rows, "t string, d string").select(text.clean_text(F.col("t")).alias("c"), text.normalized_names(F.col("t")).alias("n"), text.parse_time(F.col("d")).cast("string").alias("p"), text.time_warning(F.col("d")).alias("w")).collect()
    assert [r.c for r in got] == ["a\nb\nc d\ne\nf", "Straße X", "", None] and [r.n for r in got[:3]] == [text.normalize_name(r[0]) for r in rows[:3]]
    assert [r.p for r in got] == ["2026-01-02 01:04:05", "2026-01-02 03:04:05", None, None] and [r.w and r.w[:8] for r in got] == [None, None, "Publicat", "Unparsed"]
