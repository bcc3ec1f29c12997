import itertools
import random
import time

import pytest

from quillwork.llm.html_text import Page, align, extract


def page(nav, title, *blocks, end="</article><footer>&copy; x</footer></body></html>"):
    return f'<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">{nav}</a></li></ul></nav><!-- ad --><div class="ad">Buy {nav}</div><article><h1>{title}</h1>' + "".join(f"<p>{b}</p>" for b in blocks) + end


def test_articles_come_out_without_what_surrounds_them(spark):
    rows = [(i, f"https://a.example.org/{i}", page(f"menu {i}", f"Title {i} &amp; more", f"First <b>bold</b>  text\n {i}", "Share this page", f"Second&nbsp;{i}")) for i in range(12)]
    rows += [
        (20, "http://b.example.org/", page("m", "One", "a &lt;b&gt;", end="")),
        (21, "http://b.example.org/2", '<body><div id="comments"><p>No</p></div><main><p>Yes<br>and<p>more<aside>no</aside><ul><li>x<li>y</ul></main>'),
        (22, None, None), (23, "no host", ""), (24, "http://c.org/", "plain words"), (25, "http://c.org/", "<p>broken <b>markup <script>never ends"),
        (26, "http://c.org/2", "<div class='sidebar'>s</div><div>own</div><form>f</form>"), (27, "http://c.org/3", "<p>" + "w " * 50000 + "</p>"),
    ]
    got = {r.page_id: r for r in extract(spark.createDataFrame([(*r, 1, "z") for r in rows], "page_id long, url string, html string, host int, exemplar string").repartition(3)).collect()}
    for i in range(12):  # the line that every page has is template
        assert got[i].text == f"Title {i} & more\n\nFirst bold text {i}\n\nSecond {i}"
    assert got[20].text == "One\n\na <b>"
    assert got[21].text == "Yes and\n\nmore\n\nx\n\ny"
    assert (got[22].text, got[22].n_chars, got[23].text) == ("", 0, "")
    assert got[24].text == "plain words" and got[25].text == "broken markup" and got[26].text == "own"
    assert got[27].n_chars == 99999
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_alignment_is_the_largest_order_and_label_preserving_one():
    a, b = Page("<div><p>1</p><ul><li>2</li></ul></div><footer>3</footer>"), Page("<nav>0</nav><div><h1>9</h1><p>1</p><ul><li>2</li></ul></div><footer>3</footer>")
    pairs = align(a.shape(), b.shape())
    assert len(pairs) == len(a.labels) and all(a.labels[i] == b.labels[j] for i, j in pairs.items())
    assert align(b.shape(), a.shape()) == {j: i for i, j in pairs.items()}


def plain_matching(a, b):
    """Size of the largest matching of two trees (label, children), by trying all subsets in order."""
    if a[0] != b[0]:
        return 0
    best = 0
    for k in range(min(len(a[1]), len(b[1])) + 1):
        for us in itertools.combinations(a[1], k):
            for vs in itertools.combinations(b[1], k):
                sizes = [plain_matching(u, v) for u, v in zip(us, vs, strict=True)]
                best = max(best, sum(sizes) if all(sizes) else 0)
    return best + 1


def test_alignment_against_all_matchings():
    r = random.Random(4)

    def grow(depth):
        return r.choice("xyz"), [grow(depth - 1) for _ in range(r.randrange(4))] if depth else []

    def shape(tree):
        lines, todo = [], [(tree, -1)]
        while todo:
            (label, children), parent = todo.pop(0)
            lines.append(f"{parent} {label}")
            todo += [(c, len(lines) - 1) for c in children]
        return "\n".join(lines)

    for _ in range(60):
        a, b = ("#", grow(3)[1]), ("#", grow(3)[1])
        assert len(align(shape(a), shape(b))) == plain_matching(a, b)


def site(r, host, pages, tags=("div", "div", "div", "div")):
    """Pages without any telling name, and the articles in them: menus, adverts and footers vary from page to page."""
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(3, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    adverts, names, rows, truth = [text(7) for _ in range(12)], [word() for _ in range(60)], [], {}
    menu, advert, main, foot = tags
    for i in range(pages):
        blocks = [text(6)] + [text(r.randrange(15, 60)) for _ in range(r.randrange(2, 9))]
        body = f"<h1>{blocks[0]}</h1>" + "".join(f"<p>{b}</p>" for b in blocks[1:3]) + f"<div>{r.choice(adverts)}</div>" + "".join(f"<p>{b}</p>" for b in blocks[3:]) + "<p>Read this page every day</p>"
        links = "".join(f'<li><a href="/x">{x}</a></li>' for x in r.sample(names, 5))
        rows.append((f"http://{host}/{i}", f"<html><body><{menu}><ul>{links}</ul></{menu}><{advert}>{r.choice(adverts)}</{advert}><{main}>{body}</{main}><{foot}>{text(3)} {r.choice(names)}</{foot}></body></html>"))
        truth[rows[-1][0]] = "\n\n".join(blocks)
    return rows, truth


def test_wrappers_find_articles_where_no_name_tells(spark):
    r = random.Random(6)
    rows, truth = [], {}
    for k, pages in enumerate((40, 25, 60)):
        own, articles = site(r, f"h{k}.example.org", pages, [("div", "div", "div", "div"), ("section", "div", "div", "p"), ("div", "p", "section", "div")][k])
        rows += own
        truth |= articles
    # A third of a host are copies of one article under other menus.
    copy = rows[0][1]
    for i in range(20):
        rows.append((f"http://h0.example.org/copy{i}", copy.replace("<ul>", f"<ul><li><a>{i}</a></li>", 1)))
        truth[rows[-1][0]] = truth[rows[0][0]]
    got = {x.url: x for x in extract(spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], "page_id long, url string, html string").repartition(4)).collect()}
    for url, text in truth.items():
        assert got[url].text == text
    assert sum(x.n_by_marks for x in got.values()) == 0 and sum(x.n_by_wrapper for x in got.values()) > 8 * len(rows)


def article_site(r, host, pages, layout):
    """Articles with a lead, a closing section and references; around them menus, a sidebar and a footer."""
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(3, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    names, rows, truth = [word() for _ in range(40)], [], {}
    for i in range(pages):
        title, lead, closing, refs = text(5), text(12), text(20), [text(9) for _ in range(3)]
        body = [text(r.randrange(30, 60)) for _ in range(r.randrange(3, 6))]
        links = "".join(f'<li><a href="/m">{x}</a></li>' for x in r.sample(names, 6))
        paragraphs = "".join(f"<p>{b}</p>" for b in body)
        cited = "".join(f'<li><a href="/r">{x}</a></li>' for x in refs)
        inner = f'<h1>{title}</h1><div class="lead"><p>{lead}</p></div><div class="text">{paragraphs}</div><div class="closing"><p>{closing}</p></div><div class="refs"><ul>{cited}</ul></div>'
        blocks = [title, lead, *body, closing, *refs]
        if layout == "div":
            inner, blocks = inner[: inner.index('<div class="refs">')], blocks[:-3]
        open_, close = {"article": ("<article>", "</article>"), "main": ("<main>", "</main>"), "div": ('<div class="story">', "</div>")}[layout]
        rows.append((f"http://{host}/{i}", f'<html><body><div class="top"><ul>{links}</ul></div>{open_}{inner}{close}<div class="side"><ul>{links}</ul><div>{r.choice(names)}</div></div><div class="foot">{text(3)} {r.choice(names)}</div></body></html>'))
        truth[rows[-1][0]] = "\n\n".join(blocks)
    return rows, truth


def test_articles_come_out_whole_with_lead_closing_and_references(spark):
    r = random.Random(9)
    rows, truth = [], {}
    for k, layout in enumerate(("article", "main", "div")):
        for pages in (8, 30):
            own, articles = article_site(r, f"w{k}-{pages}.example.org", pages, layout)
            rows += own
            truth |= articles
    got = {x.url: x.text for x in extract(spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], "page_id long, url string, html string").repartition(4)).collect()}
    wrong = [url for url, text in truth.items() if got[url] != text]
    assert not wrong, (len(wrong), wrong[0], got[wrong[0]], truth[wrong[0]])


def test_hidden_and_marked_elements_go_also_within_a_line(spark):
    rows = [
        (1, "http://a.org/", '<p>One <span class="advert">buy <span>now</span></span>two <i style="display: none">x</i>three</p><p hidden>four</p><div style="visibility:hidden"><p>5</p></div>'),
        (2, "http://a.org/2", '<p>Text <em class="note">stays</em> a < b and <a title="x > y">c</a><p>d<span class="ad">e<p>f</p><div class="reader-comments"><p>g</p></div>'),
        (3, "http://a.org/3", '<p class=x data-y="<p>">h</p><!-- <p>i</p> --><p>j<br/>k</p><b>l'),
        (4, "http://a.org/4", 'm<script>"<p>n</p>"</script ><p>o &lt;p&gt; &unreal; &#233;</p><!-- p'),
    ]
    got = {x.page_id: x.text for x in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "One two three", 2: "Text stays a < b and c\n\nd\n\nf", 3: "h\n\nj k\n\nl", 4: "m\n\no <p> &unreal; \u00e9"}


@pytest.mark.parametrize("page", ['<p "x ' * 170_000, '<p a="x ' * 130_000, "<div>" * 200_000, "<div><p>" * 60_000 + "</p>" * 120_000, "<!-- " * 200_000, "</script " * 100_000 + "<script>" + "</script " * 10_000, "<a b='x\" " * 110_000, "".join(f'<p class="c{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}">x</p>' for i in range(17_000))])
def test_a_megabyte_of_malformed_markup_is_read_in_seconds(page):
    began = time.process_time()
    shape = Page(page).shape()
    align(shape, Page("<html><body><p>a</p><div><p>b</p><div>c</div></div></body></html>").shape())
    assert time.process_time() - began < 5
