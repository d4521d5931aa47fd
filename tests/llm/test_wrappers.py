"""Generated hosts whose articles are known, and the cases that went wrong once."""

import random

import pytest

from pagelathe.llm import wrappers

FIELDS = "page_id long, url string, html string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))


def generated(rng, host, kind, n):
    """(pages of a host, their main texts): menus, adverts, notices and footers vary or not, articles have lists, quotes and tables."""
    motto, licence, share = words(rng, 12), words(rng, 20), words(rng, 4)
    pages = []
    for i in range(n):
        title = words(rng, 6)
        blocks, html = [title], f"<h1>{title}</h1>"
        for _ in range(rng.randint(2, 9)):
            pick, text = rng.choice("ppppuqt"), words(rng, rng.randint(5, 60))
            if pick == "u":
                some = [words(rng, 4) for _ in range(rng.randint(2, 5))]
                html += "<ul>" + "".join(f"<li>{x}" for x in some) + "</ul>"
                blocks += some
            elif pick == "q":
                html += f"<blockquote><p>{text}</p></blockquote>"
                blocks.append(text)
            elif pick == "t":
                html += f"<table><tr><th>{text[:9]}</th><td>{text}</td></tr></table>"
                blocks += [text[:9].strip(), text]
            else:
                html += f"<p>{text}&amp;&nbsp;co" + ("</p>" if rng.random() < 0.5 else "")
                blocks.append(text + "& co")
        html += f'<div class="share-buttons">{share}</div><p class="licence">{licence}</p>'
        if kind == "article":
            html = f"<article>{html}</article>"
        elif kind == "main":
            html = f'<div role="main"><section>{html}</section></div>'
        else:
            html = f'<div id="c{i}" class="k2">{html}</div>'
        menu = "".join(f'<li><a href="/{j}">{words(rng, 1)}</a>' for j in range(rng.randint(3, 7)))
        html = f"<html><head><title>{title}</title><body><p>{motto}</p><nav><ul>{menu}</ul></nav><div class='ad'>{words(rng, 9)}</div>{html}<div id='comments'><p>{words(rng, 30)}</div><aside>{words(rng, 8)}</aside><footer>&copy; {words(rng, 8)}</footer>"
        pages.append((html, "\n".join(blocks)))
    return pages


@pytest.mark.parametrize("kind", ["article", "main", "bare"])
def test_generated_hosts(spark, kind):
    rng = random.Random(kind)
    known = {}
    rows = []
    for host in ("one.org", "two.net"):
        for html, text in generated(rng, host, kind, 40):
            known[len(rows)] = text
            rows.append((len(rows), f"https://{host}/{len(rows)}", html))
    out = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, FIELDS)).collect()}
    right = got = want = 0
    for i, text in known.items():
        a, b = out[i].split("\n"), text.split("\n")
        right += len(set(a) & set(b))
        got += len(set(a))
        want += len(set(b))
    assert right >= 0.99 * want and right >= 0.99 * got, (right, got, want)
    # without the host's other pages the line that they share can't be told from the article
    alone = wrappers.main_text(rows[0][2])
    assert alone.count("\n") > out[0].count("\n")


def test_bounds_of_wrappers_lose_no_text(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, "http://h.de/", html) for i, (html, _) in enumerate(generated(rng, "h.de", "bare", 30))]
    docs = spark.createDataFrame(rows, FIELDS)
    whole = {r.page_id: r.text for r in wrappers.extract(docs).collect()}
    deep = "<div>" * 200 + "<p>deep text</p>" + "</div>" * 200
    wide = "".join(f"<p class=c{chr(97 + i % 26)}{chr(97 + i // 26)}>text {i}" for i in range(300))
    assert wrappers.main_text(deep) == "deep text"
    assert wrappers.main_text(wide) == "\n".join(f"text {i}" for i in range(300))
    for name, value in (("WIDE", 500), ("MOST", 50_000), ("DEPTH", 400)):
        monkeypatch.setattr(wrappers, name, value)
    host, node = None, None
    for _, _, html in rows:
        page = wrappers.generalised(wrappers.read_page(html)[0])
        node = wrappers.merge(node, page) if node else page
    wanted = wrappers.judge(node)
    assert all(wrappers.main_text(html, node, wanted) == whole[i] for i, _, html in rows)


@pytest.mark.parametrize(
    "html, text",
    [
        ("<head><title>T</title><body><h1>Head</h1><ul><li>a</ul><p>para</p>", "Head\na\npara"),
        ("<head><title>T</title><h1>Head</h1>text", "Head\ntext"),
        ("<head><title>T</title>text<p>more", "text\nmore"),
        ("<article><h1>t</h1><p class='notice-board'>board</p><div class='related-work'>work</div><p class=notice>gone</p><div class='related-posts'>gone</div></article>", "t\nboard\nwork"),
        ("<body><h1>Title</h1><h3>" + "long heading " * 30 + "</h3><p>para</p>", "Title\n" + ("long heading " * 30).strip() + "\npara"),
        ("<p>a &lt;b&gt; &#8364;&nbsp;&nbsp;x</p><script>no</script><style>no</style><form>no<p>no</form>", "a <b> € x"),
        ("<nav>n</nav><p>one</p><nav>m</nav><p>two", "one\ntwo"),
        ("", ""),
        ("plain", "plain"),
        ("<article></article><p>outside", "outside"),
    ],
)
def test_pages_alone(html, text):
    assert wrappers.main_text(html) == text


def test_what_copies_share_stays(spark):
    """Copies of one article among others of the host: what only they have is no boilerplate."""
    page = "<body><article><h1>{0}</h1><p>{0} first {0}</p>{1}<p>{0} second</p></article>"
    rows = [(i, "http://h.com/", page.format("copy", "<blockquote>only in the copies</blockquote>")) for i in range(20)]
    rows += [(20 + i, "http://h.com/", page.format(f"other{i}", "<div class=x>says every page</div>")) for i in range(8)]
    out = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, FIELDS)).collect()}
    assert "only in the copies" in out[3] and "says every page" not in out[22] and out[22].startswith("other2\nother2 first")


def test_ambiguous_names_by_the_wrapper(spark):
    page = "<body><article><h1>{0}</h1><p>{0} first {0}</p><div class='notice-{1}'><p>{2}</p></div></article>"
    rows = [(i, "http://a.com/", page.format(f"t{i}", "board", "always the same")) for i in range(7)] + [(10 + i, "http://b.com/", page.format(f"t{i}", "board", f"own words {i}")) for i in range(7)]
    out = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, FIELDS)).collect()}
    assert out[3] == "t3\nt3 first t3" and out[13] == "t3\nt3 first t3\nown words 3"


def test_defined_results(spark):
    rows = [(1, "http://h.com/", "<p>a"), (1, "http://h.com/", "<p>a"), (None, None, None), (2, "http://h.com/", "<p>" + "long " * 1_000_000)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], FIELDS + ", text string, host long")
    out = sorted(((r.page_id or 0, r.text[:9], r.n_chars) for r in wrappers.extract(docs).collect()))
    assert out == [(0, "", 0), (1, "a", 1), (1, "a", 1), (2, "long long", 4_999_999)]
