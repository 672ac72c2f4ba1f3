"""Wrapper inference and extraction on layouts of different kinds."""

import random

from logweave.llm import html_wrappers as H


def units(s):
    return s.split()


def test_repeats_fold():
    nodes, places = H.fold_repeats(units("ul li # li # li # /ul p # p #"))
    assert nodes == ["ul", ("+", ["li", "#"]), "/ul", ("+", ["p", "#"])]
    assert places == [[0], [1, 3, 5], [2, 4, 6], [7], [8, 10], [9, 11]]


def wrapper(s, key):
    import json
    nodes, _ = H.fold_repeats(units(s))
    return H._wrapper(json.dumps(nodes), key, {})


def test_mismatches_become_optional_or_repeated():
    a = wrapper("h1. # p. # div.ad # /div footer. #", "a")
    b = wrapper("h1. # p. # p. # p. # footer. # p. #", "b")
    w = H.align(a, b)
    assert H._keys(w) == ["h1.", "#", "(", "p.", "#", ")+", "div.ad", "#", "/div", "footer.", "#", "p.", "#"]
    assert [n.get("o", 0) for n in w] == [0, 0, 0, 1, 1, 1, 0, 0, 1, 1]


def page(r, article, host):
    nav = "".join(f"<li><a href=/{i}>{r.choice(['Home', 'News', 'x'])} {i}</a>" for i in range(r.randrange(2, 7)))
    notice = "<div class='cookie-notice'>We use cookies</div>" if r.random() < 0.5 else ""
    comments = "<section id=comments><article class='comment'><p>Nice one!</p></article></section>" if r.random() < 0.5 else ""
    if host == "a.example":
        body = f"<article><h1>{article[0]}</h1>" + "".join(f"<p>{x}" for x in article[1:]) + f"{notice}</article>"
    else:
        body = f"<div id=content><h2>{article[0]}</h2>" + "".join(f"<p>{x}</p>" for x in article[1:]) + f"{notice}</div><div>Fixed words of the layout</div>"
    return (f"<!DOCTYPE html><title>T</title><style>p{{}}</style><script>var t='</p>';</script><header><p>Site</p></header><nav><ul>{nav}</ul>"
            f"</nav><!-- <p>no</p> -->{body}<aside><p>See also</p></aside>{comments}<form><p>Mail us</p></form><footer>&copy; {host}</footer>")


def test_extraction(spark):
    r = random.Random(1)
    rows, want = [], {}
    for i in range(80):
        host = r.choice(["a.example", "b.example"])
        blocks = [" ".join(r.choices(["alpha", "beta", "gamma", "delta"], k=r.randrange(1, 20))) + f" {i}.{j}"
                  for j in range(r.randrange(1, 6))]
        html = [b.replace("beta", "<b>beta</b>\n\t&amp;<br>") for b in blocks]
        rows.append((i, f"http://{host}/{i}?q", page(r, html, host), "clash"))
        want[i] = "\n".join(b.replace("beta", "beta &") for b in blocks)
    rows += [(100, "http://a.example/", None, "c"), (101, None, "", "c"), (102, "http://[bad", "<article>only < this", "c"),
             (None, "http://a.example/0", rows[0][2], "c"), (0, rows[0][1], rows[0][2], "c"),
             (103, "http://a.example/", "<article>" + "<p>long text" * 30_000, "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = H.extract(df).collect()
    assert len(got) == len(rows)
    for x in got:
        assert x.n_chars == len(x.text)
        if x.page_id is not None and x.page_id < 100:
            assert x.text == want[x.page_id]
    by = {x.page_id: x.text for x in got}
    assert by[100] == by[101] == "" and by[102] == "only < this"
    assert by[103] == "\n".join(["long text"] * 30_000)
    assert H.extract(df.limit(0)).count() == 0


def test_hosts_with_templates_of_different_kinds(spark):
    rows, want = [], {}
    for i in range(24):
        words = [f"block {i} {j} with words of its own" for j in range(1 + i % 4)]
        cells = "".join(f"<p>{w}</p>" for w in words)
        menu = "<ul class='main-menu'><li>Home<li>Contact</ul>"
        body = [f"<article>{cells}</article>", f"<div class=content>{cells}</div>",
                f"<table><tr><td>{cells}</td></tr></table>"][i % 3]
        rows.append((i, "http://mixed.example/x", f"{menu}<div id=main-nav>Go</div>{body}<footer>End</footer>"))
        rows.append((100 + i, "http://menu.example/x", f"{menu}<div class='main-sidebar'>Side</div><div>{cells}</div>"))
        want[i] = want[100 + i] = "\n".join(words)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {x.page_id: x.text for x in H.extract(df).collect()} == want


def test_copies_lose_nothing(spark):
    one = "<nav>{}</nav><div><h1>Headline here</h1><p>A short paragraph.</p></div><footer>{}</footer>"
    cells = "<table>" + "<tr><td>same cell</td></tr>" * 9 + "</table>"
    rows = []
    for n in (1, 4, 5, 6, 300):
        rows += [(n, f"http://copies{n}.example/", one.format(f"Menu {i}", f"seen {i}")) for i in range(n)]
    rows += [(1000, "http://cells.example/", cells)]
    long = "fixed words of the layout " * 20
    rows += [(2000 + i, "http://layout.example/", f"<h1>Text {i}</h1><p>{long}</p>") for i in range(8)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    for x in H.extract(df).collect():
        assert x.text == ("\n".join(["same cell"] * 9) if x.page_id == 1000 else f"Text {x.page_id - 2000}"
                          if x.page_id >= 2000 else "Headline here\nA short paragraph."), x
