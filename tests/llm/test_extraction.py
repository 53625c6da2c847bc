import numpy as np
import pytest
from llm.cases import prose
from pyspark.sql import functions as F

from barquet.llm import extraction, queries
from barquet.llm.blocks import parse


def texts(html):
    return [b.text for b in parse(html)]


@pytest.mark.parametrize(
    "html, want",
    [
        ("", []),
        ("plain &amp; simple", ["plain & simple"]),
        ("<p>a<b>b</b> c\n\n d<p>e<br>f</p>g", ["ab c d", "e f", "g"]),
        ("<p><b>open<br><p>next</p>", ["open", "next"]),
        ("<title>t</title><div>x<script>var a='</p>';</script>y</div><style>p{}</style>", ["x y"]),
        ("<!-- c <p>no</p> --><ul><li>1<li>2</ul>", ["1", "2"]),
        ("<td title='a>b'>c</td><textarea>no</textarea>", ["c"]),
        ("2 < 3 and 4 > 1", ["2 < 3 and 4 > 1"]),
        ("<p>&lt;b&gt; &#233;&nbsp;x", ["<b> é x"]),
        ("<script>never closed <p>x", []),
        ("</div></p></b>after", ["after"]),
    ],
)
def test_blocks(html, want):
    assert texts(html) == want


def test_slopes_are_gradients():
    rng = np.random.default_rng(4)
    net = extraction.Labeller.fresh(rng)
    x = rng.normal(size=(2, 5, extraction.WIDTH))
    mask = np.array([[1, 1, 1, 1, 1], [1, 1, 1, 0, 0]], float)
    y = rng.integers(0, 2, (2, 5)).astype(float)

    def loss():
        p = extraction.sigmoid(net.run(x, mask))
        return -(mask * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / mask.sum()

    for k, g in enumerate(net.slopes(x, mask, y)):
        for at in [tuple(int(rng.integers(n)) for n in g.shape) for _ in range(4)]:
            old, eps = net.w[k][at], 1e-5
            net.w[k][at] = old + eps
            up = loss()
            net.w[k][at] = old - eps
            down = loss()
            net.w[k][at] = old
            assert g[at] == pytest.approx((up - down) / (2 * eps), abs=1e-6)


def page(i):
    body = "".join(f"<p>{prose(10 * i + k, 30)}</p>" for k in range(1 + i % 5))
    menu = "".join(f'<li><a href="/x">{prose(i + k, 1)}</a></li>' for k in range(5))
    return f"<html><head><title>t</title></head><body><nav><ul>{menu}</ul></nav><div class=\"ad\">{prose(500 + i, 6)}</div><article><h1>{prose(10 * i, 5)}</h1>{body}</article><footer>{prose(900 + i, 5)}</footer></body></html>"


@pytest.fixture(scope="module")
def net():
    return extraction.train([page(i) for i in range(60)], rounds=240)


def test_pages_it_has_not_seen(net):
    right = 0
    for i in range(100, 140):
        blocks = parse(page(i))
        got = extraction.label_pages(net, [blocks])[0] >= 0.5
        right += [b.text for b, k in zip(blocks, got, strict=True) if k] == [b.text for b in blocks if "article" in b.path]
    assert right >= 39


def test_layouts_it_has_not_seen(net):
    rng = np.random.default_rng(77)
    words = [prose(2000 + i, 25) for i in range(60)]
    noise = [prose(3000 + i, 4) for i in range(60)]
    hit = total = 0
    for _ in range(120):
        blocks, y = extraction.labelled_layout(rng, words, noise)
        got = extraction.label_pages(net, [blocks])[0] >= 0.5
        hit += int((got == y).sum())
        total += len(y)
    assert hit >= 0.96 * total


#: (page around the article, blocks of the article): shapes and names that no page of the training set has.
SHAPES = [
    ("<div class='post-body'>{}</div>", "<h1>{0}</h1><p>{1}</p><table><tr><th>{6}</th><th>{7}</th></tr><tr><td>{8}</td><td>42</td></tr></table><p>{2}</p>"),
    ("<div class='post-body'>{}</div>", "<h1>{0}</h1><p>{1}</p><pre>x = f(1); return x</pre><p>{2}</p><dl><dt>{6}</dt><dd>{3}</dd></dl>"),
    ("<div class='zqkv'>{}</div>", "<h1>{0}</h1><p>{1}</p><p>{2}</p><p>{3}</p><p>{4}</p>"),
    ("<section id='wub'>{}</section>", "<h2>{0}</h2><p>{1}</p><figure><img src=a><figcaption>{5}</figcaption></figure><p>{2}</p><ol><li>{6} {7}</li><li>{8}</li></ol>"),
]


def test_articles_of_shapes_and_names_it_has_not_seen(net):
    right = noise = total = 0
    for i in range(40):
        around, inside = SHAPES[i % 4]
        words = [prose(7000 + 20 * i + k, 30 if 0 < k < 5 else 3) for k in range(9)]
        menu = "".join(f'<li><a href="/x">{prose(i + k, 1)}</a></li>' for k in range(5))
        body = inside.format(*words)
        html = f"<html><body><nav><ul>{menu}</ul></nav>{around.format(body)}<footer>{prose(9000 + i, 5)}</footer></body></html>"
        blocks = parse(html)
        main = {b.text for b in parse(body)}
        kept = {b.text for b, p in zip(blocks, extraction.label_pages(net, [blocks])[0], strict=True) if p >= 0.5}
        right, total = right + len(main & kept), total + len(main)
        noise += len(kept - main)
    assert right >= 0.93 * total and noise <= 12


@pytest.mark.parametrize(
    "page",
    [
        "<a " * 500_000, '<a href="x ' * 150_000, "<a '" * 300_000, "<!" * 500_000, "<script>" + "</script " * 150_000,
        "<i>" * 50_000 + "<p>t" * 50_000, "<table><td>" + "<i>" * 50_000 + "<h1>t</h1>" * 50_000, "<div>x" * 60_000,
        "<dd>a" * 60_000 + "</ul>" * 60_000, "<b>" * 60_000 + "</i>" * 60_000,
    ],
    ids=range(10),
)
def test_broken_and_deep_pages_take_time_in_proportion(page):
    import time

    began = time.process_time()
    parse(page)
    assert time.process_time() - began < 8


def test_padding_does_not_change_a_page(net):
    pages = [parse(page(i)) for i in (1, 4, 2)] + [[]]
    alone = [extraction.label_pages(net, [p])[0] for p in pages]
    together = extraction.label_pages(net, pages)
    assert all(np.allclose(a, b) for a, b in zip(alone, together, strict=True))


def test_query_on_awkward_pages(spark, tmp_path):
    rows = [(i, f"http://a/{i}", page(i)) for i in range(40)]
    long_page = page(3).replace("</article>", f"<p>{prose(1, 60_000)}</p></article>")
    rows += [(100, None, page(5)), (101, "u", None), (102, "v", ""), (103, "w", "<nav><a>x</a></nav>"), (None, "x", page(6)), (104, "y", long_page), (0, "http://a/0", page(0))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    df.withColumn("text", F.lit(1)).withColumn("n_chars", F.lit("x")).write.parquet(str(tmp_path / "pages.parquet"))
    got = queries.QUERIES["op2_main_text"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    want = {(i, u): "\n".join(b.text for b in parse(h or "") if "article" in b.path) for i, u, h in rows}
    assert sum(r["text"] == want[(r["page_id"], r["url"])] for r in got) >= len(rows) - 2
    by = {r["page_id"]: r for r in got}
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert [by[i]["text"] for i in (101, 102)] == ["", ""] and by[104]["n_chars"] > 200_000


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    net = extraction.learn(empty)
    assert extraction.extract(empty, net).count() == 0


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<p>a<svg-icon name="x"></svg-icon> b</p><p>rest</p>', ["a b", "rest"]),
        ("<p>a<svg class=i/> b</p><p>rest</p>", ["a b", "rest"]),
        *[(f"<div><{t} class=x><p>a</p></div><p>rest</p>", ["a", "rest"]) for t in ("object", "canvas", "noscript", "iframe")],
        ("<p>a<object>b</p><p>c</p><object>d</object><p>rest</p>", ["a b", "c", "rest"]),
        ("<p>a<noscript><p>x</p><div>y</div></noscript> b</p>", ["a b"]),
        ("<p>a<svg><title>x</title><svg>y</svg>z</svg>b</p><p>c</p>", ["a b", "c"]),
        ("<div>a<svg>x</div><p>b</p></svg><p>c</p>", ["a", "b", "c"]),
        ("<ul><li>a<select><option>x<option>y</select><li>b</ul>", ["a", "b"]),
        ("<p>a</p><script-x>b</script-x><style>x</style ><p>c</p><script>x", ["a", "b", "c"]),
    ],
)
def test_embedded_elements_hide_only_their_content(page, want):
    assert texts(page) == want
