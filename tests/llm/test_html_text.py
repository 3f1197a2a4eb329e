import pytest

from millrace.llm import html_text

MODEL = html_text.default_model()
BODY = "".join(f"<p>Paragraph {i} says something of interest, and goes on for a while about it.</p>" for i in range(6))
SAID = " ".join(f"Paragraph {i} says something of interest, and goes on for a while about it." for i in range(6))


def page(article, before="", after=""):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{before}{article}{after}</body></html>"


PARTS = [
    ("<nav><ul><li><a href='/a'>One</a></li><li><a href='/b'>Two</a></li></ul></nav>", "<footer>&copy; somebody &middot; all rights.</footer>"),
    ("<header class='site-header'>Our site</header><div class=\"ad\">Buy this thing now, it is cheap and very good.</div>", "<aside class='sidebar'><ul><li><a href='/x'>More</a></li></ul></aside>"),
    ("<div class='cookie-notice'><p>We use cookies here, please agree to them.</p></div>", "<div id='comments'><h3>Comments</h3><div class='comment'><p>I liked this a lot, thanks.</p></div></div>"),
    ("<form class='search'><label>Find</label><input><button>Go</button></form><!-- note -->", "<div class='share'><ul><li><a href='/s'>Share</a></li></ul></div>"),
]


@pytest.mark.parametrize("before,after", PARTS)
@pytest.mark.parametrize("tag", ["article", 'div class="post"', 'main'])
def test_parts_go_and_the_article_stays(before, after, tag):
    got = MODEL.text(page(f"<{tag}><h1>A title &amp; more</h1>{BODY}</{tag.split()[0]}>", before, after))
    assert got == "A title & more " + SAID


def test_blocks_white_space_and_broken_markup():
    art = "<article><h1>Head</h1><p><b>Bold start\n  here.<br><p>Next&nbsp;one &lt;x&gt; a<i>b</i>c.</p>" + BODY
    assert MODEL.text(page(art)[: -len("</body></html>")]) == "Head Bold start here. Next one <x> abc. " + SAID
    assert MODEL.text("<article>" + BODY + "<p>cut &am") .endswith("cut &am")
    assert MODEL.text("<article>" + BODY + "<p>cut <a hre").endswith("cut")


def test_marginals_against_all_labellings():
    """Sum-product equals summing over every labelling of a small tree."""
    from itertools import product
    from math import exp

    p = html_text.Page("<div class='post'><p>Some text here.</p><ul><li><a href=x>link</a></li></ul></div>")
    own = [MODEL.bias + sum(MODEL.weights.get(f, 0) for f in fs) for fs in p.features()]
    total, on = 0.0, [0.0] * len(own)
    for y in product((0, 1), repeat=len(own)):
        w = exp(sum(o for o, v in zip(own, y) if v) + sum(MODEL.pair[y[p.parent[e]]][y[e]] for e in range(1, len(y))))
        total += w
        on = [a + w * v for a, v in zip(on, y)]
    assert [x / total for x in on] == pytest.approx(MODEL.marginals(p))


def test_held_out_pages():
    """Accuracy over elements of pages that training has not seen."""
    right = n = 0
    for source in html_text.labelled_pages(150, seed=99):
        p = html_text.Page(source)
        if not any(x is not None for x in p.label):
            continue
        label = [0] * len(p.tag)
        for e in range(1, len(label)):
            label[e] = p.label[e] if p.label[e] is not None else label[p.parent[e]]
        right += sum((m >= 0.5) == y for m, y in zip(MODEL.marginals(p), label))
        n += len(label)
    assert right / n > 0.93


def test_operator(make, spark):
    s = "page_id long, url string, html string, id int, text string"
    rows = [(1, "u", None), (2, "u", ""), (3, None, "<p"), (None, "u", page(f"<article>{BODY}</article>")), (4, "u", "just a text, no markup. It is one."), (5, "u", page("<article>" + BODY * 3000 + "</article>")), (5, "u", "<nav>menu</nav>")]
    got = sorted((str(g.id), g.text) for g in html_text.extract(make(rows, s), keep=("url",)).collect())
    assert got == sorted([("1", ""), ("2", ""), ("3", ""), ("None", SAID), ("4", "just a text, no markup. It is one."), ("5", " ".join([SAID] * 3000)), ("5", "")])
    assert html_text.extract(make([], s)).count() == 0


@pytest.mark.parametrize("odd", ["<svg><path d='m'>", "<object data=x>", "<select><option>", "<math><mi>", "<textarea>", "<iframe src=x>", "<noscript>", "<template>"])
def test_unclosed_elements_lose_no_article(odd):
    got = MODEL.text(page(f"<article>{BODY}{odd}{BODY}</article>"))
    assert got.startswith(SAID) and got.endswith(SAID)


def test_formulas_and_fallbacks_are_text():
    said = "The sum of <math><mi>x</mi><mo>+</mo><mi>y</mi></math> is a number that we will use below, as shown."
    assert MODEL.text(page(f"<article>{BODY}<p>{said}</p></article>")).endswith("The sum of x+y is a number that we will use below, as shown.")


@pytest.mark.parametrize("source", ["<body><div><p>Hello world, this is a fairly long paragraph.</p></div></body>", "<article><p>Hello world, this is</p> <p>a fairly long paragraph.</p></article>", "<p>Hello world, this is a fairly long paragraph.</p>"])
def test_short_pages(source):
    assert MODEL.text(source) == "Hello world, this is a fairly long paragraph."


def test_hostile_pages_take_linear_time():
    import time

    for piece, end in (("<a ", '"'), ("<", ""), ("<!--", ""), ("<a '", ""), ("<title>", ""), ("<script", ""), ("<a \"' ", "")):
        began = time.perf_counter()
        html_text.Page(piece * 40_000 + end)
        assert time.perf_counter() - began < 5
