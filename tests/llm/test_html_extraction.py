import numpy as np
import pytest
from lodestone.llm import html_extraction as H

SMALL = "/root/testdata/sf0.01"


def test_held_out_pages():
    rng, field, right, blocks, wrong = np.random.default_rng(12345), H.trained(), 0, 0, 0
    for _ in range(300):
        b, y = H.labels_of(*H.labelled_page(rng))
        z = field.decode(b)
        right, blocks, wrong = right + (y == z), blocks + len(y), wrong + sum(a != c for a, c in zip(y, z, strict=True))
    assert right / 300 > 0.85 and wrong / blocks < 0.01


def test_decoding_and_likelihood_against_enumeration():
    from itertools import product

    rng, field = np.random.default_rng(1), H.Field()
    blocks = H.leaf_blocks("<p>a</p><div class=x>b c</div><ul><li>d<li>e f g h</ul>tail")
    field.index = {x: k for k, x in enumerate(sorted({x for f in H.features(blocks) for x in f}))}
    field.weight, field.step = rng.normal(size=(len(field.index), 2)), rng.normal(size=(2, 2))
    score = np.array([field.weight[r].sum(0) for r in field._rows(blocks)])
    value = {p: sum(score[i, x] for i, x in enumerate(p)) + sum(field.step[a, b] for a, b in zip(p, p[1:], strict=False)) for p in product((0, 1), repeat=len(blocks))}
    assert tuple(field.decode(blocks)) == max(value, key=value.get)
    single, pair = field._marginals(score)
    total = sum(map(np.exp, value.values()))
    assert single[2, 1] == pytest.approx(sum(np.exp(v) for p, v in value.items() if p[2]) / total)
    assert pair[1, 0, 1] == pytest.approx(sum(np.exp(v) for p, v in value.items() if p[1:3] == (0, 1)) / total)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<nav><a href=/>Home</a></nav><article><h1>T &amp; t</h1><p><b>One\n two.<br><p>Th&eacute;&nbsp;end.</p></article><footer>&copy; x</footer>", "T & t\n\nOne two.\n\nThé end."),
        ('<div class="cookie-notice"><p>We use.</p></div><main><p>Body text goes here, long enough.</p><div class="ad">Buy now.</div><p>More.</p></main><section id="comments"><p>Me too.</p></section>', "Body text goes here, long enough.\n\nMore."),
        ("<article><p>Kept <script>var t='</p>';</script>whole <!-- no --> text.</p><form><p>Sign up now.</p></form><p>End</p></article><aside><p>Side words here.</p></aside>", "Kept whole text.\n\nEnd"),
        ("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be given here.</p><noscript><p>Shown without scripts, it says.</p></noscript><p>A <object>drawn</object> thing.</p></article>", "Let x=2 be given here.\n\nShown without scripts, it says.\n\nA drawn thing."),
        ("<article><p>Cut off here and th", "Cut off here and th"),
        ("", ""),
        (None, ""),
    ],
)
def test_pages(page, want):
    assert H.main_text(page, H.trained()) == want


def test_whole_table_and_edges(spark):
    import re

    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = {r.page_id: r for r in H.op7(spark, SMALL).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        assert got[r.page_id].text == "\n\n".join(b.text for b in H.leaf_blocks(inner)) and got[r.page_id].n_chars == len(got[r.page_id].text)
    kind = "page_id long, url string, html string, text string"
    assert H.extract(spark.createDataFrame([], kind)).collect() == []
    rows = [(None, None, None, "c"), (1, "u", "", "c"), (1, "u", "<article><p>" + "long " * 50_000 + "</p></article>", "c")]
    assert sorted(r.n_chars for r in H.extract(spark.createDataFrame(rows, kind)).collect()) == [0, 0, 249_999]


@pytest.mark.parametrize("begin", ["<body>", "", "<BODY class=x>", "<svg><text>no</text></svg>"])
def test_head_without_its_end(begin):
    head = "<!doctype html><html><head><meta charset=utf-8><title>Site title</title><link rel=icon href=x><style>p{}</style><script>var a='<p>no</p>'</script><noscript><link href=y></noscript>\n"
    page = head + begin + "<article><h1>Head line</h1><p>Body text goes here, long enough.</p></article>"
    assert H.main_text(page, H.trained()) == "Head line\n\nBody text goes here, long enough."
    assert [b.text for b in H.leaf_blocks("<head><title>T</title>Text right behind it<p>More")] == ["Text right behind it", "More"]
    assert H.leaf_blocks("<head><title>T</title> <meta name=a> </head> ") == []


def test_all_names_of_an_attribute():
    classes = " ".join(f"u{chr(97 + k)}" for k in range(12))
    assert "c:sidebar" in H.leaf_blocks(f'<div class="{classes} sidebar"><p>x</p></div>')[0].path
