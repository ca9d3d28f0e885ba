import itertools
import random
from html.parser import HTMLParser

import numpy as np
import pytest

from gleanery.llm import maintext
from gleanery.llm.common import table

SF = "/root/testdata/sf0.001"
SCHEMA = "page_id long, url string, html string, text string, n_chars int"


def brute_region(scores):
    best = None
    for start, end in itertools.combinations(range(len(scores) + 1), 2):
        total = sum(scores[start:end])
        if total > 0 and (best is None or total > best[0]):
            best = (total, start, end)
        elif best is not None and total == best[0] and end == best[2] and start < best[1]:
            best = (total, start, end)
    return best


def test_linear_scan_equals_all_pairs():
    draw = random.Random(4)
    for _ in range(300):
        scores = [draw.randint(-4, 4) for _ in range(draw.randint(0, 12))]
        expected, found = brute_region(scores), maintext.best_region(np.array(scores, float))
        if expected is None:
            assert found is None
            continue
        assert sum(scores[slice(*found)]) == expected[0]
        assert found[1] == min(e for s, e in itertools.combinations(range(len(scores) + 1), 2) if sum(scores[s:e]) == expected[0])


class Marked(HTMLParser):
    """Text of the one article element of well-marked pages, by the standard parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines, self.open = [""], False

    def handle_starttag(self, tag, attrs):
        self.open = self.open or tag == "article"
        if tag == "br":
            self.lines[-1] += " "
        elif tag != "b":
            self.lines.append("")

    def handle_endtag(self, tag):
        if tag == "article":
            self.open = False
        if tag != "b":
            self.lines.append("")

    def handle_data(self, data):
        if self.open:
            self.lines[-1] += data


def marked(html):
    parser = Marked()
    parser.feed(html)
    lines = [" ".join(line.split()) for line in parser.lines]
    return "\n".join(line for line in lines if line)


def test_given_pages_equal_the_standard_parser(spark):
    pages = table(spark, SF, "pages")
    found = {r["page_id"]: r for r in maintext.extract(pages).collect()}
    rows = pages.collect()
    assert len(found) == len(rows)
    for row in rows:
        assert found[row["page_id"]]["text"] == marked(row["html"])
        assert found[row["page_id"]]["n_chars"] == len(marked(row["html"])) and found[row["page_id"]]["url"] == row["url"]


def test_held_out_pages_without_their_marks(spark):
    """Weights know no page whose text they find, and the content element is renamed."""
    pages = table(spark, SF, "pages")
    weights = maintext.train(pages.where("page_id % 2 = 0"))
    for row in pages.where("page_id % 2 = 1").collect():
        plain = row["html"].replace("<article>", "<div>").replace("</article>", "</div>")
        assert maintext.main_text(plain, weights) == marked(row["html"])


PARAGRAPHS = ["A first paragraph with a good many words in it.", "Short.", "The last one tells how it ended, at length."]
TEXT = "A headline\n" + "\n".join(PARAGRAPHS)
BODY = "<h1>A headline</h1>" + "".join(f"<p>{p}</p>" for p in PARAGRAPHS)


@pytest.fixture(scope="module")
def weights(spark):
    return maintext.train(table(spark, SF, "pages"))


@pytest.mark.parametrize(
    "page",
    [
        f"<body><div id=content>{BODY}</div></body>",
        f"<header><a href=/>Site name</a> and a motto of some words</header><main>{BODY}</main>",
        f"<div class='cookie-notice'>We use cookies on this site, please agree to all of them now.</div><section>{BODY}</section>",
        f"<article><header><h1>A headline</h1></header>{BODY[19:]}<footer>Filed under news and other things</footer></article>",
        f"<div>{BODY}<aside>Read also this other story of ours</aside></div>",
        f"<div>{BODY}</div><section class=comments><p>I do not agree with any of this, said a reader at great length.</p></section>",
        f"<article>{BODY}<div id='reader-comments'><article class=comment><p>Nice article, thank you.</p></article></div></article>",
        f"<article><h1>A headline</h1><p>{PARAGRAPHS[0]}</p><div class='ad-slot'>Buy this now</div><p>{PARAGRAPHS[1]}</p>"
        f"<form>Your mail <input name=x><button>Send</button></form><p>{PARAGRAPHS[2]}</p></article>",
        f"<div class=sidebar><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></div><div class='post-content'>{BODY}</div>",
        f"<form id=aspnet><div class=nav>Home and more</div><div>{BODY}</div></form>",
        f"<nav><ul><li>Home<article>{BODY}</article>",
        f"<script>if (a < b) document.write('<p>no</p>')</script><style>p > a {{}}</style><article>{BODY}<!-- <p>no</p> --></article>",
        f"<article>{BODY.replace('first', '<b>fi<i>rst</i></b>').replace(' ', '  ' + chr(10))}</article>",
        f"<article>{BODY.replace('last one', 'last&#32;&#x6f;n&#101;')}</article>",
    ],
)
def test_page_shapes(weights, page):
    assert maintext.main_text(page, weights) == TEXT


def test_references_and_empty_pages(weights):
    assert maintext.main_text("<p>a &amp;amp; b &lt;p&gt; c&nbsp;d &copy; &eacute;</p>", weights) == "a &amp; b <p> c d © é"
    for page in (None, "", "   ", "<p>", "<nav>only a menu</nav>", "<!-- x", "<script>1", "<p title=\"x", "</div></div>"):
        assert maintext.main_text(page, weights) == ""
    assert maintext.main_text("plain words", weights) == "plain words"
    assert maintext.main_text("<p>a < b and c<p title=\"x>y\">d", weights) == "a < b and c\nd"


def test_long_pages_lose_nothing(weights):
    words = " ".join(f"w{i}" for i in range(200_000))
    many = "".join(f"<p>x{i}</p>" for i in range(20_000))
    assert maintext.main_text(f"<article><p>{words}</p>{many}</article>", weights) == words + "\n" + "\n".join(f"x{i}" for i in range(20_000))
    deep = "<div>" * 5000 + "deep text" + "</div>" * 5000
    assert maintext.main_text(deep, weights) == "deep text"
    assert maintext.main_text("<p title='" * 3000 + "x", weights) is not None


def test_nulls_repeats_empty_tables_and_clashing_columns(spark):
    rows = [(1, "u", f"<article>{BODY}</article>", "x", 3), (1, "u", f"<article>{BODY}</article>", "x", 3), (None, None, None, None, None), (2, "v", "", "y", 1)]
    frame = spark.createDataFrame(rows, SCHEMA)
    found = sorted((tuple(r) for r in maintext.extract(frame).collect()), key=str)
    assert found == sorted([(1, "u", TEXT, len(TEXT)), (1, "u", TEXT, len(TEXT)), (None, None, "", 0), (2, "v", "", 0)], key=str)
    empty = maintext.extract(frame.limit(0))
    assert empty.columns == ["page_id", "url", "text", "n_chars"] and empty.count() == 0


def test_fit_keeps_signs_and_separates():
    found = maintext.fit([("#word", True, 900), ("#word+furniture", False, 300), ("#word+link+furniture", False, 99), ("p", True, 80), ("li", False, 90)])
    assert found.of("#word") > 0 > found.of("#word+furniture") and found.of("#word+link") > 0
    assert found.of("li") < found.of("p") < 0 and found.of("blink") == maintext.TAG_PRIOR
    assert maintext.fit([]).of("#word") == maintext.WORD_PRIOR
