"""Pages that are cut off, misdeclared, hidden in parts or full of spans."""

import random
import time

import pytest

from tallyard.llm.html_text import html_to_text


@pytest.mark.parametrize("page,text", [
    ("<p>a<![foo[bar]]>b</p>", "a]>b"[:1] + "b"),
    ("<p>a<![1>b", "ab"),
    ("<p>a<![if IE]>b<![endif]>c", "abc"),
    ("<p>a<svg><text><![CDATA[b > c]]></text></svg>", "a b > c"),
    ("<p>a<!-- open", "a"),
    ("<p>a<!-- open <b>c</b>", "a"),
    ("<p>a<div class='x", "a"),
    ("<p>a</p", "a"),
    ("<p>a<!doc", "a"),
    ("<p>1 < 2 & 3 <", "1 < 2 & 3 <"),
    ("<details><summary>s</summary>hidden <p>too</p></details>t", "s\nt"),
    ("<details open><summary>s</summary>shown</details>t", "s\nshown\nt"),
    ("<details>no summary</details>t", "t"),
    ("<dialog>hidden</dialog><dialog open>shown</dialog>", "shown"),
    ("<style>div .a{display:none}</style><div><p><b class=a>hidden</b>x</p></div><b class=a>shown</b>", "x\n\nshown"),
    ("<style>ul > .a{display:none}</style><ul><li class=a>hidden<li><b class=a>shown</b></ul>", "- shown"),
    ("<style>#n i, p:hover, .c + .d{display:none}</style><p id=n>a<i>hidden</i></p><i class=d>b</i>", "a\n\nb"),
    ("<style>.o .a{visibility:hidden}.o .a .s{visibility:visible}</style><div class=o><p class=a>h<span class=s>v</span></p></div>", "v"),
])
def test_pages(page, text):
    assert html_to_text(page) == text


def test_spans_are_linear():
    def seconds(rows):
        page = "<table>" + "<tr><td colspan=1000 rowspan=65534>x" * rows + "</table>"
        began = time.process_time()
        out = html_to_text(page)
        assert out.count("x") == rows
        return time.process_time() - began

    seconds(50)
    assert seconds(4000) < 20 * max(seconds(400), 0.05)


def test_spans_keep_columns_apart():
    page = "<table><tr><td rowspan=2>ab<td colspan=3>c<td>d<tr><td>e<td>f<td>g<td>h<tr><td>i<td>j</table>"
    assert html_to_text(page) == "ab  c        d\n    e  f  g  h\ni   j"


def test_random_pages_never_fail():
    rng = random.Random(8)
    bits = ["<", ">", "<!", "<![", "]]>", "<!--", "-->", "</", "/>", "<p", "<td colspan=9 rowspan=3>", "<table>", "<svg>", "<math>", "<style>", ".a{", "}", "<select>", "<option", "<details>", "&", "&#x110000;", "&amp", "\x00", "a", " ", "\n", "'", '"', "=", "<textarea>", "<title>", "</title>", "<?", "<li>", "<div class=a>"]
    for _ in range(10_000):
        html_to_text("".join(rng.choice(bits) for _ in range(rng.randint(1, 25))))


def test_mutated_pages_never_fail(spark):
    rng = random.Random(9)
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    for _ in range(1500):
        page = rng.choice(pages)
        for _ in range(rng.randint(1, 4)):
            at, n = rng.randrange(len(page) + 1), rng.randint(0, 6)
            page = page[:at] + rng.choice(["", "<", "<![", "<!", "<!--", ">", "</", "\x00", "&#", "<![x[", "'"]) + page[at + n :]
        html_to_text(page)


def test_clauses_take_linear_time():
    from tallyard.llm.toxicity import FEATURES, HITS, Grammar

    class Counting(Grammar):
        def __init__(self):
            pass

        def label(self, token):
            return "" if token == "." else sorted(HITS)[0] if token == "x" else "o"

        def path_of(self, clause):
            assert clause == (sorted(HITS)[0], "o")
            return (1,) + (0,) * (len(FEATURES) - 1)

    began = time.process_time()
    found = Counting().clauses("x y. " * 1_000_000, {})
    assert found[0] == found[-1] == 1_000_000 and time.process_time() - began < 30
