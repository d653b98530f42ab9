"""What pages show: foreign elements, spaces, style sheets, tables, long and empty inputs."""

import pytest

pytest.importorskip("shoebox.llm.queries")
from shoebox.llm import html_extraction as H  # noqa: E402


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<svg><defs/><text>a</text></svg>b", "a\nb"), ("<svg><metadata/><mask/><g/></svg><p>b</p>", "b"), ("<math><mi/>x</math> y", "x y"), ("<div/>a<div>b</div>", "a\nb"), ("<svg/>c", "c"),
        ("a&nbsp;&nbsp;b &nbsp; c", "a  b   c"), ("a \t\n\f b", "a b"), ("a b", "a b"), ("<p>x&nbsp;</p>y", "x \n\ny"),
        ('<div style="white-space: pre">a  b\n c</div>d', "a  b\n c\nd"), ('<div style="white-space:pre-line">a  b\n c</div>', "a b\nc"), ('<pre>a  b<span style="white-space:normal"> c  d</span></pre>', "a  b c d"), ('<div style="white-space:pre"><p>a  b</p></div>', "a  b"),
        ("<table><tfoot><tr><td>f</td></tr></tfoot><tbody><tr><td>b</td></tr></tbody></table>", "b\nf"), ("<table><tr><td>b</td></tr><thead><tr><th>h</th></tr></thead><caption>c</caption></table>", "c\n\nh\nb"),
        ("<style>.x{display:none}</style><p class='y x'>a</p>b", "b"), ("<style>#i, em.q { visibility : hidden }</style><i id=i>a</i>b<em class=q>c</em><em>d</em>", "bd"), ("<style>p{display:none} .show{display:block}</style><p>a</p><p class=show>b</p>", "b"),
        ("<style>.x{display:none!important}</style><p class=x style='display:block'>a</p>b", "b"), ("<style>.x{display:none}</style><p class=x style='display:block'>a</p>b", "a\n\nb"), ("<style>/* p{display:none} */ @media print{p{display:none}} @media screen{b{display:none}}</style><p>a<b>c</b></p>", "a"),
        ("<style>div p{display:none} p:hover{display:none} a > b {display:none}</style><div><p>a</p></div>", "a"), ("<style>.pre{white-space:pre}</style><div class=pre>a  b</div>", "a  b"), ("<style>p{display:none", ""), ("<style>@import url(x); p{display:none}</style><p>a</p>b", "b"), ("<style>}{}{{</style>a", "a"),
        ("", ""), ("<p></p>", ""), ("<style></style>", ""),
    ],
)
def test_what_shows(html, text):
    assert H.visible_text(html) == text


def test_later_and_closer_rules_win():
    rules = {"p": "none", ".c": "block", "#i": "none", "p.c": "block"}
    for first in rules:
        for second in rules:
            if first != second:
                rank = {"p": (0, 0, 1), ".c": (0, 1, 0), "#i": (1, 0, 0), "p.c": (0, 1, 1)}
                winner = max((first, second), key=lambda r: rank[r])
                html = f"<style>{first}{{display:{rules[first]}}}{second}{{display:{rules[second]}}}</style><p class=c id=i>a</p>b"
                assert ("a" in H.visible_text(html)) == (rules[winner] == "block"), (first, second)


def test_long_and_empty_tables(spark):
    assert H.extract(spark.createDataFrame([], "page_id long, html string")).collect() == []
    wide = "<style>" + "".join(f".c{i}{{display:{'none' if i % 2 else 'block'}}}" for i in range(2000)) + "</style>" + "".join(f"<p class=c{i}>{i}</p>" for i in range(2000))
    long = "<p>" + "word&nbsp;x " * 200_000 + "</p>"
    got = {r.page_id: (r.text, r.n_lines) for r in H.extract(spark.createDataFrame([(1, wide), (2, long), (3, None)], "page_id long, html string")).collect()}
    assert got[1][0].split() == [str(i) for i in range(0, 2000, 2)] and got[2] == ("word x " * 199_999 + "word x", 1) and got[3] == ("", 0)
