"""Golden micro-pages for H1-H15 (one rule or trap per case)."""
import pytest

from conftest import pages_df
from quire.operators.html import html_tokens, page_items, strip_noise, content_root

CASES = {
    # auto-close: <p> closes an open <p>; unclosed <b> ends with its block; <br> inside <b> does not split
    "p_autoclose_bold": ("<article><p><b>Title<br><p>Body</p></article>",
                         [("text", "Normal", "Title", "Title"), ("text", "Normal", "Body", "")]),
    # direct <br> splits a block into items of the same style
    "br_split": ("<article><h2>a<br>b<i>c</i></h2></article>",
                 [("text", "Heading 3", "a", ""), ("text", "Heading 3", "b c", "")]),
    # a block with a direct block child yields nothing itself
    "container_li": ("<article><ul><li>own<p>child</p></li></ul></article>",
                     [("text", "Normal", "child", "")]),
    # a block nested inside a wrapper is not a direct child: the outer block keeps its text
    "li_with_sublist": ("<article><ol><li>one<ul><li>sub</li></ul></li><li>two</li></ol></article>",
                        [("text", "List Number", "one", ""), ("text", "List Bullet", "sub", ""),
                         ("text", "List Number", "two", "")]),
    # page-wide first occurrence, case-sensitive
    "dedup": ("<article><p>x</p><p>y</p><p>x</p><p>X</p></article>",
              [("text", "Normal", "x", ""), ("text", "Normal", "y", ""), ("text", "Normal", "X", "")]),
    # text outside any block is lost; h4 maps to Heading 4
    "loose_text": ("<article>loose<div>also loose</div><h4>h</h4></article>",
                   [("text", "Heading 4", "h", "")]),
    # runs join with one space; &nbsp; is whitespace; comment splits text nodes (dropped, D1)
    "runs": ("<article><p>foo<b>bar</b> &nbsp; baz<!-- c -->qux</p></article>",
             [("text", "Normal", "foo bar baz qux", "bar")]),
    # noise removal survives a stray close tag; root falls back to body
    "strip_stray": ("<body></nav><nav><p>menu</p></nav><p>kept</p><footer><p>f</p></footer></body>",
                    [("text", "Normal", "kept", "")]),
    # root priority: main beats an earlier content div
    "root_priority": ("<body><div class='entry'><p>div</p></div><main><p>main</p></main></body>",
                      [("text", "Normal", "main", "")]),
    # unanchored, case-insensitive class match
    "root_div_class": ("<body><p>out</p><div class='Postal'><p>in</p></div></body>",
                       [("text", "Normal", "in", "")]),
    # td/th close each other; header inside article is stripped
    "table": ("<article><header><p>hdr</p></header><table><tr><td>a<td>b</tr></table></article>",
              [("text", "Normal", "a", ""), ("text", "Normal", "b", "")]),
    # script text with </p> never reaches the items
    "script": ("<article><script>var s='</p><p>x';</script><p>ok</p></article>",
               [("text", "Normal", "ok", "")]),
}


@pytest.fixture(scope="module")
def items(spark):
    rows = [(i, "https://s.example/a/b", html) for i, (html, _) in enumerate(CASES.values())]
    got = page_items(pages_df(spark, rows)).orderBy("page_id", "idx").collect()
    out = {}
    for r in got:
        bold = "|".join(x.text for x in (r.runs or []) if x.bold)
        out.setdefault(r.page_id, []).append((r.type, r.style, r.full_text, bold))
    return out


@pytest.mark.parametrize("case", list(CASES))
def test_micro_page(items, case):
    pid = list(CASES).index(case)
    assert items.get(pid, []) == CASES[case][1]


def test_images_follow_their_block(spark):
    html = ("<article><p><img src='/i1.png' alt=' Pic '>caption</p><img src='data:x'><img src=''>"
            "<div><img src='rel/i2.png'></div></article>")
    df = pages_df(spark, [(1, "https://s.example/a/b", html)])
    got = [(r.type, r.full_text, r.img_url, r.alt) for r in
           page_items(df, include_images=True).orderBy("idx").collect()]
    assert got == [("text", "caption", None, None),
                   ("image", "", "https://s.example/i1.png", "Pic"),
                   ("image", "", "https://s.example/a/rel/i2.png", "Image")]


def test_idx_dense_and_text_unique(spark):
    html = "".join(f"<p>line {i % 7}</p>" for i in range(50))
    df = pages_df(spark, [(1, "u", "<article>" + html + "</article>")])
    got = page_items(df).orderBy("idx").collect()
    assert [r.idx for r in got] == list(range(len(got)))
    assert len({r.full_text for r in got}) == len(got) == 7


def test_tokens_strip_root_counts(spark):
    df = pages_df(spark, [(1, "u", "<html><body><nav><a href='/x'>x</a></nav><article><p>a</p></article></body></html>")])
    t = html_tokens(df)
    assert [r.kind for r in t.orderBy("pos").collect()][:3] == ["open", "open", "open"]
    s = strip_noise(df)
    assert "nav" not in {r.tag for r in s.collect()}
    r = content_root(df)
    assert [(x.kind, x.tag) for x in r.orderBy("pos").collect()] == [("open", "p"), ("text", None), ("close", "p")]
