"""Visible text of pages, against a plain reference."""

import random

import pytest

from cairn.llm import html


@pytest.mark.parametrize(
    "page, text",
    [
        ("<style>@media print{.c{display:none}}</style><p class=c>shown", "shown"),
        ("<style>.c{display:none} .c{display:block}</style><p class=c>shown", "shown"),
        ("<style>p.c{display:none} .c{display:block}</style><p class=c>no", ""),
        ("<style>.c{display:none}</style><p class=c style='display:block'>shown", "shown"),
        ("<style>#i{display:none!important}</style><p id=i style='display:block'>no", ""),
        ("<div style='visibility:hidden'>no<b style='visibility:visible'>shown</b></div>", "shown"),
        ("<style>.a .b{display:none} .a>.d{display:none}</style><div class=a><i><b class=b>no</b></i><i><u class=d>one</u></i><u class=d>no</u></div><b class=b>two</b>", "one\ntwo"),
        ("<math><mi>x</mi><mo>=</mo><mn>1</mn></math> <svg><text>drawn</text><text>too</text><defs><text>no</text></defs></svg><map name=m>mapped</map>", "x=1 drawn too mapped"),
        ("<table><tr><td rowspan=2>A<td>b<td>c<tr><td>d<td>e<tr><td>f<td>g<td>h</table>", "A  b  c\n   d  e\nf  g  h"),
        ("<table><tfoot><tr><td>foot<td>9</tfoot><tbody><tr><td colspan=2>wide one<td>x<tr><td>1<td>2<td>3</table>", "wide one  x\n1     2  3\nfoot  9"),
        ("<table><tr><td rowspan=0>A<td>b<tr><td>c<tbody><tr><td>d<td>e</table>", "A  b\n   c\nd  e"),
        ("<style>@media (max-width:600px){.m{display:none}} @media screen and (min-width:600px){.n{display:none}}</style><p class=m>yes<p class=n>no", "yes"),
        ("<style>[data-x='1']{display:none} a:hover{display:none} p::before{content:'}'} .z{display:none}</style><p data-x=1>no<p data-x=2>yes <a>link</a><p class=z>no", "yes link"),
        ("<ul style='visibility:hidden'><li>no<li style='visibility:visible'>yes</ul>", "- yes"),
        ("<details>no<summary>sum</summary><p>no</details><details open><summary>s</summary>yes</details>", "sum\ns\nyes"),
    ],
)
def test_visibility_and_tables(page, text):
    assert html.visible_text(page) == text


def tree(rng, depth, hidden, invisible, state):
    """Markup of random nested elements; state gets the words a browser shows, in order."""
    out = []
    for _ in range(rng.randint(1, 4)):
        kind = rng.randrange(4 if depth else 1)
        if kind == 0:
            state["n"] += 1
            word = f"w{state['n']}"
            if not hidden and not invisible:
                state["shown"].append(word)
            out.append(f" {word} ")
            continue
        tag = rng.choice(["div", "p", "span", "b", "blockquote", "section", "h3", "i"])
        if tag in ("p", "h3"):
            inner, h, v = None, hidden, invisible
        style = rng.choice(["", "", "", "gone", "back", "unseen", "seen"])
        h, v = hidden or style == "gone", {"unseen": True, "seen": False}.get(style, invisible)
        inner = tree(rng, depth - 1 if tag not in ("p", "h3") else 0, h, v, state)
        out.append(f'<{tag} class="{style}">{inner}</{tag}>' if style else f"<{tag}>{inner}</{tag}>")
    return "".join(out)


def test_shown_words_in_the_order_of_the_source():
    rng = random.Random(11)
    css = "<style>.gone{display:none} .back{display:none} .back{display:block} div.unseen,.unseen{visibility:hidden} .seen{visibility:visible}</style>"
    for _ in range(200):
        state = {"n": 0, "shown": []}
        page = css + tree(rng, 4, False, False, state)
        assert html.visible_text(page).split() == state["shown"], page


def test_a_very_long_page():
    page = "".join(f"<p>word{i} <b>and</b> more" for i in range(40_000))
    got = html.visible_text(page).split("\n\n")
    assert len(got) == 40_000 and got[-1] == "word39999 and more"
