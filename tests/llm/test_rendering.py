"""Rendering of deep, spanning, hidden and wide content."""

from __future__ import annotations

import random

import pytest

from clipweave.llm import rendering

SHALLOW = [
    ("a<div hidden>HIDDEN</div>", "a"),
    ("<pre> a  b</pre>", " a  b"),
    ("<ul><li>x<li>y</ul>", "- x\n- y"),
    ("<table><tr><td>1<td>2<tr><td>33<td>4</table>", "1   2\n33  4"),
]


@pytest.mark.parametrize("depth", [1, 450, 20_000])
@pytest.mark.parametrize(("inner", "want"), SHALLOW)
def test_depth_changes_nothing(depth: int, inner: str, want: str) -> None:
    assert rendering.render("<div>" * depth + inner) == want


def test_deep_lists_and_tables() -> None:
    lists = rendering.render("<ul><li>x" * 3000)
    assert lists.count("- x") == 3000 and max(map(len, lists.split("\n"))) <= 2 * rendering.INDENTS + 3
    assert rendering.render("<table><tr><td>x" * 500) == " ".join(["x"] * 500)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<table><tr><td colspan=2>long spanning cell<td>c<tr><td>1<td>2<td>3</table>", "long spanning cell  c\n1  2                3"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
        ("<table><tbody><tr><td rowspan=0>a<td>b<tr><td>c<tbody><tr><td>d</table>", "a  b\n   c\nd"),
        ("<table><tr><td colspan=x>a<td colspan=99999>b<tr><td>cc<td>d</table>", "a   b\ncc  d"),
        ("<table><tr><td>名前<td>x<tr><td>abcd5<td>y</table>", "名前   x\nabcd5  y"),
        ("<table><tr><td>é<td>x<tr><td>ab<td>y</table>", "é   x\nab  y"),
        ("<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b>no</div>!", "yes\n!"),
        ("<table><tr style='visibility:collapse'><td>no<td style='visibility:visible'>yes</table>", "  yes"),
        ("<ul style='visibility:hidden'><li>a<li style='visibility:visible'>b</ul>", "- b"),
        ("<p style='display:none;display:block'>q</p><p style='display:block;display:none'>r</p>", "q"),
        ("<div style='display:none'><b style='visibility:visible'>no</b></div>", ""),
    ],
)
def test_spans_visibility_width(page: str, want: str) -> None:
    assert rendering.render(page) == want


def test_cells_begin_in_their_columns() -> None:
    """Every cell of random tables begins at the same place as the others of its column, found by filling a grid."""
    rng = random.Random(3)
    for _ in range(300):
        taken: dict[tuple[int, int], bool] = {}
        page, starts, n = "<table>", {}, 0
        for r in range(rng.randint(1, 6)):
            page += "<tr>"
            column = 0
            for _ in range(rng.randint(1, 5)):
                while (r, column) in taken:
                    column += 1
                wide = rng.choice([1, 1, 2, 3])
                if any((r, column + i) in taken for i in range(wide)):
                    wide = 1
                down = rng.choice([1, 1, 1, 2])
                taken |= {(r + i, column + j): True for i in range(down) for j in range(wide)}
                word = f"w{n}" + rng.choice(["", "xx", "宽"]) + "."
                n += 1
                page += f"<td colspan={wide} rowspan={down}>{word}"
                starts[word] = (r, column)
                column += wide
        lines = rendering.render(page).split("\n")
        at: dict[int, set[int]] = {}
        for word, (r, column) in starts.items():
            at.setdefault(column, set()).add(rendering.places(lines[r][: lines[r].index(word)]))
        assert all(len(places) == 1 for places in at.values()), page
