"""Pages that nest deeper than any layout needs."""

import pytest

from lakescope.llm.html import rendered

DEEP = [
    ("<div hidden><div>a</div></div>", ""), ("<p style='display:none'><span>a</span></p>", ""), ("<details><summary>s</summary><div>a</div></details>", "s"),
    ("<select><option>a<option>b</select>", "a"), ("<table><tr><td>a<td>b</table>", "a  b"), ("<ol><li>a<li>b</ol>", "1. a\n2. b"),
]


@pytest.mark.parametrize("depth", [119, 500, 20_000])
@pytest.mark.parametrize(("inner", "want"), DEEP)
def test_roles_at_depth(depth, inner, want):
    assert rendered("<div>" * depth + inner + "</div>" * depth) == want


def test_end_tags_at_depth():
    assert rendered("<div hidden>" + "<div>" * 300 + "a" + "</div>" * 300 + "b</div>c") == "c"


def test_lists_at_depth():
    assert rendered("<ul><li>" * 300 + "x" + "</li></ul>" * 300) == "- " * 300 + "x"
