"""What an svg hides on a page."""

import pytest

from lectern.llm import html_extract


def shown(page):
    return " ".join(" ".join(p for n in html_extract.order(html_extract.parse(page)) for p in n.parts if isinstance(p, str)).split())


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>a</p><svg class='i'/><p>b</p>", "a b"), ("<p>a</p><svg/><p>b</p><svg><text>no</text></svg><p>c</p>", "a b c"),
        ("<p>a</p><svg><svg>no</svg>no</svg><p>b</p>", "a b"), ("<p>a</p><svg><path d='M0'><p>b</p>", "a b"), ("<p>a</p><svg><svg/>no</svg><p>b</p>", "a b"),
        ("<p>a</p><!-- <svg> --><svg>no</svg><p>b</p>", "a b"), ("<p>a</p><script>'</svg>'</script><svg>no<script>'</svg>'</script>no</svg><p>b</p>", "a b"),
    ],
)
def test_svg_hides_only_itself(page, text):
    assert shown(page) == text
