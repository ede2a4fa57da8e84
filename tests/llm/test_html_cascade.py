"""End tags that authors leave out in elements that close whole, and what style sheets show again."""

import random

import pytest
from millrace.llm.html_text import CLOSED_WHOLE, UNSEEN, render

CASES = [
    ("<body><noscript><p>enable JS</noscript><div>visible</div><p>after", "visible\n\nafter"),
    ("<datalist><option>a</datalist>visible", "visible"),
    ("<select hidden><option>a<option>b</select>visible", "visible"),
    ("<video><p>x</video>visible", "visible"),
    ("<audio><div>x</audio>visible", "visible"),
    ("<canvas><ul><li>x</canvas>visible", "visible"),
    ("<template><table><tr><td>x</template>visible", "visible"),
    ("<button hidden><p>x</button>visible", "visible"),
    ("<svg><title>t<desc>d</svg>visible", "visible"),
    ("<select><option>a<option>b</select>visible", "a\nb\nvisible"),
    ("<style>.x{display:none} .x{display:block}</style><p class=x>shown", "shown"),
    ("<style>.x{display:none}</style><p class=x style='display:block'>shown", "shown"),
    ("<style>.x{display:none !important}</style><p class=x style='display:block'>hidden", ""),
    ("<style>#a{display:block} .x{display:none}</style><p class=x id=a>shown", "shown"),
    ("<style>p{visibility:hidden} b{visibility:visible}</style><p>no <b>yes</b> no", "yes"),
    ("<p hidden style='display:block'>shown", "shown"),
    ("<style>@media (max-width:600px){.m{display:none}}</style><p class=m>menu", "menu"),
    ("<style>@media (min-width:600px){.m{display:none}}</style><p class=m>menu", ""),
    ("<style>@media screen and (max-width: 40em), print{.m{display:none}}</style><p class=m>menu", "menu"),
    ("<style>@media not print{.m{display:none}}</style><p class=m>menu", ""),
    ("<style>@media (width < 2000px){.m{display:none}}</style><p class=m>menu", ""),
    ("<style>@supports not (display:grid){.m{display:none}}</style><p class=m>menu", "menu"),
    ("<style>@supports (display:grid){.m{display:none}}</style><p class=m>menu", ""),
    ("<!-->b-->c", "b-->c"),
    ("<!--->b<!-- x -->c", "bc"),
]


@pytest.mark.parametrize(("page", "text"), CASES)
def test_measured_inputs(page, text):
    assert render(page) == text


def test_nothing_after_an_end_tag_is_lost():
    rng = random.Random(2)
    for n in range(400):
        shown, unseen, page, word = [], [], [], 0

        def more(depth, seen):
            nonlocal word
            for _ in range(rng.randint(1, 3)):
                word += 1
                (shown if seen else unseen).append(f"w{word}")
                page.append(f"w{word} ")
                if depth and rng.random() < 0.7:
                    tag = rng.choice(["p", "div", "li", "ul", "h2", "blockquote", "dl", "dd", "option"])
                    page.append(f"<{tag}>")
                    more(depth - 1, seen)
                    if rng.random() < 0.4:
                        page.append(f"</{tag}>")

        for _ in range(3):
            tag = rng.choice(sorted(CLOSED_WHOLE - {"svg", "math", "select"}) + ["noscript"])
            page.append("<table><tr><td>")  # an open paragraph or item outside would be ended from inside, as browsers have it
            page.append(f"<{tag}{' hidden' if (hide := rng.random() < 0.5) else ''}>")
            more(3, not hide and tag not in UNSEEN)
            page.append(f"</{tag}>")
            more(2, True)
            page.append("</table>")
            more(1, True)
        got = render("".join(page)).split()
        assert set(shown) <= set(got) and not set(unseen) & set(got), "".join(page)
