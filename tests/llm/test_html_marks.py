"""Words of MARKS in the class or id of wrappers, and of what surrounds the text."""

import pytest

pytest.importorskip("codeloom.llm")
from codeloom.llm import op03_html_text as op3  # noqa: E402

TEXT = " ".join(f"Sentence {i} of the story says a thing." for i in range(12))
BODY = f"<p>{TEXT}</p><p>And so it ends.</p>"
WHOLE = f"{TEXT} And so it ends."
NAV = "<nav><a href=/>Home</a></nav>"


@pytest.mark.parametrize(
    "page",
    [
        f"<body>{NAV}<div class='content no-sidebar'><article>{BODY}</article></div><footer>x</footer></body>",
        f"<body>{NAV}<div class='content no-sidebar'>{BODY}</div><footer>x</footer></body>",
        f"<body>{NAV}<article class='with-comments'>{BODY}</article><div class='ad'>Buy now</div></body>",
        f"<body>{NAV}<main id='search-page'>{BODY}</main></body>",
        f"<body><div class='with-sidebar'><main><article class='has-comments'>{BODY}</article></main><div id='sidebar'>Some words here</div></div></body>",
    ],
)
def test_marked_wrappers_keep_the_text(page):
    assert op3.main_text(page) == WHOLE


def test_what_is_around_stays_out():
    long = "<p>I think this is a fine story and I liked it a lot.</p>" * 8
    pages = [
        f"<body><article>{BODY}</article><div id='comments'><article class='comment'>{long}</article></div></body>",
        f"<body><div class='related'><article><p>Another story of old.</p></article></div><article>{BODY}<div class='share'>Share it now</div></article></body>",
        f"<body><div class='post'>{BODY}<ul><li class='ad'><div>Buy one</div></li></ul><p class='promo'>Buy two<p class='notice'>Read on</div></body>",
    ]
    assert [op3.main_text(p) for p in pages] == [WHOLE] * 3
    assert op3.main_text("<body><div class='cookie-notice'><p>We use cookies here.</p></div></body>") == ""
