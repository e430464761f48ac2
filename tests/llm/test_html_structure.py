"""Structure of op1_html_suffix_array: what must not cut an article's text."""

import pytest

from kinfolk.llm.html_suffix_array import ARTICLE, blocks_of


def text(html):
    return "\n".join(t for kind, t in blocks_of(html) if kind == ARTICLE)


@pytest.mark.parametrize(
    "inner,want",
    [
        ("<p>one <svg width='1'/> two</p><p>three</p>", "one two\nthree"),
        ("<p>one <math/> two</p><p>a <math><mi>x</mi></math> b</p>", "one two\na x b"),
        ("<p>one <button>press</p><p>two</p><p>three <button>x</button> four</p>", "one\ntwo\nthree four"),
        ("<p>one <select><option>x</p><p>two</p></select>", "one\ntwo"),
        ("<button-group>one</button-group><p>two</p><title-card>three</title-card>", "one\ntwo\nthree"),
        ("<p>one</p><script/><p>two</p><p><svg><text>x</text></svg>three</p>", "one\ntwo\nthree"),
        ('<h2 id="related-work">Work</h2><h2 id="share-prices">Prices</h2><p class="notice-period">Two months</p>', "Work\nPrices\nTwo months"),
        ('<div class="entry-content no-sidebar"><p>one</p><p>two</p></div>', "one\ntwo"),
        ('<p>a long text of the article</p><div class="social-share">x</div><div class="related">y</div>', "a long text of the article"),
    ],
)
def test_article_text(inner, want):
    assert text(f"<body><nav>menu</nav><article>{inner}</article><footer>foot</footer></body>") == want


def test_article_without_comments():
    assert text('<article class="post no-comments"><p>one</p></article><article class="comment-body"><p>me too</p></article>') == "one"
