"""Main text of pages written by hand in shapes that the composed training pages do not have."""

import pytest

from tessera.llm import crf

#: Pages and their main blocks, labelled by hand.
PAGES = [
    (
        "<!doctype html><title>Bread</title><meta name=x><h1>How to bake bread</h1><p>Mix flour, water, salt and yeast.<p>Wait two hours, then bake."
        "<nav><a href=/>Start</a><a href=/r>Recipes</a></nav><footer>© The kitchen</footer>",
        ["How to bake bread", "Mix flour, water, salt and yeast.", "Wait two hours, then bake."],
    ),
    (
        "<html><head><title>x</title><link rel=a><p>No body tag and no end of the head here.</p><p>The text goes on all the same.</p></html>",
        ["No body tag and no end of the head here.", "The text goes on all the same."],
    ),
    (
        "<body><form id=aspnetForm method=post><div id=topNav class=menu><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></div><div id=content><h1>Council meets</h1>"
        "<p>The council met on Tuesday to talk about the bridge.</p><p>It will meet again in June.</p></div><div id=footer>All rights reserved</div></form>",
        ["Council meets", "The council met on Tuesday to talk about the bridge.", "It will meet again in June."],
    ),
    (
        '<header class="site-header"><a href=/>The Daily</a></header><article class="share-price story"><h1>Shares fall</h1><p class=byline>By Ann Smith, 3 May</p><p>The price fell by a tenth.</p>'
        '<p class="related-work">Earlier work found the same.</p><div class="share-buttons"><a href=/f>Post</a> <a href=/t>Send</a></div></article>'
        '<section class="comments"><h3>2 comments</h3><div class=comment><p>I sold mine last week, luckily.</p></div><div class=comment><p>So did I.</p></div></section>',
        ["Shares fall", "By Ann Smith, 3 May", "The price fell by a tenth.", "Earlier work found the same."],
    ),
    (
        "<main id=popular-science><h2>Why the sky is blue</h2><p>Light is scattered by <math><mi>N</mi></math> molecules.</p><ul><li>Blue light more<li>Red light less</ul></main>"
        "<aside><h4>Most read</h4><ol><li><a href=/1>Why grass is green</a><li><a href=/2>Why snow is white</a></ol></aside>",
        ["Why the sky is blue", "Light is scattered by N molecules.", "Blue light more", "Red light less"],
    ),
    (
        '<div id="cookie-consent-banner"><p>We use cookies. <button>Accept</button></p></div><div class="c-page"><div class="l-main"><h1>Minutes</h1><table><tr><td>Item</td><td>Vote</td></tr><tr><td>Roof</td><td>Yes</td></tr></table>'
        '<blockquote>It was about time.</blockquote></div><div class="l-sidebar widget-area"><p>Subscribe to the letter and get it every week.</p></div></div>',
        ["Minutes", "Item", "Vote", "Roof", "Yes", "It was about time."],
    ),
    (
        '<nav aria-label="Main navigation"><a href=/>Home</a></nav><div role=main><h1>Rain</h1><p>It rained.</p><div class="advert"><p>Buy one umbrella and get a second one for free today.</p></div><p>Then it stopped.</p>'
        '<form class="newsletter-signup"><label>Your address</label><input><button>Join</button></form><p>Nobody knew why.</p></div>',
        ["Rain", "It rained.", "Then it stopped.", "Nobody knew why."],
    ),
    ("<nav><a href=/>Home</a></nav><script>var p = '<p>no text</p>';</script><footer><p>© nobody</p></footer>", []),
]


@pytest.mark.parametrize("at", range(len(PAGES)))
def test_pages_written_by_hand(at):
    page, main = PAGES[at]
    assert crf.default_field().extract(page) == "\n".join(main)


def test_names_are_read_whole():
    assert crf.kinds_of("share-buttons") == crf.kinds_of("article-share") == {"share"}
    assert crf.kinds_of("site-footer") == {"footer"}
    assert crf.kinds_of("post-content") == {"body"}
    assert not crf.kinds_of("share-price") | crf.kinds_of("related-work") | crf.kinds_of("popular-science") | crf.kinds_of("byline") | crf.kinds_of("wrapper")
