"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks, decoded by Viterbi.

Blocks are labelled main text or not. Features are the tags of a block's ancestors, the kinds of part that their attribute
names mean, and shapes of its text. Training maximises the conditional likelihood of labelled pages by forward-backward; `labelled_pages` composes
these pages from the parts that articles and their surroundings commonly have, so that the labels are exact.
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_batches
from tessera.llm.dom import Block, blocks

PAGES = 1200
ROUNDS = 120
SEED = 11

#: Attribute names of parts around an article, as sites commonly write them.
AROUND = {
    "nav": "nav navbar navigation menu main-menu topnav site-nav mega-menu breadcrumb breadcrumbs pagination pager skip-link tabs toc",
    "header": "header site-header masthead topbar top-bar banner logo branding page-header global-header",
    "footer": "footer site-footer page-footer bottom copyright legal colophon footer-links",
    "aside": "sidebar side-bar aside widget widget-area related related-posts recommended more-stories popular trending rail teaser teasers latest most-read",
    "notice": "notice cookie cookie-banner cookie-consent consent gdpr alert message popup modal overlay warning toast paywall announcement infobar",
    "ad": "ad ads advert adverts advertisement ad-slot ad-container sponsored sponsor promo promotion promoted dfp adsense outbrain taboola affiliate",
    "form": "form search search-form login signin signup subscribe newsletter newsletter-signup contact-form register feedback poll survey rating",
    "comments": "comments comment comment-list comment-body responses replies reply discussion disqus respond user-comments reader-comments",
    "share": "share sharing share-buttons social social-links follow follow-us toolbar tools print tags tag-list",
}
TAGS = {
    "nav": "nav nav nav ul div", "header": "header header div", "footer": "footer footer div", "aside": "aside aside section div",
    "notice": "div div section dialog aside", "ad": "div div aside section ins", "form": "form form div section", "comments": "section div ol ul", "share": "div ul p section",
}
BODY = "content article post entry story main text body article-body post-content entry-content story-body page-content prose markdown article-text"
#: What a line about the article's author and date is called: it belongs to the article.
LINES = "byline by-line author dateline date published meta post-meta entry-meta"
#: Words that names add to say where or in which shape a part stands.
NEUTRAL = frozenset(f"{BODY} {LINES} site list box section area item items top bottom side bar left right wrapper wrap container block inner outer group row col column module component panel global primary secondary mobile desktop js c l u is".replace("-", " ").split())
KINDS = {kind: frozenset(names.replace("-", " ").split()) - NEUTRAL for kind, names in AROUND.items()}
NAMES = {kind: frozenset(names.split()) - NEUTRAL for kind, names in AROUND.items()}
BODY_WORDS = frozenset(BODY.replace("-", " ").split())
SYLLABLES = "an re ti on en er th st ing ou la de men tion ar os es que ver sch te lo mi ka no su pe ra el ab".split()


class Writer:
    """Composes labelled pages: each fragment of text is noted as main text or not."""

    def __init__(self, seed: int):
        self.random = random.Random(seed)
        self.main: set[str] = set()
        self.count = 0

    def words(self, low: int, high: int) -> str:
        r = self.random
        self.count += 1
        made = ["".join(r.choices(SYLLABLES, k=r.randint(1, 4))) for _ in range(r.randint(low, high))]
        # A number makes every fragment distinct, so that labels can be told by text.
        return " ".join([*made, str(self.count)]).capitalize()

    def sentence(self, low: int = 4, high: int = 24) -> str:
        return self.words(low, high) + self.random.choice([".", ".", ".", "?", "!", "", ":"])

    def paragraph(self) -> str:
        """Main text comes in every shape: with marks, in columns, in capitals, repeated, in a few words."""
        r = self.random
        text = " ".join(self.sentence() for _ in range(r.choice([1, 1, 2, 3, 5, 8])))
        x = r.random()
        if x < 0.08:
            text = " | ".join(text.split()) + r.choice(["", " |"])
        elif x < 0.12:
            text = " · ".join(text.split(" ", 3)) + " © " + str(self.count)
        elif x < 0.16:
            text = text.upper()
        elif x < 0.24:
            text = self.words(1, 3)
        return self.note(text)

    def note(self, text: str) -> str:
        self.main.add(text)
        return text

    def attrs(self, names: str) -> str:
        r = self.random
        picked = r.choice(names.split())
        styles = ['class="%s"', 'class="%s"', 'id="%s"', 'class="box %s"', "class=%s", 'class="c-%s col"', 'role="%s"']
        return " " + r.choice(styles) % picked

    def around(self, kind: str) -> str:
        r = self.random
        tag = r.choice(TAGS[kind].split())
        plain = tag == kind or tag in ("nav", "aside", "form")
        attrs = "" if plain and r.random() < 0.5 else self.attrs(AROUND[kind])
        if kind == "nav" or (kind in ("footer", "header", "aside", "share") and r.random() < 0.5):
            items = [f'<a href="/{i}">{self.words(1, 9 if kind == "aside" else 3)}</a>' for i in range(r.randint(1, 8))]
            item = r.choice(["<li>%s</li>", "<li>%s", "%s | ", "<div>%s</div>", "<p>%s</p>"])
            inside = "".join(item % i for i in items)
            inside = f"<ul>{inside}</ul>" if item.startswith("<li") and tag != "ul" else inside
        elif kind == "comments":
            rows = [f"<div class=\"{r.choice(['comment', 'reply', 'c-item'])}\"><b>{self.words(1, 2)}</b><p>{self.sentence(2, 50)}</p></div>" for _ in range(r.randint(1, 6))]
            inside = f"<h3>{self.words(1, 3)}</h3>" * (r.random() < 0.7) + f"<p>{self.sentence(2, 50)}</p>" * (r.random() < 0.3) + "".join(rows)
        elif kind == "form":
            inside = f"<label>{self.words(1, 4)}</label><input name=q><button>{self.words(1, 2)}</button>" + f"<p>{self.sentence(3, 18)}</p>" * (r.random() < 0.5)
        else:
            inside = "".join(r.choice(["<p>%s</p>", "%s ", "<div>%s</div>", "<h4>%s</h4>", "<span>%s</span>", "&copy; %s &middot; "]) % self.sentence(2, 40) for _ in range(r.randint(1, 4)))
        return f"<{tag}{attrs}>{inside}</{tag}>"

    def line(self, tag: str) -> str:
        """Who wrote the article, and when."""
        r = self.random
        text = self.note(self.words(2, 8))
        return f"<{tag}{self.attrs(LINES)}>" + r.choice([text, f'<a href="/by">{text}</a>', f"<time>{text}</time>"]) + f"</{tag}>"

    def article(self) -> str:
        r = self.random
        if r.random() < 0.06:
            # Text straight in its container, lines parted by breaks only.
            lines = [self.sentence() for _ in range(r.randint(1, 6))]
            self.note(" ".join(lines))
            return r.choice(["<br>", "<br><br>", "<br/>"]).join(lines) + (self.line("div") if r.random() < 0.4 else "")
        out = [f"<h1>{self.note(self.words(2, 12))}</h1>"] if r.random() < 0.85 else []
        if out and r.random() < 0.2:
            out = [f"<header>{out[0]}{self.line('p')}</header>"]
        elif r.random() < 0.2:
            out.append(self.line(r.choice(["p", "div", "address"])))
        for _ in range(r.randint(1, 12)):
            x = r.random()
            if x < 0.62:
                text = self.paragraph()
                out.append(r.choice([f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>", f"<div>{text}</div>", f'<p class="lead">{text}</p>']))
            elif x < 0.70:
                out.append(f"<h2>{self.note(self.words(1, 8))}</h2>")
            elif x < 0.76:
                out.append("<ul>" + "".join(f"<li>{self.note(self.sentence(1, 14))}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
            elif x < 0.80:
                out.append(f"<blockquote><p>{self.note(self.sentence(3, 30))}</p></blockquote>")
            elif x < 0.83:
                out.append("<table>" + "".join(f"<tr><td>{self.note(self.words(1, 4))}</td><td>{self.note(self.words(1, 3))}</td></tr>" for _ in range(2)) + "</table>")
            elif x < 0.86:
                out.append(f"<figure><img src=x><figcaption>{self.note(self.words(3, 12))}</figcaption></figure>")
            elif x < 0.89:
                out.append(f'<p><a href="/x">{self.note(self.words(3, 9))}</a></p>')
            else:
                out.append(self.around(r.choice(["ad", "aside", "share", "form", "notice", "ad"])))
        return "".join(out)

    def page(self) -> str:
        r = self.random
        before = [self.around(k) for k in ("nav", "notice", "ad", "header", "form", "share") if r.random() < 0.5]
        after = [self.around(k) for k in ("share", "aside", "ad", "form", "notice", "footer") if r.random() < 0.45]
        r.shuffle(before)
        body = self.article()
        if r.random() < 0.4:
            comments = self.around("comments")
            body, after = (body + comments, after) if r.random() < 0.4 else (body, [comments, *after])
        x = r.random()
        if x < 0.45:
            body = f"<article>{body}</article>"
        elif x < 0.6:
            body = f"<main>{body}</main>"
        elif x < 0.9:
            tag = r.choice(["div", "section", "article"])
            body = f"<{tag}{self.attrs(BODY)}>{body}</{tag}>"
        elif x < 0.95:
            body = f"<div>{body}</div>"
        if r.random() < 0.3:
            body = f"<main>{body}</main>"
        if r.random() < 0.3:
            body = f'<div class="{r.choice(["wrapper", "container", "page", "layout", "row"])}">{body}' + "</div>" * (r.random() < 0.8)
        return f"<html><head><title>{self.words(2, 8)}</title></head><body>{''.join(before)}{body}{''.join(after)}</body></html>"


def labelled_pages(n: int = PAGES, seed: int = SEED) -> list[tuple[list[Block], list[int]]]:
    """Blocks of composed pages with their labels, 1 for main text."""
    writer, out = Writer(seed), []
    for _ in range(n):
        found = blocks(writer.page())
        out.append((found, [int(b.text in writer.main) for b in found]))
    return out


@lru_cache(maxsize=50_000)
def kinds_of(name: str) -> frozenset[str]:
    """The kinds of part that a whole attribute name means: none if it holds a word that says something else."""
    exact = frozenset(kind for kind, names in NAMES.items() if name in names)
    if exact:
        return exact
    words = frozenset(name.split("-"))
    telling = words - NEUTRAL
    if not telling:
        return frozenset({"body"}) if words & BODY_WORDS else frozenset()
    found = {kind: own & telling for kind, own in KINDS.items()}
    return frozenset(kind for kind, own in found.items() if own) if telling <= frozenset().union(*found.values()) else frozenset()


def roles(ancestors: frozenset[str]) -> list[str]:
    """Features of a block's ancestors: their tags, and the kinds of part that their names mean."""
    tags = sorted(a for a in ancestors if a[0] == "<" or a == "hidden")
    kinds = sorted(frozenset().union(*(kinds_of(a) for a in ancestors if a[0] != "<")))
    return [*tags, *(f"kind:{k}" for k in kinds), *(["around"] if set(kinds) - {"body"} else [])]


def shapes(block: Block, at: int, of: int) -> list[str]:
    """Features of a block's text and place."""
    text = block.text
    n, words = len(text), text.count(" ") + 1
    out = ["bias", f"in:{block.tag}", "words:" + ("1" if words < 3 else "3" if words < 8 else "8" if words < 20 else "20" if words < 60 else "60")]
    share = block.linked / n
    out.append("links:" + ("none" if not block.linked else "few" if share < 0.3 else "half" if share < 0.7 else "all"))
    out.append("stop" if text[-1] in ".?!:…" else "open")
    if "©" in text or "|" in text or "·" in text:
        out.append("bars")
    out.append("alone" if of < 4 else "first" if at == 0 else "last" if at == of - 1 else "inside")
    return out


class Field:
    """Weights of a two-label chain: emissions are of label 1 against label 0."""

    def __init__(self, weights: dict[str, float], moves: np.ndarray):
        self.weights, self.moves = weights, moves
        self._known: dict[frozenset[str], float] = {}

    def emission(self, block: Block, at: int, of: int) -> float:
        known = self._known.get(block.ancestors)
        if known is None:
            if len(self._known) > 50_000:
                self._known.clear()
            known = self._known[block.ancestors] = sum(self.weights.get(a, 0.0) for a in roles(block.ancestors))
        return known + sum(self.weights.get(s, 0.0) for s in shapes(block, at, of))

    def decode(self, found: list[Block]) -> list[int]:
        """The likeliest labels of a page's blocks (Viterbi)."""
        if not found:
            return []
        (m00, m01), (m10, m11) = self.moves.tolist()
        zero, one, back = 0.0, self.emission(found[0], 0, len(found)), []
        for at in range(1, len(found)):
            gain = self.emission(found[at], at, len(found))
            back.append((zero + m00 < one + m10, zero + m01 < one + m11))
            zero, one = max(zero + m00, one + m10), max(zero + m01, one + m11) + gain
        label = int(one > zero)
        labels = [label]
        for step in reversed(back):
            label = int(step[label])
            labels.append(label)
        return labels[::-1]

    def extract(self, page: str | None) -> str:
        """Main text of a whole page: its main blocks joined by line feeds; empty if there are none."""
        found = blocks(page)
        return "\n".join(b.text for b, label in zip(found, self.decode(found), strict=True) if label)


def train(pages: list[tuple[list[Block], list[int]]], rounds: int = ROUNDS, penalty: float = 2e-3) -> Field:
    """Maximise the conditional log-likelihood of labelled pages by Adam on exact forward-backward gradients."""
    pages = [p for p in pages if p[0]]
    longest = max(len(b) for b, _ in pages)
    names: dict[str, int] = {}
    rows = [[[names.setdefault(f, len(names)) for f in (*roles(b.ancestors), *shapes(b, i, len(found)))] for i, b in enumerate(found)] for found, _ in pages]
    x = np.zeros((len(pages), longest, len(names)), np.float32)
    y, real = np.zeros((len(pages), longest), int), np.zeros((len(pages), longest), bool)
    for p, page in enumerate(rows):
        for i, active in enumerate(page):
            x[p, i, active] = 1
        y[p, : len(page)], real[p, : len(page)] = pages[p][1], True
    w, moves = np.zeros(len(names)), np.zeros((2, 2))
    state = [np.zeros(len(w) + 4), np.zeros(len(w) + 4)]
    step_real = real[:, 1:]
    seen = np.array([[(step_real & (y[:, :-1] == a) & (y[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)])
    for n in range(1, rounds + 1):
        e = x @ w.astype(np.float32)
        emit = np.stack([np.zeros_like(e), e], axis=2).astype(float)
        forward, backward = np.zeros_like(emit), np.zeros_like(emit)
        forward[:, 0] = emit[:, 0]
        for i in range(1, longest):
            new = np.logaddexp.reduce(forward[:, i - 1, :, None] + moves, axis=1) + emit[:, i]
            forward[:, i] = np.where(real[:, i, None], new, forward[:, i - 1])
        for i in range(longest - 2, -1, -1):
            new = np.logaddexp.reduce(moves + (emit[:, i + 1] + backward[:, i + 1])[:, None, :], axis=2)
            backward[:, i] = np.where(real[:, i + 1, None], new, 0.0)
        total = np.logaddexp.reduce(forward[:, -1], axis=1)
        one = np.where(real, np.exp(forward[:, :, 1] + backward[:, :, 1] - total[:, None]), 0)
        joint = forward[:, :-1, :, None] + moves + (emit[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None]
        pairs = np.where(step_real[:, :, None, None], np.exp(np.minimum(joint, 0)), 0).sum(axis=(0, 1))
        slope = np.concatenate([np.tensordot((y * real - one).astype(np.float32), x, axes=2), (seen - pairs).ravel()]) / len(pages)
        slope -= penalty * np.concatenate([w, moves.ravel()])
        state[0] = 0.9 * state[0] + 0.1 * slope
        state[1] = 0.99 * state[1] + 0.01 * slope**2
        move = 0.15 * (state[0] / (1 - 0.9**n)) / (np.sqrt(state[1] / (1 - 0.99**n)) + 1e-8)
        w, moves = w + move[:-4], moves + move[-4:].reshape(2, 2)
    return Field({f: float(w[i]) for f, i in names.items()}, moves)


@lru_cache(maxsize=1)
def default_field() -> Field:
    """The field trained on the composed pages, once a driver."""
    return train(labelled_pages())


def extract(pages: DataFrame, keep: list[str], html_col: str = "html", field: Field | None = None) -> DataFrame:
    """`keep` columns of every row with `text string` (empty if there is none) and `n_chars long` (code points).

    Null pages are empty; null keys, ties and repeated rows stay as they are; an empty table gives an empty result.
    """
    field = field or default_field()
    weights, moves = field.weights, field.moves
    named = [pages[c].alias(f"k{i}") for i, c in enumerate(keep)]
    types = ", ".join(f"k{i} {pages.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))

    def run(batch: dict[str, list]) -> dict[str, list]:
        own = Field(weights, moves)
        texts = [own.extract(page) for page in batch["html"]]
        return {f"k{i}": batch[f"k{i}"] for i in range(len(keep))} | {"text": texts, "n_chars": [len(t) for t in texts]}

    out = map_batches(pages.select(*named, pages[html_col].alias("html")), run, f"{types}, text string, n_chars long")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "text", "n_chars")
