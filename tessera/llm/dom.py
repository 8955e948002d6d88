"""Leaf blocks of a web page: runs of text between block-level tags, with their ancestors' tags and attribute names."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

#: Elements whose content is never text of the page. Formulas (but their annotations) and the fallback of objects are text.
SKIPPED = frozenset("script style noscript template svg annotation annotation-xml iframe canvas audio video head title textarea select datalist".split())
#: Of these, the ones whose content has no tags: it ends only at their end tag.
RAW = frozenset("script style noscript iframe title textarea".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a block.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol optgroup option p pre search section summary table tbody td "
    "tfoot th thead tr ul".split()
)
#: Start tags that close an open element of the same group, and where the search for it ends.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol menu dl table td th body article section div nav aside footer header main form button".split())
TOKEN = re.compile(
    r"<!--(?P<comment>.*?)(?:-->|\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"'=]|=\s*+(?:\"[^\"]*+\"|'[^']*+')?|[\"'])*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)|(?P<text>[^<]++|<)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"(class|id|role|itemprop|aria-label|data-component|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.IGNORECASE)
#: Elements deeper than this are taken as their neighbours' siblings, as browsers do; their text stays.
DEPTH = 512
#: Elements that a head may hold; any other, or text, begins the body.
IN_HEAD = frozenset("base basefont bgsound link meta noscript script style template title head html".split())
#: Elements of a page as a whole: a form around one of them is no form to fill in but the frame of the page.
WHOLE = frozenset("article main header footer nav h1".split())
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
PARTS = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    """Text of a leaf block, the features of its ancestors, and its characters inside links."""

    text: str
    ancestors: frozenset[str]
    linked: int
    tag: str


def attribute_names(attrs: str) -> set[str]:
    """Names that the attributes give an element: each whole, its parts in lower case joined by hyphens."""
    out = set()
    for name, *values in ATTRIBUTE.findall(attrs):
        value = next(filter(None, values), "")
        if name.lower() in ("hidden", "aria-hidden"):
            if value.lower() != "false":
                out.add("hidden")
            continue
        for one in [value] if name.lower() == "aria-label" else value.split():
            out.add("-".join(PARTS.findall(CAMEL.sub(" ", one).lower())))
    return out - {""}


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks of a whole page in order; character references decoded, white space inside a block made one space."""
    page = page or ""
    held: list[tuple[Block, list | None]] = []
    # An element is its tag, its own features, whether it frames the page, and the features of its ancestors so far.
    stack: list[list] = [["", frozenset(), False, frozenset()]]
    parts: list[str] = []
    linked, links, skipping, forms = 0, 0, 0, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            tag = next((e[0] for e in reversed(stack) if e[0] in BLOCK), "")
            held.append((Block(text, stack[-1][3], min(linked, len(text)), tag), list(stack) if forms else None))
        parts.clear()
        linked = 0

    def pop_to(depth: int) -> None:
        nonlocal links, skipping, forms
        for tag, *_ in stack[depth:]:
            links -= tag == "a"
            skipping -= tag in SKIPPED
            forms -= tag == "form"
        del stack[depth:]

    at, end = 0, len(page)
    while at < end:
        found = TOKEN.match(page, at)
        at = found.end()
        text, tag = found["text"], found["tag"]
        if text is not None:
            if stack[-1][0] == "head" and not text.isspace():
                pop_to(len(stack) - 1)
            if not skipping:
                parts.append(text)
                if links:
                    linked += len(text)
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if stack[-1][0] == "head" and tag not in IN_HEAD:
            pop_to(len(stack) - 1)
        if tag == "br" or tag == "wbr":
            parts.append(" " if tag == "br" else "")
            continue
        if tag in BLOCK:
            flush()
        if found["close"]:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
            if depth:
                pop_to(depth)
            continue
        if tag in VOID:
            continue
        if tag in BLOCK:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] in ("p", *SCOPE)), 0)
            if depth and stack[depth][0] == "p":
                pop_to(depth)
        if tag in CLOSES:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in CLOSES[tag]:
                    pop_to(i)
                    break
                if stack[i][0] in SCOPE:
                    break
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.IGNORECASE).search(page, at)
            at = close.start() if close else end
            at = (page.find(">", at) + 1 or end) if close else end
            continue
        own = {f"<{tag}>"} if tag in BLOCK or tag in ("a", "time", "small", "span", "cite") else set()
        if found["attrs"].strip():
            own |= attribute_names(found["attrs"])
        if len(stack) > DEPTH:
            continue
        if forms and tag in WHOLE:
            for element in stack:
                element[2] = element[2] or element[0] == "form"
        stack.append([tag, own, False, stack[-1][3] | own if own else stack[-1][3]])
        links += tag == "a"
        skipping += tag in SKIPPED
        forms += tag == "form"
        if tag == "body":
            pop_to(1)
            stack.append([tag, frozenset(), False, frozenset()])
    flush()
    return [_unframed(block, path) if path and any(e[2] for e in path) else block for block, path in held]


def _unframed(block: Block, path: list) -> Block:
    """The block without the features of forms that frame the page."""
    return Block(block.text, frozenset().union(*(e[1] for e in path if not e[2])), block.linked, block.tag)
