"""Column functions over text: tokens, sizes, languages, ranges, query routing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that the term index leaves out.
STOP_WORDS = ("if", "else", "for", "while", "return", "true", "false", "nil", "none")
# Words that make a query a question.
QUESTION_WORDS = ("what", "how", "why", "where", "when", "which")
# File extensions and the language that each stands for.
LANGUAGES = {
    "rs": "rust",
    "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript",
    "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript",
    "py": "python", "pyw": "python",
    "go": "go",
    "java": "java",
    "c": "c",
    "h": "cpp", "hpp": "cpp", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "c++": "cpp",
    "html": "html", "htm": "html",
    "css": "css", "scss": "css", "sass": "css", "less": "css",
    "json": "json",
    "toml": "toml",
    "md": "markdown", "markdown": "markdown",
}


def octets(text: Column) -> Column:
    """Bytes of a text in UTF-8."""
    return F.octet_length(text)


def estimate_tokens(text: Column) -> Column:
    """A quarter of the bytes, rounded up."""
    return F.ceil(octets(text) / F.lit(4.0)).cast("long")


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, stop words left out, in order."""
    parts = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda t: (t != "") & ~t.isin(*STOP_WORDS))


def language_of(path: Column) -> Column:
    """Language by extension, whatever its case; `unknown` for others."""
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, extension), F.lit("unknown"))


def analyze_query(query: Column, strict_words: bool = False) -> Column:
    """`hybrid` for questions and for long queries with more than identifiers, else `lexical`.

    A question word counts inside other words too, unless `strict_words`.
    """
    words = "|".join(QUESTION_WORDS)
    question = F.lower(query).rlike(rf"\b(?:{words})\b" if strict_words else words)
    phrase = (octets(query) > 20) & ~query.rlike(r"^[\p{IsAlphabetic}\p{N}_:]*$")
    return F.when(question | phrase, F.lit("hybrid")).otherwise(F.lit("lexical"))


def trim(text: Column) -> Column:
    """Trim every Unicode white space, not only blanks."""
    return F.regexp_replace(text, r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$", "")


def is_fragment(line: Column) -> Column:
    """Lines that the term index keeps: not blank, no `//` or `#` comment."""
    plain = trim(line)
    return (plain != "") & ~plain.startswith("//") & ~plain.startswith("#")


def strip_self(name: Column) -> Column:
    """A callee without leading `self::`, however often."""
    return F.regexp_replace(name, "^(self::)+", "")


def contains_byte(start: Column, end: Column, at: Column) -> Column:
    """Whether a half-open range holds a byte."""
    return (start <= at) & (at < end)


def contains_range(start: Column, end: Column, inner_start: Column, inner_end: Column) -> Column:
    """Whether a range holds another."""
    return (start <= inner_start) & (inner_end <= end)


def overlaps(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """Whether two half-open ranges share a byte."""
    return (start < other_end) & (other_start < end)


def line_count(start_line: Column, end_line: Column) -> Column:
    """Lines of an inclusive range."""
    return end_line - start_line + 1


def compact(text: str, max_tokens: int) -> str | None:
    """A text within a budget: itself if it fits, else cut at its last line end (or character) that leaves room for a
    note of how many lines are left out. The note counts; None if not even the note fits. Sizes are bytes of UTF-8."""
    raw = text.encode("utf-8", "surrogatepass")
    limit = 4 * max_tokens
    if len(raw) <= limit:
        return text
    note = lambda n: f"...\n[{n} more lines]".encode()
    room = limit - len(note(raw.count(b"\n")))
    if room < 0:
        return None
    at = raw.rfind(b"\n", 0, room)
    at = at + 1 if at >= 0 else room
    while at and at < len(raw) and raw[at] & 0xC0 == 0x80:
        at -= 1
    return (raw[:at] + note(raw.count(b"\n", at))).decode("utf-8", "surrogatepass")
