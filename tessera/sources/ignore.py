"""Ignore files compiled to regular expressions over relative paths."""

from __future__ import annotations

import re


def compile_rules(text: str, base: str = "") -> list[tuple[re.Pattern, bool, bool]]:
    """Rules of one ignore file in order: pattern over paths relative to the root, negated, directories only.

    `base` is the directory of the file, empty or ending in a slash.
    """
    out = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        rule = line[1:] if negated else line
        rule = rule[1:] if rule.startswith(("\\#", "\\!")) else rule
        directory = rule.endswith("/")
        rule = rule.rstrip("/")
        anchored = "/" in rule
        body = _translate(rule.lstrip("/"))
        prefix = re.escape(base) + ("" if anchored else "(?:.*/)?")
        out.append((re.compile(prefix + body + r"\Z"), negated, directory))
    return out


def _translate(rule: str) -> str:
    out, i = [], 0
    while i < len(rule):
        if rule.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif rule.startswith("/**", i) and i + 3 == len(rule):
            out.append("/.*")
            i += 3
        elif rule.startswith("**", i):
            out.append(".*")
            i += 2
        elif rule[i] == "*":
            out.append("[^/]*")
            i += 1
        elif rule[i] == "?":
            out.append("[^/]")
            i += 1
        elif rule[i] == "[" and "]" in rule[i + 2 :]:
            end = rule.index("]", i + 2)
            inside = rule[i + 1 : end]
            out.append("[" + ("^" + inside[1:] if inside[0] in "!^" else inside).replace("\\", "\\\\") + "]")
            i = end + 1
        elif rule[i] == "\\" and i + 1 < len(rule):
            out.append(re.escape(rule[i + 1]))
            i += 2
        else:
            out.append(re.escape(rule[i]))
            i += 1
    return "".join(out)


def ignored(path: str, is_dir: bool, rules: list[tuple[re.Pattern, bool, bool]]) -> bool:
    """Whether the last rule that matches a path ignores it."""
    for pattern, negated, directory in reversed(rules):
        if (is_dir or not directory) and pattern.match(path):
            return not negated
    return False
