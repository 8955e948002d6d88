"""Symbols and calls of one source file: a pure function that never raises.

Python is read by its own parser. Other languages are scanned: strings and comments are blanked at equal length, so that
offsets stay those of the bytes; declarations are found by patterns, their ends by matching braces, nesting by
containment. Ids are local to the file, in order of start; they become global when tables are built.
"""

from __future__ import annotations

import ast
import keyword
import re
from bisect import bisect_right
from dataclasses import dataclass


@dataclass
class Symbol:
    local_id: int
    name: str
    kind: str
    start: int
    end: int
    start_line: int
    end_line: int
    parent: int | None


@dataclass
class Call:
    caller: int | None
    callee: str
    start: int
    end: int
    start_line: int
    end_line: int


C_LIKE = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
STRINGS = r'"(?:\\.|[^"\\\n])*"?'
BLANKED = {
    "rust": rf"{C_LIKE}|b?r(#*)\".*?(?:\"\1|\Z)|b?\"(?:\\.|[^\"\\])*\"?|b?'(?:\\[^\n]{{1,8}}?|[^'\\\n])'",
    "javascript": rf"{C_LIKE}|{STRINGS}|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?",
    "go": rf"{C_LIKE}|{STRINGS}|`[^`]*`?|'(?:\\[^\n]{{1,8}}?|[^'\\\n])+'",
    "java": rf"{C_LIKE}|\"\"\".*?(?:\"\"\"|\Z)|{STRINGS}|'(?:\\[^\n]{{1,6}}?|[^'\\\n])'",
    "cpp": rf"{C_LIKE}|R\"(\w*)\(.*?(?:\)\1\"|\Z)|{STRINGS}|'(?:\\.|[^'\\\n])+'|^[ \t]*#(?:[^\n\\]|\\\n|\\.)*",
}
BLANKED["typescript"], BLANKED["c"] = BLANKED["javascript"], BLANKED["cpp"]
BLANKS = {language: re.compile(pattern, re.DOTALL | re.MULTILINE) for language, pattern in BLANKED.items()}

_TYPE_ARGS = r"(?:<[^;{}()]*?>)?"
#: Kind, pattern with the name as its last group, and whether a body in braces is needed (else a semicolon may end it).
DECLARATIONS: dict[str, list[tuple[str, str, bool]]] = {
    "rust": [
        ("Function", r"(?:\bpub(?:\([^)]*\))?\s+)?(?:(?:default|const|async|unsafe|extern(?:\s+\"?\s*\"?)?)\s+)*\bfn\s+(\w+)", True),
        ("Struct", r"(?:\bpub(?:\([^)]*\))?\s+)?\bstruct\s+(\w+)", False),
        ("Enum", r"(?:\bpub(?:\([^)]*\))?\s+)?\benum\s+(\w+)", True),
        ("Trait", r"(?:\bpub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?\btrait\s+(\w+)", True),
        ("Impl", r"(?:\bunsafe\s+)?\bimpl\b\s*(?:<[^{};]*?>\s*(?=[\w&(]))?(?:[^{};]*?\bfor\s+)?&?(?:'\w+\s+)?(?:mut\s+|dyn\s+)?(?:\w+::)*(\w+)", True),
        ("Constant", r"(?:\bpub(?:\([^)]*\))?\s+)?\bconst\s+(\w+)\s*:", False),
    ],
    "javascript": [
        ("Function", r"(?:\basync\s+)?\bfunction\b\s*\*?\s*([\w$]+)", True),
        ("Class", r"(?:\babstract\s+)?\bclass\s+([\w$]+)", True),
    ],
    "typescript": [
        ("Function", r"(?:\basync\s+)?\bfunction\b\s*\*?\s*([\w$]+)", True),
        ("Class", r"(?:\babstract\s+)?\bclass\s+([\w$]+)", True),
        ("Interface", r"\binterface\s+([\w$]+)", True),
        ("Type", r"\btype\s+([\w$]+)\s*(?:<[^=;]*>)?\s*=", False),
    ],
    "go": [
        ("Method", r"^func\s*\([^)]*\)\s*(\w+)", True),
        ("Function", r"^func\s+(\w+)", True),
        ("Struct", r"\btype\s+(\w+)\s*(?:\[[^\]]*\]\s*)?struct\b", True),
        ("Interface", r"\btype\s+(\w+)\s*(?:\[[^\]]*\]\s*)?interface\b", True),
        ("Type", r"\btype\s+(\w+)\s*(?:\[[^\]]*\]\s*)?=?\s*(?!struct\b|interface\b)[\w*\[(]", False),
    ],
    "java": [
        ("Class", r"(?:\b(?:public|protected|private|abstract|static|final|sealed|strictfp)\s+)*\b(?:class|record|enum)\s+(\w+)", True),
        ("Interface", r"(?:\b(?:public|protected|private|abstract|static|sealed)\s+)*(?<!@)\binterface\s+(\w+)", True),
        ("Method", rf"(?:\b(?:public|protected|private|static|final|abstract|synchronized|native|default)\s+)*(?:<[^>;{{}}]*>\s*)?\b(?!return\b|new\b|else\b|throw\b|case\b)[\w.]+{_TYPE_ARGS}(?:\s*\[\])*\s+(?!if\b|for\b|while\b|switch\b|catch\b)(\w+)\s*(?=\()", False),
        ("Field", rf"(?:\b(?:public|protected|private|static|final|volatile|transient)\s+)+[\w.]+{_TYPE_ARGS}(?:\s*\[\])*\s+(\w+)\s*(?=[=;,])", False),
    ],
    "cpp": [
        ("Struct", r"\bstruct\s+(\w+)\s*(?:final\s*)?(?::[^;{}()]*)?(?=\{)", True),
        ("Class", r"(?<!enum )\bclass\s+(\w+)\s*(?:final\s*)?(?::[^;{}()]*)?(?=\{)", True),
        ("Enum", r"\benum\s+(?:class\s+|struct\s+)?(\w+)\s*(?::[^;{}()]*)?(?=\{)", True),
        ("Function", rf"(?:^|(?<=[;}}{{\n]))[ \t]*(?:(?:static|inline|virtual|constexpr|explicit|extern|const|unsigned|signed|long|short|struct|enum)\s+)*(?!return\b|else\b|new\b|delete\b|throw\b|case\b|goto\b|using\b)[A-Za-z_][\w:]*{_TYPE_ARGS}[\s*&]+(?:\w+::)*(~?(?!if\b|for\b|while\b|switch\b|catch\b|return\b)[A-Za-z_]\w*)\s*(?=\([^;{{}}]*\)[^;{{}}()=]*\{{)", True),
    ],
}
DECLARATIONS["c"] = [d for d in DECLARATIONS["cpp"] if d[0] != "Class"]
PATTERNS = {language: [(kind, re.compile(pattern, re.MULTILINE), body) for kind, pattern, body in rows] for language, rows in DECLARATIONS.items()}
CALL = re.compile(r"(?<![\w$.:!@#])((?:[A-Za-z_$][\w$]*)(?:(?:\s*(?:\.|\?\.|::|->)\s*)[A-Za-z_$][\w$]*)*)\s*(?:::<[^()]*>)?\(")
#: Words before a parenthesis that call nothing.
KEYWORDS = frozenset(
    "if for while switch match return fn func function loop catch sizeof typeof instanceof in of and or not else do try with await yield new delete "
    "throw case super synchronized assert defer go select range let const var static struct enum class impl trait interface use where as mut pub move "
    "elif lambda except alignof decltype noexcept static_assert import export extends implements throws".split()
)


PYTHON_BLANKS = re.compile(r"#[^\n]*|\"\"\"(?:\\.|[^\\])*?(?:\"\"\"|\Z)|'''(?:\\.|[^\\])*?(?:'''|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?", re.DOTALL)
HEADER = re.compile(r"\s*(?:async\s+)?(def|class)\s+([^\W\d]\w*)")
PYTHON_KEYWORDS = frozenset(keyword.kwlist)


def scan(content: bytes, language: str) -> tuple[list[Symbol], list[Call]]:
    """Symbols and calls of a file; both empty for other languages, broken text and anything that cannot be read."""
    try:
        content.decode("utf-8")
        if language == "python":
            try:
                return _python(content)
            except (SyntaxError, ValueError):
                return _indented(content)
        if language in PATTERNS:
            return _braces(content, language)
    except (UnicodeDecodeError, SyntaxError, ValueError, RecursionError, MemoryError):
        pass
    return [], []


class _Lines:
    def __init__(self, content: bytes):
        self.starts = [0, *(m.end() for m in re.finditer(b"\n", content))]

    def of(self, offset: int) -> int:
        return bisect_right(self.starts, offset)


def _python(content: bytes) -> tuple[list[Symbol], list[Call]]:
    tree = ast.parse(content)
    lines = _Lines(content)
    symbols: list[Symbol] = []
    calls: list[Call] = []
    todo: list[tuple[ast.AST, int | None]] = [(tree, None)]
    place = lambda line, column: lines.starts[line - 1] + column
    while todo:
        node, parent = todo.pop()
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            kind = "Class" if isinstance(node, ast.ClassDef) else "Function"
            own = len(symbols)
            symbols.append(Symbol(own, node.name, kind, place(node.lineno, node.col_offset), place(node.end_lineno, node.end_col_offset), node.lineno, node.end_lineno, parent))
            parent = own
        elif isinstance(node, ast.Call) and isinstance(node.func, ast.Name | ast.Attribute):
            f = node.func
            callee = content[place(f.lineno, f.col_offset) : place(f.end_lineno, f.end_col_offset)].decode()
            calls.append(Call(parent, callee, place(node.lineno, node.col_offset), place(node.end_lineno, node.end_col_offset), node.lineno, node.end_lineno))
        todo += [(child, parent) for child in reversed(list(ast.iter_child_nodes(node)))]
    return symbols, calls


def _indented(content: bytes) -> tuple[list[Symbol], list[Call]]:
    """Symbols and calls of Python that its parser rejects (older, or half edited): headers, indentation, call marks."""
    code = PYTHON_BLANKS.sub(_blank, content.decode("latin-1"))
    lines = _Lines(content)
    rows: list[dict] = []
    names: set[int] = set()
    open_: list[int] = []
    last = 0
    for start, row in zip(lines.starts, code.split("\n"), strict=False):
        if not row.strip():
            continue
        indent = len(row) - len(row.lstrip())
        while open_ and rows[open_[-1]]["indent"] >= indent:
            rows[open_.pop()]["end"] = last
        header = HEADER.match(row)
        if header:
            names.add(start + header.start(2))
            kind = "Class" if header[1] == "class" else "Function"
            rows.append({"indent": indent, "name": header[2], "kind": kind, "start": start + indent, "end": 0, "parent": open_[-1] if open_ else None})
            open_.append(len(rows) - 1)
        last = start + len(row.rstrip())
    for at in open_:
        rows[at]["end"] = last
    symbols = [Symbol(i, r["name"].encode("latin-1").decode(), r["kind"], r["start"], r["end"], lines.of(r["start"]), lines.of(r["end"] - 1), r["parent"]) for i, r in enumerate(rows)]
    closes, calls = _pairs(code, "(", ")"), []
    for m in CALL.finditer(code):
        callee = re.sub(r"\s+", "", m[1])
        if m.start() in names or callee.split(".")[-1] in PYTHON_KEYWORDS:
            continue
        end = closes.get(m.end() - 1, m.end() - 1) + 1
        holder = next((s.local_id for s in reversed(symbols) if s.start <= m.start() < s.end), None)
        calls.append(Call(holder, callee.encode("latin-1").decode(), m.start(), end, lines.of(m.start()), lines.of(end - 1)))
    return symbols, calls


def _blank(match: re.Match) -> str:
    return re.sub(r"[^\n]", " ", match[0])


def _braces(content: bytes, language: str) -> tuple[list[Symbol], list[Call]]:
    code = BLANKS[language].sub(_blank, content.decode("latin-1"))
    lines = _Lines(content)
    closes = _pairs(code, "{", "}")
    found: dict[int, tuple[int, int, str, str, int]] = {}
    names: set[int] = set()
    for kind, pattern, needs_body in PATTERNS[language]:
        for m in pattern.finditer(code):
            name_at = m.start(m.lastindex)
            if name_at in found:
                continue
            end = _end(code, m.end(), closes, needs_body, language)
            if end is None:
                continue
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            found[name_at] = (start, end, m[m.lastindex], kind, name_at)
            names.add(name_at)
    rows = sorted(found.values(), key=lambda r: (r[0], -r[1]))
    symbols: list[Symbol] = []
    stack: list[Symbol] = []
    for start, end, name, kind, _ in rows:
        while stack and stack[-1].end < end:
            stack.pop()
        while stack and stack[-1].end <= start:
            stack.pop()
        if kind in ("Method", "Field") and language == "java" and not (stack and stack[-1].kind in ("Class", "Interface")):
            continue
        raw = content[start:end]
        symbol = Symbol(len(symbols), name.encode("latin-1").decode(), kind, start, end, lines.of(start), lines.of(start + max(0, len(raw) - 1)), stack[-1].local_id if stack else None)
        symbols.append(symbol)
        stack.append(symbol)
    if language in ("javascript", "typescript"):
        symbols = _js_methods(code, content, lines, closes, symbols)
    return symbols, _calls(code, content, lines, symbols, names)


def _js_methods(code: str, content: bytes, lines: _Lines, closes: dict[int, int], symbols: list[Symbol]) -> list[Symbol]:
    """Add the methods of classes, and number symbols anew in order of start."""
    method = re.compile(r"(?:^|(?<=[;{}]))\s*((?:(?:static|async|get|set|public|private|protected|readonly|override)\s+)*\*?\s*([\w$#]+)\s*)(?=\([^;{}]*\)[^;{}()=]*\{)", re.MULTILINE)
    rows = [(s.start, s.end, s.name, s.kind) for s in symbols]
    classes = [s for s in symbols if s.kind == "Class"]
    for m in method.finditer(code):
        owner = next((c for c in reversed(classes) if c.start < m.start(1) < c.end), None)
        if owner is None or m[2] in KEYWORDS or _depth(code, owner.start, m.start(1)) != 1:
            continue
        brace = code.find("{", code.find("(", m.end() - 1))
        if brace in closes:
            rows.append((m.start(1), closes[brace] + 1, m[2], "Method"))
    rows.sort(key=lambda r: (r[0], -r[1]))
    out: list[Symbol] = []
    stack: list[Symbol] = []
    for start, end, name, kind in rows:
        while stack and stack[-1].end <= start:
            stack.pop()
        out.append(Symbol(len(out), name, kind, start, end, lines.of(start), lines.of(end - 1), stack[-1].local_id if stack else None))
        stack.append(out[-1])
    return out


def _depth(code: str, start: int, at: int) -> int:
    return code.count("{", start, at) - code.count("}", start, at)


def _pairs(code: str, left: str, right: str) -> dict[int, int]:
    out, stack = {}, []
    for m in re.finditer(f"[{re.escape(left + right)}]", code):
        if m[0] == left:
            stack.append(m.start())
        elif stack:
            out[stack.pop()] = m.start()
    return out


def _end(code: str, at: int, closes: dict[int, int], needs_body: bool, language: str) -> int | None:
    """End of a declaration: its matching brace, or a semicolon where that may end it, or the line for Go types."""
    depth = 0
    for m in re.compile(r"[{};()\[\]\n]").finditer(code, at):
        c = m[0]
        if c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
            if depth < 0:
                return None
        elif depth:
            continue
        elif c == "{":
            close = closes.get(m.start())
            return None if close is None else close + 1
        elif c == ";":
            return None if needs_body else m.end()
        elif c == "}":
            return None
        elif c == "\n" and language == "go" and not needs_body:
            return m.start()
    return None


def _calls(code: str, content: bytes, lines: _Lines, symbols: list[Symbol], names: set[int]) -> list[Call]:
    closes = _pairs(code, "(", ")")
    starts = [s.start for s in symbols]
    declared = names | {s.start for s in symbols}
    out = []
    for m in CALL.finditer(code):
        callee = re.sub(r"\s+", "", m[1])
        last = re.split(r"\.|::|->", callee)[-1]
        before = code[max(0, m.start() - 12) : m.start()].rstrip()
        if callee in KEYWORDS or last in KEYWORDS or m.start() in declared or re.search(r"\b(?:new|fn|func|function|class|struct|enum)$", before):
            continue
        open_at = m.end() - 1
        end = closes.get(open_at, open_at) + 1
        caller = None
        for i in range(bisect_right(starts, m.start()) - 1, -1, -1):
            if symbols[i].end >= end and symbols[i].kind != "Field":
                caller = symbols[i]
                break
        if caller is not None and caller.name == callee and code.find("{", caller.start, m.start()) < 0:
            continue  # the parameters of the declaration itself
        out.append(Call(caller.local_id if caller else None, callee.encode("latin-1").decode(), m.start(), end, lines.of(m.start()), lines.of(end - 1)))
    return out
