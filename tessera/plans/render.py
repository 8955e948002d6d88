"""Texts of results: JSON lines, compact, full, and the context of the server."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FORMATS = ("json", "jsonl", "compact", "full")


def attributed(fragments: DataFrame, files: DataFrame) -> list[dict]:
    """Fragments of one plan with their paths, in order: at most the budget's number of symbols."""
    rows = fragments.join(F.broadcast(files.select("file_id", "path").join(fragments.select("file_id").distinct(), "file_id", "left_semi")), "file_id")
    return [r.asDict() for r in rows.orderBy("position").collect()]


def fragments_json(fragments: DataFrame, files: DataFrame) -> DataFrame:
    """One JSON object a row: file, lines, symbol, content. Distributed, for plans of many queries."""
    lines = F.concat_ws("-", "start_line", "end_line")
    rows = fragments.join(files.select("file_id", F.col("path").alias("file")), "file_id")
    return rows.select(F.to_json(F.struct("file", lines.alias("lines"), F.col("name").alias("symbol"), "content")).alias("value"))


def render(rows: list[dict], kind: str, query: str, budget: int = 0) -> str:
    """Rows of `attributed` as text."""
    if kind not in FORMATS:
        raise ValueError(f"format must be one of {', '.join(FORMATS)}")
    objects = [{"file": r["path"], "lines": f"{r['start_line']}-{r['end_line']}", "symbol": r["name"], "content": r["content"]} for r in rows]
    if kind == "json":
        return json.dumps(objects, ensure_ascii=False)
    if kind == "jsonl":
        return "\n".join(json.dumps(o, ensure_ascii=False) for o in objects)
    if not rows:
        return f"No results found for: {query}"
    if kind == "full":
        return "\n".join(f"=== {o['file']}:{o['lines']}\n{o['symbol']}\n{o['content']}" for o in objects)
    out = []
    for path, own in by_file(rows):
        spans = ",".join(f"{r['start_line']}-{r['end_line']}" for r in own)
        names = ", ".join(json.dumps(r["name"], ensure_ascii=False) for r in own if r["name"])
        out.append(f"{path}:{spans} [{names}]")
    return "\n".join([*out, "", f"Tokens: {sum(r['token_count'] for r in rows)}", f"Files: {len({r['path'] for r in rows})}", f"Symbols: {len(rows)}"])


def context(rows: list[dict], budget: int) -> str:
    """Context text: a header with tokens of the budget, then the files with their fragments."""
    out = [f"Context: {sum(r['token_count'] for r in rows)}/{budget} tokens, {len(rows)} fragments"]
    for path, own in by_file(rows):
        out.append(f"\n## {path}")
        out += [f"[{r['start_line']}-{r['end_line']}] {r['content'].strip()}" for r in own]
    return "\n".join(out)


def by_file(rows: Iterable[dict]) -> list[tuple[str, list[dict]]]:
    """Rows grouped by path, groups in the order of their first row."""
    groups: dict[str, list[dict]] = {}
    for r in rows:
        groups.setdefault(r["path"], []).append(r)
    return list(groups.items())
