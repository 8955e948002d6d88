"""The change feed of a source tree: snapshots are compared, changes are appended to a log, a stream applies the log.

Spark's file source reports new paths only; modified and deleted files would be missed, hence the log."""

from __future__ import annotations

import json
import os
import time
import uuid
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from tessera.plans.engine import CodeIndex
from tessera.sources.files import walk

SCHEMA = "seq long, op string, path string, text string"


class ChangePoller:
    """Remembers size, time and a hash of each file of a local tree, and logs what has changed since the last poll.

    With `known` (path to text) the first poll reports changes against these files, else against the tree as it is now.
    """

    def __init__(self, root: str, log: str, known: dict[str, str] | None = None):
        self.root, self.log = root, Path(log)
        self.log.mkdir(parents=True, exist_ok=True)
        self.seq = time.time_ns()
        self.seen = self._snapshot() if known is None else {p: hash(t) for p, t in known.items()}

    def _snapshot(self) -> dict[str, int]:
        out = {}
        for path, _, _ in walk(self.root):
            text = self._text(path)
            if text is not None:
                out[path] = hash(text)
        return out

    def _text(self, path: str) -> str | None:
        try:
            return Path(self.root, path).read_bytes().decode("utf-8", "replace")
        except OSError:
            return None

    def poll(self) -> int:
        """Append the changes since the last poll to the log as one file, and return their number."""
        now = self._snapshot()
        rows = [("deleted", p, None) for p in self.seen.keys() - now.keys()]
        rows += [("created" if p not in self.seen else "modified", p, self._text(p)) for p, h in now.items() if self.seen.get(p) != h]
        if rows:
            name = f"{self.seq:020d}-{uuid.uuid4().hex}.json"
            with open(self.log / f".{name}", "w", encoding="utf-8") as out:
                for op, path, text in sorted(rows, key=lambda r: r[1]):
                    self.seq += 1
                    out.write(json.dumps({"seq": self.seq, "op": op, "path": path, "text": text}) + "\n")
            os.rename(self.log / f".{name}", self.log / name)
        self.seen = now
        return len(rows)


def stream(spark: SparkSession, index: CodeIndex, log: str, checkpoint: str, available_now: bool = False, interval: str = "250 milliseconds") -> StreamingQuery:
    """Apply a change log to an index as it grows (`available_now`: what is there, then end). A batch that is replayed
    after a failure applies the same last states again."""
    changes = spark.readStream.schema(SCHEMA).json(log)
    writer = changes.writeStream.foreachBatch(index.on_change()).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()
