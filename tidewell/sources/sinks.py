"""Pool, provenance and summary files, each committed atomically, the summary last.

Spark writes the ordered parts; the driver streams them into one file beside the target, syncs it and renames it. A
failed run never replaces a file that has content.
"""

from __future__ import annotations

import os
import tempfile
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame

from tidewell.operators.merge import pool_order
from tidewell.operators.summary import provenance


@dataclass(frozen=True)
class ArtifactPaths:
    pool: Path
    provenance: Path
    summary: Path

    @classmethod
    def from_output(cls, output: str) -> ArtifactPaths:
        """``<stem>.jsonl`` and ``<stem>.summary.json`` beside the output; a name that would be the output itself is
        built on the full name."""
        out = Path(output)
        stem = out.stem if out.name else "proxies"
        side = {kind: out.with_name(f"{stem}{end}") for kind, end in (("provenance", ".jsonl"), ("summary", ".summary.json"))}
        if out in side.values():
            side = {kind: out.with_name(f"{out.name}.{end}") for kind, end in (("provenance", "provenance.jsonl"), ("summary", "summary.json"))}
        return cls(out, side["provenance"], side["summary"])


def has_contents(path: Path) -> bool:
    return path.is_file() and path.stat().st_size > 0


def write_atomic(path: Path, lines) -> int:
    """A temporary file in the same folder, synced, renamed over the target; removed on failure."""
    fd, temp = tempfile.mkstemp(dir=path.parent or ".", prefix=f".{path.name}.")
    n = 0
    try:
        with os.fdopen(fd, "w", encoding="utf-8", newline="\n") as f:
            for line in lines:
                f.write(f"{line}\n")
                n += 1
            f.flush()
            os.fsync(f.fileno())
        os.replace(temp, path)
    except BaseException:
        Path(temp).unlink(missing_ok=True)
        raise
    folder = os.open(path.parent or ".", os.O_RDONLY)
    try:
        os.fsync(folder)
    finally:
        os.close(folder)
    return n


def write_artifacts(pool: DataFrame, summary: DataFrame, outcome: str, output: str, started_at: int, failed_summary: str | None = None) -> ArtifactPaths:
    """Pool and provenance in pool order, then the summary; rows stream through the driver a partition at a time."""
    paths = ArtifactPaths.from_output(output)
    ordered = pool_order(pool)
    try:
        for path, rows in ((paths.pool, ordered.select("url")), (paths.provenance, provenance(ordered, started_at))):
            if outcome == "failed" and has_contents(path):  # S16: the last good one stays
                continue
            write_atomic(path, (r[0] for r in rows.toLocalIterator()))
    except Exception:
        if failed_summary is not None:
            write_atomic(paths.summary, [failed_summary])
        raise
    write_atomic(paths.summary, (r[0] for r in summary.toLocalIterator()))
    return paths


def write_pool(pool: DataFrame, path: str) -> None:
    """S12 at scale: the ordered pool as part files with a success marker."""
    pool_order(pool).select("url").write.mode("overwrite").text(path)


def write_provenance(pool: DataFrame, path: str, started_at: int) -> None:
    provenance(pool_order(pool), started_at).write.mode("overwrite").text(path)
