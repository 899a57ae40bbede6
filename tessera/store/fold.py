"""Folds a snapshot into Parquet. Rows that no later commit changes are sealed: written once, then linked from fold to fold.

A table's folder holds at most one part `live`, of rows that may still change and are written anew by each fold
that changes any, and sealed parts, named by their level. MERGE parts of one level become one of the next, so that a
row is written again a logarithmic number of times, and a table has few parts however long its history.
"""

from __future__ import annotations

import os
import shutil
import uuid
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import states as S
from tessera.store.schemas import TABLES, schema
from tessera.store.snapshot import APPEND_ONLY, LIVE, Snapshot

#: Sealed parts of one level that are merged; bytes of a file, about.
MERGE, FILE_BYTES = 8, 128 << 20


def fold(now: Snapshot, base: str) -> dict[str, int]:
    """Writes the tables to a new folder that stands for itself; rows by table."""
    return {name: _table(now, name, Path(base) / name) for name in TABLES}


def _table(now: Snapshot, name: str, root: Path) -> int:
    root.mkdir(parents=True)
    old = now.parts(name)
    if not now.changed(name):
        parts = old
    else:
        sealed, live = split(now, name)
        parts = [p for p in old if p.name != LIVE]
        parts += [] if sealed is None else _written(sealed, root / _label(0), 1)
        parts += [] if live is None else _written(live, root / LIVE, _files([p for p in old if p.name == LIVE]))
        level = 0
        while len(same := [p for p in parts if p.name.startswith(_label(level, ""))]) >= MERGE:
            rows = now.spark.read.schema(schema(name)).parquet(*map(str, same))
            merged = _written(rows, root / _label(level + 1), _files(same), TABLES[name][1][0])
            for part in same:
                if part.parent == root:
                    shutil.rmtree(part)
            parts = [p for p in parts if p not in same] + merged
            level += 1
    for part in parts:
        if part.parent != root:
            _link(part, root / part.name)
    return sum(_rows(root / p.name) for p in parts)


def split(now: Snapshot, name: str) -> tuple[DataFrame | None, DataFrame | None]:
    """Rows to seal and rows that may change; None where there can be none."""
    if name in APPEND_ONLY:
        return now.here(name), None
    live = now.table(name, live=True)
    if name == "jobs":  # no job of the last fold's live part has ended but by a change
        ended = F.col("state").isin(*S.TERMINAL)
        return now.here(name).where(ended), live.where(~ended)
    if name == "claim_receipts":  # an extension changes the receipt of the lease that a job is under
        keys = list(TABLES[name][1])
        held = now.table("jobs", live=True).where(F.col("state") == S.LEASED).select("job_id", F.col("updated_transaction_id").alias("transaction_id"))
        return live.join(held, keys, "left_anti").select(*live.columns), live.join(held, keys, "left_semi").select(*live.columns)
    return None, live


def _label(level: int, own: str | None = None) -> str:
    return f"{level:02d}-{uuid.uuid4().hex if own is None else own}"


def _written(rows: DataFrame, part: Path, files: int, key: str | None = None) -> list[Path]:
    """The part, or nothing if there are no rows. Merged parts get Bloom filters of their key, for look-ups of single rows."""
    blooms = {f"parquet.bloom.filter.enabled#{key}": "true", "parquet.bloom.filter.adaptive.enabled": "true"} if key else {}
    rows.coalesce(files).write.options(**blooms).parquet(str(part))
    if _rows(part):
        return [part]
    shutil.rmtree(part)
    return []


def _files(parts: list[Path]) -> int:
    return max(1, sum(f.stat().st_size for p in parts for f in p.glob("*.parquet")) // FILE_BYTES)


def _rows(part: Path) -> int:
    """From the files' footers."""
    import pyarrow.parquet as pq

    return sum(pq.read_metadata(f).num_rows for f in part.glob("*.parquet"))


def _link(part: Path, to: Path) -> None:
    """FileNotFoundError if the part is gone, as when two newer folds have been made meanwhile."""
    to.mkdir()
    for file in part.iterdir():
        os.link(file, to / file.name)
