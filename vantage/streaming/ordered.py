"""A key's new rows in order, without all of them in memory."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa

HELD, PIECE = 1_000_000, 25_000  # most rows that are sorted at once, and rows of a frame


def in_order(frames: Iterable[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of frames sorted by columns, in frames of at most PIECE rows.

    Where there are more than HELD rows, sorted runs of about so many wait in temporary files, and only a piece of each run is held while they merge.
    """
    held, n, runs = [], 0, []

    def ordered() -> pd.DataFrame:
        return pd.concat(held).sort_values(by, kind="stable")

    def read(path: str) -> Iterator[pd.DataFrame]:
        with pa.OSFile(path) as f, pa.ipc.open_stream(f) as batches:
            for batch in batches:
                yield batch.to_pandas()

    with tempfile.TemporaryDirectory() as folder:

        def write() -> None:
            table = pa.Table.from_pandas(ordered(), preserve_index=False)
            path = os.path.join(folder, str(len(runs)))
            with pa.OSFile(path, "wb") as f, pa.ipc.new_stream(f, table.schema) as out:
                out.write_table(table, max_chunksize=PIECE)
            runs.append(read(path))

        for frame in frames:
            held.append(frame)
            n += len(frame)
            if n >= HELD:
                write()
                held, n = [], 0
        if runs and n:
            write()
        pool = _merged(runs, by) if runs else iter([ordered()] if n else [])
        for rows in pool:
            for at in range(0, len(rows), PIECE):
                yield rows.iloc[at : at + PIECE]


def _merged(runs: list[Iterator[pd.DataFrame]], by: list[str]) -> Iterator[pd.DataFrame]:
    """Rows go out up to the first that ends a piece; then the next piece of its run comes in."""

    def piece(k: int) -> list[pd.DataFrame]:
        rows = next(runs[k], None)
        return [] if rows is None else [rows.assign(__ends=[-1] * (len(rows) - 1) + [k])]

    pool = pd.concat([x for k in range(len(runs)) for x in piece(k)])
    while len(pool):
        pool = pool.sort_values(by, kind="stable")
        at = int((pool["__ends"].to_numpy() >= 0).argmax())
        k = int(pool["__ends"].iloc[at])
        if k < 0:  # no run has more
            at = len(pool) - 1
        yield pool.iloc[: at + 1].drop(columns="__ends")
        pool = pd.concat([pool.iloc[at + 1 :], *(piece(k) if k >= 0 else [])])
