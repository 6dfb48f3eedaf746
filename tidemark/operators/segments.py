"""Streaming over sorted partitions in frames that end where a key ends."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd


def whole_keys(frames: Iterable[pd.DataFrame], keys: list[str], rows: int = 100_000) -> Iterator[pd.DataFrame]:
    """Joins the batches of a partition sorted by `keys` into frames of about `rows` rows that cut no key in two.

    Memory is that of one frame plus the largest key; callers bound the rows of a key before they come here.
    """
    held: list[pd.DataFrame] = []
    n = 0
    for f in frames:
        if not len(f):
            continue
        held.append(f)
        n += len(f)
        if n < rows:
            continue
        whole = pd.concat(held, ignore_index=True)
        last = np.ones(len(whole), dtype=bool)
        for k in keys:
            last &= (whole[k] == whole[k].iloc[-1]).to_numpy()
        cut = len(whole) - int(last.sum())
        if cut:
            yield whole.iloc[:cut].reset_index(drop=True)
            whole = whole.iloc[cut:].reset_index(drop=True)
        held, n = [whole], len(whole)
    if held:
        yield pd.concat(held, ignore_index=True)


def starts(frame: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """True at the first row of each key of a sorted frame."""
    first = np.zeros(len(frame), dtype=bool)
    first[:1] = True
    for k in keys:
        v = frame[k].to_numpy()
        first[1:] |= v[1:] != v[:-1]
    return first
