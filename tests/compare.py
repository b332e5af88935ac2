"""Order-free comparison of results by value."""

import numpy as np
import pandas as pd


def _plain(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (float, np.floating)):
        return None if np.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, np.integer):
        return int(v)
    if isinstance(v, (list, tuple, np.ndarray)):
        return repr([_plain(x) for x in v])
    return v


def rows(df: pd.DataFrame) -> list[tuple]:
    return sorted((tuple(map(_plain, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None)), key=repr)


def same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    assert sorted(a.columns) == sorted(b.columns)
    x, y = rows(a), rows(b)
    assert len(x) == len(y)
    assert x == y
