"""Compare rows of two frames without regard to order."""

from __future__ import annotations

import pandas as pd


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(x):
        if hasattr(x, "__len__") and not isinstance(x, str):
            return str(list(x))
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
            return None
        return f"{x:.9g}" if isinstance(x, float) else str(x)

    df = df[sorted(df.columns)]
    return sorted((tuple(plain(x) for x in r) for r in df.itertuples(index=False)), key=str)
