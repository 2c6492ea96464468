"""Rows of two engines as comparable values."""

from __future__ import annotations

import pandas as pd


def rows(df: pd.DataFrame) -> list[str]:
    columns = sorted(df.columns)
    plain = df[columns].astype(object).where(df[columns].notna(), None)
    return sorted(map(repr, plain.itertuples(index=False, name=None)))
