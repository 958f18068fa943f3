"""Frame functions for TRANSFORM stages: pandas in, pandas out."""

from __future__ import annotations

import pandas as pd


def spread(frame: pd.DataFrame) -> pd.DataFrame:
    return (frame.max(numeric_only=True) - frame.min(numeric_only=True)).to_frame().T


def mean(frame: pd.DataFrame) -> pd.DataFrame:
    return frame.mean(numeric_only=True).to_frame().T


def skew(frame: pd.DataFrame) -> pd.DataFrame:
    return frame.skew(numeric_only=True).to_frame().T


def distinct(frame: pd.DataFrame) -> pd.DataFrame:
    return frame.drop_duplicates()


def bottom(n: int, column: str):
    return lambda frame: frame.nsmallest(n, column)


def head(n: int):
    return lambda frame: frame.head(n)


def keep(columns: list[str]):
    return lambda frame: frame[columns]


def where(expression: str):
    return lambda frame: frame.query(expression)


def sort(column: str):
    return lambda frame: frame.sort_values(column)
