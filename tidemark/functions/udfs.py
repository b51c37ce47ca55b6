"""Functions without a built-in form, as Arrow-batched pandas UDFs."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from difflib import SequenceMatcher
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalars as S


@lru_cache(maxsize=65536)
def char_width(c: str) -> int:
    """2 for wide, full-width and ambiguous characters, else 1."""
    return 2 if unicodedata.east_asian_width(c) in "WFA" else 1


def text_width(text: str) -> int:
    return sum(map(char_width, text))


def truncated(text: str, most: int) -> str:
    """The text, or its longest prefix that leaves room for three dots."""
    if text_width(text) <= most:
        return text
    room, end = most - 3, 0
    for c in text:
        room -= char_width(c)
        if room < 0:
            break
        end += 1
    return text[:end] + "..."


_TOKEN = re.compile(S.DISPLAY_TOKEN)


def wrapped(text: str, most: int) -> str:
    """Greedy lines of at most ``most`` columns; words stay whole, a longer one stands alone, no line begins with a blank.

    A line ends where the running width of all tokens passes the line's start by more
    than ``most``.
    """
    tokens = _TOKEN.findall(text)
    ends = list(accumulate(map(text_width, tokens), initial=0))
    lines: list[str] = []
    at, carried = 0, False  # whether a token that didn't fit begins the line
    while at < len(tokens):
        stop = bisect_right(ends, ends[at] + most) - 1
        if stop == at and not carried:
            lines.append(tokens[at])
            at += 1
            continue
        stop = max(stop, at + 1)
        lines.append("".join(tokens[at:stop]).rstrip())
        carried = stop < len(tokens) and not tokens[stop].isspace()
        at = stop if carried else stop + 1
    return "\n".join(lines)


def _each(function):
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(function, na_action="ignore")

    return run


def width(text: Column | str) -> Column:
    return F.pandas_udf(_each(text_width), "int")(text)


def truncate_width(text: Column | str, most: int = 18) -> Column:
    return F.pandas_udf(_each(lambda t: truncated(t, most)), "string")(text)


def wrap_width(text: Column | str, most: int = 40) -> Column:
    return F.pandas_udf(_each(lambda t: wrapped(t, most)), "string")(text)


_SEPARATORS = re.compile(r"[\s\-_/\\.,，。·]+")


def ratio(left: str | None, right: str | None) -> float:
    """Share of matching blocks of the normalised texts; 0 if either is empty as it came."""
    if not left or not right:
        return 0.0
    a, b = (_SEPARATORS.sub("", t.strip().lower()) for t in (left, right))
    return SequenceMatcher(None, a, b).ratio()


def similarity(left: Column | str, right: Column | str) -> Column:
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([ratio(x, y) for x, y in zip(a.where(a.notna(), None), b.where(b.notna(), None), strict=True)], dtype="float64")

    return run(left, right)


def emoji_tokens(text: Column | str, names: Column | str) -> Column:
    """The text cut at emoji names, which are tokens themselves; the first listed name that fits wins."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series, keys: pd.Series) -> pd.Series:
        out = []
        for t, k in zip(texts, keys, strict=True):
            known = [] if k is None else list(k)
            cut = re.split("(" + "|".join(map(re.escape, known)) + ")", t or "") if known else [t or ""]
            out.append([x for x in cut if x])
        return pd.Series(out)

    return run(text, names)


def not_a_knot(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cubic spline whose third derivative is continuous at the second and last but one knots (n > 3).

    The end conditions give the outer second derivatives from the inner ones, so the
    system is tridiagonal and solved in linear time.
    """
    n, h = len(x), np.diff(x)
    slope = np.diff(y) / h
    low, mid, up, want = h[:-1].copy(), 2 * (h[:-1] + h[1:]), h[1:].copy(), 6 * np.diff(slope)
    a, b = h[0] / h[1], h[-1] / h[-2]
    mid[0] += h[0] * (1 + a)
    up[0] -= h[0] * a
    mid[-1] += h[-1] * (1 + b)
    low[-1] -= h[-1] * b
    for k in range(1, n - 2):
        share = low[k] / mid[k - 1]
        mid[k] -= share * up[k - 1]
        want[k] -= share * want[k - 1]
    m = np.zeros(n)
    m[n - 2] = want[-1] / mid[-1]
    for k in range(n - 4, -1, -1):
        m[k + 1] = (want[k] - up[k] * m[k + 2]) / mid[k]
    m[0], m[-1] = m[1] + a * (m[1] - m[2]), m[-2] + b * (m[-2] - m[-3])
    i = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    d = at - x[i]
    return y[i] + d * (slope[i] - h[i] * (2 * m[i] + m[i + 1]) / 6) + d**2 * m[i] / 2 + d**3 * (m[i + 1] - m[i]) / (6 * h[i])


def resample(series: DataFrame, key: str, t: str, v: str, points: int = 300, ticks: int = 5) -> DataFrame:
    """key, t, v, tick: each series as a smooth curve; raw points where there are three or fewer, none for one.

    ``series`` must be cleaned (strictly increasing t).  A series is one viewing window,
    so its points fit one task.
    """

    def curve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(t)
        x, y = pdf[t].to_numpy(np.float64), pdf[v].to_numpy(np.float64)
        if len(x) < 2:
            return pd.DataFrame({key: [], t: [], v: [], "tick": []})
        at, out = x, y
        if len(x) > 3:
            at = np.linspace(x[0], x[-1], points)
            out = not_a_knot(x - x[0], y, at - x[0])
            if not np.isfinite(out).all():
                at, out = x, y
        marks = np.unique(np.linspace(0, len(at) - 1, ticks).round().astype(int))
        return pd.DataFrame({key: pdf[key].iloc[0], t: at, v: out, "tick": np.isin(np.arange(len(at)), marks)})

    kind = series.schema[key].dataType.simpleString()
    return series.select(key, t, v).groupBy(key).applyInPandas(curve, f"{key} {kind}, {t} double, {v} double, tick boolean")


