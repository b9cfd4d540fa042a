"""Windows of a fixed number of rows over numpy arrays, for code that sees a ticker's rows in blocks.

Missing values are NaN. ``values`` starts with ``before`` rows of history, fewer where the ticker begins, and results
are for the rows after them.
"""

from __future__ import annotations

import numpy as np


def windows(values: np.ndarray, n: int, before: int) -> np.ndarray:
    """One row of n values, the latest last, for each row after the history; NaN where there are none."""
    padded = np.concatenate([np.full(n - 1, np.nan), values])
    return np.lib.stride_tricks.sliding_window_view(padded, n)[before:]


def _full(w: np.ndarray, out: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(w).any(axis=1), np.nan, out)


def _spread(w: np.ndarray) -> np.ndarray:
    # equal values have none, whatever their mean was rounded to
    return np.where(w.max(axis=1) == w.min(axis=1), 0.0, w.std(axis=1, ddof=1)) if w.shape[1] > 1 else np.full(len(w), np.nan)


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.full(len(a), np.nan), where=b != 0)


def _rank(w: np.ndarray) -> np.ndarray:
    last, d = w[:, -1:], w.shape[1]
    return ((w < last).sum(axis=1) + ((w == last).sum(axis=1) - 1) / 2) / (d - 1) if d > 1 else np.full(len(w), np.nan)


#: Of a window in which all values are finite.
OF_WINDOW = {
    "ts_mean": lambda w: w.mean(axis=1),
    "sma": lambda w: w.mean(axis=1),
    "ts_std": _spread,
    "ts_zscore": lambda w: _ratio(w[:, -1] - w.mean(axis=1), _spread(w)),
    "ts_sum": lambda w: w.sum(axis=1),
    "product": lambda w: w.prod(axis=1),
    "ts_min": lambda w: w.min(axis=1),
    "ts_max": lambda w: w.max(axis=1),
    "ts_argmax": lambda w: w.argmax(axis=1) + 1.0,
    "ts_argmin": lambda w: w.argmin(axis=1) + 1.0,
    "ts_rank": _rank,
}


def _covariance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = a.shape[1]
    return ((a - a.mean(axis=1, keepdims=True)) * (b - b.mean(axis=1, keepdims=True))).sum(axis=1) / (n - 1) if n > 1 else np.full(len(a), np.nan)


def rolling(name: str, arrays: list[np.ndarray], n: int, *, before: int, seen: int = 0) -> np.ndarray:
    """An operator along a ticker for the rows after the history; ``seen`` rows came before the history."""
    if name in ("ts_delay", "ts_delta"):
        w = windows(arrays[0], n + 1, before)
        return w[:, 0] if name == "ts_delay" else w[:, -1] - w[:, 0]
    if name == "linear_decay":
        w = windows(np.nan_to_num(arrays[0], nan=0.0), n, before)
        number = seen + before + 1 + np.arange(len(w))
        return np.where(number >= n, np.nan_to_num(w) @ np.arange(1.0, n + 1) / (n * (n + 1) / 2), 0.0)
    observed = [windows(np.where(np.isfinite(a), a, np.nan), n, before) for a in arrays]
    with np.errstate(all="ignore"):
        if name in OF_WINDOW:
            return _full(observed[0], OF_WINDOW[name](observed[0]))
        a, b = observed
        out = _covariance(a, b)
        if name == "ts_correlation":
            out = _ratio(out, _spread(a) * _spread(b))
        return _full(a + b, out)


def depth(name: str, n: int) -> int:
    """How many rows of history an operator looks at."""
    return n if name in ("ts_delay", "ts_delta") else n - 1


NAMES = {*OF_WINDOW, "ts_delay", "ts_delta", "linear_decay", "ts_correlation", "ts_covariance"}
