"""Bin numbers and labels as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def edge_bin(c: Column, edges: Sequence[float], closed: str = "left") -> Column:
    """Index of the bin that holds ``c``; NULL outside the edges.

    ``closed="left"`` means ``[lo, hi)``, ``closed="right"`` means ``(lo, hi]``.
    """
    out = None
    for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
        inside = ((c >= lo) & (c < hi)) if closed == "left" else ((c > lo) & (c <= hi))
        out = F.when(inside, F.lit(i)) if out is None else out.when(inside, F.lit(i))
    return out


def bin_label(index: Column, labels: Sequence[str]) -> Column:
    out = None
    for i, text in enumerate(labels):
        out = F.when(index == i, F.lit(text)) if out is None else out.when(index == i, F.lit(text))
    return out


def linear_bin(c: Column, lo: float, hi: float, n_bins: int) -> Column:
    """Equal-width bin; the last one also holds ``hi``; NULL outside ``[lo, hi]``."""
    width = (hi - lo) / n_bins
    if width <= 0:
        return F.when(c == F.lit(lo), F.lit(0))
    raw = F.floor((c - F.lit(lo)) / F.lit(width)).cast("int")
    return F.when(c.between(lo, hi), F.least(raw, F.lit(n_bins - 1)))


def half_open_bin(c: Column, lo: float, hi: float, n_bins: int) -> Column:
    """Equal-width bin of ``[lo, hi)``; ``hi`` itself falls out."""
    width = (hi - lo) / n_bins
    return F.when((c >= lo) & (c < hi), F.least(F.floor((c - F.lit(lo)) / F.lit(width)).cast("int"), F.lit(n_bins - 1)))


def quantile_bin(c: Column, edges: Sequence[float]) -> Column:
    """Right-closed bin over quantile edges, the lowest value included in bin 0."""
    inner = edges[1:-1]
    total = F.lit(0)
    for e in inner:
        total = total + (c > F.lit(float(e))).cast("int")
    return total
