"""Likeness of two texts by the blocks that they share."""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _block_ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    matcher, out, last = SequenceMatcher(), [], None
    for x, y in zip(a, b, strict=True):
        if x is None or y is None:
            out.append(None)
            continue
        if y != last:  # what is known of the second text serves the pairs that follow it
            matcher.set_seq2(y)
            last = y
        matcher.set_seq1(x)
        out.append(matcher.ratio())
    return pd.Series(out, dtype="float64")


def block_ratio(a: Column, b: Column) -> Column:
    """Twice the characters of the longest block that both texts share, and of those to its left and right in turn, over both lengths; null for a null.

    The search for blocks within what others leave goes as deep as the texts, which no expression of columns does: it
    runs on batches of pairs. Give it distinct pairs.
    """
    return F.pandas_udf(_block_ratios, DoubleType())(a, b)


#: Characters are counted by so many remainders of their code points; characters that share one only raise a bound.
COLUMNS = 128


def _counts(texts: list[str]) -> np.ndarray:
    """How many characters of each remainder each text has."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32) % COLUMNS
    rows = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    return np.bincount(rows * COLUMNS + flat, minlength=len(texts) * COLUMNS).reshape(-1, COLUMNS).astype(np.int32)


def _in_order(a: str, b: str, places: dict[str, int]) -> int:
    """The most characters that both texts have in the same order; places has a bit for each place of a character in the first text."""
    free, all_ = (1 << len(a)) - 1, (1 << len(a)) - 1
    for ch in b:
        met = free & places.get(ch, 0)
        free = (free + met | free - met) & all_
    return len(a) - free.bit_count()


def closest(texts: list[str], others: list[str], k: int, allowed: Callable[[int, str], bool]) -> list[tuple[int, str, float]]:
    """(place of the text, other, ratio): for each text the k allowed others of the greatest ratio as block_ratio has it, equal ones from the end of the alphabet.

    Blocks that two texts share can't have more characters than the texts have in common, in any order, nor than they have in the same order. Others
    are compared from the greatest such bound down, and none is that, at its bound, would come after the k found.
    """
    if not texts or not others:
        return []
    others = sorted(set(others), reverse=True)
    theirs, lengths = _counts(others), np.array([len(o) for o in others])
    varied = (theirs != theirs[0]).any(axis=0)
    alike, theirs = theirs[0, ~varied], np.ascontiguousarray(theirs[:, varied].T)
    matcher, out = SequenceMatcher(), []
    for i, (text, own) in enumerate(zip(texts, _counts(texts), strict=True)):
        shared = np.full(len(others), np.minimum(alike, own[~varied]).sum())
        for column, n in zip(theirs, own[varied].tolist(), strict=True):
            if n:
                shared += np.minimum(column, n)
        total = lengths + len(text)
        bounds = np.where(total > 0, 2.0 * shared / np.maximum(total, 1), 1.0)
        places: dict[str, int] = {}
        for at, ch in enumerate(text):
            places[ch] = places.get(ch, 0) | 1 << at
        best: list[tuple[float, str]] = []
        for bound in np.unique(bounds)[::-1].tolist():
            if len(best) == k and bound < best[-1][0]:
                break
            for j in np.flatnonzero(bounds == bound).tolist():
                other = others[j]
                if len(best) == k and (bound, other) < best[-1]:
                    break
                if len(best) == k and (2.0 * _in_order(text, other, places) / total[j], other) < best[-1]:
                    continue
                if allowed(i, other):
                    matcher.set_seqs(text, other)
                    best = sorted([*best, (matcher.ratio(), other)], reverse=True)[:k]
        out += [(i, other, ratio) for ratio, other in best]
    return out
