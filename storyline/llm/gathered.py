"""Runs of token ids in one flat array, and texts put together from them without a step per token."""

from __future__ import annotations

import numpy as np

#: Mask of a run's length in its place.
LENGTH = (1 << 32) - 1


class Runs:
    """Runs of values, each known by its place: start << 32 | length."""

    def __init__(self, kind: str = "<u4") -> None:
        self._flat, self._used = np.zeros(1 << 16, kind), 0

    def append(self, values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Keeps values; the places of the runs of these lengths."""
        if self._used + len(values) > len(self._flat):
            self._flat = np.concatenate([self._flat[: self._used], np.zeros(max(len(values), self._used), self._flat.dtype)])
        self._flat[self._used : self._used + len(values)] = values
        starts = self._used + np.cumsum(lengths) - lengths
        self._used += len(values)
        return starts << 32 | lengths

    def gather(self, places: np.ndarray) -> np.ndarray:
        """The runs at ``places``, one after another."""
        lengths = places & LENGTH
        before = np.cumsum(lengths) - lengths
        return self._flat[np.repeat((places >> 32) - before, lengths) + np.arange(int(lengths.sum()))]


def ends_of(places: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Where each text's values end, when it consists of ``counts`` of the runs at ``places``."""
    return np.r_[0, np.cumsum(places & LENGTH)][np.cumsum(counts)]
