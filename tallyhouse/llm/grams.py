"""Counts of hashed byte trigrams of texts, for the text classifiers."""

from __future__ import annotations

import numpy as np

FEATURES = 1 << 15
_LETTERS = np.full(256, 32, np.uint8)
for _b in range(256):
    if chr(_b).isalpha() and _b < 128 or _b >= 128:
        _LETTERS[_b] = _b
_PLAIN = np.arange(256, dtype=np.uint8)


def features(text: str | None, letters_only: bool) -> np.ndarray:
    """Feature numbers of a text's byte trigrams; with ``letters_only`` lower-cased, other bytes as blanks, runs of blanks as one."""
    if not text:
        return np.zeros(0, np.int64)
    if letters_only:
        raw = _LETTERS[np.frombuffer((" " + text.lower() + " ").encode(), np.uint8)]
        blank = raw == 32
        raw = raw[~(blank & np.concatenate(([False], blank[:-1])))]
    else:
        raw = np.frombuffer(text.encode(), np.uint8)
    if len(raw) < 3 or (letters_only and len(raw) == 3 and raw[1] == 32):
        return np.zeros(0, np.int64)
    raw = raw.astype(np.uint32)
    key = (raw[:-2] << np.uint32(16)) | (raw[1:-1] << np.uint32(8)) | raw[2:]
    return ((key * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)


def log_shares(counts: np.ndarray, smooth: float = 0.5) -> np.ndarray:
    """Smoothed log shares of each row's features."""
    total = counts.sum(axis=1, keepdims=True) + smooth * counts.shape[1]
    return np.log((counts + smooth) / total).astype(np.float32)
