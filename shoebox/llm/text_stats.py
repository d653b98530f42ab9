"""Exact counts of a text's words, lines and repeats, for a group of texts at once."""

from __future__ import annotations

import numpy as np

from .kernels import U, Words, mix, sums

_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True



def base_counts(buf: np.ndarray, offs: np.ndarray, words: Words, window: int = 8) -> dict[str, np.ndarray]:
    """Per text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    lead = words.inside & ((buf & 0xC0) != 0x80)
    out = {"n_words": words.count, "word_chars": sums(lead, offs), "n_symbols": sums(_SYMBOL[buf], offs)}
    out["n_dup_lines"] = duplicate_lines(buf, offs)
    out["n_repeat_words"] = repeated_words(words, window)
    return out


def duplicate_lines(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Lines (split at newlines) with a word that equal an earlier line of the same text; compared byte by byte."""
    out = np.zeros(len(offs) - 1, np.int64)
    newlines = np.searchsorted(np.flatnonzero(buf == 10), offs)
    for i in np.flatnonzero(np.diff(newlines)).tolist():
        lines = [x for x in buf[offs[i] : offs[i + 1]].tobytes().split(b"\n") if x.strip()]
        out[i] = len(lines) - len(set(lines))
    return out


def repeated_words(words: Words, k: int) -> np.ndarray:
    """Words inside windows of k words that occur twice or more in the same text. Windows are compared by 64-bit
    fingerprints: in a text of n words two different ones agree with a probability below n * n / 2**65."""
    texts = len(words.count)
    h, fits = words.windows(k)
    at = np.flatnonzero(fits)
    if not len(at):
        return np.zeros(texts, np.int64)
    key = h[at] ^ mix(words.text[at].astype(U))
    order = np.argsort(key)
    equal = key[order[1:]] == key[order[:-1]]
    again = np.zeros(len(at), bool)
    again[order[1:]] |= equal
    again[order[:-1]] |= equal
    return np.bincount(words.text[covered(at[again], k, len(words))], minlength=texts)


def covered(at: np.ndarray, k: int, n: int) -> np.ndarray:
    """Positions below n inside a span of k from one of ``at`` on."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + k, -1)
    return np.flatnonzero(np.cumsum(change[:n]) > 0)
