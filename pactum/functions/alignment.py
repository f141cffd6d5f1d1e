"""The stretch of a text that is most like a quote, for many quotes at once.

A window's score is 2 * LCS / (its length + the quote's). Windows are as long as the quote, or shorter at the text's ends. Runs of
letters that a window of a sufficient score must share with the quote name the few windows that are looked at: shared q-grams
are counted by diagonal, and a window needs a number of them near its own. LCS lengths of all windows of a batch are then
worked out together, a machine word of the quote at a time."""

from __future__ import annotations

import numpy as np

#: Letters of a run; cells of the table of letters of the windows that are worked out together.
GRAM, CELLS = 5, 1 << 22
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _grams(codes: np.ndarray) -> np.ndarray:
    n = max(0, len(codes) - GRAM + 1)
    out = np.zeros(n, np.uint64)
    for k in range(GRAM):
        out = out * _BASE + codes[k : k + n].astype(np.uint64)
    return out


def _diagonals(quote: np.ndarray, text: np.ndarray) -> np.ndarray:
    """counts[d + m]: shared q-grams of the quote's place i and the text's i + d."""
    m, n = len(quote), len(text)
    known, asked = _grams(quote), _grams(text)
    counts = np.zeros(m + n + 1, np.int64)
    if len(known) and len(asked):
        order = np.argsort(known, kind="stable")
        low, high = (np.searchsorted(known[order], asked, side) for side in ("left", "right"))
        times = high - low
        place = np.repeat(np.arange(len(asked)), times)
        own = order[np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
        counts += np.bincount(place - own + m, minlength=m + n + 1)
    return counts


def windows(quote: np.ndarray, text: np.ndarray, least: float) -> np.ndarray:
    """Starts, below 0 for windows that begin before the text, of all windows that may score `least` or more."""
    m, n = len(quote), len(text)
    starts = np.arange(-m + 1, n)
    width = np.minimum(starts + m, n) - np.maximum(starts, 0)
    common = np.ceil(least * (m + width) / 2 - 1e-9).astype(np.int64)
    starts, width, common = (x[common <= width] for x in (starts, width, common))
    # unmatched letters part the matched ones into runs, each of which keeps all but its last few q-grams
    need = common - (GRAM - 1) * (m + width - 2 * common + 1)
    total = np.concatenate([[0], np.cumsum(_diagonals(quote, text))])
    drift = m - common
    low, high = np.maximum(starts - drift + m, 0), np.minimum(starts + drift + m + 1, len(total) - 1)
    return starts[(need <= 0) | (total[np.maximum(high, low)] - total[low] >= need)]


def _common(patterns: list[np.ndarray], letters: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """LCS lengths of each row of letters (padded with -1) and the pattern that owner names; patterns have as many words each."""
    words = max(1, -(-max(len(p) for p in patterns) // 64))
    masks, first, alphabets = [], [], []
    for p in patterns:
        own, at = np.unique(p, return_inverse=True)
        table = np.zeros((len(own) + 1, words), np.uint64)
        place = np.arange(len(p))
        np.bitwise_or.at(table, (at, place // 64), np.uint64(1) << (place % 64).astype(np.uint64))
        first.append(sum(map(len, masks)))
        masks.append(table)
        alphabets.append(own)
    table, rows = np.concatenate(masks), np.empty(letters.shape, np.int64)
    for k, own in enumerate(alphabets):
        mine = np.flatnonzero(owner == k)
        at = np.minimum(np.searchsorted(own, letters[mine]), len(own) - 1)
        rows[mine] = first[k] + np.where(own[at] == letters[mine], at, len(own))
    v = np.full((words, len(letters)), ~np.uint64(0))
    for j in range(letters.shape[1]):
        mask, carry = table[rows[:, j]], np.zeros(len(letters), np.uint64)
        for w in range(words):
            u = v[w] & mask[:, w]
            part = v[w] + u
            total = part + carry
            carry = ((part < u) | (total < part)).astype(np.uint64)
            v[w] = total | (v[w] & ~u)
    zeros = np.bitwise_count(~v).sum(0).astype(np.int64)
    # bits above a pattern's length are never cleared, and carries out of it only leave the table
    return zeros


def best_windows(pairs: list[tuple[str, str]], least: float) -> list[tuple[float, int, int] | None]:
    """(score, start, end in the text) of each (quote, text), the first of the best, or None if no window scores `least`. A text
    shorter than its quote is compared with the quote's windows and found as a whole."""
    out: list[tuple[float, int, int] | None] = [None] * len(pairs)
    jobs: dict[int, list] = {}
    for k, (quote, text) in enumerate(pairs):
        a, b = _codes(quote), _codes(text)
        short, long = (a, b) if len(a) <= len(b) else (b, a)
        if len(short):
            starts = windows(short, long, least)
            if len(starts):
                jobs.setdefault(-(-len(short) // 64), []).append((k, short, long, starts, len(a) > len(b)))
    for same in jobs.values():
        most = max(len(j[1]) for j in same)
        while same:
            batch, rows = [], 0
            while same and (not batch or (rows + len(same[-1][3])) * most <= CELLS):
                batch.append(same.pop())
                rows += len(batch[-1][3])
            letters = np.full((rows, most), -1, np.int64)
            owner, at = np.repeat(np.arange(len(batch)), [len(j[3]) for j in batch]), 0
            for _, short, long, starts, _ in batch:
                place = starts[:, None] + np.arange(len(short))
                inside = (place >= 0) & (place < len(long))
                letters[at : at + len(starts), : len(short)] = np.where(inside, long[np.clip(place, 0, len(long) - 1)].astype(np.int64), -1)
                at += len(starts)
            common, at = _common([j[1].astype(np.int64) for j in batch], letters, owner), 0
            for k, short, long, starts, swapped in batch:
                begin, end = np.maximum(starts, 0), np.minimum(starts + len(short), len(long))
                scores = 2 * common[at : at + len(starts)] / (len(short) + end - begin)
                at += len(starts)
                best = int(scores.argmax())
                if scores[best] >= least - 1e-12:
                    out[k] = (float(scores[best]), 0, len(short)) if swapped else (float(scores[best]), int(begin[best]), int(end[best]))
    return out
