"""Byte pair encoding of long unbroken pieces in windows, exactly.

Windows of WINDOW bytes, each beginning half a window after the one before, are encoded by
themselves and joined where two have a token in common (the same place and length).

Why that is exact: a sequence of tokens is the encoding of its bytes if and only if each pair of
neighbours is the encoding of the pair's bytes. (Merges inside a run of an encoding's tokens are, in
order, those of the run alone, as nothing merges across its ends; and the first merge across a boundary
in the whole would also be the first across it in the pair.) At a token that both windows have, every pair of
neighbours stands in one of the windows, so all pairs of the joined sequence are encodings.

Where two windows have no token in common, a window that begins at a boundary of the last one is
encoded; it is joined if it begins with the same token there, else the last one is encoded anew at
twice its length, to the end of the piece if need be.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

WINDOW = 64
#: Windows that are encoded at once.
BLOCK = 4096


def windows_of(piece: bytes, length: int = WINDOW) -> list[bytes]:
    half = length // 2
    return [piece[a : a + length] for a in range(0, max(1, len(piece) - half), half)]


def stitched(piece: bytes, encode: Callable[[list[bytes]], list[np.ndarray]], sizes: np.ndarray, length: int = WINDOW) -> np.ndarray:
    """The ids of a piece; ``encode`` gives the ids of each of some windows, ``sizes`` the bytes of each id."""
    n, half = len(piece), length // 2
    out: list[np.ndarray] = []
    block_at, block = 0, []

    def places(at: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        ends = at + np.cumsum(sizes[ids])
        return ends - sizes[ids], ids, int(ends[-1])

    def fixed(k: int) -> tuple[np.ndarray, np.ndarray, int]:
        nonlocal block_at, block
        if not block_at <= k < block_at + len(block):
            block_at, block = k, encode([piece[a : a + length] for a in range(k * half, min(max(1, n - half), (k + BLOCK) * half), half)])
        return places(k * half, block[k - block_at])

    k, at = 0, 0  # the ids of all bytes before ``at`` are out; ``now`` begins there
    now = fixed(0)
    while now[2] < n:
        k = max(k + 1, (now[2] - length) // half + 1)
        starts, ids, end = fixed(k)
        common = np.intersect1d(now[0] << 8 | np.minimum(sizes[now[1]], 255), starts << 8 | np.minimum(sizes[ids], 255))
        if len(common):
            cut, then = int(common[0]) >> 8, (starts, ids, end)
        else:
            cut, then = _on(piece, now, encode, sizes, length, places)
            if cut == at:  # encoded anew, at greater length
                now = then
                continue
        out.append(now[1][now[0] < cut])
        stays = then[0] >= cut
        now, at = (then[0][stays], then[1][stays], then[2]), cut
    return np.concatenate([*out, now[1]])


def _on(piece, now, encode, sizes, length, places) -> tuple[int, tuple[np.ndarray, np.ndarray, int]]:
    """(a boundary of ``now``, a window from there), or (its beginning, it at twice the length)."""
    starts, ids, end = now
    mid = len(ids) // 2
    if mid:
        cut = int(starts[mid])
        fresh = places(cut, encode([piece[cut : end + length]])[0])
        if sizes[fresh[1][0]] == sizes[ids[mid]]:
            return cut, fresh
    a = int(starts[0])
    return a, places(a, encode([piece[a : a + 2 * (end - a)]])[0])
