"""Suffix arrays by two-stage sorting, adjacent common prefixes, and window anchors, in numpy."""

from __future__ import annotations

import numpy as np

U = np.uint64


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor (type B). The last one isn't: the empty suffix is smaller."""
    n = len(text)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1].astype(np.int16))
    step[-1:] = -1
    change = np.where(step != 0, np.arange(n), n)
    nxt = np.minimum.accumulate(change[::-1])[::-1]
    return step[nxt] > 0


def _names(text: np.ndarray, is_b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Ranks of the substrings from each type-B position to the next one, by characters and, where those are equal, types."""
    ends = np.append(at[1:], len(text) - 1)
    code = np.append(text.astype(np.uint64) * U(2) + is_b + U(1), np.zeros(8, np.uint64))  # 0: past the end
    size, ranks, todo, offset = ends - at + 1, np.zeros(len(at), np.int64), np.arange(len(at)), 0
    while len(todo):
        word = np.zeros(len(todo), np.uint64)
        for i in range(6):
            where = at[todo] + offset + i
            word = word * U(1024) + np.where(offset + i < size[todo], code[np.minimum(where, len(text))], U(0))
        if offset == 0:
            _, ranks = np.unique(word, return_inverse=True)
        else:  # the longer ones, behind the shorter ones that are equal so far
            order = np.lexsort((word, ranks[todo]))
            key_a, key_b = ranks[todo][order], word[order]
            fresh = np.concatenate([[True], (key_a[1:] != key_a[:-1]) | (key_b[1:] != key_b[:-1])])
            sub = np.empty(len(todo), np.int64)
            sub[order] = np.cumsum(fresh)
            full = np.zeros(len(at), np.int64)
            full[todo] = sub
            order = np.lexsort((full, ranks))
            fresh = np.concatenate([[True], (np.diff(ranks[order]) != 0) | (np.diff(full[order]) != 0)])
            again = np.empty(len(at), np.int64)
            again[order] = np.cumsum(fresh) - 1
            ranks = again
        offset += 6
        todo = todo[size[todo] > offset]
    return ranks


def sort_b(text: np.ndarray, is_b: np.ndarray, depth: int) -> np.ndarray:
    """The type-B suffixes, sorted directly by at least their first ``depth`` bytes: ranks of runs of 1, 2, 4, ... substrings."""
    at = np.flatnonzero(is_b)
    if not len(at):
        return at
    ranks, k = _names(text, is_b, at), 1
    far = np.append(at, np.full(1, len(text) + depth))
    while True:
        reach = far[np.minimum(np.arange(len(at)) + k, len(at))] - at
        if ranks.max() == len(at) - 1 or reach.min() >= depth:
            return at[np.argsort(ranks, kind="stable")]
        after = np.zeros(len(at), np.int64)
        after[:-k] = ranks[k:] + 1
        _, ranks = np.unique(ranks * (len(at) + 1) + after, return_inverse=True)
        k *= 2


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes, in order by at least their first ``depth`` bytes.

    Only suffixes smaller than their successors are sorted; a scan over the buckets in order induces the others: each suffix,
    as it is passed, puts its predecessor, if that is larger, next in the bucket of its first byte.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    is_b = smaller_than_next(text)
    b = sort_b(text, is_b, depth)
    b_starts = np.searchsorted(text[b], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []

    def induce(suffixes: np.ndarray) -> None:
        before = suffixes[suffixes > 0] - 1
        before = before[~is_b[before]]
        first = text[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        cuts = np.flatnonzero(np.diff(first)) + 1
        for part in np.split(before, cuts) if len(before) else []:
            induced[text[part[0]]].append(part)

    induce(np.array([n]))
    for c in range(256):
        done = 0
        while done < len(induced[c]):
            out.append(induced[c][done])
            done += 1
            induce(out[-1])
        own = b[b_starts[c] : b_starts[c + 1]]
        if len(own):
            out.append(own)
            induce(own)
        induced[c] = []
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Common prefix length of each suffix of ``order`` with the one before it, exact up to ``most`` (longer ones are at least
    ``most``). A suffix whose neighbour is the successor of its predecessor's neighbour has one byte less in common than those,
    if they have any."""
    n = len(text)
    before = np.full(n + 1, -2, np.int64)
    before[order[1:]] = order[:-1]
    at = np.flatnonzero(before[:n] >= 0)
    tied = np.zeros(n + 1, bool)
    tied[at] = (at > 0) & (before[at - 1] >= 0) & (before[at] == before[at - 1] + 1) & (text[at - 1] == text[before[at - 1]])
    heads = at[~tied[at]]
    head_of = np.maximum.accumulate(np.where(~tied[:n], np.arange(n), 0))
    reach = int((at - head_of[at]).max(initial=0)) + most
    padded = np.concatenate([text, np.zeros(16, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    lcp = np.zeros(n + 1, np.int64)
    live = heads
    for offset in range(0, reach + 8, 8):
        if not len(live):
            break
        x, y = live + offset, before[live] + offset
        inside = (x < n) & (y < n)
        live, x, y = live[inside], x[inside], y[inside]
        differs = np.bitwise_xor(np.ascontiguousarray(words[x]).view(np.uint64)[:, 0], np.ascontiguousarray(words[y]).view(np.uint64)[:, 0])
        low = differs & (~differs + U(1))
        lcp[live] = np.minimum(offset + np.where(differs == 0, 8, np.bitwise_count(low - U(1)).astype(np.int64) // 8), n - np.maximum(live, before[live]))
        live = live[differs == 0]
    own = np.zeros(n + 1, np.int64)
    own[at] = np.maximum(lcp[head_of[at]] - (at - head_of[at]), 0)
    out = own[order]
    out[:1] = 0
    return out


def repeated_windows(texts: list[bytes], width: int) -> list[np.ndarray]:
    """For each text, which of its starts of ``width`` bytes have an equal string at another start, in it or another text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    text = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.cumsum(sizes) - sizes
    valid = np.zeros(len(text) + 1, np.int64)
    counts = np.maximum(sizes - width + 1, 0)
    np.add.at(valid, starts, (counts > 0).astype(np.int64))
    np.add.at(valid, starts + counts, -(counts > 0).astype(np.int64))
    ok = np.cumsum(valid)[:-1] > 0
    del valid
    order = suffix_array(text, width)
    order = order[ok[order]]
    equal = common_prefixes(text, order, width) >= width
    hit = np.zeros(len(text), bool)
    hit[order[equal]] = True
    hit[order[:-1][equal[1:]]] = True
    return [hit[s : s + c] for s, c in zip(starts.tolist(), counts.tolist(), strict=True)]


GRAM = 32
_TABLE = np.random.default_rng(20240501).integers(1 << 63, size=256, dtype=np.uint64)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position on."""
    h, size = _TABLE[data], 1
    for odd in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD):
        h = (h[:-size] * U(odd)) ^ (h[size:] + (h[size:] >> U(29)))
        size *= 2
    h = (h ^ (h >> U(31))) * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(29))


def window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbouring values."""
    n = len(values) - width + 1
    blocks = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[: len(values)] = values
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


#: Most window starts in a run.
RUN = 2048


def anchored(data: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of window starts that share the hash of their anchor, the leftmost smallest gram in the window: first start, last
    start, the gram's hash, and whether the anchor moves inside the run (so that its windows may repeat there, as in text with
    a period). Equal windows have equal hashes. Runs have at most RUN starts, counted from where the hash was new."""
    if len(data) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    h = gram_hashes(data)
    packed = (h >> U(24) << U(24)) | np.arange(len(h), dtype=np.uint64)
    at = (window_minimum(packed, width - GRAM + 1) & U((1 << 24) - 1)).astype(np.int64)
    steps = np.flatnonzero(np.diff(at)) + 1
    new = np.concatenate([[0], steps[h[at[steps]] != h[at[steps - 1]]]])
    starts = np.arange(len(at))
    head = np.repeat(new, np.diff(np.append(new, len(at))))
    first = starts[(starts - head) % RUN == 0]
    last = np.append(first[1:] - 1, len(at) - 1)
    return first, last, h[at[first]], at[first] != at[last]
