"""Vectorised word and shingle hashing over Arrow string buffers.

Texts stay in the UTF-8 buffer that Arrow hands over; words are byte spans of
it. All functions take a slice of whole texts, never a part of one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
SHINGLE_WORDS = 5

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MASK64 = (1 << 64) - 1
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"): ord("Z") + 1] += 32
# Words of letters, digits and everything outside ASCII, as the licence rules read them.
_NOT_ALNUM = np.zeros(256, bool)
_NOT_ALNUM[:128] = [not (chr(i).isdigit() or chr(i).isalpha()) for i in range(128)]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power_table(n: int, name: str, base: np.uint64) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) <= n:
        size = max(n + 1, SLICE_BYTES + 1)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if size <= 2 * SLICE_BYTES:
            _powers[name] = have
    return have


def slices(texts: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets into bytes) of runs of whole texts of about ``limit`` bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64)[texts.offset: texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        yield at, end, raw[offs[at]: offs[end]], offs[at: end + 1] - offs[at]
        at = end


def spans(raw: np.ndarray, offs: np.ndarray, breaks: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, words per text) of the maximal runs of bytes outside ``breaks``."""
    gap = breaks[raw]
    before = np.ones(len(raw), bool)
    before[1:] = gap[:-1]
    after = np.ones(len(raw), bool)
    after[:-1] = gap[1:]
    heads = offs[:-1][offs[:-1] < len(raw)]
    before[heads] = True
    after[heads[heads > 0] - 1] = True
    start = np.flatnonzero(~gap & before)
    end = np.flatnonzero(~gap & after) + 1
    return start, end, np.diff(np.searchsorted(start, offs))


def alnum_spans(raw: np.ndarray, offs: np.ndarray):
    return spans(raw, offs, _NOT_ALNUM)


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z in lower case, nothing else changed."""
    return _LOWER[raw]


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span: a polynomial from prefix sums, finalised."""
    n = len(raw)
    power = _power_table(n, "up", _BASE)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
    down = _power_table(n, "down", _BASE_INVERSE)
    return mix((total[end] - total[start]) * down[start] ^ (end - start).astype(np.uint64))


def shingles(raw: np.ndarray, offs: np.ndarray, words: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, words per text) of every run of ``words`` words, repeats included.

    A text with fewer words gives its whole sequence as one; one without words gives none.
    """
    low = lowered(raw)
    start, end, counts = spans(low, offs)
    word = span_hashes(low, start, end)
    first = np.concatenate([[0], np.cumsum(counts)])
    owner = np.repeat(np.arange(len(counts)), counts)
    k = np.arange(len(word)) - first[owner]
    full = np.flatnonzero(k <= counts[owner] - words)
    keys = mix(np.arange(1, words + 1, dtype=np.uint64) * _BASE) | np.uint64(1)
    hashes = np.zeros(len(full), np.uint64)
    for j in range(words):
        hashes += word[full + j] * keys[j]
    short = np.flatnonzero((counts > 0) & (counts < words))
    tail = np.zeros(len(short), np.uint64)
    for j in range(words - 1):
        has = counts[short] > j
        tail[has] += word[first[short[has]] + j] * keys[j]
    tail += counts[short].astype(np.uint64)
    hashes = mix(np.concatenate([hashes, tail]))
    owners = np.concatenate([owner[full], short])
    return hashes, owners, counts


def shingle_sets(raw: np.ndarray, offs: np.ndarray, words: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, words per text), distinct and sorted by text and hash."""
    hashes, owners, counts = shingles(raw, offs, words)
    order = np.lexsort((hashes, owners))
    hashes, owners = hashes[order], owners[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])
    return hashes[new], owners[new], counts
