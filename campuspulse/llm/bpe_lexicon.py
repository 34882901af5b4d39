"""A byte-level BPE vocabulary compiled into one memory-mapped image.

The image holds the merges, the bytes of every token, a character class table and a
lexicon: a minimal acyclic automaton over frequent words. Suffixes are shared, and
each transition adds to an output, so that a word's outputs sum to its slot in the table of token ids.
A state's transitions are a 256-bit map and the number of its first edge; a step is two gathers and a bit count.
"""

from __future__ import annotations

import hashlib
import json
import os

import numpy as np
import regex
from pyspark import SparkFiles

_NO_RANK = np.int32(2**31 - 1)
SPACE, LETTER, NUMBER, OTHER = range(4)


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file, by rule: printable
    Latin-1 characters stand for themselves, the other bytes are numbered from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def char_classes() -> np.ndarray:
    """Class of each code point: white space, letter, number or other."""
    table = np.full(0x110000, OTHER, np.uint8)
    step = 0x800  # in parts, as every worker makes this table; the surrogates are one part
    for first in range(0, 0x110000, step):
        if first == 0xD800:
            continue
        part = "".join(map(chr, range(first, first + step)))
        for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
            for m in regex.finditer(f"{pattern}+", part):
                table[first + m.start(): first + m.end()] = kind
    table[0x1C:0x20] = OTHER  # separators that only some engines count as blanks
    return table


# --- the automaton ------------------------------------------------------------------


def minimal_automaton(words: list[bytes]) -> list[tuple[bool, tuple[tuple[int, int], ...]]]:
    """States (final, ((byte, target), …)) of the minimal automaton of sorted distinct words; the last is the start."""
    states: list = []
    known: dict = {}

    def freeze(node) -> int:
        key = (node[0], tuple(node[1]))
        if key not in known:
            known[key] = len(states)
            states.append(key)
        return known[key]

    path = [[False, []]]  # nodes of the last word, not frozen yet
    last = b""
    for word in words:
        shared = 0
        while shared < len(last) and shared < len(word) and last[shared] == word[shared]:
            shared += 1
        for depth in range(len(last), shared, -1):
            path[depth - 1][1].append((last[depth - 1], freeze(path[depth])))
        path[shared + 1:] = [[False, []] for _ in word[shared:]]
        path[-1][0] = True
        last = word
    for depth in range(len(last), 0, -1):
        path[depth - 1][1].append((last[depth - 1], freeze(path[depth])))
    states.append((path[0][0], tuple(path[0][1])))
    return states


def packed_automaton(words: list[bytes]) -> dict[str, np.ndarray]:
    states = minimal_automaton(words)
    below = []  # accepted words from each state; targets are always frozen before their sources
    bits = np.zeros((len(states), 4), np.uint64)
    first = np.zeros(len(states), np.int64)
    target, output = [], []
    for s, (final, edges) in enumerate(states):
        first[s] = len(target)
        seen = int(final)
        for byte, to in edges:
            bits[s, byte >> 6] |= np.uint64(1 << (byte & 63))
            target.append(to)
            output.append(seen)
            seen += below[to]
        below.append(seen)
    before = np.cumsum(np.bitwise_count(bits), axis=1) - np.bitwise_count(bits)
    return {
        "bits": bits.ravel(), "before": before.astype(np.int64).ravel(), "first": first, "target": np.array(target, np.int32),
        "output": np.array(output, np.int32), "final": np.array([f for f, _ in states], np.uint8),
    }


# --- the image ---------------------------------------------------------------------------


def _write_image(path: str, arrays: dict[str, np.ndarray]) -> None:
    head, at, body = {}, 0, []
    for name, a in arrays.items():
        pad = -at % 64
        body.append(b"\0" * pad)
        at += pad
        head[name] = [at, a.dtype.str, len(a)]
        body.append(a.tobytes())
        at += a.nbytes
    text = json.dumps(head).encode()
    with open(path, "wb") as f:
        f.write(len(text).to_bytes(8, "little") + text + b"\0" * (-(8 + len(text)) % 64))
        f.write(b"".join(body))


class Lexicon:
    """Arrays of an image, mapped from its file."""

    def __init__(self, path: str):
        data = np.memmap(path, np.uint8, "r")
        size = int.from_bytes(data[:8].tobytes(), "little")
        head = json.loads(data[8: 8 + size].tobytes())
        base = -(-(8 + size) // 64) * 64
        for name, (at, kind, n) in head.items():
            kind = np.dtype(kind)
            setattr(self, name, np.asarray(data[base + at: base + at + n * kind.itemsize]).view(kind))
        self.special = [(self.special_bytes[a:b].tobytes(), int(i)) for a, b, i in
                        zip(self.special_offs[:-1], self.special_offs[1:], self.special_ids)]

    def slots(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Slot of each word of ``raw``, -1 for words not in the lexicon."""
        slot = np.full(len(start), -1, np.int64)
        at, live = start.copy(), np.arange(len(start))
        state = np.full(len(start), len(self.first) - 1, np.int64)
        total = np.zeros(len(start), np.int64)
        while len(live):
            done = at == end[live]
            hit = done & (self.final[state] > 0)
            slot[live[hit]] = total[hit]
            go = ~done
            at, live, state, total = at[go], live[go], state[go], total[go]
            byte = raw[at]
            cell = state * 4 + (byte >> 6)
            shift = (byte & 63).astype(np.uint64)
            row = self.bits[cell]
            go = (row >> shift) & np.uint64(1) > 0
            low = np.bitwise_count(row & ((np.uint64(1) << shift) - np.uint64(1)))
            edge = (self.first[state] + self.before[cell] + low)[go]
            at, live, total = at[go] + 1, live[go], total[go] + self.output[edge]
            state = self.target[edge].astype(np.int64)
        return slot

    def merged(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(token ids of all words one after another, ids per word) by exact merging, all words at a time.

        In every round each word merges its leftmost pair of the lowest rank.
        """
        lengths = end - start
        word = np.repeat(np.arange(len(start)), lengths)
        symbol = self.byte_ids[raw[ragged(start, lengths)]].astype(np.int64)
        done_word, done_symbol = [], []
        rank, made = self._pairs(symbol[:-1], symbol[1:])
        same = word[:-1] == word[1:]
        rank = np.append(np.where(same, rank, _NO_RANK), _NO_RANK)[: len(symbol)]
        made = np.append(made, 0)[: len(symbol)]
        while len(symbol):
            heads = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, heads)
            sizes = np.diff(np.append(heads, len(word)))
            spread = np.repeat(best, sizes)
            finished = spread == _NO_RANK
            if finished.any():
                done_word.append(word[finished])
                done_symbol.append(symbol[finished])
                left = ~finished
                word, symbol, rank, made, spread = word[left], symbol[left], rank[left], made[left], spread[left]
                if not len(symbol):
                    break
            pick = np.flatnonzero(rank == spread)
            pick = pick[np.append(True, word[pick[1:]] != word[pick[:-1]])]
            symbol[pick] = made[pick]
            keep = np.ones(len(symbol), bool)
            keep[pick + 1] = False
            # The merged symbol takes over the pair of the one that goes.
            place = np.cumsum(keep)[pick] - 1
            symbol, word, rank, made = symbol[keep], word[keep], rank[keep], made[keep]
            for left in (place, place - 1):
                left = left[(left >= 0) & (left < len(symbol))]
                right = np.minimum(left + 1, len(symbol) - 1)
                r, m = self._pairs(symbol[left], symbol[right])
                ok = (word[left] == word[right]) & (right > left)
                rank[left], made[left] = np.where(ok, r, _NO_RANK), m
        if not done_word:
            return np.zeros(0, np.int32), np.zeros(len(start), np.int64)
        word, symbol = np.concatenate(done_word), np.concatenate(done_symbol)
        order = np.argsort(word, kind="stable")
        return symbol[order].astype(np.int32), np.bincount(word, minlength=len(start))

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged id) of symbol pairs; no merge gives the rank ``_NO_RANK``."""
        if not len(self.pair_keys):
            return np.full(len(left), _NO_RANK), np.zeros(len(left), np.int64)
        key = left * np.int64(len(self.token_offs)) + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        hit = self.pair_keys[at] == key
        return np.where(hit, self.pair_ranks[at], _NO_RANK), self.pair_made[at].astype(np.int64)


def ragged(start: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start[i] … start[i] + lengths[i] - 1 of all i, one after another."""
    shift = start - np.concatenate([[0], np.cumsum(lengths)[:-1]])
    return np.repeat(shift, lengths) + np.arange(int(lengths.sum()))


def _ragged_bytes(items: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    offs = np.concatenate([[0], np.cumsum([len(x) for x in items], dtype=np.int64)]).astype(np.int64)
    return np.frombuffer(b"".join(items), np.uint8), offs


def vocabulary_arrays(path: str) -> dict[str, np.ndarray]:
    """Arrays of a byte-level BPE file in the tokenizers library's JSON format."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, added = spec["model"]["vocab"], spec["added_tokens"]
    symbols = byte_symbols()
    size = 1 + max([*vocab.values(), *(t["id"] for t in added)])
    tokens = [b""] * size
    for token, i in vocab.items():
        tokens[i] = bytes(symbols[c] for c in token)
    for t in added:
        tokens[t["id"]] = t["content"].encode()
    keys, ranks, made = [], [], []
    for rank, pair in enumerate(spec["model"]["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        keys.append(vocab[a] * (size + 1) + vocab[b])
        ranks.append(rank)
        made.append(vocab[a + b])
    order = np.argsort(np.array(keys, np.int64))
    token_bytes, token_offs = _ragged_bytes(tokens)
    # Longer special strings are found first where one begins another.
    special = sorted(added, key=lambda t: -len(t["content"]))
    special_bytes, special_offs = _ragged_bytes([t["content"].encode() for t in special])
    return {
        "byte_ids": np.array([vocab[c] for c, _ in sorted(symbols.items(), key=lambda x: x[1])], np.int32),
        "pair_keys": np.array(keys, np.int64)[order], "pair_ranks": np.array(ranks, np.int32)[order], "pair_made": np.array(made, np.int32)[order],
        "token_bytes": token_bytes, "token_offs": token_offs, "classes": char_classes(),
        "special_bytes": special_bytes, "special_offs": special_offs, "special_ids": np.array([t["id"] for t in special], np.int32),
    }


def compile_image(vocabulary: str, words: list[bytes]) -> str:
    """Write the image into Spark's folder of files for executors; returns its name, which tells its content."""
    words = sorted(set(words) - {b""})
    arrays = vocabulary_arrays(vocabulary) | packed_automaton([])
    arrays |= {"slot_ids": np.zeros(0, np.int32), "slot_offs": np.zeros(1, np.int64)}
    mark = hashlib.sha256(b"".join(a.tobytes() for a in arrays.values()) + b"\0".join(words)).hexdigest()[:24]
    name = f"lexicon-{mark}.bin"
    path = os.path.join(SparkFiles.getRootDirectory(), name)
    if not os.path.exists(path):
        plain = f"{path}.plain"
        _write_image(plain, arrays)
        raw, offs = _ragged_bytes(words)
        ids, counts = Lexicon(plain).merged(raw, offs[:-1], offs[1:])
        arrays |= packed_automaton(words)
        arrays |= {"slot_ids": ids, "slot_offs": np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)}
        _write_image(plain, arrays)
        os.replace(plain, path)
    return name


_open: dict[str, Lexicon] = {}


def lexicon(name: str) -> Lexicon:
    """The image as this process maps it."""
    if name not in _open:
        _open.clear()
        _open[name] = Lexicon(SparkFiles.get(name))
    return _open[name]
