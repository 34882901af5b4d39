"""Secret scan: fixed patterns, and further spans that a linear-chain conditional random field tags token by token.

Tokens are runs of letters, digits, ``_`` and characters outside ASCII; every other character but white space is a token of its own. The field gives
each token one of three tags, outside, begin or inside a secret. Its features are the token's shape, the shape and words of its neighbours, the unbroken
run it stands in, its line, and the share of signs and digits in the whole text. ``inside`` needs a tag of the same secret right before, without a
gap. Viterbi decoding works on whole texts: blocks of steps are multiplied in the max-plus sense and joined, and weights are integers, so that
sums are exact and a text's tags don't depend on what it is read with.

The field is trained here. Secrets have no labels, so they are planted: random values of many formats, in and out of assignments, besides look-alikes that are none
(addresses, numbers, identifiers, plain assignments), in texts of the corpus. What the fixed patterns find counts as secret as well. The sample is whole
documents of the smallest id hashes, at most ``TRAIN_DOCS`` and ``TRAIN_CHARS`` characters: that bounds what the driver gets. Tagging covers
every whole text where it is read, without a shuffle.

Base spans always stay; a tagged span that overlaps one is dropped. Edge cases: null text is empty and has no spans. Positions count code points, ends are
exclusive. Rows are independent, so null ids, ties and repeated rows need no rule. An empty table gives an empty result; extra columns are
ignored by ``find`` and kept by ``redact``.
"""

from __future__ import annotations

import random
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import from_arrow_type

from campuspulse.llm.common import ids_and_text, table
from campuspulse.llm.textbytes import lowered, slices, span_hashes

TRAIN_DOCS = 400
TRAIN_CHARS = 250_000
ROUNDS = 60
RATE = 0.2
L2 = 1e-6
SCALE = 256
NEVER = -(1 << 40)
OUTSIDE, BEGIN, INSIDE = range(3)

# Kinds and patterns of the base contract: fixed values.
BASE = {
    "assign": rb"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": rb"AKIA[A-Z0-9]+",
    "hex": rb"[0-9a-f]+",
}
KINDS = (*BASE, "tagged")
_BASE = {k: re.compile(p) for k, p in BASE.items()}
_GOOD = {"assign": lambda m: len(m[2]) >= 8, "access": lambda m: len(m[0]) >= 16, "hex": lambda m: len(m[0]) >= 32}
# A text without any of these has no base span.
_GATE = re.compile(rb"(?i:password|passwd|secret|token|api_?key)|AKIA|[0-9a-f]{32}")


def base_spans(body: bytes) -> list[tuple[int, int, int]]:
    """(start, end, kind number) by start, then kind, in bytes. All patterns are ASCII, so bytes match as characters do."""
    if not _GATE.search(body):
        return []
    return sorted((m.start(), m.end(), n) for n, (kind, p) in enumerate(_BASE.items()) for m in p.finditer(body) if _GOOD[kind](m))


# --- tokens and features ------------------------------------------------------------------


def _mark(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_SPACE = _mark(" \t\n\x0b\x0c\r")
_UPPER, _LOWER, _DIGIT = _mark(string.ascii_uppercase), _mark(string.ascii_lowercase), _mark(string.digits)
_FOREIGN = np.arange(256) >= 0x80
_WORD = _UPPER | _LOWER | _DIGIT | _FOREIGN | _mark("_")
_VOWEL = _mark("aeiouyAEIOUY")
_HEX = {1: _mark("0123456789abcdef"), 2: _mark("0123456789ABCDEF")}
_CLASS = (_UPPER + 2 * _LOWER + 3 * _DIGIT + 4 * _FOREIGN).astype(np.uint8)
_LENGTHS = np.array([2, 3, 4, 6, 8, 12, 16, 20, 32, 40])
_HASHED = 4096

# Templates with the number of their values; a weight belongs to a value of a template and a tag.
TEMPLATES = {
    "bias": 1, "shape": 9 * 11, "mix": 5 * 6 * 11, "vowels": 5 * 11, "hex": 3 * 11, "word": _HASHED, "head": _HASHED,
    "before": 9 * 11 * 2, "after": 9 * 11 * 2, "sign_before": 256, "sign_after": 256, "two_before": 9 * 11, "sign_two_before": 256,
    "word_before": _HASHED, "word_two_before": _HASHED, "word_after": _HASHED, "value_of": _HASHED, "signs_in_text": 6 * 9 * 11, "digits_in_text": 5 * 9 * 11,
    "line": 4 * 9 * 11, "run": 5 * 6 * 11,
}
OFFSETS = dict(zip(TEMPLATES, np.cumsum([0, *TEMPLATES.values()])[:-1].tolist()))
WEIGHTS = sum(TEMPLATES.values())


def tokens(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): token spans in bytes, and which begin a text."""
    word, space = _WORD[raw], _SPACE[raw]
    head = np.zeros(len(raw) + 1, bool)
    head[offs] = True
    same = np.zeros(len(raw), bool)  # goes on with the token of the byte before
    same[1:] = word[1:] & word[:-1]
    same &= ~head[:-1]
    start = np.flatnonzero(~space & ~same)
    follows = np.append(same[1:], False)
    end = np.flatnonzero(~space & ~follows) + 1
    first = np.zeros(len(start), bool)
    at = np.searchsorted(start, offs[:-1])
    first[at[at < len(start)]] = True
    return start, end, first


def _before(values: np.ndarray, chain: np.ndarray, step: int, none: int = 0) -> np.ndarray:
    """The value ``step`` tokens earlier (later if negative) in the same text."""
    out = np.full_like(values, none)
    if step > 0:
        out[step:] = np.where(chain[step:] == chain[:-step], values[:-step], none)
    else:
        out[:step] = np.where(chain[:step] == chain[-step:], values[-step:], none)
    return out


def features(raw: np.ndarray, offs: np.ndarray):
    """(token starts, ends, first, glued, {template: values}); ``glued`` tokens follow the one before without a gap."""
    start, end, first = tokens(raw, offs)
    n, size = len(start), end - start
    chain = np.cumsum(first)
    glued = np.zeros(n, bool)
    glued[1:] = (start[1:] == end[:-1]) & ~first[1:]

    def counter(flags: np.ndarray):
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int32)])
        return lambda a, b: total[b] - total[a]

    def share(part: np.ndarray, whole: np.ndarray, edges: tuple[float, ...]) -> np.ndarray:
        return np.searchsorted(np.array(edges), part / np.maximum(1, whole), "left")

    upper, lower, digit, vowel, foreign = (counter(t[raw]) for t in (_UPPER, _LOWER, _DIGIT, _VOWEL, _FOREIGN))
    kinds = _CLASS[raw]
    change = counter(np.concatenate([[False], kinds[1:] != kinds[:-1]])[: len(raw)])
    ups, lows, digits, strange = upper(start, end), lower(start, end), digit(start, end), foreign(start, end)
    word = _WORD[raw[start]] if n else np.zeros(0, bool)
    length = np.searchsorted(_LENGTHS, size, "right")
    fifths, changes = (0.0, 0.2, 0.5, 0.99), (1, 2, 3, 5, 9)
    digit_bin = share(digits, size, fifths)
    change_bin = np.searchsorted(np.array(changes), change(np.minimum(start + 1, end), end), "right")
    kind = np.select(
        [~word, strange > 0, lows == size, digits == size, ups == size, digits > 0, (ups == 1) & _UPPER[raw[start]] & (ups + lows == size), ups + lows == size],
        [0, 7, 1, 4, 3, 5, 2, 6], 8) if n else np.zeros(0, int)
    shape = kind * 11 + length
    hexed = np.zeros(n, np.int64)
    for number, marks in _HEX.items():
        hexed = np.where((counter(marks[raw])(start, end) == size) & (hexed == 0), number, hexed)
    low = lowered(raw)
    hashes = (span_hashes(low, start, end) % np.uint64(_HASHED - 1)).astype(np.int64) + 1 if n else np.zeros(0, np.int64)
    heads = (span_hashes(raw, start, np.minimum(start + 4, end)) % np.uint64(_HASHED - 1)).astype(np.int64) + 1 if n else np.zeros(0, np.int64)
    sign = np.where(word, 0, raw[start].astype(np.int64)) if n else np.zeros(0, np.int64)

    # The nearest words on either side, whatever signs stand between.
    places = np.flatnonzero(word)
    nth = np.cumsum(word)  # words up to and with this token
    def nearest(step: int) -> np.ndarray:
        at = nth - word - step if step > 0 else nth - step - 1
        at = np.where((at >= 0) & (at < len(places)), at, -1)
        if not len(places):
            return np.zeros(n, np.int64)
        there = places[at]
        return np.where((at >= 0) & (chain[there] == chain), hashes[there], 0)

    before = nearest(1)
    # Unbroken runs of glued tokens.
    run = np.cumsum(~glued) - 1
    run_start = start[~glued]
    run_end = end[np.append(~glued[1:], True)[:n]]
    run_size = run_end - run_start
    runs = share(digit(run_start, run_end), run_size, fifths) * 66
    runs += np.searchsorted(np.array(changes), change(np.minimum(run_start + 1, run_end), run_end), "right") * 11
    runs += np.searchsorted(_LENGTHS, run_size, "right")
    # The line up to the token: does an assignment sign stand in it?
    breaks = counter(raw == 10)(np.zeros(n, np.int64), start)
    line = np.flatnonzero(np.concatenate([[True], (breaks[1:] != breaks[:-1]) | first[1:]])[:n])
    line_start = start[line][np.searchsorted(line, np.arange(n), "right") - 1] if n else start
    line_bin = 2 * (counter(raw == 0x3D)(line_start, start) > 0) + (counter(raw == 0x3A)(line_start, start) > 0)
    # Shares over the whole text.
    text = np.searchsorted(offs, start, "right") - 1
    whole = np.diff(offs)
    signs_in = share(counter(~_WORD[raw] & ~_SPACE[raw])(offs[:-1], offs[1:]), whole, (0.01, 0.02, 0.04, 0.08, 0.16))[text]
    digits_in = share(digit(offs[:-1], offs[1:]), whole, (0.0, 0.01, 0.04, 0.1))[text]
    values = {
        "bias": np.zeros(n, np.int64), "shape": shape, "mix": (digit_bin * 6 + change_bin) * 11 + length,
        "vowels": share(vowel(start, end), ups + lows, (0.0, 0.2, 0.35, 0.5)) * 11 + length, "hex": hexed * 11 + length,
        "word": np.where(size <= 16, hashes, 0), "head": np.where(word & (size >= 5), heads, 0),
        "before": _before(shape, chain, 1) * 2 + glued, "after": _before(shape, chain, -1) * 2 + np.append(glued[1:], False)[:n],
        "sign_before": _before(sign, chain, 1), "sign_after": _before(sign, chain, -1), "two_before": _before(shape, chain, 2),
        "sign_two_before": _before(sign, chain, 2), "word_before": before, "word_two_before": nearest(2), "word_after": nearest(-1),
        "value_of": np.where(size >= 6, before, 0), "signs_in_text": signs_in * 99 + shape, "digits_in_text": digits_in * 99 + shape,
        "line": line_bin * 99 + shape, "run": runs[run] if n else np.zeros(0, np.int64),
    }
    return start, end, first, glued, values


# --- the chain ------------------------------------------------------------------------------


def _max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    parts = [a[..., :, k: k + 1] + b[..., k: k + 1, :] for k in range(3)]
    return np.maximum(np.maximum(parts[0], parts[1]), parts[2])


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = sum(a[..., :, k: k + 1] * b[..., k: k + 1, :] for k in range(3))
    return out / np.maximum(out.max(axis=(-1, -2), keepdims=True), 1e-300)


def forward(steps: np.ndarray, combine=_max_plus) -> np.ndarray:
    """Row vectors v[t] = u steps[0] … steps[t] for steps of 3 x 3; the first step has equal rows, so ``u`` is any start.

    Blocks of steps are multiplied side by side, then joined one after another: about the square root of their number of operations each.
    """
    n = len(steps)
    if not n:
        return steps.reshape(0, 3)
    size = max(1, int(n**0.5))
    blocks = -(-n // size)
    one = np.where(np.eye(3) > 0, 0, NEVER) if combine is _max_plus else np.eye(3)
    m = np.empty((blocks * size, 3, 3), steps.dtype)
    m[:n], m[n:] = steps, one
    m = m.reshape(blocks, size, 3, 3)
    for t in range(1, size):
        m[:, t] = combine(m[:, t - 1], m[:, t])
    starts = np.empty((blocks, 1, 3), steps.dtype)
    v = (np.array([[0, NEVER, NEVER]]) if combine is _max_plus else np.array([[1.0, 0, 0]])).astype(steps.dtype)
    for b in range(blocks):
        starts[b] = v
        v = combine(v, m[b, -1])
    return combine(starts[:, None], m)[:, :, 0].reshape(-1, 3)[:n]


class Field:
    """Weights per feature value and tag, of pairs of tags, and of the first tag; all integers, ``SCALE`` to one."""

    def __init__(self, weights: np.ndarray, pairs: np.ndarray, start: np.ndarray):
        self.weights, self.pairs, self.start = weights.astype(np.int32), pairs.astype(np.int64), start.astype(np.int64)

    def emissions(self, values: dict[str, np.ndarray], n: int) -> np.ndarray:
        total = np.zeros((n, 3), np.int64)
        for name, v in values.items():
            total += self.weights[OFFSETS[name] + v]
        return total

    def tags(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(token starts, ends, tags of the best path)"""
        start, end, first, glued, values = features(raw, offs)
        return start, end, viterbi(self.emissions(values, len(start)), self.pairs, self.start, first, glued)

    def spans(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) in bytes of the tagged secrets of all texts."""
        start, end, tag = self.tags(raw, offs)
        first = np.flatnonzero(tag == BEGIN)
        stop = np.flatnonzero((tag != OUTSIDE) & np.append(tag[1:] != INSIDE, True)[: len(tag)])
        return start[first], end[stop]


def _steps(emission: np.ndarray, pairs: np.ndarray, start: np.ndarray, first: np.ndarray, glued: np.ndarray, never) -> np.ndarray:
    """Scores of (tag before, tag) of each token; a first token's don't depend on the tag before, which starts a new chain."""
    allowed = pairs.copy()
    allowed[OUTSIDE, INSIDE] = never
    begin = start.copy()
    begin[INSIDE] = never
    steps = np.where(first[:, None, None], begin[None, None, :], allowed[None]) + emission[:, None, :]
    steps[~glued, :, INSIDE] = never
    return steps


def viterbi(emission: np.ndarray, pairs: np.ndarray, start: np.ndarray, first: np.ndarray, glued: np.ndarray) -> np.ndarray:
    """Tags of the best path of each chain; ties prefer the lower tag."""
    n = len(emission)
    if not n:
        return np.zeros(0, np.int8)
    steps = _steps(emission, pairs, start, first, glued, NEVER)
    best = forward(steps)
    back = np.zeros((n, 3), np.int8)
    back[1:] = (best[:-1, :, None] + steps[1:]).argmax(axis=1)
    moves, tag = back.tolist(), int(best[-1].argmax())
    out = [0] * n
    for t in range(n - 1, -1, -1):
        out[t] = tag
        tag = moves[t][tag]
    return np.array(out, np.int8)


def marginals(emission: np.ndarray, pairs: np.ndarray, start: np.ndarray, first: np.ndarray, glued: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probability of each token's tags, of its pairs of tags) by forward-backward."""
    steps = np.exp(_steps(emission - emission.max(axis=1, keepdims=True), pairs, start, first, glued, -np.inf))
    alpha = forward(steps, _product)
    # Backwards with transposed steps; the step after the last one is a new chain.
    turned = np.ones_like(steps)
    turned[1:] = steps[:0:-1].transpose(0, 2, 1)
    beta = forward(turned, _product)[::-1]
    both = alpha * beta
    joint = np.zeros_like(steps)
    joint[1:] = alpha[:-1, :, None] * steps[1:] * beta[1:, None, :]
    joint /= np.maximum(joint.sum(axis=(1, 2), keepdims=True), 1e-300)
    return both / both.sum(axis=1, keepdims=True), joint


# --- training ------------------------------------------------------------------------------

# Names and openings of values that people keep secret, and of some that they don't.
SECRET_NAMES = (
    "password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access_key", "client_secret", "auth_token", "passphrase",
    "private_key", "credential", "db_password", "bearer", "signing_key", "master key", "login code",
)
PLAIN_NAMES = ("user", "name", "title", "color", "version", "id", "commit", "checksum", "file", "url", "page", "host", "date", "model", "order", "isbn", "ref", "build")
OPENINGS = ("ghp_", "gho_", "glpat-", "xoxb-", "xoxp-", "sk_live_", "rk_live_", "sk-", "AIza", "npm_", "SG.", "AKIA", "ASIA", "ya29.", "hf_")
_ALNUM, _BASE64 = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"


def _chars(rng: random.Random, alphabet: str, low: int, high: int | None = None) -> str:
    return "".join(rng.choice(alphabet) for _ in range(rng.randint(low, high or low)))


def a_secret(rng: random.Random) -> tuple[str, bool]:
    """(value, whether it is told only by its context)"""
    pick = rng.randrange(9)
    if pick == 0:
        return rng.choice(OPENINGS) + _chars(rng, _ALNUM, 16, 40), False
    if pick == 1:
        return _chars(rng, _BASE64, 30, 64) + rng.choice(("", "=", "==")), False
    if pick == 2:
        return ".".join(("eyJ" + _chars(rng, _ALNUM, 15, 30), "eyJ" + _chars(rng, _ALNUM + "_-", 20, 60), _chars(rng, _ALNUM + "_-", 20, 43))), False
    if pick == 3:
        return _chars(rng, rng.choice(("0123456789abcdef", "0123456789ABCDEF")), rng.choice((32, 40, 64))), False
    if pick == 4:
        return _chars(rng, _ALNUM, 24, 48), False
    if pick == 5:
        return "-".join(_chars(rng, "0123456789abcdef", n) for n in (8, 4, 4, 4, 12)), True
    if pick == 6:
        return _chars(rng, string.ascii_lowercase, 3, 8).capitalize() + _chars(rng, string.digits, 2, 4) + _chars(rng, "!$%*@#", 0, 2), True
    if pick == 7:
        return _chars(rng, _ALNUM + "!$%*#_-", 8, 16), True
    return _chars(rng, _ALNUM, 10, 22), True


def _name(rng: random.Random, names: tuple[str, ...]) -> str:
    name = rng.choice(names)
    return rng.choice((name, name, name.upper(), name.capitalize(), f"my_{name}", f"{name}_{rng.randint(1, 9)}"))


def _assigned(rng: random.Random, name: str, value: str) -> tuple[str, str]:
    """(text before the value, text after it) of an assignment."""
    quote = rng.choice(("", "", '"', "'"))
    return rng.choice((
        (f"{name} = {quote}", quote), (f"{name}={quote}", quote), (f"{name}: {quote}", quote), (f"export {name}={quote}", quote), (f'"{name}": "', '",'),
        (f"{name} => '", "'"), (f"the {name} is {quote}", quote), (f"{name} {quote}", quote), (f"--{name} {quote}", quote), (f"<{name}>", f"</{name}>"),
    ))


def planted(rng: random.Random, word: str) -> tuple[str, int, int]:
    """(text, start, end) of one insertion; start and end are equal where it holds no secret."""
    if rng.random() < 0.5:
        value, needs_context = a_secret(rng)
        pick = rng.random()
        if needs_context or pick < 0.5:
            before, after = _assigned(rng, _name(rng, SECRET_NAMES), value)
        elif pick < 0.6:
            before, after = "Authorization: Bearer ", ""
        elif pick < 0.7:
            before, after = f"{rng.choice(('postgres', 'mysql', 'https', 'amqp'))}://{word.lower() or 'u'}:", "@db.example.com/main"
        else:
            before, after = "", rng.choice(("", "", ".", ","))
        return before + value + after, len(before), len(before) + len(value)
    n = rng.randint
    plain = rng.choice((
        lambda: f"{word}.{n(0, 99)}@mail{n(1, 9)}.example.com", lambda: ".".join(str(n(0, 255)) for _ in range(4)), lambda: _chars(rng, string.digits, 7, 19),
        lambda: " ".join(_chars(rng, string.digits, 4) for _ in range(4)), lambda: f"+{n(1, 99)} {n(100, 999)} {n(1000, 9999)}-{n(10, 99)}",
        lambda: "-".join(_chars(rng, "0123456789abcdef", k) for k in (8, 4, 4, 4, 12)), lambda: f"20{n(10, 30)}-{n(10, 12)}-{n(10, 28)}T{n(10, 23)}:{n(10, 59)}:00Z",
        lambda: f"v{n(0, 9)}.{n(0, 20)}.{n(0, 9)}-rc{n(1, 9)}", lambda: f"https://www.example.com/{word}/{n(1, 9999)}/index.html?q={word}&p={n(1, 9)}",
        lambda: f"/usr/{word}/lib{n(1, 99)}/{word}_{word}.so.{n(1, 9)}", lambda: f"{word.capitalize()}{word.capitalize()}Factory{n(1, 9)}", lambda: f"{word}_{word}_{word}",
        lambda: f"commit {_chars(rng, '0123456789abcdef', 7, 12)}", lambda: f"#{_chars(rng, '0123456789abcdef', 6)}", lambda: f"ORD-{n(10000, 99999)}-{n(10, 99)}",
        lambda: f"{word.upper()}-{n(100, 9999)}", lambda: f"{word}{n(1, 2030)}", lambda: f"978-{n(1, 9)}-{n(1000, 9999)}-{n(1000, 9999)}-{n(0, 9)}", lambda: word * 3,
    ))()
    pick = rng.random()
    if pick < 0.3:
        before, after = _assigned(rng, _name(rng, PLAIN_NAMES), plain)
        plain = before + plain + after
    elif pick < 0.5:
        # A secret's name beside an ordinary word.
        before, after = _assigned(rng, _name(rng, SECRET_NAMES), word)
        plain = before + (word or "none") + after
    return plain, 0, 0


def with_plants(text: str, rng: random.Random) -> tuple[str, list[tuple[int, int]]]:
    """The text with insertions at some of its gaps, and the (start, end) of the secrets among them."""
    pieces = re.split(r"([ \n]+)", text)
    out, at, spans = [], 0, []
    words = [w for w in pieces[::2] if w.isalpha()] or ["word"]
    for i, piece in enumerate(pieces):
        out.append(piece)
        at += len(piece)
        if i % 2 and rng.random() < 0.04:
            extra, a, b = planted(rng, rng.choice(words))
            if b > a:
                spans.append((at + a, at + b))
            out.append(extra + " ")
            at += len(extra) + 1
    return "".join(out), spans


def _byte_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    if text.isascii():
        return spans
    at = np.concatenate([[0], np.cumsum([len(c.encode()) for c in text])])
    return [(int(at[a]), int(at[b])) for a, b in spans]


def _value_spans(body: bytes) -> list[tuple[int, int]]:
    """The base spans, of assignments the value only."""
    return [m.span(2) if kind == "assign" else m.span() for kind, p in _BASE.items() for m in p.finditer(body) if _GOOD[kind](m)]


def gold(start: np.ndarray, end: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Tags of tokens inside byte spans; of overlapping spans the longest counts."""
    tags = np.zeros(len(start), np.int8)
    for a, b in sorted(spans, key=lambda s: s[1] - s[0]):
        i, j = np.searchsorted(start, a), np.searchsorted(end, b, "right")
        if i < j:
            tags[i:j] = INSIDE
            tags[i] = BEGIN
            if j < len(tags) and tags[j] == INSIDE:
                tags[j] = BEGIN
    return tags


def fit_texts(texts: list[str], rounds: int = ROUNDS, seed: int = 11) -> Field:
    """Maximum likelihood with a small quadratic penalty, by Adam steps on the exact gradient, from texts with planted secrets."""
    rng = random.Random(seed)
    made = [with_plants(t, rng) for t in texts]
    made += [planted_only(rng) for _ in range(300)]
    bodies = [t.encode() for t, _ in made]
    offs = np.concatenate([[0], np.cumsum([len(b) for b in bodies])]).astype(np.int64)
    raw = np.frombuffer(b"".join(bodies), np.uint8)
    start, end, first, glued, values = features(raw, offs)
    spans = [(a + o, b + o) for (t, s), o, body in zip(made, offs.tolist(), bodies) for a, b in _byte_spans(t, s) + _value_spans(body)]
    y = gold(start, end, spans)
    index = np.stack([OFFSETS[k] + v for k, v in values.items()], axis=1)
    n = len(y)
    seen = np.zeros((n, 3))
    seen[np.arange(n), y] = 1
    inner = np.flatnonzero(~first)
    seen_pairs = np.zeros((3, 3))
    np.add.at(seen_pairs, (y[inner - 1], y[inner]), 1)
    theta = np.zeros((WEIGHTS + 4, 3))  # features, then pairs by rows, then the first tag
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    width = index.shape[1]
    for t in range(1, rounds + 1):
        emission = theta[index].sum(axis=1)
        p, joint = marginals(emission, theta[WEIGHTS: WEIGHTS + 3], theta[-1], first, glued)
        diff = seen - p
        grad = np.empty_like(theta)
        for tag in range(3):
            grad[:WEIGHTS, tag] = np.bincount(index.ravel(), np.repeat(diff[:, tag], width), WEIGHTS)
        grad[WEIGHTS: WEIGHTS + 3] = seen_pairs - joint[inner].sum(axis=0)
        grad[-1] = diff[first].sum(axis=0)
        grad = grad / n - L2 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta += RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    whole = np.rint(theta * SCALE)
    return Field(whole[:WEIGHTS], whole[WEIGHTS: WEIGHTS + 3], whole[-1])


def planted_only(rng: random.Random) -> tuple[str, list[tuple[int, int]]]:
    """A text of one insertion between ordinary words, so that a field can be trained without a corpus."""
    words = "the of and report plan value system note page line when team result".split()
    head, tail = (" ".join(rng.choices(words, k=rng.randint(0, 6))) for _ in range(2))
    extra, a, b = planted(rng, rng.choice(words))
    text = f"{head} {extra} {tail}"
    return text, [(len(head) + 1 + a, len(head) + 1 + b)] if b > a else []


def fit(docs: DataFrame, limit: int = TRAIN_DOCS, chars: int = TRAIN_CHARS) -> Field:
    """Train on whole documents of the smallest id hashes, at most ``limit`` of them and ``chars`` characters together."""
    keyed = ids_and_text(docs).withColumn("h", F.xxhash64("doc_id", "text"))
    sizes = keyed.select("h", F.char_length("text").alias("size")).orderBy("h", "size").limit(limit).collect()
    wanted, total = [], 0
    for r in sizes:
        if total + r.size <= chars and r.h not in wanted:
            wanted.append(r.h)
            total += r.size
    found = {r.h: r.text for r in keyed.where(F.col("h").isin(wanted)).select("h", "text").groupBy("h").agg(F.min("text").alias("text")).collect()} if wanted else {}
    return fit_texts([found[h] for h in wanted])


# --- on tables --------------------------------------------------------------------------------

_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_FOUND = pa.struct([("base", pa.list_(_SPAN)), ("spans", pa.list_(_SPAN))])


def text_spans(field: Field, raw: np.ndarray, offs: np.ndarray) -> list[tuple[list, list]]:
    """(base, all) spans of each text as (start, end, kind number) in code points."""
    begin, stop = field.spans(raw, offs)
    edges = np.searchsorted(begin, offs).tolist()
    begin, stop, body, places = begin.tolist(), stop.tolist(), raw.tobytes(), offs.tolist()
    out = []
    for i, (a, b) in enumerate(zip(places[:-1], places[1:])):
        base = base_spans(body[a:b])
        tagged = [(x - a, y - a, len(BASE)) for x, y in zip(begin[edges[i]: edges[i + 1]], stop[edges[i]: edges[i + 1]])]
        free, held, reach = [], 0, 0
        for x, y, k in tagged:  # both by start: ``reach`` is the furthest end of the base spans that start before y
            while held < len(base) and base[held][0] < y:
                reach = max(reach, base[held][1])
                held += 1
            if x >= reach:
                free.append((x, y, k))
        spans = sorted(base + free)
        if spans and not body[a:b].isascii():
            points = np.concatenate([[0], np.cumsum((raw[a:b] & 0xC0) != 0x80)])
            base, spans = ([(int(points[x]), int(points[y]), k) for x, y, k in s] for s in (base, spans))
        out.append((base, spans))
    return out


def _structs(spans: list[tuple[int, int, int]]) -> list[dict]:
    return [{"kind": KINDS[k], "start": a, "end": b} for a, b, k in spans]


def found(field: Field, text: Column) -> Column:
    """Struct of ``base`` and ``spans``, arrays of (kind, start, end) by start, then kind."""

    @arrow_udf(from_arrow_type(_FOUND))
    def scan(texts: pa.Array) -> pa.Array:
        rows = [r for _, _, raw, offs in slices(texts) for r in text_spans(field, raw, offs)]
        return pa.array([{"base": _structs(base), "spans": _structs(spans)} for base, spans in rows], _FOUND)

    return scan(text)


def find(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, base, spans): one row per document."""
    return ids_and_text(docs).select("doc_id", found(field, F.col("text")).alias("f")).select("doc_id", "f.base", "f.spans")


def redact(docs: DataFrame, field: Field) -> DataFrame:
    """All columns, with every span of ``text`` replaced by ``<secret>``; overlapping spans are replaced as one. Null stays null."""

    @arrow_udf(from_arrow_type(pa.string()))
    def cleaned(texts: pa.Array) -> pa.Array:
        spans = [s for _, _, raw, offs in slices(texts) for _, s in text_spans(field, raw, offs)]
        out = []
        for text, some in zip(texts.to_pylist(), spans):
            parts, at = [], 0
            for a, b, _ in some:
                if a >= at:
                    parts += [text[at:a], "<secret>"]
                at = max(at, b)
            out.append(text if text is None else "".join([*parts, text[at:]]))
        return pa.array(out, pa.string())

    return docs.select(*(cleaned("text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns))


def joined(spans: str) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op12_secrets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = find(docs, fit(docs))
    return rows.select("doc_id", *map(_count, BASE), F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))


QUERIES = {"op12_secrets": op12_secrets}
ORACLES: dict[str, str] = {}
