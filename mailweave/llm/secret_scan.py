"""Secret scans: a linear-chain conditional random field over the tokens of whole texts.

Tokens are runs of the characters that keys are made of; each is tagged as the begin of a
secret, inside one, or outside. Features are the token's shape (length, kinds of characters
and changes between them), hashed neighbouring words, the separator before it and features of
the whole text. The field is trained in numpy by stochastic gradients of its exact likelihood
(forward-backward) on generated lines: secrets of many forms in prose and assignments against
look-alikes. Decoding is Viterbi. Scores of all tokens of a block are gathered at once; a token
whose outside score leads by more than the transitions can give back is outside on every best
path, so the path is decoded exactly and only around the others.

The base rules (assignments, access keys, hex runs) are regular expressions over whole texts;
their spans always stay and the field adds to them. Spans count code points, end exclusive.

Defined results: a null text counts as empty, with no span; repeated rows are scanned each; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from mailweave.llm.common import blocks, encoded, mix, parts

# Fixed values of the contract of the query.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "crf")

BUCKETS = 1 << 14
OUT, BEGIN, INSIDE = 0, 1, 2
#: Generated lines that training sees, passes over them, step size.
LINES, EPOCHS, RATE = 3000, 4, 0.3
#: Least characters of a span that the field adds.
LEAST = 8

_KEY = np.zeros(256, bool)
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-":
    _KEY[_c] = True
_KEY[128:] = True
_DIGIT, _UPPER, _LOWERS, _HEXA = (np.zeros(256, bool) for _ in range(4))
_DIGIT[48:58] = _UPPER[65:91] = _LOWERS[97:123] = _HEXA[48:58] = _HEXA[97:103] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_CLASS = np.zeros(256, np.int8)
_CLASS[_DIGIT], _CLASS[_UPPER], _CLASS[_LOWERS] = 1, 2, 3
_CLASS[128:] = 3


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """Spans (start, kind, end) of the base rules."""
    found = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return found


@dataclass
class Tokens:
    start: np.ndarray  # byte offsets in the block
    end: np.ndarray
    upto: np.ndarray  # tokens before each text
    features: np.ndarray  # (tokens, number of features): rows of the weight table


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    """Tokens of a block of texts with their feature buckets; tokens never cross texts."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _KEY[data]
    begin, stop = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    both = cut[inside[cut] & inside[cut + 1]]
    begin[both] = stop[both] = True
    start, end = np.flatnonzero(begin), np.flatnonzero(stop)
    upto = np.searchsorted(start, offsets)
    n = len(start)
    if not n:
        return Tokens(start, end, upto, np.zeros((0, 12), np.int32))

    def total(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int32)
        np.cumsum(flags, out=sums[1:])
        return sums[end] - sums[start]

    size = end - start
    kind = _CLASS[data]
    changes = np.zeros(len(data), bool)
    changes[1:] = kind[1:] != kind[:-1]
    digits, uppers, hexes, turns = (total(f) for f in (_DIGIT[data], _UPPER[data], _HEXA[data], changes))
    # hash of the lowered token from its first and last eight bytes and its length
    folded = np.concatenate([_FOLD[data], np.zeros(16, np.uint8)])
    word = np.zeros(n, np.uint64)
    for k in range(8):
        word = word * np.uint64(257) + np.where(k < size, folded[np.minimum(start + k, len(data))], 0).astype(np.uint64)
        word = word * np.uint64(263) + np.where(k < size, folded[np.maximum(end - 1 - k, 0)], 0).astype(np.uint64)
    word = mix(word + size.astype(np.uint64))
    head = np.zeros(n, np.uint64)  # the first four bytes, as they are: well-known prefixes of keys
    plain = np.concatenate([data, np.zeros(16, np.uint8)])
    for k in range(4):
        head = head * np.uint64(256) + np.where(k < size, plain[np.minimum(start + k, len(data))], 0).astype(np.uint64)
    text = np.searchsorted(offsets, start, side="right") - 1
    first, last = start == start[upto[text]], np.zeros(n, bool)
    last[upto[1:][np.diff(upto) > 0] - 1] = True
    before = np.where(first, np.uint64(1), np.roll(word, 1))
    before2 = np.where(first | np.roll(first, 1), np.uint64(2), np.roll(word, 2))
    after = np.where(last, np.uint64(3), np.roll(word, -1))
    # separator before: kinds of signs between this token and the last one
    gap_from = np.where(first, offsets[text], np.roll(end, 1))
    sign = np.zeros(len(data) + 1, np.int32)
    np.cumsum(((data == 58) | (data == 61)).astype(np.int32), out=sign[1:])
    quote = np.zeros(len(data) + 1, np.int32)
    np.cumsum(((data == 34) | (data == 39)).astype(np.int32), out=quote[1:])
    sep = np.minimum(sign[start] - sign[gap_from], 1) * 2 + np.minimum(quote[start] - quote[gap_from], 1)
    glued = (start - gap_from) == 1
    length = np.digitize(size, [4, 8, 12, 16, 20, 28, 36, 48])
    shape = (
        length * 64
        + np.digitize(digits / size, [0.001, 0.2, 0.6]) * 16
        + np.digitize(uppers / size, [0.001, 0.3, 0.9]) * 4
        + np.digitize(turns / size, [0.1, 0.25, 0.4])
    )
    per_text = np.diff(upto)
    long_ = (size >= 16).astype(np.int64)
    many = np.add.reduceat(long_, np.minimum(upto[:-1], n - 1)) * (per_text > 0)
    file_kind = np.digitize(np.where(per_text > 0, many / np.maximum(per_text, 1), 0), [0.002, 0.02, 0.2]) * 4 + np.digitize(per_text, [10, 100, 1000])
    mixed = (digits > 0).astype(int) * 4 + (uppers > 0) * 2 + (hexes == size)
    columns = [
        shape,
        length * 8 + mixed,
        sep * 2 + glued,
        (before % np.uint64(1 << 40)).astype(np.int64),
        (before2 % np.uint64(1 << 40)).astype(np.int64),
        (after % np.uint64(1 << 40)).astype(np.int64),
        (before % np.uint64(1 << 40)).astype(np.int64) * 4 + sep,
        file_kind[text] * 16 + length,
        sep * 1024 + shape,
        (head.astype(np.int64) << 4) + length,
        # a dot right before ties the parts of a key
        shape * 4 + glued * 2 + (plain[np.maximum(start - 1, 0)] == 46),
        np.zeros(n, np.int64),
    ]
    features = np.stack(
        [(mix(c.astype(np.uint64) + np.uint64((k + 1) << 48)) % np.uint64(BUCKETS)).astype(np.int32) for k, c in enumerate(columns)], 1
    )
    return Tokens(start, end, upto, features)


@dataclass
class Field:
    weights: np.ndarray  # (BUCKETS, 3)
    moves: np.ndarray  # (3, 3): from, to

    def scores(self, tokens: Tokens) -> np.ndarray:
        return self.weights[tokens.features].sum(1)

    def viterbi(self, score: np.ndarray) -> np.ndarray:
        """Best tags of one chain of tokens."""
        n = len(score)
        best, back = score[0].copy(), np.zeros((n, 3), np.int8)
        for i in range(1, n):
            step = best[:, None] + self.moves
            back[i] = step.argmax(0)
            best = step.max(0) + score[i]
        tags = np.zeros(n, np.int8)
        tags[-1] = best.argmax()
        for i in range(n - 1, 0, -1):
            tags[i - 1] = back[i, tags[i]]
        return tags

    def decode(self, score: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """Tags of all tokens of a block, chain by chain.

        Exchanging the tag of one token changes two transitions; a token whose outside score
        leads by more than twice their spread is outside on every best path. Chains are cut
        there, and what is between two such tokens is decoded with both of them as ends.
        """
        tags = np.zeros(len(score), np.int8)
        if not len(score):
            return tags
        spread = float(self.moves.max() - self.moves.min())
        unsure = score[:, OUT] - np.maximum(score[:, BEGIN], score[:, INSIDE]) <= 2 * spread
        text = np.searchsorted(upto, np.arange(len(score)), side="right")
        at = np.flatnonzero(unsure)
        if not len(at):
            return tags
        runs = np.split(at, np.flatnonzero((np.diff(at) > 1) | (text[at[1:]] != text[at[:-1]])) + 1)
        for run in runs:
            a, b = int(run[0]), int(run[-1]) + 1
            left = int(a > 0 and text[a - 1] == text[a])
            right = int(b < len(score) and text[b] == text[a])
            part = score[a - left : b + right].copy()
            # the sure tokens at both ends take part as outside
            for end, on in ((0, left), (-1, right)):
                if on:
                    part[end, [BEGIN, INSIDE]] = -1e9
            found = self.viterbi(part)
            tags[a:b] = found[left : len(part) - right]
        return tags


def train(seed: int = 11) -> Field:
    """Fit the field on generated lines by stochastic gradient of the exact log-likelihood."""
    rng = np.random.default_rng(seed)
    lines, marks = zip(*(generated_line(rng) for _ in range(LINES)), strict=True)
    texts = [x.encode() for x in lines]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    tokens = tokens_of(data, offsets)
    tags = np.zeros(len(tokens.start), np.int8)
    for k, spans in enumerate(marks):
        for s, e in spans:
            hit = np.flatnonzero((tokens.start >= offsets[k] + s) & (tokens.end <= offsets[k] + e))
            tags[hit] = INSIDE
            tags[hit[:1]] = BEGIN
    weights, moves = np.zeros((BUCKETS, 3)), np.zeros((3, 3))
    for epoch in range(EPOCHS):
        rate = RATE / (1 + epoch)
        for k in rng.permutation(len(lines)):
            a, b = tokens.upto[k], tokens.upto[k + 1]
            if a == b:
                continue
            rows, y = tokens.features[a:b], tags[a:b]
            score = weights[rows].sum(1)
            n = b - a
            ahead, behind = np.zeros((n, 3)), np.zeros((n, 3))
            ahead[0] = score[0]
            for i in range(1, n):
                ahead[i] = score[i] + np.logaddexp.reduce(ahead[i - 1][:, None] + moves, axis=0)
            for i in range(n - 2, -1, -1):
                behind[i] = np.logaddexp.reduce(moves + (score[i + 1] + behind[i + 1])[None, :], axis=1)
            total = np.logaddexp.reduce(ahead[-1])
            gradient = -np.exp(ahead + behind - total)
            gradient[np.arange(n), y] += 1
            if n > 1:
                pair = np.exp(ahead[:-1, :, None] + moves[None] + (score[1:] + behind[1:])[:, None, :] - total)
                step = -pair.sum(0)
                np.add.at(step, (y[:-1], y[1:]), 1)
                moves += rate * 0.1 * step
            for c in range(rows.shape[1]):
                np.add.at(weights, rows[:, c], rate * gradient)
            moves = np.clip(moves, -4, 4)
    return Field(weights.astype(np.float32), moves)


def generated_line(rng: np.random.Generator) -> tuple[str, list[tuple[int, int]]]:
    """One line of prose or code with the spans of its secrets, in bytes."""
    low, up, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"

    def chars(alphabet: str, n: int) -> str:
        return "".join(alphabet[i] for i in rng.integers(0, len(alphabet), n))

    def word() -> str:
        w = chars(low + "aeioun" * 3 + "\u00e9\u00fc\u00f1\u00f3", int(rng.integers(2, 14) if rng.random() < 0.9 else rng.integers(14, 26)))
        return [w, w.capitalize(), w, w.upper(), w + rng.choice([".", ",", "!!", "&&&", "###"])][int(rng.integers(0, 5))]

    def name() -> str:
        return chars(low, int(rng.integers(3, 9)))

    def plain() -> str:
        return [
            lambda: chars(digit, int(rng.integers(1, 17))),
            lambda: ".".join(chars(digit, 3) for _ in range(4)),
            lambda: f"{word().lower()}@{name()}.example.com",
            lambda: f"https://{name()}.example.com/{name()}/{name()}",
            lambda: "-".join(name() for _ in range(3)),
            lambda: "_".join(name() for _ in range(int(rng.integers(2, 5)))),
            lambda: f"{rng.choice(['width', 'colour', 'size', 'name', 'title', 'user', 'id'])} = {name()}",
            lambda: f"+1 ({chars(digit, 3)}) {chars(digit, 3)}-{chars(digit, 4)}",
            lambda: "-".join(chars(digit + "abcdef", n) for n in (8, 4, 4, 4, 12)),
            lambda: f"{rng.integers(1990, 2030)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}T{rng.integers(0, 24):02d}:{rng.integers(0, 60):02d}",
            lambda: f"/{name()}/{name()}/{name()}_{rng.integers(0, 99)}.{name()[:3]}",
            lambda: "".join(name().capitalize() for _ in range(int(rng.integers(2, 5)))),
            lambda: f"{name()}{rng.integers(0, 9999)}",
            lambda: f"v{rng.integers(0, 20)}.{rng.integers(0, 20)}.{rng.integers(0, 20)}",
            lambda: f"{chars(up, 2)}{chars(digit, 2)} {chars(digit, 4)} {chars(digit, 4)} {chars(digit, 4)}",
            lambda: chars(up, int(rng.integers(2, 16))),
        ][int(rng.integers(0, 16))]() if rng.random() < 0.4 else word()

    def secret() -> str:
        mixed = low + up + digit
        return [
            lambda: chars(digit + "abcdef", int(rng.choice([32, 40, 64]))),
            lambda: "AKIA" + chars(up + digit, 16),
            lambda: str(rng.choice(["ghp_", "gho_", "sk-", "xoxb-", "glpat-", "npm_", "pypi-", "hf_"])) + chars(mixed, int(rng.integers(20, 40))),
            lambda: chars(mixed + "+/", int(rng.integers(24, 48))),
            lambda: chars(mixed + "_-", int(rng.integers(20, 36))),
            lambda: chars(up + digit, int(rng.integers(20, 32))),
            lambda: ".".join("eyJ" * (k < 2) + chars(mixed + "_-", int(rng.integers(20, 44))) for k in range(3)),
        ][int(rng.integers(0, 7))]()

    parts, spans, size = [], [], 0

    def add(piece: str, is_secret: bool = False) -> None:
        nonlocal size
        if is_secret:
            spans.append((size, size + len(piece.encode())))
        parts.append(piece)
        size += len(piece.encode())

    for _ in range(int(rng.integers(3, 25))):
        if rng.random() < 0.06:
            label = rng.choice(["password", "token", "secret", "api_key", "key", "auth", "bearer", "credential", "pwd", "access"])
            add(str(label) + str(rng.choice([" = ", ": ", "=", " ", ':"', " = '"])))
            # what stands after such a name is a secret if it looks like one
            if rng.random() < 0.7:
                add(secret(), True)
            else:
                add(plain())
        elif rng.random() < 0.04:
            add(secret(), True)
        else:
            add(plain())
        add(" ")
    return "".join(parts), spans


def _spans(text: str, raw: bytes, at: int, start: np.ndarray, end: np.ndarray, tags: np.ndarray) -> list[tuple[int, str, int]]:
    """Base spans and the field's spans that no base span overlaps. One pass over the text."""
    found = base_spans(text)
    hit = np.flatnonzero(tags)
    taken = sorted((s, e) for s, _, e in found)
    added, k, b, seen, points = [], 0, 0, 0, 0
    while k < len(hit):
        last = k
        # parts of one key touch but for one sign
        while last + 1 < len(hit) and hit[last + 1] == hit[last] + 1 and tags[hit[last + 1]] == INSIDE and start[hit[last + 1]] - end[hit[last]] == 1:
            last += 1
        first, stop = int(start[hit[k]]) - at, int(end[hit[last]]) - at
        points += len(raw[seen:first].decode("utf-8", "ignore"))
        s = points
        points += len(raw[first:stop].decode("utf-8", "ignore"))
        seen = stop
        while b < len(taken) and taken[b][1] <= s:
            b += 1
        if points - s >= LEAST and not _overlaps(taken, b, s, points):
            added.append((s, "crf", points))
        k = last + 1
    return sorted(found + added, key=lambda x: (x[0], KINDS.index(x[1])))


def _overlaps(taken: list[tuple[int, int]], first: int, s: int, e: int) -> bool:
    """Whether one of the sorted spans from ``first`` on overlaps [s, e)."""
    while first < len(taken) and taken[first][0] < e:
        if taken[first][1] > s:
            return True
        first += 1
    return False


def scan_secrets(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id and the array of spans (kind, start, end, value) of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(field or train())  # fixed size

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        field = shared.value
        for pdf in parts(batches):
            texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
            raws, out = encoded(texts), []
            for first, last, data, offsets in blocks(raws):
                tokens = tokens_of(data, offsets)
                tags = field.decode(field.scores(tokens), tokens.upto)
                for k in range(first, last):
                    a, b = tokens.upto[k - first], tokens.upto[k - first + 1]
                    spans = _spans(texts[k], raws[k], int(offsets[k - first]), tokens.start[a:b], tokens.end[a:b], tags[a:b])
                    out.append([{"kind": kind, "start": s, "end": e, "value": texts[k][s:e]} for s, kind, e in spans])
            yield pd.DataFrame({"doc_id": pdf["doc_id"].array, "found": out})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(
        scan, f"doc_id {kind}, found array<struct<kind: string, start: int, end: int, value: string>>"
    )

