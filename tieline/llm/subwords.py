"""Byte-level BPE: text units with a bounded memo, ids by the tokenizers library, and a two-tier encoder of its own.

Both encoders split a text before every blank that a non-blank follows.  The usual byte-level pattern always
starts a new match there, so units can be encoded one by one and remembered.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import regex
import xxhash

#: The pattern that splits text before byte-level merges (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SPLIT = re.compile(r" (?=\S)")
_PLAIN = re.compile(r"[\x00-\x1b\x20-ɏ‐-‧‰-⁞]*")
#: Latin letters, then ASCII signs but the apostrophe: two pre-tokens, or one where there are no signs.
_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿĀ-ſ]*)([!-&(-/:-@\[-`{-~]*)")


class _NotAUnit(Exception):
    pass


class Memo(dict):
    """Memo of ``compute`` in two generations of at most ``limit`` entries.

    A full generation becomes the old one and its hits move over, so frequent units stay and memory is bounded.
    Texts over ``longest`` characters are never kept.
    """

    def __init__(self, compute: Callable[[str], object], limit: int = 300_000, longest: int = 48):
        super().__init__()
        self.compute, self.limit, self.longest, self.old = compute, limit, longest, {}

    def __missing__(self, unit: str):
        value = self.old.get(unit)
        if value is None:
            value = self.make(unit)
        if len(unit) <= self.longest:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[unit] = value
        return value

    def make(self, unit: str):
        return self.compute(unit)


class Units(Memo):
    """Memo over the units of texts: a unit stands for itself behind a blank."""

    def make(self, unit: str):
        if not unit or unit[0].isspace():
            raise _NotAUnit
        return self.compute(" " + unit)

    def of(self, text: str) -> list:
        """Values of the text's units in order."""
        first, *rest = text.split(" ")
        try:
            found = list(map(self.__getitem__, rest))
        except _NotAUnit:
            first, *rest = _SPLIT.split(text)
            found = list(map(self.__getitem__, rest))
        return [self.compute(first), *found] if first else found


def _byte_alphabet() -> dict[int, str]:
    """The printable stand-ins of byte-level vocabularies: printable bytes are themselves, the others follow 255."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


@lru_cache(maxsize=4)
def library_encoder(path: str) -> Callable[[str], bytes]:
    """Text → ids as little-endian unsigned 32-bit integers, equal to ``Tokenizer.encode(text, add_special_tokens=False)``.

    For a plain byte-level tokenizer the library's model encodes each distinct pre-token once and the memo serves
    repeats.  Units with added tokens or with characters that pattern libraries class differently, and all texts of other
    tokenizers, go through ``encode`` whole.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    simple = (pre.get("type"), pre.get("use_regex", True), pre.get("add_prefix_space")) == ("ByteLevel", True, False) and not spec.get("normalizer")

    def whole(text: str) -> bytes:
        return np.asarray(tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    if not simple or any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
        return whole
    added = [t["content"] for t in spec["added_tokens"]]
    find = regex.compile(PATTERN).findall
    stand_in = str.maketrans({chr(b): c for b, c in _byte_alphabet().items()})
    model = tok.model
    simple_units = not any(_WORD.fullmatch(a) for a in added)

    def unit(text: str) -> bytes:
        word = _WORD.fullmatch(text, 1) if simple_units and text[:1] == " " else None
        if word and word[1]:  # no added token can be inside
            return units[word[1]] + parts[word[2]] if word[2] else part(text)
        if not _PLAIN.fullmatch(text) or any(a in text for a in added):
            return whole(text)
        return b"".join(map(parts.__getitem__, find(text)))

    def part(text: str) -> bytes:
        ids = [t.id for t in model.tokenize(text.encode().decode("latin-1").translate(stand_in))]
        return struct.pack(f"<{len(ids)}I", *ids)

    parts = Memo(part)
    units = Units(unit)
    return lambda text: b"".join(units.of(text))


class MinimalPerfectHash:
    """Hash-and-displace: a key's bucket holds the displacement that sends it to a slot no other key has.

    Buckets are placed largest first; a bucket of one key holds a free slot itself, as a negative number.
    """

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        self.n, self.buckets = n, max(1, n // 2)
        h = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), dtype=np.uint64, count=n)
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.buckets)
        ends = np.cumsum(sizes)
        self.shift = [0] * self.buckets
        taken = bytearray(n)
        hashes = h.tolist()
        self.slots = [0] * n
        free = 0
        for b in np.argsort(-sizes, kind="stable").tolist():
            members = order[ends[b] - sizes[b] : ends[b]].tolist()
            if not members:
                break
            if len(members) == 1:
                while taken[free]:
                    free += 1
                taken[free], self.shift[b], self.slots[free] = 1, -1 - free, members[0]
                continue
            d = 0
            while True:
                at = [self._slot(hashes[m], d) for m in members]
                if len(set(at)) == len(at) and not any(taken[s] for s in at):
                    break
                d += 1
            self.shift[b] = d
            for m, s in zip(members, at, strict=True):
                taken[s] = 1
                self.slots[s] = m

    def _slot(self, h: int, d: int) -> int:
        if d < 0:
            return -1 - d
        x = ((h >> 17) ^ (d * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF
        x = (x ^ (x >> 29)) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
        return (x ^ (x >> 32)) % self.n

    def index(self, key: bytes) -> int:
        """Position of ``key`` among the keys; of any other key some position, so the caller compares."""
        h = xxhash.xxh3_64_intdigest(key)
        return self.slots[self._slot(h, self.shift[h % self.buckets])]


class TwoTierBPE:
    """Tier one: a pre-token that is in the vocabulary is one look-up.  Tier two: merges by a heap over linked bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.keys = list(ranks)
        self.ids = list(ranks.values())
        self.hash = MinimalPerfectHash(self.keys)
        self.find = regex.compile(pattern).findall
        self.bytes_of = dict(zip(self.ids, self.keys, strict=True))
        self.ranks = ranks
        self.parts = Memo(self._part)
        self.units = Units(self._unit)

    def rank(self, piece: bytes) -> int | None:
        i = self.hash.index(piece)
        return self.ids[i] if self.keys[i] == piece else None

    def merge(self, piece: bytes) -> list[int]:
        n = len(piece)
        rank, push, pop = self.ranks.get, heapq.heappush, heapq.heappop
        # A live part starts at i and ends where the next one, after[i], starts; merged starts are marked -1.
        after, before = list(range(1, n + 2)), list(range(-1, n))
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, j, e = pop(heap)
            if after[i] != j or j >= n or after[j] != e:
                continue
            after[i], after[j], before[e] = e, -1, i
            if e < n and (r := rank(piece[i : after[e]])) is not None:
                push(heap, (r, i, e, after[e]))
            if i and (r := rank(piece[(h := before[i]) : e])) is not None:
                push(heap, (r, h, i, e))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def _part(self, part: str) -> tuple[int, ...]:
        raw = part.encode()
        r = self.rank(raw)
        return tuple(self.merge(raw)) if r is None else (r,)

    def _unit(self, text: str) -> tuple[int, ...]:
        out: list[int] = []
        for p in self.find(text):
            out += self.parts[p]
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        return [i for unit in self.units.of(text) for i in unit]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def rank_file_encoder(path: str) -> TwoTierBPE:
    import base64

    with open(path, "rb") as f:
        return TwoTierBPE({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})
