"""Byte-level BPE encoding and decoding.

A pre-token's merges come from a segment tree over the ranks of its adjacent pairs. The root holds the leftmost pair
of the lowest rank; merging it changes at most three leaves, each a logarithmic update, until no pair can merge. Every
pre-token of two bytes or more goes through its tree, whatever its length; pre-tokens seen before come from a cache.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import map_rows, vocabulary

VOCABULARY = vocabulary("byte_bpe_50k.json")
# The vocabulary's published pre-token pattern, with Unicode's own white space: a fixed value.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 as it is, the rest from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


BITS = 20  # an id's; a pair is left << BITS | right
NEVER = 1 << 100
_NONE = np.int64(1 << 62)  # NEVER of Forest's arrays


def merge_all(ids: list[int], ranks: dict[int, int], merged: list[int]) -> list[int]:
    """Merge a pre-token's ids by a segment tree over its adjacent pairs. ranks: pair (as under BITS) to rank; merged: rank to id.

    Leaf i holds rank << bits | i of the pair that begins at place i, or NEVER; a node holds the less of its two children, so
    the root holds the leftmost pair of the lowest rank. A merge changes three leaves at most: its own, that of the
    place it empties, and that of the place before; each change goes up to the root, or until a node stays the same.
    """
    n = len(ids)
    if n < 2:
        return ids
    size = 1 << (n - 2).bit_length()
    bits = size.bit_length()
    mask = (1 << bits) - 1
    get = ranks.get
    tree = [NEVER] * (2 * size)
    for i in range(n - 1):
        rank = get(ids[i] << BITS | ids[i + 1])
        if rank is not None:
            tree[size + i] = rank << bits | i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    ids = ids[:]
    right, left = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, rank: int | None) -> None:
        value = NEVER if rank is None else rank << bits | i
        i += size
        while tree[i] != value:
            tree[i] = value
            if i == 1:
                return
            other = tree[i ^ 1]
            i >>= 1
            if other < value:
                value = other

    while (root := tree[1]) != NEVER:
        i = root & mask
        j = right[i]
        after, before = right[j], left[i]
        ids[i] = new = merged[root >> bits]
        ids[j] = -1
        right[i] = after
        if after < n:
            left[after] = i
            put(j, None)
            put(i, get(new << BITS | ids[after]))
        else:
            put(i, None)
        if before >= 0:
            put(before, get(ids[before] << BITS | new))
    return [x for x in ids if x >= 0]


class Forest:
    """merge_all() for many pre-tokens at once: their trees lie in one array, a row each, and change in step.

    Pre-tokens of one row have the same number of leaves, a power of two. In a round, every tree that has a pair left takes
    its root's, sets its three leaves, and sets the three ways up level by level.
    """

    def __init__(self, ranks: dict[int, int], merged: list[int], first: list[int]):
        pairs = np.fromiter(ranks.keys(), np.int64, len(ranks))
        order = np.argsort(pairs)
        self.pairs, self.ranks = pairs[order], np.fromiter(ranks.values(), np.int64, len(ranks))[order]
        self.merged, self.first = np.array(merged, np.int64), np.array(first, np.int64)
        self.tables = ranks, merged, first

    def rank_of(self, a: np.ndarray, b: np.ndarray, use: np.ndarray) -> np.ndarray:
        """Ranks of pairs, _NONE where there is none or `use` is false."""
        pair = a << BITS | b
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(use & (self.pairs[at] == pair), self.ranks[at], _NONE)

    def merge(self, words: list[bytes], cells: int = 1 << 20) -> list[tuple[int, ...]]:
        out: list[tuple[int, ...]] = [()] * len(words)
        groups: dict[int, list[int]] = {}
        for k, word in enumerate(words):
            groups.setdefault(max(1, 1 << (max(0, len(word) - 2)).bit_length()), []).append(k)
        for size, own in groups.items():
            if len(own) * 8 < size:  # few and long: the same tree, one after the other
                ranks, merged, first = self.tables
                for k in own:
                    out[k] = tuple(merge_all([first[b] for b in words[k]], ranks, merged))
                continue
            step = max(1, cells // size)
            for begin in range(0, len(own), step):
                part = own[begin : begin + step]
                for k, ids in zip(part, self.grown([words[k] for k in part], size), strict=True):
                    out[k] = ids
        return out

    def grown(self, words: list[bytes], size: int) -> list[tuple[int, ...]]:
        n, w = np.fromiter(map(len, words), np.int64, len(words)), size + 1
        raw = np.frombuffer(b"".join(x.ljust(w, b"\0") for x in words), np.uint8).reshape(len(words), w)
        place = np.arange(w)
        ids = np.where(place < n[:, None], self.first[raw], -1)
        bits = size.bit_length()
        tree = np.empty((len(words), 2 * size), np.int64)
        rank = self.rank_of(ids[:, :-1], ids[:, 1:], place[:-1] < n[:, None] - 1)
        tree[:, size:] = np.where(rank == _NONE, _NONE, rank << bits | place[:-1])
        level = size // 2
        while level:
            np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2], out=tree[:, level : 2 * level])
            level //= 2
        right, left = np.tile(place + 1, (len(words), 1)), np.tile(place - 1, (len(words), 1))
        flat_ids, flat_right, flat_left, nodes = ids.ravel(), right.ravel(), left.ravel(), tree.ravel()
        rows = np.arange(len(words))
        while True:
            root = nodes[rows * 2 * size + 1]
            rows = rows[root != _NONE]
            if not len(rows):
                break
            root = root[root != _NONE]
            at, i, new = rows * w, root & ((1 << bits) - 1), self.merged[root >> bits]
            j = flat_right[at + i]
            after = flat_right[at + j]
            before, more = flat_left[at + i], after < n[rows]
            flat_ids[at + i], flat_ids[at + j], flat_right[at + i] = new, -1, after
            flat_left[(at + after)[more]] = i[more]
            earlier = before >= 0
            own = self.rank_of(new, flat_ids[at + np.where(more, after, 0)], more)
            previous = self.rank_of(flat_ids[at + np.where(earlier, before, 0)], new, earlier)
            base = rows * 2 * size
            # Without a pair after it or before it, a place stands for its own leaf again.
            leaves = size + np.stack([i, np.where(more, j, i), np.where(earlier, before, i)])
            own = np.where(own == _NONE, _NONE, own << bits | i)
            nodes[base + leaves[1]] = _NONE
            nodes[base + leaves[2]] = np.where(previous == _NONE, _NONE, previous << bits | before)
            nodes[base + leaves[0]] = own
            up = leaves >> 1
            while up[0, 0]:
                children = base + 2 * up
                nodes[base + up] = np.minimum(nodes[children], nodes[children + 1])
                up >>= 1
        kept = ids >= 0
        values, ends = ids[kept].tolist(), np.cumsum(kept.sum(1)).tolist()
        return [tuple(values[a:b]) for a, b in zip([0, *ends], ends)]


class ByteBPE:
    """Encodes and decodes with a byte-level BPE vocabulary file."""

    def __init__(self, path: str = VOCABULARY, cached_words: int = 300_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        letters = byte_alphabet()
        self.first = [0] * 256
        for ch, b in letters.items():
            self.first[b] = vocab[ch]
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault(vocab[a] << BITS | vocab[b], rank)
            self.merged.append(vocab[a + b])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.raw = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            self.raw[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        for token, i in self.special.items():
            self.raw[i] = token.encode()
        self.decimal = [str(i) for i in range(len(self.raw))]
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.split = regex.compile(PRETOKEN).findall
        self.loose = re.compile(r"^\s|\s\s|\s\Z").search
        self.forest = Forest(self.ranks, self.merged, self.first)
        self.most = cached_words
        self.words: dict[str, tuple[int, ...]] = {}  # of a pre-token
        self.spaced: dict[str, tuple[int, ...]] = {}  # of what stands between two spaces, with the first of them

    def learn(self, words: set[str], spaced: set[str]) -> None:
        """Ids of pre-tokens, and of stretches between spaces through those of their pre-tokens."""
        own = list(spaced)
        parts = [self.split(" " + w) for w in own]
        new = list((words | set(chain.from_iterable(parts))) - self.words.keys())
        self.words.update(zip(new, self.forest.merge([w.encode("utf-8") for w in new])))
        word = self.words.__getitem__
        for w, p in zip(own, parts, strict=True):
            self.spaced[w] = word(p[0]) if len(p) == 1 else tuple(chain.from_iterable(map(word, p)))

    def cut_up(self, text: str) -> tuple[list[str], list[str]]:
        """The first pre-tokens of a text without special tokens, and the stretches between spaces that follow.

        Where white space comes alone and between other characters, no pre-token crosses from one side of a space to
        the other but for the space itself, so each stretch between spaces stands for itself; else the pattern splits all.
        """
        if self.loose(text):
            return self.split(text), []
        first, *rest = text.split(" ")
        return self.split(first), rest

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text. The caches are emptied when they have grown past their bound, before a batch."""
        if len(self.words) > self.most:
            self.words = {}
        if len(self.spaced) > 2 * self.most:
            self.spaced = {}
        every = []  # of each text its parts: a special token's id, or words and stretches
        for text in texts:
            pieces = self.cut.split(text) if self.cut is not None and any(s in text for s in self.special) else (text,)
            every.append([self.special[p] if p in self.special else self.cut_up(p) for p in pieces])
        plain = [p for parts in every for p in parts if not isinstance(p, int)]
        words = set(chain.from_iterable(p[0] for p in plain)) - self.words.keys()
        spaced = set(chain.from_iterable(p[1] for p in plain)) - self.spaced.keys()
        if words or spaced:
            self.learn(words, spaced)
        word, stretch = self.words.__getitem__, self.spaced.__getitem__
        out = []
        for parts in every:
            ids: list[int] = []
            for p in parts:
                if isinstance(p, int):
                    ids.append(p)
                else:
                    ids.extend(chain.from_iterable(map(word, p[0])))
                    ids.extend(chain.from_iterable(map(stretch, p[1])))
            out.append(ids)
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def codec_of(path: str, cached_words: int) -> ByteBPE:
    """One codec a worker process: what it has cached serves later tasks."""
    return ByteBPE(path, cached_words)


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY, cached_words: int = 300_000, step_chars: int = 1 << 20, with_ids: bool = True, with_text: bool = True) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids and the decoded text.

    Whole texts are encoded, then decoded from their ids. A null text is empty: no ids and the hashes of nothing.
    Special tokens' strings in a text become their ids. Repeated rows are answered each, an empty table gives an empty
    one, other columns are ignored. A very long pre-token costs n log n.
    """
    schema = "id " + dict(docs.dtypes)[id_col] + ", n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded string" * with_text

    def make():
        codec = codec_of(path, cached_words)
        decimal = codec.decimal.__getitem__

        def step(batch):
            out: dict = {"id": batch.column("id"), "n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": [], "decoded": []}
            texts = [t or "" for t in batch.column("text").to_pylist()]
            i = 0
            while i < len(texts):
                j, held = i, 0
                while j < len(texts) and (j == i or held + len(texts[j]) <= step_chars):
                    held += len(texts[j])
                    j += 1
                for ids in codec.encode_batch(texts[i:j]):
                    decoded = codec.decode(ids)
                    out["n_tokens"].append(len(ids))
                    out["ids_sha256"].append(hashlib.sha256(",".join(map(decimal, ids)).encode()).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(decoded.encode("utf-8")).hexdigest())
                    if with_ids:
                        out["ids"].append(ids)
                    if with_text:
                        out["decoded"].append(decoded)
                i = j
            return out

        return step

    return map_rows(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), schema, make).withColumnRenamed("id", id_col)
