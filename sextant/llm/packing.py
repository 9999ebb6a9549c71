"""Cost-balanced packing of token sequences.

A piece of n tokens costs linear * n + quadratic * n * n, the attention estimate. Within a block, pieces go in
descending order to the sequence of lowest cost that still has room; a piece that fits nowhere opens a sequence.
Blocks are dealt by hash, so one block's work and memory are bounded however many documents there are.
"""

from __future__ import annotations

import gc
import heapq
import math
import unicodedata
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import Scratch, map_rows, vocabulary

VOCABULARY = vocabulary("word_bpe_49k.json")
# The vocabulary's own pre-token pattern: a fixed value.
# str.split() also takes these for white space, which Unicode's property doesn't.
_SEPARATORS = regex.compile("[\x1c-\x1f]")
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"


class WordIds:
    """Text to ids as little-endian 32-bit bytes; unseen words go to the tokenizers library's model, a batch at a time.

    No pre-token of this vocabulary holds white space, so the ids of a text are those of its words, one after another.
    """

    def __init__(self, path: str = VOCABULARY, cached_words: int = 600_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        # The model alone, for pre-tokens that are folded already: neither the normalizer nor the pattern runs again.
        self.model = Tokenizer(self.library.model)
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.library.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(1 + max(vocab.values()), bool)
        for token, i in vocab.items():
            self.ends[i] = token.endswith("</w>")
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.split = regex.compile(PRETOKEN).findall
        self.spaced = regex.compile(r"\P{White_Space}+").findall
        self.tokens: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.most = cached_words

    @staticmethod
    def folded(text: str) -> str:
        """As the vocabulary's normalizer does: NFC, then lower case letter by letter (no final sigma)."""
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        return "".join(c.lower() for c in text) if "Σ" in text else text.lower()

    def learn(self, words: list[str]) -> None:
        """Ids of new words, through those of their pre-tokens; new pre-tokens in one call, cut where a token ends a word."""
        folded = self.folded("\n".join(words)).split("\n")  # folding leaves line ends where they are
        parts = [[w] if w.isalpha() else [w[:-1], w[-1]] if w[-1] in ".,!?" and w[:-1].isalpha() else self.split(w) for w in folded]
        new = list(set(chain.from_iterable(parts)).difference(self.tokens))
        if new:
            ids = np.array(self.model.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, np.uint32)
            after = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(after) == len(new):
                raw = ids.astype("<u4").tobytes()
                self.tokens.update(zip(new, map(raw.__getitem__, map(slice, chain((0,), after), after)), strict=True))
            else:
                for token in new:
                    self.tokens[token] = np.array(self.library.encode(token, add_special_tokens=False).ids, "<u4").tobytes()
        token = self.tokens
        self.words.update(zip(words, [token[own[0]] if len(own) == 1 else b"".join([token[t] for t in own]) for own in parts], strict=True))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Each text's ids. Words are looked up in passes over a batch that run inside the interpreter's own functions."""
        if len(self.words) >= self.most:
            self.words = {}
        if len(self.tokens) >= self.most:
            self.tokens = {}
        parts = [list(chain.from_iterable([p] if p in self.special else self.spaced(p) if _SEPARATORS.search(p) else p.split() for p in self.cut.split(t))) if any(s in t for s in self.special) else self.spaced(t) if _SEPARATORS.search(t) else t.split() for t in texts]
        for s, i in self.special.items():
            self.words[s] = np.array([i], "<u4").tobytes()
        fresh = set().union(*parts).difference(self.words)
        if fresh:
            self.learn(list(fresh))
        return [b"".join(map(self.words.__getitem__, own)) for own in parts]


@lru_cache(maxsize=1)
def codec_of(path: str, cached_words: int) -> WordIds:
    """One codec a worker process: what it has cached serves later tasks."""
    return WordIds(path, cached_words)


def pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 1, path: str = VOCABULARY, cached_words: int = 600_000, step_bytes: int = 1 << 20) -> DataFrame:
    """Tokenize and cut: rows (id, start, length, ids_crc32, doc_tokens), each of at most `capacity` ids.

    A document's ids end with end_id, so a null or empty text is one piece of one id. All pieces but a document's
    last are full.
    """
    schema = "id " + dict(docs.dtypes)[id_col] + ", start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    tail = np.array([end_id], "<u4").tobytes()

    def make():
        codec = codec_of(path, cached_words)

        def step(batch):
            rows, out = batch.column("text"), {k: [] for k in ("at", "start", "length", "ids_crc32", "doc_tokens")}
            sizes = pc.fill_null(pc.binary_length(rows), 0).to_pylist()
            i, n = 0, len(rows)
            while i < n:
                j, held = i, 0
                while j < n and (j == i or held + sizes[j] <= step_bytes):
                    held += sizes[j]
                    j += 1
                gc.disable()  # only short lists without cycles are made, and many
                try:
                    encoded = codec.encode_batch([t or "" for t in rows.slice(i, j - i).to_pylist()])
                finally:
                    gc.enable()
                for at, raw in enumerate(encoded, i):
                    raw += tail
                    total = len(raw) // 4
                    for start in range(0, total, capacity):
                        own = raw[4 * start : 4 * (start + capacity)]
                        out["at"].append(at)
                        out["start"].append(start)
                        out["length"].append(len(own) // 4)
                        out["ids_crc32"].append(zlib.crc32(own))
                        out["doc_tokens"].append(total)
                i = j
            return {"id": batch.column("id").take(pa.array(out.pop("at"), pa.int64()))} | out

        return step

    return map_rows(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), schema, make)


def assign(lengths: np.ndarray, capacity: int, linear: float, quadratic: float) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece; lengths descend.

    The number of sequences begins at the least that can hold all tokens and grows when a piece fits nowhere. Open
    sequences lie in one heap by cost for each remaining room; the cheapest of those with enough room takes the piece.
    """
    n = len(lengths)
    sequence, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    least = max(1, math.ceil(int(lengths.sum()) / capacity))
    used, cost = [0] * least, [0.0] * least
    width = max(1, int(math.isqrt(capacity)))
    groups: list[list[tuple[float, int, int]]] = [[] for _ in range(capacity // width + 1)]  # by room // width; stale entries are skipped

    def push(s: int) -> None:
        room = capacity - used[s]
        if room:
            heapq.heappush(groups[room // width], (cost[s], s, used[s]))

    for s in range(least):
        push(s)
    for k in range(n):
        need, best = int(lengths[k]), None
        for g in range(need // width, len(groups)):
            heap, aside = groups[g], []
            while heap:
                c, s, was = heap[0]
                if was != used[s]:
                    heapq.heappop(heap)
                elif capacity - was < need:  # only in the first group
                    aside.append(heapq.heappop(heap))
                else:
                    if best is None or (c, s) < best:
                        best = (c, s)
                    break
            for entry in aside:
                heapq.heappush(heap, entry)
        if best is None:
            s = len(used)
            used.append(0)
            cost.append(0.0)
        else:
            s = best[1]
        sequence[k], offset[k] = s, used[s]
        used[s] += need
        cost[s] += linear * need + quadratic * need * need
        push(s)
    return sequence, offset


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 1, path: str = VOCABULARY, linear: float = 1.0, quadratic: float = 1.0 / 2048, block_pieces: int = 4096, cached_words: int = 600_000) -> DataFrame:
    """One row a piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Pieces are written to the shared folder, so texts are tokenized once, and counted there. They are dealt to blocks of
    about block_pieces by a hash of id, start and ids, so a long document's pieces lie in many blocks and a block's rows
    are bounded; each block is packed by itself. Sequence ids are block * 2**32 + number. Null and empty texts are one
    piece (the end id). Repeated rows are packed each. Ties of length go by id, then start. An empty table gives an empty
    one; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    cut = scratch.written(pieces(docs, id_col=id_col, text_col=text_col, capacity=capacity, end_id=end_id, path=path, cached_words=cached_words), "pieces")
    blocks = max(1, math.ceil(cut.count() / block_pieces))
    dealt = cut.withColumn("block", F.pmod(F.xxhash64("id", "ids_crc32", "start"), F.lit(blocks)))
    schema = "id " + dict(docs.dtypes)[id_col] + ", start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        block = table.column("block")[0].as_py()
        sequence, offset = assign(table.column("length").to_numpy(), capacity, linear, quadratic)
        return table.drop_columns(["block"]).append_column("sequence_id", pa.array(sequence + (block << 32), pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    return dealt.groupBy("block").applyInArrow(one, schema).withColumnRenamed("id", id_col)
