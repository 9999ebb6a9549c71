"""Log-likelihood of whole documents under a gated recurrent language model, in numpy.

Tokens are words and an end. The output softmax is factored: first a class, then a word within it. The most frequent
words have classes of their own kind, `width` words each, and a softmax within the class that depends on the state; the
others fall to classes by their last letters and are drawn there by their counts. Training is truncated backpropagation
over every window; the state goes on from window to window to a document's end. Documents lie end to end in parallel streams.

Word counts are counts of 64-bit hashes over all training text. After them texts are read once more, as tokens; training and
scoring go on from those. The bounded set of frequent words goes to every task;
the counts of the rest are joined.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import Scratch
from sextant.llm.shingles import words_of

END = np.uint64(0xE5D)  # the end token's hash
_STEP = 1 << 20


@dataclass(frozen=True)
class Shape:
    """Sizes of the model. frequent: words whose counts are sent to all tasks, the bound of that broadcast."""

    hidden: int = 24
    head_classes: int = 16
    width: int = 64
    tail_classes: int = 16
    frequent: int = 1 << 18
    streams: int = 256
    window: int = 24
    buffer_docs: int = 16384
    block_tokens: int = 1 << 21
    rate: float = 0.05

    @property
    def head(self) -> int:
        return self.head_classes * self.width


def steps_of(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Hashes and last letters of the tokens of about a megabyte of texts at a time, and where each text's tokens begin
    (one more entry: the end). Every text's last token is its end."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    i = 0
    while i < len(raw):
        j, held = i, 0
        while j < len(raw) and (j == i or held + len(raw[j]) <= _STEP):
            held += len(raw[j])
            j += 1
        words, at, tails = words_of(raw[i:j])
        yield np.insert(words, at[1:], END), np.insert(tails, at[1:], 0), at + np.arange(len(at))
        i = j


def tokens_of(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, last letters) of each text's tokens, the end token last."""
    for hashes, tails, at in steps_of(texts):
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield hashes[a:b], tails[a:b]


def tail_class(tails: np.ndarray, classes: int) -> np.ndarray:
    return (tails.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % classes


def count_words(docs: DataFrame, text_col: str, classes: int, most: int = 1 << 20) -> DataFrame:
    """(word, class, n) over all whole texts; each task adds up what it can hold first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, groups, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        pending: list = []
        size = 0

        def merge():
            nonlocal words, groups, counts, pending, size
            w = np.concatenate([words, *(p[0] for p in pending)])
            g = np.concatenate([groups, *(tail_class(p[1], classes) for p in pending)])
            n = np.concatenate([counts, np.ones(size, np.int64)])
            order = np.argsort(w, kind="stable")
            w = w[order]
            first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]])) if len(w) else np.zeros(0, np.int64)
            words, groups = w[first], g[order][first]
            counts = np.add.reduceat(n[order], first) if len(first) else n
            pending, size = [], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array(words.astype(np.int64)), pa.array(groups), pa.array(counts)], ["word", "class", "n"])

        for batch in batches:
            for hashes, tails, _ in steps_of(batch.column("text").to_pylist()):
                pending.append((hashes, tails))
                size += len(hashes)
                if size >= most:
                    merge()
            if len(words) >= most:
                yield out()
                words, groups, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        merge()
        yield out()

    part = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "word long, class long, n long")
    return part.groupBy("word").agg(F.min("class").alias("class"), F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, counts and classes of at most `most` words, by descending count, then word.

    A histogram over bands of counts, 64 to a factor of e, says from which band on all words fit; so no task sorts or
    gathers more than the words that are sent.
    """
    band = F.floor(F.log(F.col("n").cast("double")) * 64).cast("int")
    sizes = counts.groupBy(band.alias("band")).agg(F.count("*").alias("k")).collect()
    least, held = math.inf, 0
    for row in sorted(sizes, key=lambda r: -r["band"]):
        held += row["k"]
        if held > most:
            break
        least = row["band"]
    rows = counts.where(band >= least).toArrow() if least < math.inf else None
    if rows is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    words, n, classes = rows.column("word").to_numpy().astype(np.int64), rows.column("n").to_numpy(), rows.column("class").to_numpy()
    order = np.lexsort((words, -n))
    return words[order].view(np.uint64), n[order], classes[order]


class Frequent:
    """The frequent words, by hash: counts, and the model's ids of the first of them."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, shape: Shape):
        """words and counts by descending count."""
        rank = np.arange(len(words))
        self.order = np.argsort(words, kind="stable")
        self.words, self.counts, self.rank = words[self.order], counts[self.order], rank[self.order]
        self.shape = shape
        # Where the words of each bucket, the first bits of a hash, begin.
        bits = min(20, max(1, 2 + len(words).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.words, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def places(self, hashes: np.ndarray, most: int = 8) -> np.ndarray:
        """np.searchsorted(words, hashes), the last place at most: from a bucket's begin a few places on, as buckets are small."""
        last = len(self.words) - 1
        at = np.minimum(self.first[(hashes >> self.shift).view(np.int64)], last)
        todo = np.flatnonzero(self.words[at] < hashes)
        for _ in range(most):
            if not len(todo):
                break
            at[todo] += 1
            todo = todo[at[todo] <= last]
            todo = todo[self.words[at[todo]] < hashes[todo]]
        if len(todo):
            at[todo] = np.searchsorted(self.words, hashes[todo])
        return np.minimum(at, last, out=at)

    def head_counts(self) -> np.ndarray:
        """Counts of the head words, by rank."""
        out = np.zeros(len(self.words), np.int64)
        out[self.rank] = self.counts
        return out[: self.shape.head]

    def look_up(self, hashes: np.ndarray, tails: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The model's id of each token (a head word, or head + tail class) and its count, -1 if it isn't frequent."""
        ids = self.shape.head + tail_class(tails, self.shape.tail_classes)
        if not len(self.words):
            return ids, np.full(len(hashes), -1, np.int64)
        at = self.places(hashes)
        known = self.words[at] == hashes
        rank = self.rank[at]
        return np.where(known & (rank < self.shape.head), rank, ids), np.where(known, self.counts[at], -1)


def streams_of(docs: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents laid end to end in at most n streams of about equal length: (ids, document) matrices over time, -1 for none."""
    n = max(1, min(n, len(docs)))
    heap, rows = [(0, s) for s in range(n)], [[] for _ in range(n)]
    for d in sorted(range(len(docs)), key=lambda d: -len(docs[d])):
        used, s = heapq.heappop(heap)
        rows[s].append(d)
        heapq.heappush(heap, (used + len(docs[d]), s))
    length = max(used for used, _ in heap)
    ids, owner = np.full((length, n), -1, np.int32), np.full((length, n), -1, np.int32)
    for s, own in enumerate(rows):
        at = 0
        for d in own:
            ids[at : at + len(docs[d]), s] = docs[d]
            owner[at : at + len(docs[d]), s] = d
            at += len(docs[d])
    return ids, owner


class Model:
    """GRU with a table of input projections, class weights and within-class weights."""

    def __init__(self, shape: Shape, weights: dict[str, np.ndarray] | None = None, seed: int = 5):
        self.shape, h, ids = shape, shape.hidden, shape.head + shape.tail_classes + 1
        rng = np.random.default_rng(seed)
        small = lambda *n: (rng.standard_normal(n) * 0.1).astype(np.float32)
        self.w = weights or {
            "table": small(ids, 3 * h), "gates": small(h, 2 * h), "candidate": small(h, h),
            "classes": small(h, shape.head_classes + shape.tail_classes), "class_bias": np.zeros(shape.head_classes + shape.tail_classes, np.float32),
            "words": small(shape.head_classes, h, shape.width), "word_bias": np.zeros((shape.head_classes, shape.width), np.float32),
        }
        self.squares: dict[str, np.ndarray] = {}
        self.pending: dict[str, np.ndarray] = {}
        self.tokens = 0

    def begin(self, head: np.ndarray, tails: np.ndarray) -> None:
        """Set the biases to the logarithms of the head words' and the tail classes' counts: the state has no say yet."""
        full = np.zeros(self.shape.head)
        full[: len(head)] = head
        full = full.reshape(self.shape.head_classes, self.shape.width)
        self.w["word_bias"] = np.log(full + 1e-3).astype(np.float32)
        self.w["class_bias"] = np.log(np.concatenate([full.sum(1), tails]) + 1e-3).astype(np.float32)

    def run(self, docs: list[np.ndarray], train: bool) -> np.ndarray:
        """Natural log-probability of each document's classes and head words; with train, it also learns from every window.

        Streams lie along the last axis, so that numpy's loops run over them and not over the few numbers of a state.
        """
        shape, w, h = self.shape, self.w, self.shape.hidden
        scores = np.zeros(len(docs))
        if not docs:
            return scores
        ids, owner = streams_of(docs, shape.streams)
        start = shape.head + shape.tail_classes
        state = np.zeros((h, ids.shape[1]), np.float32)
        for t0 in range(0, len(ids), shape.window):
            own, who = ids[t0 : t0 + shape.window], owner[t0 : t0 + shape.window]
            live = np.flatnonzero(own[0] >= 0)
            if len(live) < own.shape[1]:  # streams end, and don't begin again
                own, who = own[:, live], who[:, live]
            before = owner[t0 - 1][live] if t0 else np.full(len(live), -1)
            previous = np.vstack([before[None], who[:-1]])
            fresh = who != previous
            inputs = np.where(fresh, start, np.vstack([ids[t0 - 1][live][None] if t0 else own[:1], own[:-1]]))
            inputs[own < 0] = start
            x = np.ascontiguousarray(w["table"][inputs].transpose(0, 2, 1))
            gates, candidate = np.ascontiguousarray(w["gates"].T), np.ascontiguousarray(w["candidate"].T)
            last = state[:, live]
            keep = np.empty((5 if train else 1, len(own), h, own.shape[1]), np.float32)  # new states; with train also old ones, gates and candidates
            for t in range(len(own)):
                if fresh[t].any():
                    last = np.where(fresh[t], np.float32(0), last)
                rz = gates @ last
                rz += x[t, : 2 * h]
                rz *= np.float32(0.5)
                np.tanh(rz, out=rz)
                rz *= np.float32(0.5)
                rz += np.float32(0.5)
                r, z = rz[:h], rz[h:]
                c = candidate @ (r * last)
                c += x[t, 2 * h :]
                np.tanh(c, out=c)
                if train:
                    keep[1, t], keep[2, t], keep[3, t], keep[4, t] = last, r, z, c
                new = last - c
                new *= z
                new += c
                keep[0, t] = last = new
            state[:, live] = last
            valid = np.flatnonzero(own >= 0)
            flat = keep[0].transpose(1, 0, 2).reshape(h, -1)
            if len(valid) < own.size:
                flat = flat.take(valid, 1)
            target = own.ravel()[valid]
            logp, grad = self.output(flat, target, train)
            scores += np.bincount(who.ravel()[valid], weights=logp, minlength=len(docs))
            if train:
                back = np.zeros((h, own.size), np.float32)
                back[:, valid] = grad["state"]
                self.learn(inputs, fresh, keep, back.reshape(h, *own.shape), grad, len(target))
        return scores

    def output(self, flat: np.ndarray, target: np.ndarray, train: bool) -> tuple[np.ndarray, dict]:
        shape, w = self.shape, self.w
        head = target < shape.head
        cls = np.where(head, target // shape.width, shape.head_classes + target - shape.head)
        logits = w["classes"].T @ flat
        logits += w["class_bias"][:, None]
        logits -= logits.max(0)
        e = np.exp(logits)
        total = e.sum(0)
        columns = np.arange(flat.shape[1])
        logp = (logits[cls, columns] - np.log(total)).astype(np.float64)
        grad: dict = {}
        if train:
            e /= total
            e[cls, columns] -= 1
            grad = {"classes": flat @ e.T, "class_bias": e.sum(1), "state": w["classes"] @ e, "words": np.zeros_like(w["words"]), "word_bias": np.zeros_like(w["word_bias"])}
        at = np.flatnonzero(head)
        at = at[np.argsort(cls[at].astype(np.int16), kind="stable")]
        ends = np.searchsorted(cls[at], np.arange(shape.head_classes + 1))
        f_all, words, inside = flat.take(at, 1), target[at] % shape.width, np.zeros(len(at))
        back = np.zeros((len(f_all), len(at) + 1), np.float32) if train else None  # the last column: of tokens that are no head words
        for k in range(shape.head_classes):
            own = slice(ends[k], ends[k + 1])
            word, f = words[own], f_all[:, own]
            if len(word):
                inner = w["words"][k].T @ f
                inner += w["word_bias"][k][:, None]
                inner -= inner.max(0)
                i = np.arange(len(word))
                inside[own] = inner[word, i]
                ei = np.exp(inner, out=inner)
                ti = ei.sum(0)
                inside[own] -= np.log(ti)
                if train:
                    ei /= ti
                    ei[word, i] -= 1
                    grad["words"][k], grad["word_bias"][k] = f @ ei.T, ei.sum(1)
                    back[:, own] = w["words"][k] @ ei
        logp[at] += inside
        if train:
            place = np.full(len(target), len(at))
            place[at] = np.arange(len(at))
            grad["state"] += back.take(place, 1)
        return logp, grad

    def learn(self, inputs, fresh, keep, back, grad, n) -> None:
        """Backpropagation through the window. A step waits until the gradients of half a full window's tokens have come
        together, so that where few streams are left, a single long document doesn't lead the model away."""
        w, h = self.w, self.shape.hidden
        _, last, r, z, c = keep
        table = np.empty((len(inputs), 3 * h, inputs.shape[1]), np.float32)
        by_candidate, by_update, by_reset = (1 - z) * (1 - c * c), (last - c) * z * (1 - z), last * r * (1 - r)
        carried = np.zeros_like(back[:, 0])
        for t in range(len(inputs) - 1, -1, -1):
            d = back[:, t] + carried
            dc = d * by_candidate[t]
            drh = w["candidate"] @ dc
            table[t, :h], table[t, h : 2 * h], table[t, 2 * h :] = drh * by_reset[t], d * by_update[t], dc
            carried = w["gates"] @ table[t, : 2 * h]
            d *= z[t]
            drh *= r[t]
            carried += d
            carried += drh
            carried[:, fresh[t]] = 0
        flat = table.transpose(0, 2, 1).reshape(-1, 3 * h)
        grad["gates"] = last.transpose(1, 0, 2).reshape(h, -1) @ flat[:, : 2 * h]
        grad["candidate"] = (r * last).transpose(1, 0, 2).reshape(h, -1) @ flat[:, 2 * h :]
        order = np.argsort(inputs.astype(np.int16) if len(w["table"]) < 1 << 15 else inputs, axis=None, kind="stable")
        at = inputs.ravel()[order]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        touched = at[first]
        rows = np.add.reduceat(flat[order], first)
        own = self.pending.setdefault("table", np.zeros_like(w["table"]))
        own[touched] += rows
        for name, g in grad.items():
            if name != "state":
                self.pending[name] = self.pending[name] + g if name in self.pending else g
        self.tokens += n
        if self.tokens >= self.shape.window * self.shape.streams // 2:
            self.descend()

    def descend(self) -> None:
        """One AdaGrad step with the gradients gathered so far, if there are any."""
        if not self.tokens:
            return
        for name, g in self.pending.items():
            g = np.clip(g * np.float32(32 / self.tokens), -1, 1)
            s = self.squares.setdefault(name, np.full_like(self.w[name], 0.1))
            s += g * g
            self.w[name] -= np.float32(self.shape.rate) * g / np.sqrt(s)
        self.pending, self.tokens = {}, 0

    def packed(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.w.values()])

    def unpacked(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for k, v in self.w.items():
            out[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size
        return out


@dataclass(frozen=True)
class Corpus:
    """Texts as tokens, with what the training rows' counts say of them.

    encoded: row, id, train, tokens (the model's ids), n_known, base, tail, rest, times: the sums over frequent words of the
    base score and of the tail words' shares in their classes, and the hashes of the other words with their numbers.
    """

    encoded: DataFrame
    counts: DataFrame
    frequent: Frequent
    class_sums: np.ndarray
    n: int
    v: int
    shape: Shape
    scratch: Scratch

    @property
    def class_log(self) -> np.ndarray:
        """log10 of each tail class's counts, one more for each of its words."""
        return np.log10(self.class_sums.sum(1) + 1)


def prepare(docs: DataFrame, is_train: Column, *, id_col: str = "doc_id", text_col: str = "text", shape: Shape = Shape()) -> Corpus:
    """Count the training texts' words, then read every text once more as tokens, which are written to the shared folder."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "language-model")
    counts = scratch.written(count_words(docs.where(is_train), text_col, shape.tail_classes), "counts")
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    words, numbers, classes = most_frequent(counts, shape.frequent)
    frequent = Frequent(words, numbers, shape)
    sums = np.zeros((shape.tail_classes, 2))
    for r in counts.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        sums[r["class"]] = r["n"], r["v"]
    if len(numbers):
        np.subtract.at(sums, classes[: shape.head], np.stack([numbers[: shape.head], np.ones(min(len(numbers), shape.head))], 1))
    sent = spark.sparkContext.broadcast((frequent, np.log10(sums.sum(1) + 1)))
    least = math.log10(n + v + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, class_log = sent.value
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("tokens", "n_known", "base", "tail", "rest", "times", "n_tokens", "n_rest")}
            for hashes, tails, at in steps_of(batch.column("text").to_pylist()):
                ids, c = frequent.look_up(hashes, tails)
                known, tail, sizes = c >= 0, ids >= shape.head, np.diff(at)
                logs = np.log10(np.maximum(c, 0) + 1.0)
                shares = np.where(tail, logs - class_log[np.maximum(ids - shape.head, 0)], 0)
                out["tokens"].append(ids.astype(np.int16))
                out["n_tokens"].append(sizes)
                for name, of in (("n_known", known.astype(np.int64)), ("base", logs), ("tail", shares)):
                    out[name].append(np.add.reduceat(of, at[:-1]))  # no text is without a token
                out["base"][-1] -= sizes * least
                rest, owner = hashes[~known], np.repeat(np.arange(len(sizes)), sizes)[~known]
                order = np.lexsort((rest, owner))
                rest, owner = rest[order], owner[order]
                begin = np.flatnonzero(np.append(True, (rest[1:] != rest[:-1]) | (owner[1:] != owner[:-1]))) if len(rest) else np.zeros(0, np.int64)
                out["rest"].append(rest[begin].view(np.int64))
                out["times"].append(np.diff(np.append(begin, len(rest))))
                out["n_rest"].append(np.bincount(owner[begin], minlength=len(sizes)))
            flat = {k: np.concatenate([np.zeros(0, np.float64 if k in ("base", "tail") else np.int16 if k == "tokens" else np.int64), *v]) for k, v in out.items()}
            lists = []
            for name, sizes in (("tokens", "n_tokens"), ("rest", "n_rest"), ("times", "n_rest")):
                at = np.concatenate([[0], np.cumsum(flat[sizes])]).astype(np.int32)
                lists.append(pa.ListArray.from_arrays(pa.array(at), pa.array(flat[name])))
            rows = pa.array(row + np.arange(len(batch)), pa.int64())
            row += len(batch)
            yield pa.RecordBatch.from_arrays([rows, batch.column("id"), batch.column("train"), lists[0], pa.array(flat["n_known"]), pa.array(flat["base"]), pa.array(flat["tail"]), *lists[1:]], ["row", "id", "train", "tokens", "n_known", "base", "tail", "rest", "times"])

    plain = docs.select(F.col(id_col).alias("id"), F.coalesce(is_train, F.lit(False)).alias("train"), F.col(text_col).cast("string").alias("text"))
    schema = f"row long, id {dict(docs.dtypes)[id_col]}, train boolean, tokens array<short>, n_known long, base double, tail double, rest array<long>, times array<long>"
    encoded = scratch.written(plain.mapInArrow(run, schema), "encoded")
    return Corpus(encoded, counts, frequent, sums, n, v, shape, scratch)


def _tokens(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    """Each row's tokens."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, at = column.flatten().to_numpy(zero_copy_only=False).astype(np.int32), column.offsets.to_numpy()
    at = at - at[0]
    return [flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def fit(corpus: Corpus, *, start_docs: int = 256) -> dict[str, np.ndarray]:
    """Weights after one pass over all training texts, every window of them.

    Texts are dealt to blocks of about block_tokens by a hash of their ids and tokens. Every block goes on from a common start
    with its own texts, in the order of their hashes; the blocks' weights are averaged by their numbers of tokens. So
    the weights depend on the rows, not on how they are partitioned (but for the last bits of sums). The start has
    the counts of all training text as biases and the rest from start_docs texts, its bound, those of the least hashes.
    """
    shape, scratch = corpus.shape, corpus.scratch
    spark = corpus.encoded.sparkSession
    train = corpus.encoded.where("train").select(F.xxhash64("id", "tokens").alias("key"), "tokens")
    first = Model(shape)
    first.begin(corpus.frequent.head_counts(), corpus.class_sums[:, 0])
    chosen = train.orderBy("key").limit(start_docs).toArrow() if start_docs else None
    if chosen is not None and len(chosen):
        first.run(_tokens(chosen.column("tokens")), True)
        first.descend()
    if not corpus.n:
        return first.w
    sent = spark.sparkContext.broadcast(first.w)
    blocks = max(1, -(-corpus.n // shape.block_tokens))

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        docs = _tokens(table.column("tokens"))
        model, n = Model(shape, {k: v.copy() for k, v in sent.value.items()}), sum(map(len, docs))
        for i in range(0, len(docs), shape.buffer_docs):
            model.run(docs[i : i + shape.buffer_docs], True)
        model.descend()  # gradients that no full step took up
        return pa.table({"block": table.column("block").slice(0, 1), "n": pa.array([n], pa.int64()), "sums": pa.array([model.packed().astype("<f8") * n]).cast(pa.list_(pa.float64()))})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            for k, v in zip(batch.column("n").to_pylist(), batch.column("sums"), strict=True):
                own = np.asarray(v.values)
                n, total = n + k, own.copy() if total is None else total + own
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total]).cast(pa.list_(pa.float64()))], ["n", "sums"])

    dealt = train.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)))
    parts = scratch.written(dealt.groupBy("block").applyInArrow(one, "block long, n long, sums array<double>"), "weights")
    sums = parts.repartition(8, "block").sortWithinPartitions("block").select("n", "sums").mapInArrow(add, "n long, sums array<double>").collect()
    n = sum(r["n"] for r in sums)
    return first.unpacked(sum(np.asarray(r["sums"]) for r in sums) / n) if n else first.w


def scored(corpus: Corpus, weights: dict[str, np.ndarray]) -> DataFrame:
    """One row for each text: row, id, n_tokens, n_known, base, lm and, for words that aren't frequent, rest and times."""
    shape = corpus.shape
    sent = corpus.encoded.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(shape, sent.value)
        for batch in batches:
            for i in range(0, len(batch), shape.buffer_docs):
                own = batch.slice(i, shape.buffer_docs)
                docs = _tokens(own.column("tokens"))
                lm = model.run(docs, False) / math.log(10)
                yield pa.RecordBatch.from_arrays([own.column("row"), pa.array([len(d) for d in docs], pa.int64()), pa.array(lm, pa.float64())], ["row", "n_tokens", "lm"])

    lm = corpus.encoded.select("row", "tokens").mapInArrow(run, "row long, n_tokens long, lm double")
    return corpus.scratch.written(lm, "scored")


def score(docs: DataFrame, is_train: Column, *, id_col: str = "doc_id", text_col: str = "text", shape: Shape = Shape()) -> DataFrame:
    """One row for each input row: id, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities).

    is_train is a condition on the columns of docs; counts and weights come from those rows alone, all of them and their
    whole texts. An unseen word counts 0; within its class it gets the share of one count. A null text is empty: the end
    token alone. Without training rows every count is 0 and the model stays as it begins. Repeated rows are answered
    each, null ids too; an empty table gives an empty one; other columns are ignored.
    """
    corpus = prepare(docs, is_train, id_col=id_col, text_col=text_col, shape=shape)
    lm = scored(corpus, fit(corpus))
    corpus.scratch.drop("counts", "encoded", "scored")
    rare = corpus.encoded.select("row", F.explode(F.arrays_zip("rest", "times")).alias("w")).select("row", F.col("w.rest").alias("word"), F.col("w.times").alias("times"))
    seen = rare.join(corpus.counts.select("word", "n"), "word").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("logs"), F.sum("times").alias("more"))
    out = corpus.encoded.select("row", "id", "n_known", "base", "tail").join(lm, "row").join(seen, "row", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    return out.select(F.col("id").alias(id_col), "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(corpus.n).cast("long").alias("train_tokens"), (F.col("base") + logs).alias("base_score"), (F.col("lm") + F.col("tail") + logs).alias("score"))
