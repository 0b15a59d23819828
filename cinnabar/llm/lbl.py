"""Language-model scoring with a class-factored log-bilinear model trained by noise-contrastive estimation.

A symbol is predicted from the two before it.  Their vectors combine to h = near * r1 + far * r2, and
p(symbol | h) = p(class | h) * p(symbol | class, h), both softmaxes of q . h + b.  Every frequent word of the training
texts is a symbol; all other words share the symbol of their ending, in which a word's part follows its smoothed
count.  Symbols are cut into classes by frequency.  NCE learns both factors, on every token of every training text:
each shard of texts trains in numpy from the same start, and each symbol's parameters are averaged over the shards by
how often they met it, so a rare word is not watered down by shards that lack it.  Scoring normalises each factor
with batched matrix products.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinnabar.llm.common import slices, stage

#: The end of a text, as a token; no word contains a space.
END = b" "
#: Longer words are known by their digest, which bounds the tables of words.
LONG = 64


@dataclass(frozen=True)
class Settings:
    folds: int = 7
    held_out: int = 2
    #: Words that occur so often in training are symbols of their own, the most frequent of them at most `vocabulary`.
    least_count: int = 10
    vocabulary: int = 32_768
    endings: int = 64  # symbols for all other words
    classes: int = 128
    #: Words with the highest counts go to every worker, at most so many; the others' counts come by a join.
    frequent: int = 200_000
    factors: int = 16
    rounds: int = 1
    shard: int = 4_000_000  # tokens of a shard, about
    buffer: int = 1 << 20  # tokens, at least, that are shuffled among each other
    steps: int = 1000  # batches of a shard at least: a small one is passed over more than once
    batch: int = 2048
    class_noise: int = 16  # drawn for a batch
    word_noise: int = 2  # drawn for a token, in its class
    rate: float = 0.2
    calm: float = 0.5  # what AdaGrad's sums of squares start from
    block: int = 1024  # symbols of a row when models are averaged
    tile: int = 16_384  # tokens scored at once
    seed: int = 3


def split(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The lower-cased (A-Z) words of texts one after the other, and the text of each; the ends are not there."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, whose = parts.flatten().cast(pa.binary()), pc.list_parent_indices(parts).to_numpy()
    full = pc.binary_length(flat).to_numpy() > 0  # white space at an end leaves an empty word
    if not full.all():
        flat, whose = flat.filter(pa.array(full)), whose[full]
    return flat.dictionary_encode(), whose


def short(word: bytes) -> bytes:
    return word if len(word) <= LONG else b" " + xxhash.xxh3_128_digest(word)


def ending(word: bytes, s: Settings) -> int:
    return zlib.crc32(word[-2:]) % s.endings


# counts


def count_words(texts: DataFrame, s: Settings) -> DataFrame:
    """word, c (in training), n (in all texts), staged.  texts: text, train.  A batch of texts is counted before its words
    are handed over."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        learned, texts = 0, 0
        for batch in batches:
            train = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            learned, texts = learned + int(train.sum()), texts + len(train)
            found, whose = split(batch.column(0))
            at, word = found.indices.to_numpy(), found.dictionary
            if len(word) and pc.max(pc.binary_length(word)).as_py() > LONG:
                word = pa.array(list(map(short, word.to_pylist())), pa.binary())
            c, n = np.bincount(at[train[whose]], minlength=len(word)), np.bincount(at, minlength=len(word))
            yield pa.RecordBatch.from_arrays([word, pa.array(c.astype(np.int64)), pa.array(n.astype(np.int64))], ["word", "c", "n"])
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([learned], pa.int64()), pa.array([texts], pa.int64())], ["word", "c", "n"])

    return stage(texts.mapInArrow(run, "word binary, c bigint, n bigint").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n")), "words")


def frequent_words(counts: DataFrame, most: int) -> tuple[dict[bytes, int], int]:
    """The training counts of the words with n >= a limit, at most `most`, and the limit.  The histogram has a few
    hundred rows, and words of at most LONG bytes."""
    at = F.floor(F.log2("n") * 8)
    rows = counts.groupBy(at.alias("at")).agg(F.count("*").alias("many"), F.min("n").alias("least")).orderBy(F.desc("at")).collect()
    total, limit = 0, 1 << 62
    for r in rows:
        total += r["many"]
        if total > most:
            break
        limit = r["least"]
    got = counts.where(F.col("n") >= limit).select("word", "c").toPandas()
    return dict(zip(map(bytes, got["word"]), got["c"].tolist(), strict=True)), limit


def endings(counts: DataFrame, own: set[bytes], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Of each ending's words that are no symbols: their tokens in training, and the sum of their counts plus one."""
    shared = counts.sparkSession.sparkContext.broadcast(own)

    def run(batches) -> Iterator[pa.RecordBatch]:
        tokens, mass = np.zeros(s.endings, np.int64), np.zeros(s.endings, np.int64)
        for batch in slices(batches, 10_000):
            for w, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if c and w not in shared.value:
                    at = ending(w, s)
                    tokens[at] += c
                    mass[at] += c + 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(s.endings), pa.int32()), pa.array(tokens), pa.array(mass)], ["at", "tokens", "mass"])

    out = np.zeros((2, s.endings), np.int64)
    for r in counts.select("word", "c").mapInArrow(run, "at int, tokens bigint, mass bigint").groupBy("at").agg(F.sum("tokens").alias("t"), F.sum("mass").alias("m")).collect():  # a row an ending
        out[:, r["at"]] = r["t"], r["m"]
    return out[0], out[1]


# symbols


@dataclass
class Symbols:
    """Numbers of the words: a word that all workers know has one below len(count), a negative one is ~its ending."""

    number: dict[bytes, int]  # of frequent words
    count: np.ndarray  # in training, by number
    symbol: np.ndarray  # by number; the endings from behind, so that negative numbers index them
    size: np.ndarray  # tokens of each symbol in training; symbols come by falling size
    cut: np.ndarray  # classes are symbols cut[k] to cut[k + 1]
    log_mass: np.ndarray  # by number: log10 of what a word shares its symbol with, 0 for one of its own
    own: np.ndarray  # by number: has a symbol of its own

    @property
    def class_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.cut) - 1, dtype=np.int32), np.diff(self.cut))


def symbols(counts: DataFrame, frequent: dict[bytes, int], s: Settings) -> Symbols:
    names = sorted(frequent, key=lambda w: (-frequent[w], w))
    own = [w for w in names if w == END or frequent[w] >= s.least_count][: s.vocabulary]
    own = own if END in own else [*own[: s.vocabulary - 1], END]
    chosen = set(own)
    tokens, mass = endings(counts, chosen, s)
    size = np.concatenate([[frequent.get(w, 0) for w in own], tokens]).astype(np.int64)
    order = np.argsort(-size, kind="stable")
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order))
    size = size[order]
    share = np.cumsum(np.sqrt(size + 1.0))
    cut = np.unique(np.concatenate([[0], np.searchsorted(share, share[-1] * np.arange(1, s.classes) / s.classes) + 1, [len(size)]]))
    names = [*own, *(w for w in names if w not in chosen)]
    at = np.array([ending(w, s) for w in names[len(own) :]], np.int64)
    by_ending = rank[len(own) :]
    symbol = np.concatenate([rank[: len(own)], by_ending[at], by_ending[::-1]]).astype(np.int32)
    shared = np.log10(mass + 1.0)  # one for the words that training lacks
    log_mass = np.concatenate([np.zeros(len(own)), shared[at], shared[::-1]])
    count = np.concatenate([[frequent.get(w, 0) for w in names], np.zeros(s.endings)]).astype(np.int64)
    return Symbols({w: i for i, w in enumerate(names)}, count, symbol, size, cut, log_mass, np.arange(len(symbol)) < len(own))


class _Numbers(dict):
    """word -> number; those of unknown words are worked out when first met."""

    def __init__(self, known: dict[bytes, int], s: Settings):
        super().__init__(known)
        self.known, self.s = known, s

    def of(self, words: pa.Array) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words.to_pylist()), np.int64, len(words))

    def __missing__(self, word: bytes) -> int:
        if len(self) > len(self.known) + 200_000:
            self.clear()
            self.update(self.known)
        at = self.known.get(short(word)) if len(word) > LONG else None
        at = self[word] = ~ending(short(word), self.s) if at is None else at
        return at


def contexts(symbol: np.ndarray, whose: np.ndarray, texts: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts' symbols in a row, each text after two ends and before its own, and the places of their tokens.

    symbol: of the words of all texts, whose: the text of each.
    """
    length = np.bincount(whose, minlength=texts)
    row = np.full(len(symbol) + 3 * texts, end, np.int32)
    row[np.arange(len(symbol)) + 3 * whose + 2] = symbol
    token = np.ones(len(row), bool)
    first = np.cumsum(length + 3) - length - 3
    token[first] = token[first + 1] = False
    return row, np.flatnonzero(token)


# the model


@dataclass
class Model:
    context: np.ndarray  # symbols x factors
    target: np.ndarray  # symbols x factors
    bias: np.ndarray  # symbols
    classes: np.ndarray  # classes x factors
    class_bias: np.ndarray
    mix: np.ndarray  # 2 x factors: weights of the word before and of the one before that

    def parts(self) -> tuple[np.ndarray, ...]:
        return self.context, self.target, self.bias, self.classes, self.class_bias, self.mix

    def copy(self) -> Model:
        return Model(*(x.copy() for x in self.parts()))

    def hidden(self, near: np.ndarray, far: np.ndarray) -> np.ndarray:
        return self.context[near] * self.mix[0] + self.context[far] * self.mix[1]

    def log_prob(self, near: np.ndarray, far: np.ndarray, w: np.ndarray, cut: np.ndarray, class_of: np.ndarray) -> np.ndarray:
        """log10 p(w | near, far), normalised over all symbols."""
        one = np.float32(1)
        groups, each = np.c_[self.classes, self.class_bias].T.copy(), np.c_[self.target, self.bias]
        # by class, so that a class's words are one product
        at = class_of[w]
        order = np.argsort(at, kind="stable")
        at, w = at[order], w[order]
        h = np.empty((len(w), self.mix.shape[1] + 1), np.float32)
        h[:, :-1], h[:, -1] = self.hidden(near[order], far[order]), one
        out = np.empty(len(w))
        for k in range(0, len(w), 1024):
            out[k : k + 1024] = _log_softmax(h[k : k + 1024] @ groups, at[k : k + 1024])
        found, begin = np.unique(at, return_index=True)
        for k, a, b in zip(found, begin, [*begin[1:], len(at)], strict=True):
            lo, hi = cut[k], cut[k + 1]
            words = each[lo:hi].T
            for e in range(a, b if hi - lo > 1 else a, 1024):
                stop = min(e + 1024, b)
                out[e:stop] += _log_softmax(h[e:stop] @ words, w[e:stop] - lo)
        back = np.empty(len(w))
        back[order] = out
        return back / math.log(10)


def _log_softmax(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    own = x[np.arange(len(x)), at].astype(np.float64)
    if x.max(initial=0) < 60:  # no sum overflows; none underflows either, or the rows are shifted after all
        total = np.exp(x) @ np.ones(x.shape[1], x.dtype)
        if total.min(initial=1) > 1e-20:
            return own - np.log(total.astype(np.float64))
    most = x.max(1, keepdims=True)
    return own - most[:, 0] - np.log(np.exp(x - most).sum(1, dtype=np.float64))


def start(y: Symbols, s: Settings) -> Model:
    """Without training, each factor's bias is its share of the tokens, and a word says nothing of the next."""
    word, group = _shares(y)
    zero = lambda: np.zeros((len(word), s.factors), np.float32)
    classes = np.random.default_rng(s.seed).normal(0, 0.3, (len(group), s.factors)).astype(np.float32)
    mix = np.stack([np.ones(s.factors), np.full(s.factors, 0.5)]).astype(np.float32)
    return Model(zero(), zero(), np.log(word).astype(np.float32), classes, np.log(group).astype(np.float32), mix)


def _shares(y: Symbols) -> tuple[np.ndarray, np.ndarray]:
    """The part of each symbol in its class, and of each class in all."""
    size = y.size + 1.0
    group = np.add.reduceat(size, y.cut[:-1])
    return size / group[y.class_of], group / group.sum()


class Trainer:
    """AdaGrad on NCE.  The classes' noise is shared by a batch, a token's word noise is drawn from its class.

    Parameters that move together are rows of one array: of `words`, a target and its bias, of `groups` a class's."""

    def __init__(self, model: Model, y: Symbols, s: Settings, seed: int):
        self.y, self.s, self.rng = y, s, np.random.default_rng(seed)
        m, d = model.copy(), s.factors
        self.words, self.groups = np.c_[m.target, m.bias], np.c_[m.classes, m.class_bias]
        self.m = Model(m.context, self.words[:, :d], self.words[:, d], self.groups[:, :d], self.groups[:, d], m.mix)
        self.of_context, self.of_words, self.of_groups, self.of_mix = (np.full_like(x, s.calm) for x in (m.context, self.words, self.groups, m.mix))
        self.word, self.group = _shares(y)
        self.class_of, self.total = y.class_of, np.concatenate([[0.0], np.cumsum(y.size + 1.0)])
        self.log_word = np.log(s.word_noise * self.word).astype(np.float32)
        self.log_group = np.log(s.class_noise * self.group).astype(np.float32)
        self.to_group = np.cumsum(self.group)[:-1]
        self.first, self.last = y.cut[:-1].astype(np.int64), y.cut[1:].astype(np.int64) - 1
        self.low, self.width = self.total[y.cut[:-1]], self.total[y.cut[1:]] - self.total[y.cut[:-1]]
        self.alone = self.first == self.last
        self.sorts = np.uint16 if len(y.size) < 1 << 16 else np.int32  # two bytes are sorted by radix
        self.met = np.zeros(len(y.size), np.int64)
        self.steps = 0

    def learn(self, row: np.ndarray, at: np.ndarray) -> None:
        """One pass over the tokens at `at`, in a random order."""
        at = self.rng.permutation(at)
        self.met += np.bincount(row[at], minlength=len(self.met))
        for k in range(0, len(at), self.s.batch):
            some = at[k : k + self.s.batch]
            some = some[np.argsort(row[some].astype(self.sorts), kind="stable")]
            self.step(row[some - 1], row[some - 2], row[some])

    def update(self, x: np.ndarray, q: np.ndarray, rows, grad: np.ndarray) -> None:
        sums = np.square(grad)
        sums += q[rows] if isinstance(rows, slice) else q.take(rows, 0)
        q[rows] = sums
        np.sqrt(sums, out=sums)
        np.divide(grad, sums, out=grad)
        grad *= self.s.rate
        np.subtract(x[rows] if isinstance(rows, slice) else x.take(rows, 0), grad, out=grad)
        x[rows] = grad

    def order(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An order of the rows, the different ones in it, and where they begin there."""
        order = np.argsort(rows.astype(self.sorts), kind="stable")
        rows = rows.take(order)
        first = _begins(rows)
        return order, rows[first], first

    def step(self, near: np.ndarray, far: np.ndarray, w: np.ndarray) -> None:
        """w rises."""
        m, s, rng, n, d = self.m, self.s, self.rng, len(w), self.s.factors
        self.steps += 1
        r1, r2 = m.context.take(near, 0), m.context.take(far, 0)
        h = np.ones((n, d + 1), np.float32)  # the last factor is that of the bias
        np.multiply(r1, m.mix[0], out=h[:, :d])
        h[:, :d] += r2 * m.mix[1]
        one = lambda x: 1 / (1 + np.exp(-x))
        # the class against noise classes
        own = self.class_of.take(w)
        k = np.searchsorted(self.to_group, rng.random(s.class_noise), "right")
        mine, noise = self.groups.take(own, 0), self.groups.take(k, 0)
        pos = one(np.einsum("bd,bd->b", h, mine) - self.log_group.take(own)) - 1
        neg = one(h @ noise.T - self.log_group[k])
        dh = neg @ noise
        mine *= pos[:, None]
        dh += mine
        grad_groups = np.zeros_like(self.groups)
        begins = _begins(own)
        grad_groups[own[begins]] = np.add.reduceat(h * pos[:, None], begins)
        np.add.at(grad_groups, k, neg.T @ h)
        # the word against noise words of its class
        drawn = np.searchsorted(self.total, self.low.take(own)[:, None] + rng.random((n, s.word_noise)) * self.width.take(own)[:, None], "right") - 1
        every = np.empty((n, 1 + s.word_noise), np.int64)
        every[:, 0] = w
        np.clip(drawn, self.first.take(own)[:, None], self.last.take(own)[:, None], out=every[:, 1:])
        q = self.words.take(every, 0)
        e = one(np.einsum("bd,bjd->bj", h, q) - self.log_word.take(every))
        e[:, 0] -= 1
        if self.alone.any():
            e[self.alone[own]] = 0
        dh += np.einsum("bj,bjd->bd", e, q)
        order, words, begins = self.order(every.ravel())
        several = h.take(order // (1 + s.word_noise), 0)
        several *= e.ravel().take(order)[:, None]
        grad_words = np.add.reduceat(several, begins)
        dh = dh[:, :d]
        order, near_far, begins = self.order(np.concatenate([near, far]))
        grad_context = np.add.reduceat(np.concatenate([dh * m.mix[0], dh * m.mix[1]]).take(order, 0), begins)
        self.update(m.context, self.of_context, near_far, grad_context)
        self.update(self.words, self.of_words, words, grad_words)
        self.update(self.groups, self.of_groups, slice(None), grad_groups)
        self.update(m.mix, self.of_mix, slice(None), np.stack([np.einsum("bd,bd->d", dh, r1), np.einsum("bd,bd->d", dh, r2)]))


def _begins(rows: np.ndarray) -> np.ndarray:
    """Where equal rows that stand together begin."""
    return np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))


# training on shards


def _pack(m: Model, met: np.ndarray, y: Symbols, s: Settings) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(block, weights, parameters): rows of symbols that were met, a block of them at a time; -1 is all the rest."""
    each = np.concatenate([m.context, m.target, m.bias[:, None]], 1)
    for k in range(0, len(met), s.block):
        if met[k : k + s.block].any():
            yield k // s.block, met[k : k + s.block].astype(np.float64), each[k : k + s.block]
    group = np.add.reduceat(met, y.cut[:-1]).astype(np.float64)
    rest = np.concatenate([np.concatenate([m.classes, m.class_bias[:, None]], 1), np.concatenate([m.mix, np.zeros((2, 1), np.float32)], 1)])
    yield -1, np.concatenate([group, np.full(2, met.sum(), np.float64)]), rest


def _sums(batches) -> Iterator[pa.RecordBatch]:
    """Sums of weights and of weighted parameters by block: one of each is held, however many models there are."""
    held: dict[int, list] = {}
    lane = 0
    for batch in batches:
        for block, at, weight, params in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            w, lane = np.frombuffer(weight), at
            p = np.frombuffer(params).reshape(len(w), -1)
            if block in held:
                held[block][0] += w
                held[block][1] += p
            else:
                held[block] = [w.copy(), p.copy()]
    yield _rows((b, lane, w, p) for b, (w, p) in held.items())


def _rows(rows: Iterable[tuple]) -> pa.RecordBatch:
    cols = list(zip(*((b, a, w.tobytes(), p.tobytes()) for b, a, w, p in rows), strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["block", "lane", "weight", "params"])


_ROWS = "block int, lane int, weight binary, params binary"


def train(texts: DataFrame, y: Symbols, tokens: int, s: Settings) -> Model:
    """Rounds over all texts.  Shards are as many as their tokens ask for; models meet in two steps, so that a task
    adds up about the root of their number.  The driver gets one model."""
    model = start(y, s)
    shards = max(1, -(-tokens // s.shard))
    lanes = max(1, math.isqrt(shards))
    for turn in range(s.rounds if tokens else 0):
        shared = texts.sparkSession.sparkContext.broadcast((model, y))

        def run(batches, shared=shared, turn=turn) -> Iterator[pa.RecordBatch]:
            model, y = shared.value
            task = TaskContext.get().partitionId()
            numbers, end = _Numbers(y.number, s), int(y.symbol[y.number[END]])
            trainer = Trainer(model, y, s, 1_000_003 * turn + task)
            held: list[tuple[np.ndarray, np.ndarray]] = []
            last = None

            def learn() -> tuple[np.ndarray, np.ndarray]:
                start = np.cumsum([0, *(len(row) for row, _ in held)])
                both = np.concatenate([row for row, _ in held]), np.concatenate([at + k for (_, at), k in zip(held, start, strict=False)])
                trainer.learn(*both)
                held.clear()
                return both

            for batch in slices(batches, 2000):
                found, whose = split(batch.column(0))
                held.append(contexts(y.symbol[numbers.of(found.dictionary)][found.indices.to_numpy()], whose, batch.num_rows, end))
                if sum(len(at) for _, at in held) >= s.buffer:
                    last = learn()
            if held:
                last = learn()
            while last is not None and trainer.steps < s.steps:
                trainer.learn(*last)
            if last is not None:
                for b, w, p in _pack(trainer.m, trainer.met, y, s):
                    yield _rows([(b, task % lanes, w, p * w[:, None])])

        each = texts.coalesce(shards).mapInArrow(run, _ROWS)
        few = each.repartition("block", "lane").mapInArrow(_sums, _ROWS)
        got = few.repartition("block").mapInArrow(_sums, _ROWS).collect()  # a row a block
        model = _merge(got, model, s)
    return model


def _merge(rows: list, before: Model, s: Settings) -> Model:
    """The averages; what no shard has met stays as it was."""
    m, d = before.copy(), s.factors
    for r in rows:
        w = np.frombuffer(r["weight"])
        p = np.frombuffer(r["params"]).reshape(len(w), -1)
        at = np.flatnonzero(w)
        mean = (p[at] / w[at, None]).astype(np.float32)
        if r["block"] >= 0:
            to = at + r["block"] * s.block
            m.context[to], m.target[to], m.bias[to] = mean[:, :d], mean[:, d : 2 * d], mean[:, -1]
        else:
            k = len(m.class_bias)
            group = at[at < k]
            m.classes[group], m.class_bias[group] = mean[: len(group), :d], mean[: len(group), -1]
            if len(group) < len(at):
                m.mix = mean[len(group) :, :d].copy()
    return m


# scores


def fit(docs: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> tuple[Model, Symbols, DataFrame, int, int, int]:  # noqa: B008
    """Model, symbols, counts of words (staged), least n of a frequent word, training tokens and distinct ones."""
    s = settings
    rows = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), (~_held(doc_id, s)).alias("train"))
    counts = count_words(rows, s)
    whole = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    frequent, limit = frequent_words(counts, s.frequent)
    y = symbols(counts, frequent, s)
    return train(rows.where("train").select("text"), y, whole["n"], s), y, counts, limit, whole["n"], whole["v"]


def _held(doc_id: str, s: Settings):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % s.folds == s.held_out, F.lit(True))


def score(docs: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:  # noqa: B008
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    base_score is the add-one unigram's log10 probability, score the model's.  A null or empty text is its end
    alone.  A null doc_id has no fold: its text is not learned from and counts as held out.  Repeated rows are
    learned and scored each; an empty table gives no rows; other columns are ignored.  With nothing to learn from,
    both scores are those of the untrained model.
    """
    s = settings
    model, y, counts, limit, n, v = fit(docs, s, doc_id, text)
    divisor = math.log10(n + v + 1)
    kind = docs.schema[doc_id].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((model, y))  # s.frequent words at most

    def run(batches) -> Iterator[pa.RecordBatch]:
        model, y = shared.value
        numbers, class_of, end = _Numbers(y.number, s), y.class_of, int(y.symbol[y.number[END]])
        logs = np.log10(y.count + 1.0)
        extra = np.where(y.own, 0.0, logs - y.log_mass)  # a word's part of its ending's symbol, but for rare words' counts
        known = y.count > 0
        for batch in slices(batches, 1000):
            many = batch.num_rows
            found, whose = split(batch.column(1))
            number, code = numbers.of(found.dictionary), found.indices.to_numpy()
            row, place = contexts(y.symbol[number][code], whose, many, end)
            of_token = np.full(len(place), y.number[END], np.int64)
            of_token[np.arange(len(code)) + whose] = number[code]  # each text has one token more than words
            log = np.empty(len(place))
            for k in range(0, len(place), s.tile):
                some = place[k : k + s.tile]
                log[k : k + s.tile] = model.log_prob(row[some - 1], row[some - 2], row[some], y.cut, class_of)
            length = np.bincount(whose, minlength=many) + 1
            begin = np.cumsum(length) - length
            sums = [np.add.reduceat(x, begin) for x in (known[of_token].astype(np.int64), logs[of_token], log + extra[of_token])]
            odd = np.flatnonzero(number[code] < 0)
            pair, times = np.unique(whose[odd] * len(number) + code[odd], return_counts=True)
            offsets = np.searchsorted(pair, np.arange(many + 1) * len(number)).astype(np.int32)
            names = pa.array([short(w) for w in found.dictionary.take(pa.array(pair % len(number) if len(pair) else pair)).to_pylist()], pa.binary())
            rare = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([names, pa.array(times.astype(np.int64))], ["word", "n"]))
            cols = [pa.array(length.astype(np.int64)), *map(pa.array, sums), rare]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["doc_id", "n_tokens", "n_frequent", "logs", "model", "rare"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    schema = f"doc_id {kind}, n_tokens bigint, n_frequent bigint, logs double, model double, rare array<struct<word: binary, n: bigint>>"
    # numbered in the table: made anew on each read, numbers would follow the splits of that read
    scored = stage(rows.mapInArrow(run, schema).withColumn("_id", F.monotonically_increasing_id()), "scored")
    # a word here stands in fewer than `limit` places in all texts, so no key of this join is hot
    few = counts.where((F.col("n") < limit) & (F.col("c") > 0)).select("word", "c")
    rare = scored.select("_id", F.explode("rare").alias("r")).select("_id", "r.word", "r.n").join(few, "word")
    rest = rare.groupBy("_id").agg(F.sum("n").alias("n_rare"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("rare_logs"))
    both = scored.drop("rare").join(rest, "_id", "left")
    rare_logs = F.coalesce("rare_logs", F.lit(0.0))
    return both.select(
        "doc_id",
        _held("doc_id", s).alias("held_out"),
        "n_tokens",
        (F.col("n_frequent") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("logs") + rare_logs - F.col("n_tokens") * divisor).alias("base_score"),
        (F.col("model") + rare_logs).alias("score"),
    )
