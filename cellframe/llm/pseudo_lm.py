"""Masked pseudo-likelihood with a bidirectional window network.

Every token is predicted from the tokens on both its sides: each of the
``WINDOW`` tokens before and after it adds an embedding (one table per
distance), a tanh layer follows, and the probability of the token is that of
its class times that of the token inside the class (two softmax layers).  A
document's score is the sum of the log-probabilities of all its tokens; the
mean per token compares documents of different lengths.

Tokens are lower-cased words.  The most frequent words of the whole corpus
are symbols of their own, every other word is one of ``BUCKETS`` symbols by
its hash.  The vocabulary comes from the counts of all documents.  The
probability of a word in a bucket is that of the bucket times the word's
share of it, count(word) / (count(bucket) + 1), by a join of the documents'
distinct such words with the written counts.  The remaining 1 of a bucket is
for words the fit has not seen, each ``LETTERS`` ** -(its bytes + 1) of it, so
the probabilities of all words never sum to more than 1.

The documents are encoded once: their symbols are written, for all rounds and
the scores.  Training is data-parallel over these rows: in each round every task starts from the current
weights, takes the round's masked positions of all documents of its
partition, and its weights are averaged with those of all other tasks, each weighted by its
number of tokens.  The averaging runs in two shuffled steps that keep one
running sum, so nothing grows with the number of tasks but the rows moved.  A token's
position in its document modulo ``MASK`` decides its round; the rounds share
all residues, so together they predict every token once.

Edge cases: null and empty texts have no tokens, log-probability 0 and a
null mean; an empty corpus gives the untrained network.  A token without
neighbours is predicted from padding.  Rows are never merged.  Other columns
of the input are not carried.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellframe.llm.common import batches, map_batches, split_words, text_rows
from cellframe.llm.decontaminate import _WORD as WORD_BYTES
from cellframe.session import ensure_checkpoint_dir, materialize, scratch_path

CLASSES = 64
SYMBOLS = CLASSES * CLASSES
BUCKETS = 512
WINDOW, WIDTH = 3, 16
ROUNDS, MASK = 2, 24
BATCH, RATE = 1024, 0.05
COUNT_CHARS = 12_000_000  # text counted or scored at a time; a rare word is sent once for each
LINE_BYTES = 1_200_000    # symbols (two bytes each) trained on or scored at a time: about 4 MB of text
OFFSETS = tuple(k for k in range(-WINDOW, WINDOW + 1) if k)
SHARDS = 16               # pieces of the weights in the averaging
MANY = 6                  # gradients of one embedding that are added one by one
SAFE = 80                 # exponentials of up to 64 such logits are neither infinite nor zero
LETTERS = len(set(WORD_BYTES) - {32}) + 1  # bytes a word can have, and its end


@dataclass
class Model:
    """The vocabulary (sorted by count) and the weights; symbol SYMBOLS is padding."""

    words: list[bytes]
    embed: np.ndarray       # (offset, symbol, width)
    hidden_bias: np.ndarray
    class_w: np.ndarray     # (width, class)
    class_b: np.ndarray
    word_w: np.ndarray      # (class, width, word)
    word_b: np.ndarray      # (class, word)
    bucket_n: np.ndarray | None = None  # tokens of each bucket (none: no word outside the vocabulary was seen)
    counts: str | None = None           # where the counts of all words are written

    def weights(self) -> list[np.ndarray]:
        return [self.embed, self.hidden_bias, self.class_w, self.class_b, self.word_w, self.word_b]

    def flat(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in self.weights()])

    def load(self, flat: np.ndarray) -> "Model":
        out, at = [], 0
        for w in self.weights():
            out.append(flat[at:at + w.size].reshape(w.shape).astype(np.float32))
            at += w.size
        return Model(self.words, *out, self.bucket_n, self.counts)

    def symbols(self, words: pa.Array) -> np.ndarray:
        return encoded_words(words, self.words)


def encoded_words(words: pa.Array, vocabulary: list[bytes]) -> np.ndarray:
    """The symbol of each word: its place in the vocabulary, or that of its bucket."""
    found = pc.index_in(words, value_set=pa.array(vocabulary, pa.binary()))
    ids = found.fill_null(-1).to_numpy().astype(np.int32)
    rare = words.filter(found.is_null()).dictionary_encode()
    ids[ids < 0] = SYMBOLS - BUCKETS + buckets(rare.dictionary).take(rare.indices.to_numpy())
    return ids


def bucket(word: bytes) -> int:
    return int(buckets(pa.array([word], pa.binary()))[0])


def buckets(words: pa.Array) -> np.ndarray:
    """The bucket of each word, by its hash."""
    from xxhash import xxh64_intdigest  # once a batch, not once a word
    each = words.to_numpy(zero_copy_only=False).tolist()
    return (np.fromiter(map(xxh64_intdigest, each), np.uint64, len(words)) % BUCKETS).astype(np.int64)


def initial(words: list[bytes], counts: list[int], total: int, seed: int = 11) -> Model:
    """Random embeddings, biases from the corpus counts (so the untrained network is the unigram model)."""
    rng = np.random.default_rng(seed)
    share = np.zeros(SYMBOLS)
    share[:len(counts)] = counts
    share[SYMBOLS - BUCKETS:] = max(0, total - sum(counts)) / BUCKETS
    share = (share + 0.5).reshape(CLASSES, CLASSES)
    embed = rng.normal(0, 0.1, (len(OFFSETS), SYMBOLS + 1, WIDTH)).astype(np.float32)
    return Model(words, embed, np.zeros(WIDTH, np.float32),
                 rng.normal(0, 0.1, (WIDTH, CLASSES)).astype(np.float32),
                 np.log(share.sum(1) / share.sum()).astype(np.float32),
                 rng.normal(0, 0.1, (CLASSES, WIDTH, CLASSES)).astype(np.float32),
                 np.log(share / share.sum(1, keepdims=True)).astype(np.float32))


def lay_out(lines: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols with padding between documents, places of the tokens, owner of each token) of encoded documents."""
    n = pc.binary_length(lines).to_numpy() // 2
    owner = np.repeat(np.arange(len(n)), n)
    places = np.arange(len(owner)) + WINDOW * (owner + 1)
    line = np.full(len(owner) + WINDOW * (len(n) + 1), SYMBOLS, np.uint16)
    line[places] = np.frombuffer(b"".join(lines.to_pylist()), np.uint16)
    return line, places, owner


def neighbours(line: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The row of the embeddings of (distance, symbol), for each distance and place."""
    near = line.take(at + np.array(OFFSETS)[:, None])
    near += np.arange(len(OFFSETS), dtype=near.dtype)[:, None] * (SYMBOLS + 1)
    return near


def hidden(model: Model, rows: np.ndarray) -> np.ndarray:
    h = np.repeat(model.hidden_bias[None], rows.shape[1], 0)
    for near in model.embed.reshape(-1, WIDTH).take(rows, 0):
        h += near
    return np.tanh(h, out=h)


def shifted(z: np.ndarray, axis: int) -> np.ndarray:
    """The logits, lowered in place by their largest along the axis where an exponential could overflow or all vanish."""
    if not (z.max() < SAFE and z.min() > -SAFE):
        z -= z.max(axis, keepdims=True)
    return z


def softmax(z: np.ndarray, weight: float = 1.0) -> np.ndarray:
    """Softmax of each row times the weight, in place."""
    np.exp(shifted(z, 1), out=z)
    z *= (weight / (z @ np.ones(z.shape[1], z.dtype)))[:, None]
    return z


def picked(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The log-softmax of each column at its place in ``at``; changes ``z``."""
    out = shifted(z, 0)[at, np.arange(len(at))]
    return out - np.log(np.exp(z, out=z).sum(0))


def by_class(line: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The places sorted by the class of their symbols (stable)."""
    return np.argsort((line.take(at) // CLASSES).astype(np.uint8), kind="stable")


def class_cuts(classes: np.ndarray) -> list[tuple[int, int, int]]:
    """(class, begin, end) of each class in a sorted array."""
    end = np.cumsum(np.bincount(classes, minlength=CLASSES)).tolist()
    return [(c, lo, hi) for c, (lo, hi) in enumerate(zip([0, *end], end)) if lo < hi]


def log_probs(model: Model, line: np.ndarray, at: np.ndarray) -> np.ndarray:
    """log p(token | tokens on both sides) of the tokens at the places ``at``."""
    out = np.empty(len(at))
    order = by_class(line, at)  # all of them at once: a block then has few classes
    room = np.empty(CLASSES * BATCH, np.float32)  # of logits, a column for each token
    for lo in range(0, len(at), BATCH):
        own = order[lo:lo + BATCH]
        a = at.take(own)
        s, z = line.take(a), room[:CLASSES * len(a)].reshape(CLASSES, -1)
        h, classes = hidden(model, neighbours(line, a)), s // CLASSES
        np.matmul(model.class_w.T, h.T, out=z)
        z += model.class_b[:, None]
        lp = picked(z, classes)
        for c, i, j in class_cuts(classes):
            np.matmul(model.word_w[c].T, h[i:j].T, out=z[:, i:j])
            z[:, i:j] += model.word_b[c][:, None]
        lp += picked(z, s % CLASSES)
        out[own] = lp
    return out


class Trainer:
    """Adagrad over mini-batches of masked positions, on a copy of the weights.

    All weights but the embeddings are views of one array, as are their gradients.  The biases of a
    layer are the last row of its matrix, whose input has a column of ones.
    """

    def __init__(self, model: Model, rate: float = RATE):
        self.model, self.rate = model.load(model.flat()), rate
        m = self.model
        shapes = [(WIDTH,), (WIDTH + 1, CLASSES), (CLASSES, WIDTH + 1, CLASSES)]
        self.dense = np.concatenate([m.hidden_bias, m.class_w.ravel(), m.class_b, np.concatenate(
            [m.word_w, m.word_b[:, None]], 1).ravel()])
        m.hidden_bias, self.classes, words = views(self.dense, shapes)
        m.class_w, m.class_b = self.classes[:WIDTH], self.classes[WIDTH]
        m.word_w, m.word_b = words[:, :WIDTH], words[:, WIDTH]
        self.grad, self.square = np.zeros_like(self.dense), np.empty_like(self.dense)
        self.grad_hidden, self.grad_classes, self.grad_words = views(self.grad, shapes)
        self.embed_sums, self.sums = np.full_like(m.embed, 1e-8), np.full_like(self.dense, 1e-8)
        self.each = [*zip(words, m.word_w.transpose(0, 2, 1), self.grad_words)]  # of a class
        self.room = np.empty((2, 0, CLASSES), np.float32)
        self.seen = 0

    def step(self, line: np.ndarray, at: np.ndarray) -> None:
        m, n = self.model, len(at)
        if n > self.room.shape[1]:  # logits keep their memory from step to step
            self.room, self.ones = np.empty((2, n, CLASSES), np.float32), np.ones((n, WIDTH + 1), np.float32)
        dz, d = self.room[:, :n]
        at = at.take(by_class(line, at))
        s, rows, each = line.take(at), neighbours(line, at), np.arange(n)
        h, classes, h1 = hidden(m, rows), s // CLASSES, self.ones[:n]
        h1[:, :WIDTH] = h
        softmax(np.matmul(h1, self.classes, out=dz), 1 / n)[each, classes] -= np.float32(1 / n)
        np.matmul(h1.T, dz, out=self.grad_classes)
        dh = dz @ m.class_w.T
        cuts = class_cuts(classes)
        for c, lo, hi in cuts:
            np.dot(h1[lo:hi], self.each[c][0], d[lo:hi])
        softmax(d, 1 / n)[each, s % CLASSES] -= np.float32(1 / n)
        if len(cuts) < CLASSES:
            self.grad_words.fill(0)
        through = np.empty_like(dh)
        for c, lo, hi in cuts:
            _, back, grad = self.each[c]
            of = d[lo:hi]
            np.dot(h1[lo:hi].T, of, grad)
            np.dot(of, back, through[lo:hi])
        dh += through
        dh *= 1 - h ** 2
        self._embed(rows.ravel(), dh)
        np.sum(dh, 0, out=self.grad_hidden)
        self.sums += np.multiply(self.grad, self.grad, out=self.square)
        self.grad *= self.rate
        self.grad /= np.sqrt(self.sums, out=self.square)
        self.dense -= self.grad
        self.seen += n

    def _embed(self, rows: np.ndarray, grad: np.ndarray) -> None:
        """The embeddings' step: the gradients of one (distance, symbol) are added up first."""
        order = np.argsort(rows, kind="stable")
        rows, source = rows.take(order), np.tile(np.arange(len(grad)), len(OFFSETS)).take(order)
        ends = np.concatenate([np.flatnonzero(rows[1:] != rows[:-1]) + 1, [len(rows)]])
        begins = np.concatenate([[0], ends[:-1]])
        times = ends - begins
        by_times = np.argsort((MANY - np.minimum(times, MANY + 1)).astype(np.int8), kind="stable")  # most first
        begins, times = begins.take(by_times), times.take(by_times)
        used, g = rows.take(begins), grad.take(source.take(begins), 0)
        for k in range(1, MANY):  # the second of those with two or more, and so on
            some = np.count_nonzero(times > k)
            g[:some] += grad.take(source.take(begins[:some] + k), 0)
        some = np.count_nonzero(times > MANY)
        if some:
            rest = times[:some] - MANY
            ends = np.cumsum(rest)
            terms = grad.astype(np.float64).take(source.take(
                np.arange(ends[-1]) + np.repeat(begins[:some] + MANY - ends + rest, rest)), 0)
            sums = np.cumsum(terms.view(np.complex128), 0).take(ends - 1, 0).view(np.float64)  # two columns at a time
            g[:some] += np.diff(sums, axis=0, prepend=0)
        sums, embed = whole_rows(self.embed_sums), whole_rows(self.model.embed)
        size = g * g
        size += sums.take(used).view(np.float32).reshape(g.shape)
        sums.put(used, whole_rows(size))
        g *= self.rate
        g /= np.sqrt(size, out=size)
        now = embed.take(used).view(np.float32).reshape(g.shape)
        now -= g
        embed.put(used, whole_rows(now))


def views(flat: np.ndarray, shapes: list[tuple[int, ...]]) -> list[np.ndarray]:
    """Arrays of these shapes that lie one after the other in ``flat``."""
    cuts = np.cumsum([math.prod(shape) for shape in shapes])[:-1]
    return [part.reshape(shape) for part, shape in zip(np.split(flat, cuts), shapes)]


def whole_rows(table: np.ndarray) -> np.ndarray:
    """The vectors of a table as single items, which are taken and put as a whole."""
    return table.reshape(-1, WIDTH).view(f"V{WIDTH * table.itemsize}").ravel()


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``word`` (binary) and ``n`` over all documents; each batch sends a word once."""

    def fn(rb: pa.RecordBatch) -> dict:
        words, _ = split_words(rb.column(1).cast(pa.binary()).to_pylist(), WORD_BYTES)
        counted = words.value_counts()
        return {"word": counted.field("values"), "n": counted.field("counts")}

    rows = docs.select(F.lit(0).alias("_key"), F.col(text_col).cast("string").alias("_text"))
    return (map_batches(rows, fn, "word binary, n long", max_chars=COUNT_CHARS)
            .groupBy("word").agg(F.sum("n").alias("n")))


def vocabulary(docs: DataFrame, text_col: str = "text") -> Model:
    """Count words; the untrained network."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    path = scratch_path(spark, "word-counts")
    word_counts(docs, text_col).write.parquet(path)
    counts = spark.read.parquet(path)
    total = counts.agg(F.sum("n")).first()[0] or 0
    top = counts.orderBy(F.desc("n"), "word").limit(SYMBOLS - BUCKETS).collect()  # the vocabulary's fixed size
    model = initial([bytes(r["word"]) for r in top], [r["n"] for r in top], total)
    model.bucket_n, model.counts = bucket_counts(counts, model.words), path
    return model


def encode(rows: DataFrame, model: Model) -> DataFrame:
    """The rows of ``text_rows`` as symbols, written once for all rounds and the scores.

    A row for each document with its number, its key and its symbols (two bytes each), and a row for each of a
    batch's distinct words outside the vocabulary with the numbers of its documents and its times in them.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model.words)

    def fn(rb: pa.RecordBatch) -> dict:
        words, n = split_words(rb.column(1).cast(pa.binary()).to_pylist(), WORD_BYTES)
        symbols = encoded_words(words, shared.value).astype(np.uint16)
        begin = np.concatenate([[0], np.cumsum(2 * n)]).astype(np.int32)
        lines = pa.Array.from_buffers(pa.binary(), rb.num_rows, [None, pa.py_buffer(begin), pa.py_buffer(symbols)])
        rare = np.flatnonzero(symbols >= SYMBOLS - BUCKETS)
        owner = np.repeat(np.arange(len(n)), n)[rare]
        coded = words.take(pa.array(rare)).dictionary_encode()
        pairs, times = np.unique(coded.indices.to_numpy().astype(np.int64) * rb.num_rows + owner, return_counts=True)
        cuts = pa.array(np.searchsorted(pairs, np.arange(len(coded.dictionary) + 1) * rb.num_rows), pa.int32())
        numbers = rb.column(2).take(pa.array(pairs % rb.num_rows))

        def both(document: pa.Array, word: pa.Array) -> pa.Array:
            """A column of the documents' rows, then the words' rows."""
            one = pa.nulls(rb.num_rows, word.type) if document is None else document
            return pa.concat_arrays([one, pa.nulls(len(coded.dictionary), one.type) if word is None else word])

        return {"_row": both(rb.column(2), None), "_key": both(rb.column(0), None), "line": both(lines, None),
                "word": both(None, coded.dictionary), "rows": both(None, pa.ListArray.from_arrays(cuts, numbers)),
                "times": both(None, pa.ListArray.from_arrays(cuts, pa.array(times, pa.int64())))}

    kind = rows.schema["_key"].dataType.simpleString()
    # written, so that a row's number is the same on both sides of the join
    return materialize(map_batches(rows.withColumn("_row", F.monotonically_increasing_id()), fn,
                                   f"_row long, _key {kind}, line binary, word binary, rows array<long>, "
                                   "times array<long>", max_chars=COUNT_CHARS), "encoded")


def train(encoded: DataFrame, model: Model, rounds: int = ROUNDS, mask: int = MASK) -> Model:
    """``rounds`` rounds over all encoded documents."""
    lines = encoded.where("line is not null").select("line")
    for r in range(rounds):
        model = train_round(lines, model, r, "line", rounds, mask)
    return model


def fit(docs: DataFrame, text_col: str = "text", rounds: int = ROUNDS, mask: int = MASK) -> Model:
    """Count words, then train ``rounds`` rounds over all documents."""
    model = vocabulary(docs, text_col)
    rows = docs.select(F.lit(0).alias("_key"), F.col(text_col).cast("string").alias("_text"))
    return train(encode(rows, model), model, rounds, mask)


def fit_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``score`` of the documents by the ``fit`` of the same documents, which are encoded once for both."""
    model = vocabulary(docs, text_col)
    encoded = encode(text_rows(docs, id_col, text_col), model)
    return score_encoded(encoded, train(encoded, model), id_col)


def turns(owner: np.ndarray, rounds: int, mask: int) -> np.ndarray:
    """The round in which each token is masked, by its position in its document alone."""
    n = np.bincount(owner)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    return np.tile(np.arange(mask) % rounds, n.max(initial=0) // mask + 1).take(place)


def bucket_counts(counts: DataFrame, words: list[bytes]) -> np.ndarray:
    """Tokens of each bucket: of all words outside the vocabulary ``words``."""
    shared = counts.sparkSession.sparkContext.broadcast(pa.array(words, pa.binary()))

    def fn(rb: pa.RecordBatch) -> dict:
        rare = rb.filter(pc.invert(pc.is_in(rb.column(1), value_set=shared.value)))
        n = np.bincount(buckets(rare.column(1)), rare.column(0).to_numpy(), BUCKETS).astype(np.int64)
        return {"bucket": np.arange(BUCKETS), "n": n}

    out = np.zeros(BUCKETS)
    for r in map_batches(counts.select("n", "word"), fn, "bucket int, n long").groupBy("bucket").sum("n").collect():
        out[r[0]] = r[1]
    return out


def train_round(lines: DataFrame, model: Model, number: int, line_col: str, rounds: int, mask: int) -> Model:
    spark = lines.sparkSession
    shared = spark.sparkContext.broadcast(model)  # of fixed size: the vocabulary and the weights

    def run(table: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = Trainer(shared.value, RATE / (1 + number))
        for rb in batches(table, 0, LINE_BYTES):
            line, places, owner = lay_out(rb.column(0))
            masked = places[turns(owner, rounds, mask) == number]
            masked = masked[np.random.default_rng(number).permutation(len(masked))]
            for lo in range(0, len(masked), BATCH):
                trainer.step(line, masked[lo:lo + BATCH])
        if trainer.seen:
            parts = np.array_split(trainer.model.flat().astype(np.float64) * trainer.seen, SHARDS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(SHARDS), pa.int32()), pa.array([trainer.seen] * SHARDS, pa.int64()),
                 pa.array([p.astype(np.float32).tobytes() for p in parts], pa.binary())], names=["shard", "n", "w"])

    schema = "shard int, n long, w binary"
    each = lines.select(line_col).mapInArrow(run, schema)
    salted = each.withColumn("salt", F.spark_partition_id() % 16).repartition("shard", "salt").drop("salt")
    sums = salted.mapInArrow(add_up, schema).repartition("shard").mapInArrow(add_up, schema)
    rows = {r["shard"]: r for r in sums.collect()}  # one set of weights
    if not rows:
        return model
    flat = np.concatenate([np.frombuffer(rows[i]["w"], np.float32) / rows[i]["n"] for i in range(SHARDS)])
    return model.load(flat)


def add_up(table: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the pieces of weights, by shard; one running sum per shard in memory."""
    n: dict[int, int] = {}
    w: dict[int, np.ndarray] = {}
    for rb in table:
        for shard, count, blob in zip(*(rb.column(i) for i in range(3))):
            k = shard.as_py()
            part = np.frombuffer(blob.as_buffer(), np.float32).astype(np.float64)
            w[k] = w[k] + part if k in w else part
            n[k] = n.get(k, 0) + count.as_py()
    if w:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(w), pa.int32()), pa.array([n[k] for k in w], pa.int64()),
             pa.array([w[k].astype(np.float32).tobytes() for k in w], pa.binary())], names=["shard", "n", "w"])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_tokens``, ``log_prob`` (sum over its tokens), ``score`` (mean per token)."""
    return score_encoded(encode(text_rows(docs, id_col, text_col), model), model, id_col)


def score_encoded(encoded: DataFrame, model: Model, id_col: str) -> DataFrame:
    spark = encoded.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def fn(rb: pa.RecordBatch) -> dict:
        m, n, total = shared.value, [], []
        for part in batches([rb], 2, LINE_BYTES):
            line, places, owner = lay_out(part.column(2))
            lp = log_probs(m, line, places)
            rare = np.flatnonzero(line[places] >= SYMBOLS - BUCKETS)
            if m.bucket_n is not None:
                lp[rare] -= np.log(m.bucket_n + 1)[line[places[rare]] - (SYMBOLS - BUCKETS)]
            n.append(np.bincount(owner, minlength=part.num_rows))
            total.append(np.bincount(owner, lp, part.num_rows))
        return {"_row": rb.column(0), "_key": rb.column(1), "n_tokens": np.concatenate(n),
                "log_prob": np.concatenate(total)}

    kind = encoded.schema["_key"].dataType.simpleString()
    scored = map_batches(encoded.where("line is not null").select("_row", "_key", "line"), fn,
                         f"_row long, _key {kind}, n_tokens long, log_prob double", text=2, max_chars=COUNT_CHARS)
    counts = spark.read.parquet(model.counts) if model.counts else spark.createDataFrame([], "word binary, n long")
    unseen = -(F.length("word") + 1) * float(np.log(LETTERS))
    shares = (encoded.where("word is not null").join(counts, "word", "left")
              .select(F.coalesce(F.log("n"), unseen).alias("lp"), F.explode(F.arrays_zip("rows", "times")).alias("at"))
              .groupBy(F.col("at.rows").alias("_row")).agg(F.sum(F.col("lp") * F.col("at.times")).alias("rare")))
    total = F.col("log_prob") + F.coalesce("rare", F.lit(0.0))
    return (scored.join(shares, "_row", "left")
            .select(F.col("_key").alias(id_col), "n_tokens", total.alias("log_prob"),
                    F.when(F.col("n_tokens") > 0, total / F.col("n_tokens")).alias("score")))
