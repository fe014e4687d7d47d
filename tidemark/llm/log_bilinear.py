"""Language-model scores by a log-bilinear neural model with two levels of words.

Classes are the `TOP` most frequent tokens and one for all others. The model predicts a token's
class from the two latest tokens before it that have a class of their own: a context vector is the
sum of their vectors, scaled per position, and a class's score its product with the class's output
vector plus a bias. Within the class of all others every token with a count of two or more, `SHIPPED`
at most, has an output vector and bias of its own, and one more word stands for the rest; they are
scored in the same way, with the context's vector taken as the nearest of `STATES` centres of all
context vectors. The vocabulary thus grows with the corpus.

Both levels are trained in numpy with noise-contrastive estimation. Classes: executors run over the
corpus's counted class triples, a stochastic gradient each from the same start, and the results are
averaged, weighted by tokens, for a few rounds. Words: what the objective needs of a word is how often
it occurs in each state, and its noise is known in expectation, so every word is a small convex
problem of its own and words are spread over the executors. Probabilities are normalised exactly, by
matrix products over all classes for each of the (TOP + 2) ** 2 contexts, and over all words for each
state. A token of the rest gets its word's probability times its add-one share among such tokens, so
that the probabilities of all tokens, an unseen one included, sum to 1.

Counts cover every training document. Tokens are 64-bit hashes. Scoring a text needs its tokens'
counts: those of the words above (their number is a proven bound) are sent to the executors; rarer
ones are counted per document and joined, which spreads evenly as frequent ones are gone.

Defined results: a null or empty text is one end token; a very long text is scored whole; without
training documents every count is 0 and the model is the uniform start. Of tokens equally frequent
those of smaller hash become classes; words are kept from a count on, so equal counts are treated
alike. Rows are scored each, repeated ones alike. Null keys train as an empty key's text does. An
empty table gives an empty result. Extra columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.words import SPACED, Splitter, slices
from tidemark.plans.skew import materialize

TOP = 511
STATES = 32
SIZE = 16
NOISE = 64
STEP = 0.3
ROUNDS = 3
PASSES = 3  # of each executor over its triples within a round
MINIBATCH = 1000
SHIPPED = 500_000
WORD_NOISE = 25  # noise words for each word of the second level
SHRINK = 1.0  # pull of a word's vector towards none
NEWTON = 25  # steps at most; a handful suffice
FOLDS, HELD_OUT = 7, 2
END = np.uint64(0x656E64)  # stands for the end of a text; words have mixed hashes
SLICE = 1 << 21


def held_out(key: Column, folds: int = FOLDS, fold: int = HELD_OUT) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds == fold


def tokens_of(texts: pa.Array, splitter: Splitter) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each closed by END, and where each text starts (and the end)."""
    words = splitter.words(texts)
    n = len(texts)
    first = words.first + np.arange(n + 1)
    out = np.full(len(words.hashes) + n, END, dtype=np.uint64)
    out[np.arange(len(words.hashes)) + words.doc] = words.hashes
    return out, first


def _index(sorted_hashes: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Place of each token in `sorted_hashes`, -1 if absent."""
    if not len(sorted_hashes):
        return np.full(len(tokens), -1)
    at = np.minimum(np.searchsorted(sorted_hashes, tokens), len(sorted_hashes) - 1)
    return np.where(sorted_hashes[at] == tokens, at, -1)


@dataclass
class Vocabulary:
    """Hashes of the classes in ascending order; the class after them is for all other tokens."""

    hashes: np.ndarray
    noise: np.ndarray  # share of each class among training tokens, smoothed

    @property
    def size(self) -> int:
        return len(self.hashes) + 1

    def classes(self, tokens: np.ndarray) -> np.ndarray:
        found = _index(self.hashes, tokens)
        return np.where(found < 0, self.size - 1, found)

    def contexts(self, classes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The two latest classes before each token other than the class of all others; `size` stands before a text."""
        own = np.flatnonzero(classes < self.size - 1)
        held = np.concatenate([classes[own], [self.size]])  # -1 is the start
        start = np.repeat(np.searchsorted(own, first[:-1]), np.diff(first))  # own tokens before the text
        latest = np.searchsorted(own, np.arange(len(classes))) - 1
        return held[np.where(latest - 1 >= start, latest - 1, -1)], held[np.where(latest >= start, latest, -1)]


class Model:
    """Parameters as one flat array: context vectors, position scales, output vectors, biases."""

    def __init__(self, vocabulary: Vocabulary, flat: np.ndarray | None = None, dtype=np.float64):
        v = vocabulary.size
        shapes = ((v + 1, SIZE), (2, SIZE), (v, SIZE), (v,))
        if flat is None:
            rng = np.random.default_rng(3)
            parts = [rng.normal(0, 0.3, shapes[0]), np.ones(shapes[1]), rng.normal(0, 0.1, shapes[2]), np.log(vocabulary.noise)]
            flat = np.concatenate([p.ravel() for p in parts])
        self.flat = np.array(flat, dtype=dtype)
        cuts = np.cumsum([int(np.prod(s)) for s in shapes])[:-1]
        self.words, self.scales, self.outputs, self.biases = (p.reshape(s) for p, s in zip(np.split(self.flat, cuts), shapes))

    def context(self, before: np.ndarray, last: np.ndarray) -> np.ndarray:
        return self.words[before] * self.scales[0] + self.words[last] * self.scales[1]

    def normalisers(self) -> np.ndarray:
        """Log sums over all classes for every pair of classes before a token, by blocks of pairs."""
        width = len(self.words)
        outputs, biases = self.outputs.T.astype(np.float32), self.biases.astype(np.float32)
        norm = np.empty(width * width)
        for i in range(0, len(norm), 2048):
            pair = np.arange(i, min(i + 2048, len(norm)))
            scores = self.context(pair // width, pair % width).astype(np.float32) @ outputs + biases
            top = scores.max(axis=1)
            norm[pair] = top + np.log(np.exp(scores - top[:, None]).sum(axis=1, dtype=np.float64))
        return norm

    def log_probabilities(self, before: np.ndarray, last: np.ndarray, target: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """Natural logs, normalised over all classes."""
        out = np.empty(len(target))
        for i in range(0, len(target), 1 << 16):
            s = slice(i, i + (1 << 16))
            out[s] = (self.context(before[s], last[s]) * self.outputs[target[s]]).sum(axis=1) + self.biases[target[s]]
        return out - norm[before * len(self.words) + last]


def _scatter(place: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of `rows` by `place`, which is below `n`."""
    width = rows.shape[1]
    cells = (place[:, None] * width + np.arange(width)).ravel()
    return np.bincount(cells, weights=rows.ravel(), minlength=n * width).reshape(n, width)


class Trainer:
    """Noise-contrastive steps with one set of noise classes per minibatch."""

    def __init__(self, model: Model, vocabulary: Vocabulary, seed: int):
        self.model, self.noise = model, vocabulary.noise
        self.log_noise = np.log(NOISE * vocabulary.noise).astype(model.flat.dtype)
        self.cumulated = np.cumsum(vocabulary.noise)
        self.rng = np.random.default_rng(seed)
        self.seen = [np.full_like(p, 1e-3) for p in (model.words, model.scales, model.outputs, model.biases)]

    def step(self, before: np.ndarray, last: np.ndarray, target: np.ndarray, n: np.ndarray) -> None:
        m = self.model
        weight = (n / n.sum()).astype(m.flat.dtype)
        noise = np.searchsorted(self.cumulated, self.rng.random(NOISE) * self.cumulated[-1]).clip(0, len(self.noise) - 1)
        first, second, output, noise_output = m.words[before], m.words[last], m.outputs[target], m.outputs[noise]
        context = first * m.scales[0] + second * m.scales[1]
        of_target = np.einsum("ij,ij->i", context, output) + m.biases[target] - self.log_noise[target]
        of_noise = context @ noise_output.T + (m.biases[noise] - self.log_noise[noise])
        up = weight * (0.5 - 0.5 * np.tanh(0.5 * of_target))  # 1 - sigmoid
        down = np.tanh(0.5 * of_noise)
        down += 1
        down *= -0.5 * weight[:, None]
        to_context = up[:, None] * output + down @ noise_output
        outputs = _scatter(target, up[:, None] * context, len(m.outputs)) + _scatter(noise, down.T @ context, len(m.outputs))
        biases = np.bincount(target, weights=up, minlength=len(m.biases)) + np.bincount(noise, weights=down.sum(axis=0), minlength=len(m.biases))
        words = _scatter(before, to_context * m.scales[0], len(m.words)) + _scatter(last, to_context * m.scales[1], len(m.words))
        scales = np.stack([np.einsum("ij,ij->j", to_context, first), np.einsum("ij,ij->j", to_context, second)])
        for value, gradient, seen in zip((m.words, m.scales, m.outputs, m.biases), (words, scales, outputs, biases), self.seen):
            seen += gradient**2
            value += STEP * gradient / np.sqrt(seen)


def token_counts(docs: DataFrame) -> DataFrame:
    """token, c over rows with a column text."""

    def run(batches):
        splitter = Splitter(SPACED)
        for batch in batches:
            tokens = [tokens_of(part.column("text"), splitter)[0] for part in slices(batch, "text", 1 << 19)]
            hashes, n = np.unique(np.concatenate(tokens), return_counts=True) if tokens else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n.astype(np.int64))], names=["token", "c"])

    return docs.select("text").mapInArrow(run, "token long, c long").groupBy("token").agg(F.sum("c").alias("c"))


def most_frequent(counts: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (ascending) and counts of all tokens from some count on, at most `limit` of them.

    The count is read from how many tokens have each count, so no ranking of all tokens is needed.
    """
    by_count = counts.groupBy("c").agg(F.count("*").alias("n")).where(F.col("c") > 1)
    least = None
    high = by_count.agg(F.max("c")).head()[0]
    low = 2
    while high is not None and low <= high:  # the smallest count that keeps within the limit
        middle = (low + high) // 2
        if (by_count.where(F.col("c") >= middle).agg(F.sum("n")).head()[0] or 0) <= limit:
            least, high = middle, middle - 1
        else:
            low = middle + 1
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    table = counts.where(F.col("c") >= least).select("token", "c").toArrow()
    hashes, n = table["token"].to_numpy().view(np.uint64), table["c"].to_numpy()
    order = np.argsort(hashes)
    return hashes[order], n[order]


def triples(docs: DataFrame, vocabulary) -> DataFrame:
    """Counted class triples: triple (an integer code), n. `vocabulary` is a broadcast of hashes and noise."""

    def run(batches):
        splitter, v = Splitter(SPACED), Vocabulary(*vocabulary.value)
        for batch in batches:
            codes = []
            for part in slices(batch, "text", 1 << 19):
                tokens, first = tokens_of(part.column("text"), splitter)
                classes = v.classes(tokens)
                before, last = v.contexts(classes, first)
                codes.append((before * (v.size + 1) + last) * v.size + classes)
            code, n = np.unique(np.concatenate(codes), return_counts=True) if codes else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int64)), pa.array(n.astype(np.int64))], names=["triple", "n"])

    return docs.select("text").mapInArrow(run, "triple long, n long").groupBy("triple").agg(F.sum("n").alias("n"))


def train(counted: DataFrame, vocabulary, rounds: int = ROUNDS) -> np.ndarray:
    """The averaged parameters. What comes back to the driver is one model."""
    spark = counted.sparkSession
    flat = Model(Vocabulary(*vocabulary.value)).flat
    for turn in range(rounds):
        start = spark.sparkContext.broadcast(flat)

        def run(batches, start=start, turn=turn):
            v = Vocabulary(*vocabulary.value)
            model = Model(v, start.value, np.float32)
            trainer = Trainer(model, v, turn)
            held = [(b.column("triple").to_numpy(), b.column("n").to_numpy()) for b in batches]  # 16 bytes a triple
            code, n = (np.concatenate(x) for x in zip(*held)) if held else (np.zeros(0, np.int64),) * 2
            total = int(n.sum())
            for _ in range(PASSES):
                order = trainer.rng.permutation(len(code))
                for i in range(0, len(code), MINIBATCH):
                    s = order[i : i + MINIBATCH]
                    context, target = np.divmod(code[s], v.size)
                    trainer.step(*np.divmod(context, v.size + 1), target, n[s].astype(np.float64))
            if total:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(model.flat))), pa.array(model.flat.astype(np.float64) * total), pa.array(np.full(len(model.flat), total))],
                    names=["place", "value", "n"],
                )

        trained = counted.mapInArrow(run, "place long, value double, n long")
        mean = trained.groupBy("place").agg((F.sum("value") / F.sum("n")).alias("value")).toArrow()
        if mean.num_rows:
            flat = flat.copy()
            flat[mean["place"].to_numpy()] = mean["value"].to_numpy()
    return flat


# --- second level ---------------------------------------------------------------------------


def centres(model: Model, counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Centres of the context vectors, weighted by how often they occur, and the state of every context.

    Contexts are pairs of classes, (TOP + 2) ** 2 at most, so their counts are few.
    """
    v = len(model.biases)
    met = counted.groupBy(F.floor(F.col("triple") / v).cast("long").alias("pair")).agg(F.sum("n").alias("n")).toArrow()
    order = np.argsort(met["pair"].to_numpy())
    pairs, n = met["pair"].to_numpy()[order], met["n"].to_numpy()[order].astype(np.float64)
    every = np.arange((v + 1) ** 2)
    vectors = model.context(every // (v + 1), every % (v + 1))
    if not len(pairs):
        return np.zeros((1, SIZE)), np.zeros(len(every), dtype=np.int8)
    k = min(STATES, len(pairs))
    found = vectors[pairs]
    chosen = np.random.default_rng(5).choice(len(pairs), size=k, replace=False, p=n / n.sum()) if (n > 0).sum() >= k else np.arange(k)
    middle = found[chosen]
    for _ in range(20):
        state = _nearest(found, middle)
        weight = np.bincount(state, weights=n, minlength=k)
        sums = np.stack([np.bincount(state, weights=n * found[:, j], minlength=k) for j in range(SIZE)], axis=1)
        moved = np.where(weight[:, None] > 0, sums / np.maximum(weight, 1)[:, None], middle)
        if np.allclose(moved, middle, atol=1e-6):
            break
        middle = moved
    return middle, np.concatenate([_nearest(vectors[i : i + (1 << 16)], middle) for i in range(0, len(every), 1 << 16)]).astype(np.int8)


def _nearest(vectors: np.ndarray, middle: np.ndarray) -> np.ndarray:
    return ((middle**2).sum(axis=1) - 2 * vectors @ middle.T).argmin(axis=1)


def word_states(docs: DataFrame, vocabulary, words, states) -> DataFrame:
    """word (its place; the rest is the last), state, n: where tokens without a class of their own occur."""

    def run(batches):
        splitter, v, hashes, state_of = Splitter(SPACED), Vocabulary(*vocabulary.value), words.value, states.value
        for batch in batches:
            codes = []
            for part in slices(batch, "text", 1 << 19):
                tokens, first = tokens_of(part.column("text"), splitter)
                classes = v.classes(tokens)
                before, last = v.contexts(classes, first)
                other = classes == v.size - 1
                at = _index(hashes, tokens[other])
                state = state_of[(before * (v.size + 1) + last)[other]].astype(np.int64)
                codes.append(np.where(at < 0, len(hashes), at) * STATES + state)
            code, n = np.unique(np.concatenate(codes), return_counts=True) if codes else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int64)), pa.array(n.astype(np.int64))], names=["code", "n"])

    summed = docs.select("text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    return summed.select(F.floor(F.col("code") / STATES).cast("long").alias("word"), (F.col("code") % STATES).cast("int").alias("state"), "n")


def estimate(n: np.ndarray, of_state: np.ndarray, middle: np.ndarray) -> np.ndarray:
    """Vectors and biases (last column) of words that occur n[word, state] times, by noise-contrastive estimation.

    The noise is WORD_NOISE words for each of the `of_state` tokens of a state, a word's share of it
    being its share of all tokens; its expectation stands in for draws. Newton steps on every word's
    objective at once, with a pull of SHRINK towards no vector.
    """
    total = max(of_state.sum(), 1.0)
    share = n.sum(axis=1) / total
    noise = WORD_NOISE * share[:, None] * of_state  # expected noise by word and state
    inputs = np.concatenate([middle, np.ones((len(middle), 1))], axis=1)
    offset = np.log(WORD_NOISE * np.maximum(share, 1e-300))[:, None]
    weights = np.zeros((len(n), inputs.shape[1]))
    weights[:, -1] = np.log(np.maximum(share, 1e-300))
    pull = np.r_[np.full(SIZE, SHRINK), 1e-6]
    rest = weights[:, -1].copy()
    squares = np.einsum("si,sj->sij", inputs, inputs).reshape(len(inputs), -1)
    moving = np.arange(len(n))
    for _ in range(NEWTON):
        now, mine, noisy = weights[moving], n[moving], noise[moving]
        p = 1 / (1 + np.exp(-np.clip(now @ inputs.T - offset[moving], -30, 30)))
        centred = now.copy()
        centred[:, -1] -= rest[moving]
        gradient = (mine * (1 - p) - noisy * p) @ inputs - pull * centred
        curve = (((mine + noisy) * p * (1 - p)) @ squares).reshape(-1, len(pull), len(pull)) + np.diag(pull)
        step = np.linalg.solve(curve, gradient[:, :, None])[:, :, 0]
        size = np.abs(step).max(axis=1, initial=0.0)
        weights[moving] += step * np.minimum(1.0, 2.0 / np.maximum(size, 1e-12))[:, None]
        moving = moving[size > 1e-4]
        if len(moving) == 0:
            break
    return weights


def word_weights(counted: DataFrame, of_state: np.ndarray, middle: np.ndarray, n_words: int) -> np.ndarray:
    """A row of SIZE + 1 numbers for each of `n_words` words; words are worked out on the executors."""
    per_word = counted.groupBy("word").agg(F.collect_list(F.struct("state", "n")).alias("held"))  # STATES entries at most
    spark = counted.sparkSession
    shipped = spark.sparkContext.broadcast((of_state, middle))

    def run(batches):
        of_state, middle = shipped.value
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                held = part.column("held")
                row = np.repeat(np.arange(part.num_rows), np.diff(held.offsets.to_numpy()))
                flat = held.flatten()
                n = np.zeros((part.num_rows, len(middle)))
                n[row, flat.field("state").to_numpy()] = flat.field("n").to_numpy()
                weights = estimate(n, of_state, middle).astype(np.float32)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(weights.ravel()), weights.shape[1]).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([part.column("word"), lists], names=["word", "weights"])

    found = per_word.mapInArrow(run, "word long, weights array<float>").toArrow()
    out = np.zeros((n_words, SIZE + 1), dtype=np.float32)
    out[:, -1] = -np.inf
    if found.num_rows:
        out[found["word"].to_numpy()] = found["weights"].combine_chunks().flatten().to_numpy().reshape(-1, SIZE + 1)
    return out


def normalisers(weights: np.ndarray, middle: np.ndarray) -> np.ndarray:
    """Log sums over all words for each state, by blocks of words."""
    out = np.full(len(middle), -np.inf)
    for i in range(0, len(weights), 1 << 16):
        part = weights[i : i + (1 << 16)].astype(np.float64)
        out = np.logaddexp(out, np.logaddexp.reduce(middle @ part[:, :SIZE].T + part[:, SIZE], axis=1))
    return np.where(np.isfinite(out), out, 0.0)


@dataclass
class Fitted:
    """All that scoring needs, as arrays and numbers."""

    hashes: np.ndarray  # of the tokens whose count is known everywhere, ascending
    counts: np.ndarray
    classes: np.ndarray  # hashes of the first level, ascending
    noise: np.ndarray
    flat: np.ndarray
    class_norm: np.ndarray  # log sums over all classes, by context
    words: np.ndarray  # hashes of the second level, ascending; the rest comes after them
    weights: np.ndarray
    norm: np.ndarray  # log sums over all words, by state
    middle: np.ndarray
    state_of: np.ndarray
    total: int  # training tokens, and how many distinct
    distinct: int
    rest_total: int  # of these, those of the rest
    rest_distinct: int

    def __post_init__(self):
        self.vocabulary = Vocabulary(self.classes, self.noise)
        self.model = Model(self.vocabulary, self.flat)

    def log_probabilities(self, tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Natural logs of each token's probability, but for its share of the rest, and whether it belongs there."""
        v = self.vocabulary
        classes = v.classes(tokens)
        before, last = v.contexts(classes, first)
        logs = self.model.log_probabilities(before, last, classes, self.class_norm)
        other = np.flatnonzero(classes == v.size - 1)
        at = _index(self.words, tokens[other])
        rest = np.zeros(len(tokens), dtype=bool)
        rest[other] = at < 0
        weights = self.weights[np.where(at < 0, len(self.words), at)]
        state = self.state_of[before[other] * (v.size + 1) + last[other]]
        score = np.einsum("ij,ij->i", weights[:, :SIZE].astype(np.float64), self.middle[state]) + weights[:, SIZE]
        logs[other] += score - self.norm[state]
        return logs, rest


def fit(training: DataFrame, counts: DataFrame, rounds: int = ROUNDS) -> Fitted:
    """The model of rows with a column text, whose token_counts are given."""
    spark = training.sparkSession
    total, distinct = (int(x or 0) for x in counts.agg(F.sum("c"), F.count("*")).head())
    hashes, n = most_frequent(counts, SHIPPED)
    top = np.zeros(len(hashes), dtype=bool)
    top[np.lexsort((hashes, -n))[:TOP]] = True
    shares = np.concatenate([n[top], [total - n[top].sum()]]) + 1.0
    classes, noise, words = hashes[top], shares / shares.sum(), hashes[~top]
    vocabulary = spark.sparkContext.broadcast((classes, noise))
    counted = materialize(triples(training, vocabulary), "triples")
    flat = train(counted, vocabulary, rounds)
    model = Model(Vocabulary(classes, noise), flat)
    middle, state_of = centres(model, counted)
    second = word_states(training, vocabulary, spark.sparkContext.broadcast(words), spark.sparkContext.broadcast(state_of))
    second = materialize(second, "word_states")
    of_state = np.zeros(len(middle))
    for r in second.groupBy("state").agg(F.sum("n").alias("n")).collect():  # a row per state
        of_state[r["state"]] = r["n"]
    weights = word_weights(second, of_state, middle, len(words) + 1)
    if np.isneginf(weights[-1, -1]):  # no token of the rest was met; one may be when scoring
        weights[-1, -1] = -np.log(of_state.sum() + 1)
    norm = normalisers(weights, middle)
    return Fitted(hashes, n, classes, noise, flat, model.normalisers(), words, weights, norm, middle, state_of, total, distinct, int(total - n.sum()), int(distinct - len(n)))


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Per row: key, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    spark = docs.sparkSession
    slim = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    training = slim.where(~held_out(F.col("id")))
    counts = materialize(token_counts(training), "token_counts")
    fitted = fit(training, counts, rounds)
    total = fitted.total
    # plain arrays: an executor unpickles a broadcast without this package at hand
    arrays = spark.sparkContext.broadcast(tuple(getattr(fitted, f.name) for f in fields(Fitted)))
    all_of = float(fitted.total + fitted.distinct + 1)  # base: (c + 1) / (N + V + 1)
    others_of = float(fitted.rest_total + fitted.rest_distinct + 1)  # among tokens of the rest

    def run(batches):
        splitter, model = Splitter(SPACED), Fitted(*arrays.value)
        hashes, n = model.hashes, model.counts
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                tokens, first = tokens_of(part.column("text"), splitter)
                rows = len(first) - 1
                doc = np.repeat(np.arange(rows), np.diff(first))
                logs = model.log_probabilities(tokens, first)[0] / np.log(10)
                at = _index(hashes, tokens)
                known = at >= 0
                c = np.where(known, n[at] if len(n) else 0, 0)
                base = np.where(known, np.log10((c + 1) / all_of), 0.0)
                rare = np.flatnonzero(~known)
                pair = np.lexsort((tokens[rare], doc[rare]))
                rare_doc, rare_token = doc[rare][pair], tokens[rare][pair]
                new = np.ones(len(pair), dtype=bool)
                new[1:] = (rare_doc[1:] != rare_doc[:-1]) | (rare_token[1:] != rare_token[:-1])
                starts = np.flatnonzero(new)
                times = np.diff(np.concatenate([starts, [len(pair)]]))
                offsets = pa.array(np.searchsorted(rare_doc[starts], np.arange(rows + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (rare_token[starts].view(np.int64), times.astype(np.int64))]
                sums = [np.bincount(doc, weights=x, minlength=rows) for x in (known, base, logs)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("id"), pa.array(np.diff(first)), pa.array(sums[0].astype(np.int64)),
                     pa.array(sums[1]), pa.array(sums[2]), *lists],
                    names=["row", "id", "n_tokens", "n_known", "base", "score", "rare", "times"],
                )

    numbered = slim.withColumn("row", F.monotonically_increasing_id())
    schema = T.StructType([numbered.schema["row"], numbered.schema["id"]])
    schema = T.StructType(schema.fields + T._parse_datatype_string(
        "n_tokens long, n_known long, base double, score double, rare array<long>, times array<long>"
    ).fields)
    scored = materialize(numbered.select("row", "id", "text").mapInArrow(run, schema), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("token"), F.col("x.times").alias("times"))
    met = rare.join(counts, "token", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    more = met.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * F.log10((F.col("c") + 1) / F.lit(all_of))).alias("more_base"),
        F.sum(F.col("times") * F.log10((F.col("c") + 1) / F.lit(others_of))).alias("more_score"),
    )
    joined = scored.drop("rare", "times").join(more, "row", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return joined.select(
        F.col("id").alias(key), held_out(F.col("id")).alias("held_out"), "n_tokens", plus("n_known", "more_known").cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"), F.round(plus("base", "more_base"), 9).alias("base_score"),
        F.round(plus("score", "more_score"), 9).alias("score"),
    )
