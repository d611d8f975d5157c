"""Language-model scores from a log-bilinear model trained by noise-contrastive estimation.

Counting is Spark's: words of all training texts, then the trigrams of their classes. A class is one of the CLASSES - 1
most frequent tokens, or `rest` for all others. The model predicts a class from the two before it: the context vectors
are weighted per place and added up, the class scores are their products with the class vectors plus a bias. Training
runs in rounds: every partition of the trigram table takes minibatch steps on a copy of the parameters, drawing trigrams
by their counts and noise by class counts, and Spark averages the copies. The parameters have a fixed size.

Scoring multiplies the distinct contexts of a batch with all class vectors at once and normalises over all classes. A
token in `rest` gets the class probability times its smoothed share among the rest tokens, so that the probabilities of
all training tokens and one unseen token add up to 1.

Counts of the tokens that make up at least one part in HEAD of all training tokens are broadcast: there cannot be more
than HEAD of them, however large the corpus. The other tokens of a text are joined to the word counts by a shuffle.
Frequent words thus never meet in one task, and the whole word table does not pass through the driver.

Defined results: a null text counts as empty and consists of its end alone. Rows are told apart by doc_id and text; rows
that repeat both get the same scores, each its own row. Tokens that tie in count are ranked by their bytes. Without
training texts every token is unseen. An empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import SPACE, lowered, stored
from tallyforge.llm.shingles import slices

CLASSES = 512
DIMENSION = 24
HEAD = 2_000_000
ROUNDS = 4
NOISE = 64
BATCH = 512
RATE = 0.15
DRAWS = 2
SMOOTH = 0.5
#: The end of a text, as a token; no word holds a space.
END = " "


@dataclass(frozen=True)
class Counts:
    """Of training tokens: the whole word table, the frequent ones in order, and how many there are of all and distinct."""

    words: DataFrame
    head: list[tuple[bytes, int]]
    total: int
    distinct: int
    classes: int

    @property
    def rest(self) -> tuple[int, int]:
        """All and distinct tokens outside the classes of their own."""
        named = self.head[: self.classes - 1]
        return self.total - sum(c for _, c in named), self.distinct - len(named)


def tokens(text: Column) -> Column:
    words = F.array_remove(F.split(lowered(F.coalesce(text, F.lit(""))), f"{SPACE}+"), "")
    return F.concat(words, F.array(F.lit(END)))


def count_words(training: DataFrame, text: str, classes: int = CLASSES, head: int = HEAD) -> Counts:
    each = training.select(F.explode(tokens(F.col(f"`{text}`"))).alias("word"))
    words = stored(each.groupBy("word").agg(F.count("*").alias("c")), "word-counts")
    sums = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("total"), F.count("*").alias("n")).first()
    frequent = words.filter(F.col("c") * head >= sums["total"]).select("word", "c").toArrow()
    pairs = zip(frequent["word"].to_pylist(), frequent["c"].to_pylist())
    top = sorted(((word.encode(), c) for word, c in pairs), key=lambda w: (-w[1], w[0]))
    return Counts(words, top, sums["total"], sums["n"], classes)


def token_ids(text: bytes | None, ids: dict[bytes, int], end: int) -> tuple[list[int], list[bytes]]:
    """Rank of every token in the head, -1 outside, and the tokens themselves; bytes.split() cuts at ASCII space."""
    words = (text or b"").lower().split()
    words.append(END.encode())
    return [ids.get(w, -1) for w in words], words


def class_codes(ranks: np.ndarray, starts: np.ndarray, classes: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Class of every token, and the code of the two classes before it; texts begin after their neighbour's end."""
    own = np.where((ranks < 0) | (ranks >= classes - 1), classes - 1, ranks).astype(np.int64)
    before = np.concatenate([[end], own[:-1]])
    earlier = np.concatenate([[end, end], own[:-2]])[: len(own)]
    before[starts] = end
    earlier[starts] = end
    second = starts + 1
    earlier[second[second < len(own)]] = end
    return own, earlier * classes + before


def _ranked(batch_texts, ids: dict[bytes, int], end: int) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
    ranks, lengths, words = [], [], []
    for text in batch_texts:
        found, said = token_ids(text, ids, end)
        ranks += found
        lengths.append(len(found))
        words.append(said)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if lengths else np.zeros(0, np.int64)
    return np.array(ranks, np.int64), starts, words


def count_trigrams(training: DataFrame, text: str, counts: Counts, name: str = "trigrams") -> DataFrame:
    """code (two classes before, and the class) and n, over all training tokens."""
    named = counts.head[: counts.classes - 1]
    known = training.sparkSession.sparkContext.broadcast({w: i for i, (w, _) in enumerate(named)})
    classes = counts.classes
    end = next((i for i, (w, _) in enumerate(named) if w == END.encode()), classes - 1)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for at, count in slices(batch.column(0)):
                ranks, starts, _ = _ranked(batch.column(0).slice(at, count).to_pylist(), known.value, end)
                own, context = class_codes(ranks, starts, classes, end)
                held.append(context * classes + own)
                size += len(own)
                if size > 1 << 21 or at + count == batch.num_rows:
                    codes, n = np.unique(np.concatenate(held), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(n, pa.int64())], names=["code", "n"])
                    held, size = [], 0

    body = training.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("text"))
    found = body.mapInArrow(counted, "code long, n long")
    return stored(found.groupBy("code").agg(F.sum("n").alias("n")), name)


@dataclass
class LogBilinear:
    """Context vectors, class vectors, weights of the two places, and class biases."""

    contexts: np.ndarray
    vectors: np.ndarray
    places: np.ndarray
    bias: np.ndarray

    @classmethod
    def start(cls, class_counts: np.ndarray, dimension: int, seed: int = 5) -> "LogBilinear":
        random = np.random.default_rng(seed)
        n = len(class_counts)
        share = (class_counts + 1) / (class_counts + 1).sum()
        draw = lambda: random.normal(0, 0.1, (n, dimension)).astype(np.float32)
        return cls(draw(), draw(), np.ones((2, dimension), np.float32), np.log(share).astype(np.float32))

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in (self.contexts, self.vectors, self.places, self.bias)])

    def like(self, flat: np.ndarray) -> "LogBilinear":
        out, at = [], 0
        for a in (self.contexts, self.vectors, self.places, self.bias):
            out.append(np.array(flat[at : at + a.size], np.float32).reshape(a.shape))
            at += a.size
        return LogBilinear(*out)

    def predicted(self, earlier: np.ndarray, before: np.ndarray) -> np.ndarray:
        return self.contexts[earlier] * self.places[0] + self.contexts[before] * self.places[1]

    def log_normaliser(self, predicted: np.ndarray, block: int = 8192) -> np.ndarray:
        """log of the summed exponentials over all classes, for every predicted vector."""
        out = np.empty(len(predicted), np.float32)
        for at in range(0, len(predicted), block):
            scores = predicted[at : at + block] @ self.vectors.T
            scores += self.bias
            top = scores.max(axis=1, keepdims=True)
            scores -= top
            np.exp(scores, out=scores)
            out[at : at + block] = np.log(scores.sum(axis=1)) + top[:, 0]
        return out

    def log_probabilities(self, context: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Natural log probability of each class after its context code; each distinct context is normalised once."""
        codes, place = np.unique(context, return_inverse=True)
        n = len(self.bias)
        predicted = self.predicted(codes // n, codes % n)
        scores = np.einsum("ij,ij->i", predicted[place], self.vectors[own]) + self.bias[own]
        return scores - self.log_normaliser(predicted)[place]

    def train(self, codes: np.ndarray, n: np.ndarray, noise: np.ndarray, draws: int, rate: float, seed: int) -> None:
        """Minibatch steps with AdaGrad; each batch shares its noise classes, drawn by their share `noise`."""
        random = np.random.default_rng(seed)
        classes = len(self.bias)
        upto, noise_upto = np.cumsum(n), np.cumsum(noise)
        log_noise = np.log(noise * NOISE).astype(np.float32)
        pasts = [np.full(a.shape, 1e-2, np.float32) for a in (self.contexts, self.vectors, self.places, self.bias)]

        def step(values: np.ndarray, past: np.ndarray, rows: np.ndarray, gradient: np.ndarray) -> None:
            order = np.argsort(rows, kind="stable")
            unique, starts = np.unique(rows[order], return_index=True)
            total = np.add.reduceat(gradient[order], starts, axis=0)
            past[unique] += total * total
            values[unique] += rate * total / np.sqrt(past[unique])

        for _ in range(max(1, draws // BATCH)):
            drawn = codes[np.searchsorted(upto, random.random(BATCH) * upto[-1], side="right").clip(max=len(codes) - 1)]
            own, before, earlier = drawn % classes, drawn // classes % classes, drawn // classes // classes
            wrong = np.searchsorted(noise_upto, random.random(NOISE) * noise_upto[-1], side="right").clip(max=classes - 1)
            guess = self.predicted(earlier, before)
            good = np.einsum("ij,ij->i", guess, self.vectors[own]) + self.bias[own] - log_noise[own]
            bad = guess @ self.vectors[wrong].T + self.bias[wrong] - log_noise[wrong]
            up = 1 / (1 + np.exp(good.clip(-30, 30)))
            down = -1 / (1 + np.exp(-bad.clip(-30, 30)))
            towards = up[:, None] * self.vectors[own] + down @ self.vectors[wrong]
            by_place = [(towards * self.contexts[earlier]).sum(axis=0), (towards * self.contexts[before]).sum(axis=0)]
            rows = np.concatenate([own, wrong])
            class_gradient = np.concatenate([up[:, None] * guess, down.T @ guess]) / BATCH
            bias_gradient = np.concatenate([up, down.sum(axis=0)])[:, None] / BATCH
            context_gradient = np.concatenate([towards * self.places[0], towards * self.places[1]]) / BATCH
            step(self.vectors, pasts[1], rows, class_gradient)
            step(self.bias[:, None], pasts[3][:, None], rows, bias_gradient)
            step(self.contexts, pasts[0], np.concatenate([earlier, before]), context_gradient)
            step(self.places, pasts[2], np.arange(2), np.stack(by_place) / BATCH)


def fit(trigrams: DataFrame, counts: Counts, dimension: int = DIMENSION, rounds: int = ROUNDS, rate: float = RATE) -> LogBilinear:
    """Parameters after `rounds` rounds of steps on all partitions of `trigrams`, averaged by rows after each."""
    spark, classes = trigrams.sparkSession, counts.classes
    named = np.array([c for _, c in counts.head[: classes - 1]] + [0] * (classes - 1 - len(counts.head)), np.float64)
    class_counts = np.concatenate([named[: classes - 1], [max(0, counts.rest[0])]])
    noise = (class_counts + 1) / (class_counts + 1).sum()
    model = LogBilinear.start(class_counts, dimension)
    size = model.flat().size

    def rounds_of(number: int, held):
        def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codes, n = [], []
            for batch in batches:
                codes.append(batch.column(0).to_numpy())
                n.append(batch.column(1).to_numpy())
                if sum(map(len, codes)) >= 1 << 20:
                    yield from steps(codes, n)
                    codes, n = [], []
            if codes:
                yield from steps(codes, n)

        def steps(codes, n) -> Iterator[pa.RecordBatch]:
            own = model.like(held.value)
            all_codes, all_n = np.concatenate(codes), np.concatenate(n)
            if not len(all_codes):
                return
            order = np.argsort(all_codes)
            all_codes, all_n = all_codes[order], all_n[order]
            seed = number * 1_000_003 + int(all_codes[0])
            own.train(all_codes, all_n, noise, DRAWS * len(all_codes) + 4 * BATCH, rate / (1 + number), seed)
            weight = float(len(all_codes))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(size), pa.int32()), pa.array(own.flat().astype(np.float64) * weight, pa.float64()), pa.array(np.full(size, weight), pa.float64())],
                names=["at", "value", "weight"],
            )

        return trained

    for number in range(rounds):
        held = spark.sparkContext.broadcast(model.flat())
        parts = trigrams.mapInArrow(rounds_of(number, held), "at int, value double, weight double")
        mean = parts.groupBy("at").agg((F.sum("value") / F.sum("weight")).alias("value")).toPandas()
        if len(mean) == size:
            model = model.like(mean.sort_values("at")["value"].to_numpy())
    return model


def score(docs: DataFrame, counts: Counts, model: LogBilinear, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of every row."""
    context = docs.sparkSession.sparkContext
    classes = counts.classes
    known = context.broadcast({w: i for i, (w, _) in enumerate(counts.head)})
    head_counts = np.array([c for _, c in counts.head], np.float64)
    end = next((i for i, (w, _) in enumerate(counts.head[: classes - 1]) if w == END.encode()), classes - 1)
    total = counts.total + SMOOTH * (counts.distinct + 1)
    rest_all, rest_distinct = counts.rest
    rest_total = rest_all + SMOOTH * (rest_distinct + 1)
    held = context.broadcast((model, head_counts))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lbl, c = held.value
        base = np.concatenate([np.log10((c + SMOOTH) / total), [0.0]])
        inside = np.concatenate([np.log10((c + SMOOTH) / rest_total), [0.0]])
        inside[: min(classes - 1, len(c))] = 0.0
        for whole in batches:
            for at, count in slices(whole.column(2)):
                batch = whole.slice(at, count)
                ranks, starts, words = _ranked(batch.column(2).to_pylist(), known.value, end)
                own, codes = class_codes(ranks, starts, classes, end)
                model_parts = lbl.log_probabilities(codes, own) / np.log(10) + inside[ranks]
                ends = np.append(starts[1:], len(ranks))
                rare = [[w for w, r in zip(said, ranks[a:b]) if r < 0] for said, a, b in zip(words, starts, ends)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        batch.column(1),
                        pa.array(ends - starts, pa.int64()),
                        pa.array(np.add.reduceat((ranks >= 0).astype(np.int64), starts), pa.int64()),
                        pa.array(np.add.reduceat(base[ranks], starts), pa.float64()),
                        pa.array(np.add.reduceat(model_parts, starts), pa.float64()),
                        pa.array([[w.decode() for w in r] for r in rare], pa.list_(pa.string())),
                    ],
                    names=["doc_id", "hash", "n_tokens", "n_head", "base", "model", "rare"],
                )

    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(body).alias("hash"), body.cast("binary").alias("text")
    ).mapInArrow(scored, "doc_id long, hash long, n_tokens long, n_head long, base double, model double, rare array<string>")
    # One more entry per row bears the row's own values; its key holds a space, so it never meets a word, and its hash
    # spreads it.
    row = F.struct("n_tokens", "n_head", "base", "model").alias("row")
    marker = F.concat(F.lit(END), F.col("hash").cast("string"), F.lit(END))
    entries = rows.select("doc_id", "hash", row, F.explode(F.concat("rare", F.array(marker))).alias("word")).select(
        "doc_id", "hash", F.when(F.col("word") == marker, F.col("row")).alias("row"), "word"
    )
    c = F.coalesce(F.col("c"), F.lit(0))
    is_row = F.col("row").isNotNull()
    joined = entries.join(counts.words, "word", "left").select(
        "doc_id",
        "hash",
        "row",
        F.when(is_row, 0.0).otherwise(F.log10((c + SMOOTH) / F.lit(total))).alias("base"),
        F.when(is_row, 0.0).otherwise(F.log10((c + SMOOTH) / F.lit(rest_total))).alias("rest"),
        F.when(is_row, 0).otherwise((c > 0).cast("long")).alias("known"),
    )
    sums = joined.groupBy("doc_id", "hash").agg(
        F.sum("base").alias("base"),
        F.sum("rest").alias("rest"),
        F.sum("known").alias("known"),
        F.count("row").alias("copies"),
        F.max("row").alias("row"),
    )
    share = F.col("copies")
    return sums.select(
        "doc_id",
        F.col("row.n_tokens").alias("n_tokens"),
        (F.col("row.n_head") + (F.col("known") / share).cast("long")).alias("n_known"),
        (F.col("row.base") + F.col("base") / share).alias("base_score"),
        (F.col("row.model") + F.col("rest") / share).alias("score"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"),
    ).drop("_copy")


def lm_scores(docs: DataFrame, training: DataFrame, text: str = "text", doc_id: str = "doc_id", classes: int = CLASSES, head: int = HEAD) -> DataFrame:
    """Learns from `training` and scores `docs`: doc_id, n_tokens, n_known, train_tokens, base_score, score."""
    counts = count_words(training, text, classes, head)
    model = fit(count_trigrams(training, text, counts), counts)
    return score(docs, counts, model, text, doc_id).withColumn("train_tokens", F.lit(counts.total).cast("long"))
