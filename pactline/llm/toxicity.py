"""Toxicity scores from a subsequence string kernel with Nyström landmarks and a linear SVM.

Words are compared by the gap-weighted subsequence kernel of length ``LENGTH`` (decay
``DECAY`` for every character spanned), normalised, over the word with marks at its ends:
a word with characters put in between (``i-d-i-o-t``, ``idxiot``) shares its subsequences
with the word itself at a lower weight. Single characters with spaces between them count as
one more word.

Sentences are compared as bags of words: the kernel of two sentences is the sum over their
words of two powers of the words' kernel (``POWERS``: the higher one counts near equal words,
the lower one gapped ones as well), and a landmark is a sentence of one word. The landmarks
are the ``LANDMARKS`` words that stand most oftener in distinct sentences of documents with
the label than in the rest. A sentence's kernel values with them, times the inverse root of
the landmarks' own kernel matrix, are its Nyström features.

A linear support vector machine is trained on labelled sentences: of each of at most
``SAMPLE`` labelled documents, chosen by a hash of doc_id, the sentence that is most like the
landmarks, as a label holds for a document as a whole. A document's margin is that of its
worst sentence (at least that of a sentence like no landmark); a logistic curve over it gives
the score.

Every word of every whole text is looked up, in lower case and without punctuation. Pairs of
a word and a landmark that share less than ``SHARED`` of the landmark's adjacent letter pairs
(up to three places apart in the word) count as 0, at every size of the data.

Defined cases: a null or empty text has no words and gets the score of an empty document;
equal texts get equal scores; repeated doc_ids each get a row; without labelled rows of
both kinds every score is the share of the label (0 without labels); an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pactline.llm._segments import SegmentCache
from pactline.llm._spark import in_batches, saved, table

LENGTH = 4
DECAY = 0.7
LANDMARKS = 64
SAMPLE = 8_000
THRESHOLD = 0.3
POWERS = (4, 8)
CACHED = 60_000  # words of a generation that a worker keeps
WIDTH = 24  # characters of a word at once; longer ones are compared in overlapping pieces
SHARED = 0.65
_OTHER = re.compile(r"[\W_]+")
#: the ends of sentences, for Python and for Spark alike
SENTENCE = r"[.!?]+(?:\s+|$)|\n+"
_ENDS = re.compile(SENTENCE)
_SPACED = re.compile(r"(?<!\S)\S(?:\s\S){2,}(?!\S)")


def _codes(words: list[str], width: int) -> np.ndarray:
    """Code points of each word between marks, padded with 0."""
    return np.array([f"^{w}$" for w in words], f"U{width + 2}").view(np.uint32).reshape(len(words), width + 2)


def subsequence_kernel(s: np.ndarray, t: np.ndarray, length: int = LENGTH, decay: float = DECAY) -> np.ndarray:
    """The gap-weighted count of common subsequences of each pair of rows (code points, 0 pads)."""
    match = (s[:, :, None] == t[:, None, :]) & (s[:, :, None] != 0)
    n, a, b = match.shape
    weight = np.where(match, np.float32(decay * decay), np.float32(0))
    prefix = np.ones((a + 1, b + 1, n), np.float32)
    weight = np.ascontiguousarray(weight.transpose(1, 2, 0))
    for _ in range(length - 1):
        grown = np.zeros_like(prefix)
        for i in range(1, a + 1):
            run = np.zeros(n, np.float32)
            for j in range(1, b + 1):
                run = run * np.float32(decay) + weight[i - 1, j - 1] * prefix[i - 1, j - 1]
                grown[i, j] = grown[i - 1, j] * np.float32(decay) + run
        prefix = grown
    return (weight * prefix[:-1, :-1]).sum(axis=(0, 1))


def _pair_bits(codes: np.ndarray, reach: int) -> np.ndarray:
    """Which hashed ordered pairs of characters, up to ``reach`` places apart, a word has."""
    bits = np.zeros((len(codes), 512), np.float32)
    rows = np.arange(len(codes))
    for d in range(1, reach + 1):
        a, b = codes[:, :-d], codes[:, d:]
        h = ((a * np.uint32(40503) ^ b * np.uint32(2654435)) >> np.uint32(3)) % np.uint32(511) + np.uint32(1)
        h[(a == 0) | (b == 0)] = 0
        for j in range(h.shape[1]):
            bits[rows, h[:, j]] = 1
    bits[:, 0] = 0
    return bits


class Similarity:
    """Normalised kernel values of words with the landmarks, from a bounded cache."""

    def __init__(self, landmarks: list[str]):
        self.codes = _codes(landmarks, WIDTH)
        self.codes = self.codes[:, : int((self.codes != 0).sum(axis=1).max())]
        self.bits = _pair_bits(self.codes, 1)
        self.need = SHARED * self.bits.sum(axis=1)
        self.own = subsequence_kernel(self.codes, self.codes)
        self.cache = SegmentCache(self._many, CACHED)

    def _many(self, words: list[str]) -> list[tuple]:
        pieces, owner = [], []
        for k, w in enumerate(words):
            for at in range(0, max(1, len(w) - WIDTH // 2), WIDTH // 2) if len(w) > WIDTH else (0,):
                pieces.append(w[at : at + WIDTH])
                owner.append(k)
        out: list[dict[int, float]] = [{} for _ in words]
        for lo in range(0, len(pieces), 2_000):
            codes = _codes(pieces[lo : lo + 2_000], WIDTH)
            p, l = np.nonzero(_pair_bits(codes, 3) @ self.bits.T >= self.need)
            for at in range(0, len(p), 500):
                own, mark = p[at : at + 500], l[at : at + 500]
                used, back = np.unique(own, return_inverse=True)
                wide = codes[used]
                wide = wide[:, : max(1, int((wide != 0).sum(axis=1).max()))]
                value = subsequence_kernel(wide[back], self.codes[mark])
                value = value / np.sqrt(np.maximum(subsequence_kernel(wide, wide)[back] * self.own[mark], 1e-30))
                for r, m, v in zip(own.tolist(), mark.tolist(), value.tolist()):
                    k = owner[lo + r]
                    if v > out[k].get(m, 0.0):
                        out[k][m] = v
        return [tuple(x.items()) for x in out]

    def sentences(self, texts: list[str]) -> list[np.ndarray]:
        """For each text, the kernel values with the landmarks of its distinct sentences that are like any."""
        lowered = [text.lower() for text in texts]
        rows = [_words(text) for text in lowered]
        every = list(set().union(*(words.values() for words in rows)))
        near = {w: found for w, found in zip(every, self.cache(every)) if found}
        out = []
        for text, words in zip(lowered, rows):
            like = {token: w for token, w in words.items() if w in near}
            found = {}
            for sentence in _ENDS.split(text) if like else ():
                own = {like[token] for token in sentence.split() if token in like}
                own.update(like[m] for m in _SPACED.findall(sentence) if m in like)
                if own:
                    value = np.zeros((len(POWERS), len(self.codes)))
                    for w in sorted(own):
                        for m, v in near[w]:
                            for k, power in enumerate(POWERS):
                                value[k, m] += v**power
                    found[value.tobytes()] = value
            out.append(np.array(list(found.values())).reshape(-1, len(POWERS) * len(self.codes)))
        return out


def _words(text: str) -> dict[str, str]:
    """The word of each distinct token of a text in lower case; single characters with spaces between them are one more token."""
    words = {t: t if t.isalpha() else _OTHER.sub("", t) for t in set(text.split())}
    for m in _SPACED.findall(text):
        for part in {m, *m.split("\n")}:  # a line end parts sentences
            words[part] = re.sub(r"\s", "", part)
    return words


def _grouped(texts: pa.Array, size: int = 1 << 20):
    """Lists of texts of about ``size`` characters together; nulls are empty."""
    own, held = [], 0
    for t in texts:
        own.append(t.as_py() or "")
        held += len(own[-1])
        if held >= size:
            yield own
            own, held = [], 0
    if own:
        yield own


@dataclass(frozen=True)
class Model:
    landmarks: tuple[str, ...]
    weights: np.ndarray  # over a sentence's kernel values; the Nyström map is folded in
    bias: float
    slope: float
    offset: float

    def score(self, sentences: list[np.ndarray]) -> np.ndarray:
        """The scores of documents, given their sentences' kernel values."""
        margin = np.array([max([0.0, *(x @ self.weights)]) for x in sentences]) + self.bias
        return 1 / (1 + np.exp(np.clip(-(self.slope * margin + self.offset), -50, 50)))


def _svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Dual coordinate descent for a linear SVM with hinge loss and balanced classes; the last weight is the bias."""
    x = np.column_stack([x, np.ones(len(x))])
    cost = np.where(y > 0, c * len(y) / (2 * max(1, (y > 0).sum())), c * len(y) / (2 * max(1, (y < 0).sum())))
    alpha, w, square = np.zeros(len(y)), np.zeros(x.shape[1]), (x * x).sum(axis=1)
    order = np.random.default_rng(0)
    for _ in range(rounds):
        for i in order.permutation(len(y)):
            step = np.clip(alpha[i] - (y[i] * (x[i] @ w) - 1) / square[i], 0, cost[i]) - alpha[i]
            if step:
                alpha[i] += step
                w += step * y[i] * x[i]
    return w


def _logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -50, 50)))
        g = np.array([((p - y) * margin).sum() + 1e-3 * a, (p - y).sum()])
        s = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(s * margin * margin).sum() + 1e-3, (s * margin).sum()], [(s * margin).sum(), s.sum() + 1e-3]])
        da, db = np.linalg.solve(h, g)
        a, b = a - da, b - db
    return float(a), float(b)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4 == 2


def _landmarks(sample: DataFrame, most: int) -> list[str]:
    """The words of labelled sentences that speak most for the label; a bounded list."""
    sentences = sample.select("toxic", F.explode(F.split(F.lower("text"), SENTENCE)).alias("sentence")).distinct()
    words = sentences.select("toxic", F.explode(F.array_distinct(F.transform(F.split("sentence", r"\s+"), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}]+", "")))).alias("word")).where(F.length("word").between(3, WIDTH))
    totals = sentences.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    counts = words.groupBy("word").agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg")).where("pos >= 3")
    odds = F.log((F.col("pos") + 0.5) / ((totals[0] or 0) + 1)) - F.log((F.col("neg") + 0.5) / ((totals[1] or 0) + 1))
    ranked = counts.select("word", (odds * F.sqrt("pos")).alias("weight")).where("weight > 0").orderBy(F.desc("weight"), "word").limit(most)
    return [r.word for r in ranked.collect()]


def _sentences(landmarks: tuple[str, ...]):
    """(toxic, sentences, worst): the kernel values of a document's sentences and of the one most like the landmarks, as 32-bit numbers."""

    def run(batches):
        own = Similarity(list(landmarks))
        for batch in batches:
            every, worst = [], []
            for texts in _grouped(batch.column("text")):
                for x in own.sentences(texts):
                    x = np.concatenate([np.zeros((1, x.shape[1])), x[np.lexsort(x.T)]]).astype("<f4")
                    every.append(x.tobytes())
                    worst.append(x[x.sum(axis=1).argmax()].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(every, pa.binary()), pa.array(worst, pa.binary())], ["toxic", "sentences", "worst"])

    return run


def _margins(weights: np.ndarray, bias: float):
    def run(batches):
        for batch in batches:
            out = [float((np.frombuffer(x.as_py(), "<f4").reshape(-1, len(weights)).astype(float) @ weights).max()) + bias for x in batch.column("sentences")]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(out, pa.float64())], ["toxic", "margin"])

    return run


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = LANDMARKS) -> Model:
    """Fits the model to at most ``sample`` labelled documents that are not held out.

    A doc_id that is repeated counts once: with its largest label and its least text.
    """
    chosen = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most ``sample`` rows of two numbers, and as many texts: a proven bound
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    rows = saved(rows.select("toxic", "text"))
    landmarks = tuple(_landmarks(rows, most))
    if not landmarks:
        share = rows.agg(F.avg("toxic")).first()[0] or 0.0
        return Model((), np.zeros(0), 0.0, 0.0, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    vectors = saved(in_batches(rows.repartition(max(2, rows.sparkSession.sparkContext.defaultParallelism)), _sentences(landmarks), "toxic int, sentences binary, worst binary"))
    n = len(landmarks)
    size = len(POWERS) * n
    # a vector for each of the documents; in an order that does not depend on how tasks end
    got = sorted(zip(*vectors.select("toxic", "worst").toArrow().to_pydict().values()))
    y = np.array([toxic for toxic, _ in got])
    worst = np.frombuffer(b"".join(x for _, x in got), "<f4").reshape(-1, size).astype(float)
    codes = Similarity(list(landmarks))
    pairs = np.indices((n, n)).reshape(2, -1)
    gram = (subsequence_kernel(codes.codes[pairs[0]], codes.codes[pairs[1]]) / np.sqrt(codes.own[pairs[0]] * codes.own[pairs[1]])).reshape(n, n).astype(float)
    root = np.zeros((size, size))
    for k, power in enumerate(POWERS):
        values, axes = np.linalg.eigh(gram**power)
        root[k * n : k * n + n, k * n : k * n + n] = axes @ np.diag(1 / np.sqrt(np.maximum(values, 0.05))) @ axes.T
    features = worst @ root
    scale = features.std() + 1e-6
    w = _svm(features / scale, np.where(y > 0, 1.0, -1.0))
    weights, bias = root @ (w[:-1] / scale), float(w[-1])
    margins = sorted(zip(*in_batches(vectors, _margins(weights, bias), "toxic int, margin double").toArrow().to_pydict().values()))
    slope, offset = _logistic(np.array([m for _, m in margins]), np.array([float(toxic) for toxic, _ in margins]))
    return Model(landmarks, weights, bias, slope, offset)


def _scores(model: Model):
    """A function from an Arrow text column to the scores of its rows."""
    own = Similarity(list(model.landmarks)) if model.landmarks else None

    def run(texts: pa.Array) -> np.ndarray:
        parts = [model.score(own.sentences(some)) if own else model.score([np.zeros((0, 0))] * len(some)) for some in _grouped(texts)]
        return np.concatenate([np.zeros(0), *parts])

    return run


def toxicity_scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row of ``docs`` (doc_id, text)."""

    def run(batches):
        scores = _scores(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores(batch.column("text")), pa.float64())], ["doc_id", "score"])

    return in_batches(docs.select("doc_id", "text"), run, "doc_id long, score double")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scores = toxicity_scores(docs, train(docs, table(spark, sf_dir, "labels")))
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that are not predicted toxic, with their columns.

    Rows are judged where they stand, so null and repeated doc_ids keep their rows.
    """
    model = train(docs, table(spark, sf_dir, "labels"))

    def run(batches):
        scores = _scores(model)
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column("text")) < THRESHOLD))

    return in_batches(docs, run, docs.schema)
