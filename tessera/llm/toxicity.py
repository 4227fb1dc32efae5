"""Toxicity by maximum-scoring segments of token log-odds, calibrated by extreme-value statistics."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from tessera.llm.common import Remembered, TEXTS, cut, in_arrow, pieces, texts_of, written

#: Labelled documents that the model is fitted on, at most (chosen by a hash of doc_id); bounds the
#: vocabulary that is counted and the rows that the calibration brings to the driver.
MAX_LABELLED = 200_000
#: Lengths of word beginnings that stand between the corpus and a word in the hierarchy of priors.
PREFIXES = (3, 4, 5, 6)
#: Weight of a Dirichlet prior in documents: a word's rates are drawn towards its longest known beginning's.
PRIOR = 2.0
#: Tokens whose log-odds are less than so many standard deviations above 0 score as any other token.
MIN_Z = 2.6
#: ... and so do those that are less than so many times as frequent in toxic documents, as a logarithm.
MIN_ODDS = 1.6
#: Labelled documents that must hold a token.
MIN_COUNT = 3
#: Scores are clipped here, so that no single word makes a passage.
MAX_SCORE = 6.0
#: A passage is reported when so many or fewer as good are expected in a clean text of its length.
MAX_EXPECTED = 0.01
#: Bytes that a task spends on remembered words, and on counted tokens before it hands them on.
REMEMBERED_BYTES, COUNTED_BYTES = 40_000_000, 32_000_000
#: One in so many labelled documents is set aside for the calibration.
FOLDS = 4
COUNTS = ("toxic_aside", "toxic", "clean_aside", "clean")
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„‘’¿¡…–—"


@dataclass
class Model:
    """Scores of the tokens that tell, the score of all others, and the calibration."""

    scores: dict[str, float] = field(default_factory=dict)
    other: float = -0.05
    decay: float = 1.0  # lambda of the extreme-value law of clean texts
    scale: float = 0.1  # K of the same law
    slope: float = 0.0
    length: float = 0.0
    shift: float = -20.0

    def of_word(self, raw: str) -> float:
        word = raw.strip(EDGES)
        if (s := self.scores.get(f"{word} ")) is not None:
            return s
        for n in reversed(PREFIXES):
            if len(word) > n and (s := self.scores.get(word[:n])) is not None:
                return s
        return self.other


def tokens_of(word: str) -> list[str]:
    """A word's node in the hierarchy and those above it: its beginnings; a whole word ends in a space."""
    return [f"{word} ", *(word[:n] for n in PREFIXES if len(word) > n)]


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (begin, end, score), by the linear-time scan of Ruzzo and Tompa (1999).

    Neighbours of the same sign are summed first, which changes no maximal segment.
    """
    if not len(scores) or scores.max() <= 0:
        return []
    bounds = np.concatenate([[0], np.flatnonzero((scores[1:] > 0) != (scores[:-1] > 0)) + 1])
    sums = np.add.reduceat(scores, bounds).tolist()
    bounds = [*bounds.tolist(), len(scores)]
    found: list[list] = []  # [begin, end, sum before it, sum up to its end]
    total = 0.0
    for k, s in enumerate(sums):
        if s > 0:
            now = [bounds[k], bounds[k + 1], total, total + s]
            while True:
                j = len(found) - 1
                while j >= 0 and found[j][2] >= now[2]:
                    j -= 1
                if j < 0 or found[j][3] >= now[3]:
                    found.append(now)
                    break
                now = [found[j][0], now[1], found[j][2], now[3]]
                del found[j:]
        total += s
    return [(a, b, hi - lo) for a, b, lo, hi in found]


class Scorer:
    """Applies a model to texts; one per task."""

    def __init__(self, model: Model):
        self.model, self.known = model, Remembered(REMEMBERED_BYTES, 160)

    def scores(self, text: str) -> np.ndarray:
        known, out = self.known, []
        for raw in text.lower().split():
            s = known.get(raw)
            if s is None:
                s = known.keep(raw, self.model.of_word(raw))
            out.append(s)
        return np.array(out)

    def passages(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """Words of the text, and its maximal segments in words, best first."""
        scores = self.scores(text)
        return len(scores), sorted(segments(scores), key=lambda x: -x[2])

    def statistic(self, n: int, found: list[tuple[int, int, float]]) -> float:
        """Evidence of the r best segments together, for the best r (sum statistics of Karlin and Altschul, 1993).

        t, the sum of the normalised scores, is exceeded by chance with probability near
        exp(-t) t^(r-1) / (r! (r-1)!); the evidence is minus the logarithm of that. Only segments above 0
        count: a clean text of any length has one of them on average, but ever more below as it grows.
        """
        best = t = log_r = 0.0
        floor = math.log(max(self.model.scale * n, 1.0)) if n else 0.0
        for r, (_, _, s) in enumerate(found, 1):
            if (above := self.model.decay * s - floor) <= 0:
                break
            t += above
            log_r += math.log(r)
            best = max(best, t - (r - 1) * math.log(max(t, 1.0)) + 2 * log_r - math.log(r))
        return best

    def probability(self, found: list[tuple[int, list]]) -> np.ndarray:
        """Calibrated probabilities of texts, each given as words and segments."""
        m = self.model
        x, n = np.array([self.statistic(n, f) for n, f in found], np.float64), np.array([n for n, _ in found], np.float64)
        return 1 / (1 + np.exp(-np.clip(m.slope * np.log1p(x) + m.length * np.log1p(n) + m.shift, -700, 700)))

    def significant(self, n: int, found: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
        m = self.model
        return [x for x in found if m.scale * n * math.exp(-m.decay * x[2]) <= MAX_EXPECTED]


def held_out(doc_id) -> F.Column:
    """True for the documents that no label is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Learn from the documents with a label whose doc_id isn't held out.

    Of several labels of one document the highest counts; null labels don't. Beyond ``max_labelled``
    labels, a hash of doc_id picks about so many. Token rates of either class are drawn towards those
    of the word's beginnings, and these towards the corpus (Dirichlet priors); a token scores the log
    of the ratio of its rates. Without both labels the model scores every text the same.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    n = known.count()
    if n > max_labelled:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * max_labelled / n))
    # MAX_LABELLED pairs of numbers bound what is broadcast, and no text is shuffled
    train = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")
    # the labelled texts, which are bounded, are kept: learning and calibration read these, not the corpus
    train = written(train.select((F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)) == 0).alias("aside"), F.col("toxic"), "text"))
    rest, whole = _learn(train.select("toxic", "text", "aside"))
    if whole.scores:
        # the curve is fitted on documents that the tokens' scores weren't learned from; lambda and K are those of the scores that are used
        aside = train.where("aside").select("toxic", "text")
        _calibrate(rest, aside)
        _measured(whole, aside.where("toxic = 0"))
        whole.slope, whole.length, whole.shift = rest.slope, rest.length, rest.shift
    return whole


def _learn(train: DataFrame) -> tuple[Model, Model]:
    """The model of the documents that aren't set aside, and that of all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # documents by token, for each label and whether set aside; "" counts documents, " " words
        sums: dict[tuple[bool, bool], Counter] = {(t, a): Counter() for t in (True, False) for a in (True, False)}
        nodes = Remembered(REMEMBERED_BYTES, 600)

        def flush() -> pa.RecordBatch:
            tokens = list({t for c in sums.values() for t in c})
            columns = [pa.array([c[t] for t in tokens], pa.int64()) for c in sums.values()]
            for c in sums.values():
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array(tokens, pa.string()), *columns], names=["token", *COUNTS])

        long = 0  # characters of long words since the last flush
        for batch in pieces(batches, TEXTS):
            for label, text, aside in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), batch.column(2).to_pylist()):
                words, tokens = text.lower().split(), {""}
                for raw in set(words):
                    if (found := nodes.get(raw)) is None:
                        found = nodes.keep(raw, tokens_of(raw.strip(EDGES)), 6)
                    tokens.update(found)
                tokens.discard(" ")
                counter = sums[label > 0, aside]
                counter.update(tokens)
                counter[" "] += len(words)
                long += sum(len(w) for w in words if len(w) > 64)
                # a counted token takes some 180 bytes, and a long one its characters too
                if 180 * sum(map(len, sums.values())) + 24 * long > COUNTED_BYTES:
                    yield flush()
                    long = 0
        yield flush()

    counted = train.transform(
        in_arrow, count, "token string, " + ", ".join(f"{c} long" for c in COUNTS),
    ).groupBy("token").agg(*[F.sum(c).alias(c) for c in COUNTS])
    toxic, clean = F.col("toxic_aside") + F.col("toxic"), F.col("clean_aside") + F.col("clean")
    special = F.col("token").isin("", " ")
    counted = cut(counted.where((toxic >= MIN_COUNT) | special))
    sums = {r.token: r for r in counted.where(special).collect()}
    if not sums:
        return Model(), Model()
    docs, words = sums[""], sums[" "]
    n_toxic, n_clean = docs.toxic_aside + docs.toxic, docs.clean_aside + docs.clean
    if not n_toxic or not n_clean:
        return Model(), Model()
    # tokens that can't reach MIN_Z stay behind; the others are bounded by the labelled sample
    n, share = toxic + clean, n_toxic / (n_toxic + n_clean)
    tells = list(counted.where(~special).where(toxic - n * share > 2 * F.sqrt(n * share * (1 - share))).toLocalIterator())
    whole = _model(
        {r.token: (r.toxic_aside + r.toxic, r.clean_aside + r.clean) for r in tells}, n_toxic, n_clean,
        (words.toxic_aside + words.toxic, words.clean_aside + words.clean),
    )
    if not docs.toxic or not docs.clean:
        return whole, whole
    return _model({r.token: (r.toxic, r.clean) for r in tells if r.toxic >= MIN_COUNT}, docs.toxic, docs.clean, (words.toxic, words.clean)), whole


def _model(kept: dict[str, tuple[int, int]], toxic: int, clean: int, words: tuple[int, int]) -> Model:
    """Log-odds of the counted tokens under hierarchical Dirichlet priors; the share of the others makes their score."""
    model, share = Model(), toxic / (toxic + clean)
    # P(toxic | token) and P(clean | token), drawn towards the token's beginnings; 1 less the former would be 0 in
    # floats for a word that thousands of toxic texts hold and no clean one, nor its beginnings
    drawn: dict[str, tuple[float, float]] = {}
    for token in sorted(kept, key=lambda t: (t.endswith(" "), len(t))):
        word = token.rstrip(" ")
        above = next((drawn[word[:k]] for k in reversed(PREFIXES) if k < len(word) and word[:k] in drawn), (share, 1 - share))
        a, b = kept[token]
        drawn[token] = (a + PRIOR * above[0]) / (a + b + PRIOR), (b + PRIOR * above[1]) / (a + b + PRIOR)
    base = math.log(share / (1 - share))
    for token, (p, q) in drawn.items():
        a, b = kept[token]
        odds = math.log(p / q) - base
        sigma = math.sqrt(1 / (a + PRIOR * share) + 1 / (b + PRIOR * (1 - share)))
        if odds >= MIN_ODDS and odds / sigma >= MIN_Z:
            model.scores[token] = min(odds, MAX_SCORE)
    told = [sum(kept[t][k] for t in model.scores if t.endswith(" ")) for k in (0, 1)]
    rates = [min(told[k] / (words[k] + 1), 0.5) for k in (0, 1)]
    model.other = min(math.log((1 - rates[0]) / (1 - rates[1])), -0.002)
    told = [t for t in model.scores if t.endswith(" ")]
    clean = np.array([kept[t][1] / (words[1] + 1) for t in told])
    model.decay = decay_of(np.append(clean, 1 - clean.sum()), np.array([model.scores[t] for t in told] + [model.other]))
    return model


def _measured(model: Model, train: DataFrame) -> DataFrame:
    """Words and segments' scores (``toxic, n, found``) of texts; K is fitted on the clean ones' best segments."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in pieces(batches, TEXTS):
            out = [scorer.passages(t) for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int32()), pa.array([n for n, _ in out], pa.int64()),
                    pa.array([[s for _, _, s in f] for _, f in out], pa.list_(pa.float64())),
                ],
                names=["toxic", "n", "found"],
            )

    measured = cut(train.transform(in_arrow, measure, "toxic int, n long, found array<double>"))
    best = F.when(F.size("found") > 0, F.col("found")[0]).otherwise(0.0)
    clean, mass = measured.where("toxic = 0 and n > 0").agg(F.count(F.lit(1)), F.sum(F.col("n") * F.exp(-F.lit(model.decay) * best))).first()
    if clean:
        model.scale = clean / max(mass, 1e-9)
    return measured


def _calibrate(model: Model, train: DataFrame) -> None:
    """Fit K, then the logistic curve of the evidence and the length.

    The evidence is that of all segments, as in scoring; only numbers come to the driver.
    """
    measured = _measured(model, train)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in pieces(batches, TEXTS):
            x = [scorer.statistic(n, [(0, 0, s) for s in f]) for n, f in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.float64())], names=["toxic", "n", "x"])

    rows = measured.transform(in_arrow, weigh, "toxic int, n long, x double").collect()  # MAX_LABELLED rows at most
    x = np.array([r.x for r in rows])
    y = np.array([float(r.toxic > 0) for r in rows])
    n = np.array([r.n for r in rows], np.float64)
    model.slope, model.length, model.shift = _logistic(np.log1p(x), np.log1p(n), y)


def decay_of(rates: np.ndarray, scores: np.ndarray) -> float:
    """Lambda of the extreme-value law: where the mean of exp(lambda s) over a clean text's words is 1 (Karlin and Altschul, 1990).

    ``rates`` are those of the scored words and of all others together, which add up to 1. It is 1 for
    scores that are the log-odds of the rates, and another for scores that are pooled, drawn and clipped.
    Without scores on either side of 0 or with a mean that isn't below it there is no such law, and 1 is given.
    """
    if not len(scores) or scores.max() <= 0 or float(rates @ scores) >= 0:
        return 1.0
    low, high = 1e-3, 1e-3
    while float(rates @ np.exp(high * scores)) < 1 and high < 64:
        low, high = high, high * 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if float(rates @ np.exp(middle * scores)) < 1 else (low, middle)
    return (low + high) / 2


def _logistic(x: np.ndarray, n: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Coefficients of the evidence (not negative) and of the length, which moves the law of the evidence, and the shift.

    Newton's method on logarithms of both, with a weak pull of the coefficients towards 0.
    """
    if not len(y):
        return 0.0, 0.0, -20.0
    w = np.zeros(3)
    design = np.stack([x, n, np.ones_like(x)], 1)
    pull = np.diag([1e-2, 1e-2, 1e-6])
    loss = lambda w: np.logaddexp(0, np.where(y > 0, -1, 1) * (design @ w)).sum() + w @ pull @ w / 2
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve((design.T * (p * (1 - p))) @ design + pull + 1e-9 * np.eye(3), design.T @ (y - p) - pull @ w)
        while loss(w + step) > loss(w) and np.abs(step).max() > 1e-10:
            step = step / 2
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return max(float(w[0]), 0.0), float(w[1]), float(w[2])


def score(docs: DataFrame, model: Model, passages: bool = False, columns: list[str] | None = None, name: str = "score") -> DataFrame:
    """``columns`` (doc_id alone unless given) and ``score`` (or another ``name``) of every row's whole text; ``passages`` adds the significant ones.

    ``score`` lies in 0 to 1 and grows with the toxic evidence; empty and null texts have the score of
    no evidence. A passage is (first word, word behind the last, log-odds). Only the text is looked at.
    A column of the input that has the name of a new one is left out.
    """
    new = [name, "passages"] if passages else [name]
    names = [c for c in columns or ["doc_id"] if c not in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in pieces(batches, TEXTS):
            found = [scorer.passages(t) for t in texts_of(batch.column(0))]
            out = [*batch.columns[1:], pa.array(scorer.probability(found), pa.float64())]
            if passages:
                kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("log_odds", pa.float64())]))
                out.append(pa.array([[dict(zip(("begin", "end", "log_odds"), p)) for p in sorted(scorer.significant(n, f))] for n, f in found], kind))
            yield pa.RecordBatch.from_arrays(out, names=[*names, *new])

    rows = docs.select(F.col("text").cast("string").alias("__text"), *[F.col(f"`{c}`") for c in names])
    schema = StructType([*(docs.schema[c] for c in names), StructField(name, DoubleType())])
    if passages:
        schema = schema.add(
            "passages",
            ArrayType(StructType([StructField("begin", IntegerType()), StructField("end", IntegerType()), StructField("log_odds", DoubleType())])),
        )
    return rows.transform(in_arrow, run, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted, n_passages`` of every document, by a model of the labels that aren't held out.

    ``n_passages`` counts the significant passages, which :func:`score` gives with their places.

    Repeated rows are scored each for itself; no documents give no rows; a null doc_id isn't held out.
    """
    scored = score(docs, fit(docs, labels), passages=True)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("passages").cast("long").alias("n_passages"),
    )
