"""Toxic passages by maximum-scoring segments over token log-odds.

Training. Occurrences of tokens are counted by class over labelled documents. The toxic share of a
token has a Dirichlet prior whose mean is the share of the other tokens with its first five
letters, theirs that of the others with the first four, then three, then all: rare and unseen
forms of a known stem score as their stem, and a token leaves its prior only as evidence gathers.
A token's score is its log-odds against the share of all tokens, less a drift that makes
clean text fall.

Scoring. The Ruzzo-Tompa algorithm finds, in one pass, all maximal scoring segments. For
segments of random clean text the best score follows an extreme-value law: with lambda
the positive root of sum p(s) exp(lambda s) = 1 over the scores of clean tokens, a score S in a
text of n tokens has E-value K n exp(-lambda S). Segments with a small E-value are
significant; a document aggregates theirs.

The law and the final logistic curve are fit on labelled documents that the counts did not see.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftscan.llm.store import drop_clashes, materialize

#: Runs of letters and digits, lower-cased: what counts as a token.
_TOKEN = re.compile(r"[^\W_]+")
#: Letters of the stems that a token inherits from, shortest first.
STEMS = (3, 4, 5)
#: Bins of token scores, from -8 in steps of 1/4, and of segment scores, from 0 in the same steps; outer bins take what is beyond.
_BINS, _LOW, _STEP, _SEGMENT_BINS = 64, -8.0, 0.25, 200


def tokens_of(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


@dataclass(frozen=True)
class ToxicityModel:
    """Scores of tokens and stems (ending in ``*``), the law of chance segments, and the final curve."""

    weights: dict[str, float]
    default: float
    lam: float
    k: float
    slope: float
    offset: float

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> ToxicityModel:
        return ToxicityModel(**json.loads(text))


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, stop, score), by Ruzzo and Tompa, in linear time.

    Each candidate keeps the running sum before and after it. A new candidate looks left
    for one that began lower; if that one also ended lower the two join, else it stands.
    """
    starts: list[int] = []
    stops: list[int] = []
    below: list[float] = []
    above: list[float] = []
    lower: list[int] = []  # nearest candidate to the left that began lower, -1 for none
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        start, left = i, before
        while True:
            j = len(starts) - 1
            while j >= 0 and below[j] >= left:
                j = lower[j]
            if j < 0 or above[j] >= total:
                starts.append(start)
                stops.append(i + 1)
                below.append(left)
                above.append(total)
                lower.append(j)
                break
            start, left = starts[j], below[j]
            del starts[j:], stops[j:], below[j:], above[j:], lower[j:]
    return [(a, b, hi - lo) for a, b, lo, hi in zip(starts, stops, below, above, strict=True)]


def karlin_lambda(values: np.ndarray, shares: np.ndarray) -> float:
    """The positive root of sum shares * exp(lambda * values) = 1; values have a negative mean and a positive maximum."""
    if values.size == 0 or values.max() <= 0 or float(values @ shares) >= 0:
        return 1.0
    low, high = 0.0, 1.0
    while float(np.exp(np.minimum(high * values, 700)) @ shares) < 1:
        low, high = high, high * 2
    for _ in range(80):
        mid = (low + high) / 2
        if mid > 0 and float(np.exp(mid * values) @ shares) < 1:
            low = mid
        else:
            high = mid
    return (low + high) / 2


class TokenScores(dict):
    """Scores by token: its own, else that of its longest stem with one, else the default. Bounded."""

    def __init__(self, model: ToxicityModel):
        super().__init__()
        self.weights, self.default = model.weights, model.default

    def __missing__(self, token: str) -> float:
        score = self.weights.get(token)
        for k in reversed(STEMS):
            if score is None and len(token) >= k:
                score = self.weights.get(token[:k] + "*")
        score = self.default if score is None else score
        if len(self) > 500_000:
            self.clear()
        if len(token) <= 64:
            self[token] = score
        return score


def strength(scores: np.ndarray, n: int, lam: float, k: float) -> np.ndarray:
    """log10 of 1 / E of segment scores in a text of n tokens."""
    return (lam * scores - math.log(k * max(n, 1))) / math.log(10)


def aggregate_of(segments: list[float], n: int, lam: float, k: float, e_value: float) -> float:
    """The sum of the strengths of significant segments, or the strength of the best one if none is."""
    if not segments:
        return float(strength(np.zeros(1), n, lam, k)[0])
    x = strength(np.array(segments), n, lam, k)
    return max(float(x.max()), float(x[x >= -math.log10(e_value)].sum()))


def passages(text: str | None, model: ToxicityModel, scores_of: TokenScores, e_value: float = 0.1) -> tuple[float, list[tuple[int, int, float]]]:
    """(aggregate, significant passages as (first token, last token + 1, score)) of a whole text."""
    scores = [scores_of[t] for t in tokens_of(text)]
    segments = maximal_segments(scores)
    n, least = len(scores), -math.log10(e_value)
    aggregate = aggregate_of([s for _, _, s in segments], n, model.lam, model.k, e_value)
    if not segments:
        return aggregate, []
    strong = strength(np.array([s for _, _, s in segments]), n, model.lam, model.k) >= least
    return aggregate, [seg for seg, x in zip(segments, strong.tolist(), strict=True) if x]


def score_of(aggregate: float, model: ToxicityModel) -> float:
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, model.slope * aggregate + model.offset))))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts (token, n1, n0) of rows (text, toxic)."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def partial() -> pa.RecordBatch:
        tokens = list(counts[0].keys() | counts[1].keys())
        columns = [pa.array(tokens, pa.string()), *(pa.array([c[t] for t in tokens], pa.int64()) for c in reversed(counts))]
        for c in counts:
            c.clear()
        return pa.RecordBatch.from_arrays(columns, names=["token", "n1", "n0"])

    for b in batches:
        for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            counts[toxic].update(tokens_of(text))
            if len(counts[0]) + len(counts[1]) > 300_000:
                yield partial()
    yield partial()


def _shares(counts: DataFrame, base: float, prior: float) -> DataFrame:
    """(feature, n1, n0, share, parent): toxic shares of stems and tokens under the chain of priors."""
    both = [F.sum("n1").alias("n1"), F.sum("n0").alias("n0")]
    levels = counts.select("token", "n1", "n0", *[F.when(F.length("token") >= k, F.substring("token", 1, k)).alias(f"s{k}") for k in STEMS])

    def posterior(n1, n0, mean):
        return (n1 + prior * mean) / (n1 + n0 + prior)

    out, above = [], None
    for k, name in [*((k, f"s{k}") for k in STEMS), (0, "token")]:
        rows = levels.where(F.col(name).isNotNull()).groupBy(name, *([above] if above else [])).agg(*both) if k else levels.select("token", *([above] if above else []), "n1", "n0")
        if above:
            # what the stem's other members say, without this one's own counts
            up = stems.select(F.col(above), F.col("n1").alias("u1"), F.col("n0").alias("u0"), F.col("prior_mean").alias("m"))
            rows = rows.join(up, above, "left")
            others = posterior(F.col("u1") - F.col("n1"), F.col("u0") - F.col("n0"), F.col("m"))
            rows = rows.withColumn("prior_mean", F.coalesce(others, F.lit(base)))
        else:
            rows = rows.withColumn("prior_mean", F.lit(base))
        stems = rows.select(name, "n1", "n0", "prior_mean")
        feature = F.concat(F.col(name), F.lit("*")) if k else F.col(name)
        out.append(stems.select(feature.alias("feature"), "n1", "n0", posterior(F.col("n1"), F.col("n0"), F.col("prior_mean")).alias("share"), F.col("prior_mean").alias("parent")))
        above = name
    return reduce(DataFrame.unionAll, out)


def _fit_curve(x: np.ndarray, y: np.ndarray, at: float) -> tuple[float, float]:
    """Slope and offset of a regularised logistic curve, with the best cut mapped to the score ``at``.

    The cut is the midpoint of the gap with the fewest errors between classes.
    """
    order = np.argsort(x, kind="stable")
    xs, ys = x[order], y[order]
    wrong = np.concatenate([[0], np.cumsum(ys)]) + np.concatenate([[0], np.cumsum((1 - ys)[::-1])])[::-1]
    gaps = np.concatenate([[xs[0] - 1], xs, [xs[-1] + 1]])
    width = np.diff(gaps)
    best = np.flatnonzero(wrong == wrong.min())
    best = best[np.argmax(width[best])]
    cut = (gaps[best] + gaps[best + 1]) / 2
    slope = 2.0 / max(float(np.std(x)), 0.5)
    return slope, math.log(at / (1 - at)) - slope * cut


def train(
    labelled: DataFrame,
    cut_score: float = 0.3,
    prior: float = 8.0,
    clip: float = 6.0,
    drift: float = 0.35,
    k: float = 0.1,
    e_value: float = 0.1,
    tail: float = 1e-4,
    least_segments: int = 50,
    model_features: int = 2_000_000,
) -> ToxicityModel:
    """Fit on ``labelled`` (doc_id, text, toxic 0 or 1), whose number of rows the caller bounds.

    Three quarters of the rows, by a hash of doc_id, give token counts; the others fit the law and the
    curve. lambda comes from the scores of clean tokens, to which a share ``tail`` of positive ones is added as a prior, and K from the number of
    segments in the highest twentieth of clean rows; below ``least_segments`` of them K is ``k``. The driver receives
    histograms summed over all rows, and a number for each row. The model keeps all tokens and stems that tell something beyond their prior,
    at most ``model_features`` of them (about 100 bytes each, so 200 MB where it is sent): if there are more, those that tell most. Without rows of both classes every text scores
    below ``cut_score``.
    """
    part = F.pmod(F.xxhash64("doc_id"), F.lit(4))
    known = labelled.where(F.col("toxic").isin(0, 1)).select("doc_id", F.col("text").cast("string").alias("text"), F.col("toxic").cast("int").alias("toxic"))
    partial = known.where(part != 0).select("text", "toxic").mapInArrow(_counted, "token string, n1 long, n0 long")
    counts = materialize(partial.groupBy("token").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")))
    t1, t0 = (float(x or 0) for x in counts.agg(F.sum("n1"), F.sum("n0")).first())
    base = min(max(t1 / max(t1 + t0, 1.0), 1e-6), 1 - 1e-6)
    share, parent = F.col("share"), F.col("parent")
    gain = F.col("n1") * F.log(share / parent) + F.col("n0") * F.log((1 - share) / (1 - parent))
    odds = F.log(share / (1 - share)) - F.lit(math.log(base / (1 - base)))
    told = _shares(counts, base, prior).select("feature", odds.alias("odds"), gain.alias("gain")).where(F.col("gain") >= 1.0)
    told = materialize(told)
    if told.count() > model_features:
        told = told.orderBy(F.desc("gain"), "feature").limit(model_features)
    top = told.select("feature", "odds").collect()
    model = ToxicityModel({r.feature: max(-clip, min(clip, r.odds)) - drift for r in top}, -drift, 1.0, k, 1.0, math.log(cut_score / (1 - cut_score)) - 3.0)
    held = known.where(part == 0)
    clean, segments = np.zeros(_BINS), np.zeros(_SEGMENT_BINS)
    for r in _histograms(held.where("toxic = 0"), model).collect():
        (segments if r.of_segments else clean)[r.bin] = r.n
    if not clean.sum():
        return model
    values = _LOW + _STEP * (np.arange(_BINS) + 0.5)
    shares = clean + tail * clean.sum() * (values > 0) / (values > 0).sum()
    lam = karlin_lambda(values, shares / shares.sum())
    model = replace(model, lam=lam, k=fitted_k(segments, clean.sum(), lam, least_segments, k))
    rows = _aggregates(held, model, e_value).collect()
    y, x = np.array([r.toxic for r in rows], float), np.array([r.x for r in rows])
    if y.min() == y.max():
        return model
    slope, offset = _fit_curve(x, y, cut_score)
    return replace(model, slope=slope, offset=offset)


def fitted_k(segments: np.ndarray, tokens: float, lam: float, least: int, otherwise: float) -> float:
    """K of E = K n exp(-lambda S), from a histogram of the segment scores of n random clean tokens.

    The law holds for high scores, so it is held to the number of segments in the highest twentieth (``least`` at least).
    """
    if segments.sum() < least or not tokens:
        return otherwise
    beyond = np.cumsum(segments[::-1])[::-1]
    at = int(np.flatnonzero(beyond >= max(least, segments.sum() / 20))[-1])
    return float(beyond[at] / tokens * math.exp(lam * _STEP * at))


def _histograms(rows: DataFrame, model: ToxicityModel) -> DataFrame:
    """(of_segments, bin, n): how many tokens and how many segments of the texts have a score in each bin."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores_of = TokenScores(sent.value)
        tokens, segments = np.zeros(_BINS, np.int64), np.zeros(_SEGMENT_BINS, np.int64)
        for b in batches:
            for text in b.column(0).to_pylist():
                scores = np.array([scores_of[t] for t in tokens_of(text)])
                tokens += np.bincount(np.clip((scores - _LOW) / _STEP, 0, _BINS - 1).astype(int), minlength=_BINS)
                found = np.array([x for _, _, x in maximal_segments(scores.tolist())])
                segments += np.bincount(np.clip(found / _STEP, 0, _SEGMENT_BINS - 1).astype(int), minlength=_SEGMENT_BINS)
        for of_segments, counts in ((False, tokens), (True, segments)):
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([of_segments] * at.size, pa.bool_()), pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["of_segments", "bin", "n"])

    counted = rows.select("text").mapInArrow(run, "of_segments boolean, bin int, n long")
    return counted.groupBy("of_segments", "bin").agg(F.sum("n").alias("n"))


def _aggregates(rows: DataFrame, model: ToxicityModel, e_value: float) -> DataFrame:
    """toxic and x (``aggregate_of``) of rows (text, toxic)."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores_of = TokenScores(sent.value)
        for b in batches:
            x = [passages(text, sent.value, scores_of, e_value)[0] for text in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(x, pa.float64())], names=["toxic", "x"])

    return rows.select("text", "toxic").mapInArrow(run, "toxic int, x double")


def score_documents(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """``docs`` with toxicity (0 to 1), toxic_predicted (0 or 1) and toxic_passages (first, stop, score).

    Passages are in tokens (runs of letters and digits). Defined cases: a null text scores as
    the empty text, which has no passages and a low score; texts of any length are scored whole, in
    linear time; equal rows score the same; an empty table gives no rows; clashing columns
    are replaced.
    """
    plain = drop_clashes(docs, ["toxicity", "toxic_predicted", "toxic_passages"])
    sent = docs.sparkSession.sparkContext.broadcast(model)
    fields = "toxicity double, toxic_predicted int, toxic_passages array<struct<first:int,stop:int,score:double>>"
    at = plain.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())]))
        scores_of = TokenScores(sent.value)
        for b in batches:
            scores, found = [], []
            for t in b.column(at).to_pylist():
                aggregate, segments = passages(t, sent.value, scores_of)
                scores.append(score_of(aggregate, sent.value))
                found.append([{"first": a, "stop": z, "score": s} for a, z, s in segments])
            new = [pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(found, kind)]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, "toxicity", "toxic_predicted", "toxic_passages"])

    from pyspark.sql.types import StructType

    schema = StructType([*plain.schema.fields, *StructType.fromDDL(fields).fields])
    return plain.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees: crc32 of the decimal doc_id leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def train_on_labels(docs: DataFrame, labels: DataFrame, label_rows: int = 40_000, **options) -> ToxicityModel:
    """``train`` on the labels of ``docs`` that are not held out, at most ``label_rows`` of them: those with the smallest hashes.

    The bound makes the labels small enough to send to every task, so texts are read where they are. Of rows that share a
    doc_id one text is learned from, the least, so the bound holds for rows as well.
    """
    known = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = materialize(known.orderBy(F.xxhash64(F.lit(7), "doc_id"), "doc_id").limit(label_rows))
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    once = found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return train(materialize(once.select("doc_id", "text", "toxic")), **options)
