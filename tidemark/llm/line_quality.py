"""Document quality by a linear-chain conditional random field over lines.

Every line with a word is labelled good or bad.  The chain's states are scored from
features of a line, of the line before and of the line after (shares of kinds of
characters, lengths, repeated words and lines, words shared with the line before), and
neighbouring labels by a table of transitions.  Forward-backward gives each line's
probability of being good; weighted by the lines' lengths these make the document's
share of good text, which a logistic curve turns into a score.

Only documents are labelled, so the lines' labels are found while learning: all lines
of a good document are good; of a bad one those that the field calls bad, but the
worst lines up to ``least_bad`` of its text in any case.  The first round learns from a
line's own features only, so that a good line beside bad ones is not taken for bad; the
others learn those of the neighbours and the transitions too.

Learning takes a bounded sample: ``max_rows`` of the labelled rows that ``docs`` has,
chosen by a hash of their id, with ``max_lines`` lines together, none of more than a
hundredth of that; for learning alone, chains are cut every ``CHAIN`` lines.  Scoring
covers whole texts and whole chains of all rows, without a shuffle.

Defined results: a null, empty or blank text is a chain of one empty line and gets the
score that the field gives that; with no labelled row all score 0; with labels of one
kind only all score the smoothed share of good ones; labels that are null, or whose id
is, are not used; an id with several labels is bad if one of them says so; of an id
with several texts the least in byte order is learned from; repeated rows get the same
score each; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm._shared import annotate, batches_of, give_back, written

CHAIN = 256
_KINDS = ("lower", "upper", "digit", "white", "stop", "bang", "symbol", "mark", "head", "tail")
_STARTS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "white": b" \t\n\r\x0b\x0c", "stop": b".,;:?", "bang": b"!", "symbol": b"#*$%&|<>@^~_=+\\/", "mark": b"\"'()[]{}-`"}
_KIND_OF = np.zeros(256, "u1")
for _name, _bytes in _STARTS.items():
    _KIND_OF[list(_bytes)] = _KINDS.index(_name)
_KIND_OF[128:192], _KIND_OF[192:] = _KINDS.index("tail"), _KINDS.index("head")
#: A share r becomes min(1, r / e) for each of these, so that small shares can tell as much as large ones.
EDGES = (0.02, 0.1, 0.3, 1.0)
N_SHARES, N_SIZES = 12, 5
N_OWN = N_SHARES * len(EDGES) + N_SIZES
N_FEATURES = 3 * N_OWN + 2


def own_features(text: str | None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The lines of a text that have a word, their lengths, and the features that each has by itself or by the lines before it."""
    lines = [x for x in text.split("\n") if x and not x.isspace()] if text else []
    if not lines:
        return [""], np.ones(1), np.zeros((1, N_OWN), "f4")
    n = len(lines)
    data = np.frombuffer("\n".join(lines).encode(), "u1")
    at = np.zeros(len(data), "i4")
    at[np.flatnonzero(data == 10)] = 1
    cells = np.cumsum(at, dtype="i4") * len(_KINDS) + _KIND_OF[data]
    kinds = np.bincount(cells, minlength=n * len(_KINDS)).reshape(n, -1).astype(float)
    kinds[:-1, _KINDS.index("white")] -= 1  # the newline that ends a line is none of its characters
    size = np.maximum(kinds.sum(axis=1) - kinds[:, _KINDS.index("tail")], 1)
    words = np.empty((n, 6))
    seen: set[str] = set()
    before: set[str] = set()
    for k, line in enumerate(lines):
        own = line.split()
        m, kinds_of = len(own), set(own)
        pairs = len(set(zip(own, own[1:], strict=False))) if m > 1 else 1
        words[k] = (m, len(kinds_of), pairs, len(kinds_of & before), line in seen, max(map(len, own), default=0))
        seen.add(line)
        before = kinds_of
    m, different, pairs, shared, again, longest = words.T
    m = np.maximum(m, 1)
    letters = np.maximum(kinds[:, 0] + kinds[:, 1] + kinds[:, 8], 1)
    symbol = kinds[:, _KINDS.index("symbol")]
    shares = np.stack([
        kinds[:, 1] / letters, kinds[:, 2] / size, kinds[:, 4] / size, kinds[:, 5] / m, symbol / m, kinds[:, 7] / size, kinds[:, 8] / letters,
        1 - different / m, 1 - pairs / np.maximum(m - 1, 1), shared / np.maximum(different, 1), again, symbol / size,
    ], axis=1)
    bent = np.minimum(shares[:, :, None] / np.array(EDGES), 1).reshape(n, -1)
    sizes = np.stack([np.log1p(size) / 8, np.log1p(m) / 6, np.minimum(size / m / 12, 2), np.minimum(longest / 40, 2), np.ones(n)], axis=1)
    return lines, size, np.concatenate([bent, sizes], axis=1).astype("f4")


def with_neighbours(own: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The features of each line with those of the lines before and after it in its text; ``first`` marks a text's first lines."""
    n = len(own)
    last = np.append(first[1:], True)
    out = np.zeros((n, N_FEATURES), "f4")
    out[:, :N_OWN] = own
    out[1:, N_OWN : 2 * N_OWN][~first[1:]] = own[:-1][~first[1:]]
    out[:-1, 2 * N_OWN : 3 * N_OWN][~last[:-1]] = own[1:][~last[:-1]]
    out[:, -2], out[:, -1] = first, last
    return out


def forward_backward(odds: np.ndarray, first: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of many chains, one after the other: each line's probability of the two labels, and those of its label with the one before's.

    ``odds``: the score of good over bad of each line; ``first`` marks where chains begin.
    Pairs are numbered (before, own) and 0 at a chain's first line.
    """
    starts = np.flatnonzero(first)
    lengths = np.diff(np.append(starts, len(odds)))
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    own = np.stack([np.zeros(len(odds)), odds], axis=1)
    ahead, back = own.copy(), np.zeros_like(own)
    running = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1 if len(lengths) else 1), side="right")  # chains that have a t-th line
    for t in range(1, lengths[0] if len(lengths) else 0):
        at = starts[: running[t]] + t
        before = ahead[at - 1]
        ahead[at] += np.logaddexp(before[:, :1] + transitions[0], before[:, 1:] + transitions[1])
    for t in range((lengths[0] if len(lengths) else 0) - 1, 0, -1):
        at = starts[: running[t]] + t
        after = own[at] + back[at]
        back[at - 1] = np.logaddexp(after[:, :1] + transitions[:, 0], after[:, 1:] + transitions[:, 1])
    both = ahead + back
    total = np.logaddexp(both[:, 0], both[:, 1])[:, None]
    pairs = np.zeros((len(odds), 2, 2))
    inner = np.flatnonzero(~first)
    if len(inner):
        pairs[inner] = np.exp(ahead[inner - 1][:, :, None] + transitions[None] + (own + back)[inner][:, None, :] - total[inner][:, :, None])
    return np.exp(both - total), pairs


@dataclass
class Model:
    """Weights of line features, transitions (before, own) of the labels bad and good, and the curve from a document's share of good text to its score."""

    weights: np.ndarray
    transitions: np.ndarray
    curve: tuple[float, float]
    constant: float | None = None

    def lines(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """The probability of being good of each line of each text, given lengths and own features."""
        counts = [len(size) for size, _ in texts]
        first = np.zeros(sum(counts), bool)
        first[np.cumsum([0, *counts[:-1]])] = True
        odds = with_neighbours(np.concatenate([own for _, own in texts]), first) @ self.weights
        good = forward_backward(np.clip(odds, -30, 30), first, self.transitions)[0][:, 1]
        return np.split(good, np.cumsum(counts)[:-1])

    def score(self, size: np.ndarray, good: np.ndarray) -> float:
        if self.constant is not None:
            return self.constant
        slope, offset = self.curve
        return float(1 / (1 + np.exp(-np.clip(slope * _odds_of(size, good) + offset, -40, 40))))


def _odds_of(size: np.ndarray, good: np.ndarray) -> float:
    """The log odds of the share of good text, each line weighing by its length."""
    share = min(max(float((size * good).sum() / size.sum()), 1e-4), 1 - 1e-4)
    return float(np.log(share / (1 - share)))


def _descend(gradient_of, theta: np.ndarray, steps: int, rate: float = 0.1) -> np.ndarray:
    """Adam steps."""
    one, two = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        gradient = gradient_of(theta)
        one, two = 0.9 * one + 0.1 * gradient, 0.999 * two + 0.001 * gradient**2
        theta = theta - rate * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.999**step)) + 1e-9)
    return theta


def fit(texts: list[tuple[np.ndarray, np.ndarray]], truth: np.ndarray, rounds: int = 3, steps: int = 80, ridge: float = 1e-4, least_bad: float = 0.2) -> Model:
    """Learn from documents, given as (lengths, own features) of their lines, and their labels (1 good)."""
    if not len(truth) or truth.min() == truth.max():
        share = 0.0 if not len(truth) else float((truth.sum() + 0.5) / (len(truth) + 1))
        return Model(np.zeros(N_FEATURES), np.zeros((2, 2)), (1.0, 0.0), share)
    counts = np.array([len(size) for size, _ in texts])
    doc = np.repeat(np.arange(len(texts)), counts)
    starts = np.cumsum(counts) - counts
    first = np.zeros(len(doc), bool)
    first[starts] = True
    x = with_neighbours(np.concatenate([own for _, own in texts]), first)
    size = np.concatenate([s for s, _ in texts])
    cut = first | ((np.arange(len(doc)) - starts[doc]) % CHAIN == 0)
    inner = np.flatnonzero(~cut)
    weight = size / np.bincount(doc, size)[doc] / len(texts)  # every document counts the same
    label = truth[doc].astype(int)
    theta = np.zeros(N_FEATURES + 4)

    def gradient_of(theta: np.ndarray, chained: bool) -> np.ndarray:
        odds = np.clip(x @ theta[:-4].astype("f4"), -30, 30).astype(float)
        table = theta[-4:].reshape(2, 2)
        good, pairs = forward_backward(odds, cut, table) if chained else (1 / (1 + np.exp(np.stack([odds, -odds], axis=1))), None)
        out = 2 * ridge * theta
        out[:-4] += x.T @ (weight * (good[:, 1] - label)).astype("f4")
        if not chained:
            out[N_OWN:] = 0
        else:
            seen = np.zeros((2, 2))
            np.add.at(seen, (label[inner - 1], label[inner]), weight[inner])
            out[-4:] += ((pairs[inner] * weight[inner, None, None]).sum(axis=0) - seen).ravel()
        return out

    for turn in range(rounds):
        theta = _descend(lambda v, chained=turn > 0: gradient_of(v, chained), theta, steps)
        odds = np.clip(x @ theta[:-4].astype("f4"), -30, 30).astype(float)
        good = forward_backward(odds, first, theta[-4:].reshape(2, 2))[0][:, 1]
        if turn < rounds - 1:
            # The worst lines come first in each document; those that begin within least_bad of its text are bad.
            order = np.lexsort((good, doc))
            begun = np.cumsum(size[order]) - size[order]
            begun = begun - begun[starts][doc[order]]
            worst = np.empty(len(doc), bool)
            worst[order] = begun < least_bad * np.bincount(doc, size)[doc[order]]
            label = np.where(truth[doc] > 0, 1, np.where((good < 0.5) | worst, 0, 1))
    odds = np.array([_odds_of(s, g) for (s, _), g in zip(texts, np.split(good, np.cumsum(counts)[:-1]), strict=True)])
    slope = lambda v: np.array([((e := 1 / (1 + np.exp(-np.clip(v[0] * odds + v[1], -40, 40))) - truth) * odds).mean() + 2e-3 * v[0], e.mean()])
    curve = _descend(slope, np.array([1.0, 0.0]), 400, 0.05)
    return Model(theta[:-4], theta[-4:].reshape(2, 2), (float(curve[0]), float(curve[1])))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 8_000, max_lines: int = 200_000, rounds: int = 3, steps: int = 80) -> Model:
    """Learn from the rows of ``docs`` that ``labels`` (id, 0/1) covers."""
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("good")).where("id IS NOT NULL AND good IS NOT NULL")
    known = known.groupBy("id").agg(F.min(F.when(F.col("good") > 0, 1).otherwise(0)).alias("good"))
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("body"))
    known = written(known.join(own.select("id").distinct(), "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(max_rows), "line-quality-labels")
    # max_rows labels at most are broadcast; copies of an id combine before they are shuffled.
    sample = own.join(F.broadcast(known), "id").groupBy("id", "good").agg(F.min("body").alias("body"))
    sample = written(sample.select("id", "good", "body", F.coalesce(F.size(F.split("body", "\n")), F.lit(1)).alias("n")), "line-quality-sample")
    total = F.sum("n").over(Window.orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, 0))
    taken = sample.select("id", "n").where(F.col("n") <= max(1, max_lines // 100)).withColumn("total", total).where(F.col("total") <= max_lines)

    def run(batches):
        for batch in batches_of(batches, "body", 4 << 20):
            found = [own_features(t)[1:] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([s.astype("f4").tobytes() for s, _ in found], pa.binary()), pa.array([f.tobytes() for _, f in found], pa.binary())], names=["good", "size", "own"]
            )
        give_back()

    rows = sample.join(F.broadcast(taken.select("id")), "id").orderBy("id").select("good", "body").mapInArrow(run, "good int, size binary, own binary").collect()
    texts = [(np.frombuffer(r["size"], "f4").astype(float), np.frombuffer(r["own"], "f4").reshape(-1, N_OWN)) for r in rows]
    return fit(texts, np.array([r["good"] for r in rows], float), rounds, steps)


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5, lines: bool = False) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from ``threshold`` on); columns of those names are replaced.

    ``lines`` adds an array of each line with a word: the line, its probability of
    being good, and whether the field calls it good.
    """
    packed = docs.sparkSession.sparkContext.broadcast(model)
    fields: list = [("score", T.DoubleType()), ("predicted", T.IntegerType())]
    if lines:
        fields.append(("lines", T.ArrayType(T.StructType([T.StructField("line", T.StringType()), T.StructField("good", T.DoubleType()), T.StructField("kept", T.BooleanType())]))))

    def make():
        own = packed.value

        def apply(texts: pa.Array) -> list:
            found = [own_features(t) for t in texts.to_pylist()]
            good = own.lines([(s, f) for _, s, f in found])
            scores = [own.score(s, g) for (_, s, _), g in zip(found, good, strict=True)]
            out = [scores, [int(s >= threshold) for s in scores]]
            if lines:
                out.append([[{"line": x, "good": float(p), "kept": bool(p >= 0.5)} for x, p in zip(own_lines, g, strict=True) if x] for (own_lines, _, _), g in zip(found, good, strict=True)])
            return out

        return apply

    return annotate(docs, text_col, fields, make)
