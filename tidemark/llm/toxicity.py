"""Toxicity scores by a counterfactually regularised classifier.

The classifier is a logistic regression over which words, and which word beginnings,
a text has.  It learns from labelled rows.  Sentences that name a group ("identity
terms") are also rewritten with every other term of the same kind, and the training
loss holds the squared change of the score that such a swap makes, so that a neutral
mention of a group is not taken for abuse because of the company the word keeps in
the labelled rows.

Learning takes a bounded sample: ``max_rows`` of the labelled rows that ``docs`` has,
chosen by a hash of their id, and the ``max_features`` features that differ most
between the labels, of those in ``min_docs`` texts whose chi-square is ``min_chi``
at least.  All four are parameters.  All swaps of the sampled texts count: a swap
changes the score only by the features it takes out and puts in, so equal changes are
counted over all texts and weighted by their number.  Scoring covers whole texts of
all rows, without a shuffle, from the broadcast weights.

Defined results: a null or empty text has no features and gets the score of the
intercept; rows without any label known score 0; labels that are null, or whose id
is, are not used; an id with several labels is toxic if one of them says so; of an id
with several texts the least in byte order is learned from; repeated rows get the
same score each; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm._shared import annotate, batches_of, no_collection, written

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+")
PREFIXES = (4, 5, 6)

#: Terms that name groups, by kind and language; a term is swapped for others of its kind.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("woman", "man", "girl", "boy"), ("women", "men", "girls", "boys"), ("female", "male", "transgender", "nonbinary"),
    ("gay", "lesbian", "bisexual", "straight", "heterosexual", "homosexual", "queer"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "catholic", "protestant", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "catholics", "atheists"),
    ("black", "white", "asian", "latino", "hispanic", "african", "european"),
    ("american", "mexican", "chinese", "indian", "german", "french", "spanish", "arab", "turkish", "russian"),
    ("old", "young", "elderly", "teenage"), ("deaf", "blind", "disabled", "paralyzed"), ("immigrant", "refugee", "foreigner"),
    ("frau", "mann"), ("frauen", "männer"), ("mädchen", "junge"), ("schwul", "lesbisch", "bisexuell", "heterosexuell"), ("schwule", "lesben"),
    ("christ", "moslem", "jude", "hindu", "buddhist", "katholik", "protestant", "atheist"), ("christen", "muslime", "juden", "hindus", "buddhisten", "katholiken"),
    ("amerikaner", "mexikaner", "chinesen", "inder", "deutsche", "franzosen", "spanier", "araber", "türken", "russen"), ("einwanderer", "flüchtlinge", "ausländer"),
    ("femme", "homme", "fille", "garçon"), ("femmes", "hommes", "filles", "garçons"), ("homosexuel", "lesbienne", "bisexuel", "hétérosexuel"),
    ("chrétien", "musulman", "juif", "hindou", "bouddhiste", "catholique", "protestant", "athée"), ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "catholiques"),
    ("américains", "mexicains", "chinois", "indiens", "allemands", "français", "espagnols", "arabes", "turcs", "russes"), ("immigrés", "réfugiés", "étrangers"),
    ("mujer", "hombre", "chica", "chico"), ("mujeres", "hombres", "chicas", "chicos"), ("homosexual", "lesbiana", "bisexual", "heterosexual"),
    ("cristiano", "musulmán", "judío", "hindú", "budista", "católico", "protestante", "ateo"), ("cristianos", "musulmanes", "judíos", "hindúes", "budistas", "católicos"),
    ("americanos", "mexicanos", "chinos", "indios", "alemanes", "franceses", "españoles", "árabes", "turcos", "rusos"), ("inmigrantes", "refugiados", "extranjeros"),
)
#: The terms that each is swapped for: of two kinds that share a term, those of both.
_KIND: dict[str, tuple[str, ...]] = {t: tuple(sorted({x for kind in IDENTITY_TERMS if t in kind for x in kind})) for t in sorted({x for kind in IDENTITY_TERMS for x in kind})}


def features_of(word: str) -> list[str]:
    """A word itself, and its beginnings (marked by a dash)."""
    return [word, *(f"{word[:n]}-" for n in PREFIXES if len(word) >= n)]


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def swapped(text: str | None) -> list[tuple[set[str], set[str]]]:
    """For each sentence with identity terms: its words, and those after every swap of one term for another of its kind."""
    pairs = []
    for sentence in _SENTENCE.findall(text.lower()) if text else ():
        words = words_of(sentence)
        for term in sorted(words & _KIND.keys()):
            pairs += [(words, words - {term} | {other}) for other in _KIND[term] if other not in words]
    return pairs


def swap_changes(text: str | None, number: dict[str, int]) -> Counter:
    """The swaps of ``swapped`` as (features taken out, features put in), by the numbers of known features, with how often each occurs."""
    changes: Counter = Counter()
    own = lambda word: {number[f] for f in features_of(word) if f in number}
    for sentence in _SENTENCE.findall(text.lower()) if text else ():
        words = words_of(sentence)
        terms = words & _KIND.keys()
        if terms:
            held = Counter(f for w in words for f in own(w))
            for term in terms:
                gone = {f for f in own(term) if held[f] == 1}
                for other in _KIND[term]:
                    if other not in words:
                        new = own(other)
                        changes[tuple(sorted(gone - new)), tuple(sorted(new - held.keys()))] += 1
    return changes


class Model:
    """Weights by feature, and the intercept."""

    def __init__(self, weights: dict[str, float], intercept: float | None):
        self.weights, self.intercept = weights, intercept
        self._known: dict[str, tuple[str, ...]] = {}

    def logit(self, words: set[str]) -> float:
        known, weights, found = self._known, self.weights, set()
        for word in words:
            own = known.get(word)
            if own is None:
                if len(known) > 150_000:
                    known.clear()
                own = known[word] = tuple(f for f in features_of(word) if f in weights)
            if own:
                found.update(own)
        return self.intercept + sum(weights[f] for f in sorted(found))

    def score(self, text: str | None) -> float:
        if self.intercept is None:
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(self.logit(words_of(text)), -40, 40))))


def _sparse(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.array([i for r in rows for i in r], "i8")


def fit_weights(rows: list[list[int]], labels: np.ndarray, pairs: list[tuple[list[int], list[int]]], n_features: int, pair_weight: float = 1.0, ridge: float = 1e-4, steps: int = 400, times: list[int] | None = None) -> tuple[np.ndarray, float]:
    """Minimise mean log loss + pair_weight * mean squared change of the logit over pairs (each as often as ``times`` says) + ridge * |w|^2, by Adam steps."""
    at, feature = _sparse(rows)
    p_at, p_feature = _sparse([a for a, _ in pairs])
    q_at, q_feature = _sparse([b for _, b in pairs])
    n, m = len(rows), max(1, len(pairs))
    weight = np.ones(m) / m if times is None or not pairs else np.array(times, float) / sum(times)
    theta, first, second = np.zeros(n_features + 1), np.zeros(n_features + 1), np.zeros(n_features + 1)
    theta[-1] = np.log((labels.sum() + 0.5) / (n - labels.sum() + 0.5))
    for step in range(1, steps + 1):
        w = theta[:-1]
        z = np.bincount(at, w[feature], n) + theta[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels) / n
        gradient = np.append(np.bincount(feature, error[at], n_features) + 2 * ridge * w, error.sum())
        if pairs:
            change = np.bincount(p_at, w[p_feature], m) - np.bincount(q_at, w[q_feature], m)
            pull = 2 * pair_weight * change * weight
            gradient[:-1] += np.bincount(p_feature, pull[p_at], n_features) - np.bincount(q_feature, pull[q_at], n_features)
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        theta -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    return theta[:-1], float(theta[-1])


def _counts(sample: DataFrame, min_docs: int, max_features: int, min_chi: float) -> list[str]:
    """The features that differ most between the labels by the chi-square of their document counts."""
    totals = sample.groupBy("toxic").count().collect()
    positive = sum(r["count"] for r in totals if r["toxic"])
    negative = sum(r["count"] for r in totals if not r["toxic"])
    if not positive or not negative:
        return []

    def run(batches):
        counts: dict[str, list[int]] = {}
        with no_collection():
            for batch in batches_of(batches, "body", 4 << 20):
                for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for feature in {f for w in words_of(text) for f in features_of(w)}:
                        counts.setdefault(feature, [0, 0])[toxic] += 1
                if len(counts) > 150_000:
                    yield _count_batch(counts)
                    counts = {}
            yield _count_batch(counts)
            counts = {}

    found = sample.select("body", "toxic").mapInArrow(run, "feature string, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    found = found.where(F.col("n0") + F.col("n1") >= min_docs)
    a, b, c, d = F.col("n1"), F.col("n0"), F.lit(float(positive)) - F.col("n1"), F.lit(float(negative)) - F.col("n0")
    chi = (a * d - b * c) * (a * d - b * c) * (positive + negative) / ((a + b) * (c + d + 1e-9) * positive * negative)
    top = found.withColumn("chi", chi).where(F.col("chi") >= min_chi).orderBy(F.desc("chi"), "feature").limit(max_features)
    return [r["feature"] for r in top.collect()]


def _count_batch(counts: dict[str, list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(counts), pa.string()), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())], names=["feature", "n0", "n1"]
    )


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 20_000, max_features: int = 10_000, min_docs: int = 5, pair_weight: float = 1.0, min_chi: float = 15.0) -> Model:
    """Learn from the rows of ``docs`` that ``labels`` (id, 0/1) covers."""
    spark = docs.sparkSession
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("toxic")).where("id IS NOT NULL AND toxic IS NOT NULL")
    known = known.groupBy("id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("body"))
    known = written(known.join(own.select("id").distinct(), "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(max_rows), "toxicity-labels")
    # max_rows labels at most are broadcast; copies of an id combine before they are shuffled.
    sample = own.join(F.broadcast(known), "id").groupBy("id", "toxic").agg(F.min("body").alias("body"))
    sample = written(sample.select("id", "body", "toxic"), "toxicity-sample")
    chosen = _counts(sample, min_docs, max_features, min_chi)
    number = {f: n for n, f in enumerate(dict.fromkeys([*chosen, *_KIND]))}
    packed = spark.sparkContext.broadcast(number)

    def encode(words: set[str]) -> list[int]:
        known_features = packed.value
        return sorted({known_features[f] for w in words for f in features_of(w) if f in known_features})

    def run(batches):
        for batch in batches_of(batches, "body", 4 << 20):
            yield pa.RecordBatch.from_arrays([pa.array([encode(words_of(t)) for t in batch.column(0).to_pylist()], pa.list_(pa.int32())), batch.column(1)], names=["own", "toxic"])

    def swaps(batches):
        for batch in batches_of(batches, "body", 4 << 20):
            changes: Counter = Counter()
            for text in batch.column(0).to_pylist():
                changes.update(swap_changes(text, packed.value))
            kinds = (pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64())
            columns = ([a for a, _ in changes], [b for _, b in changes], list(changes.values()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["gone", "new", "n"])

    coded = sample.orderBy("id").select("body", "toxic").mapInArrow(run, "own array<int>, toxic int").collect()
    truth = np.array([r.toxic for r in coded], float)
    if not len(truth):
        return Model({}, None)
    if truth.min() == truth.max():
        share = (truth.sum() + 0.5) / (len(truth) + 1)
        return Model({}, float(np.log(share / (1 - share))))
    pairs = sample.select("body").mapInArrow(swaps, "gone array<int>, new array<int>, n long").groupBy("gone", "new").agg(F.sum("n").alias("n")).orderBy("gone", "new").collect()
    weights, intercept = fit_weights([r.own for r in coded], truth, [(p.gone, p.new) for p in pairs], len(number), pair_weight, times=[p.n for p in pairs])
    return Model({f: float(weights[n]) for f, n in number.items() if weights[n]}, intercept)


def count_terms(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """term and texts: how many texts hold each identity term, that is, what the swaps can work on."""

    def run(batches):
        counts: Counter = Counter()
        for batch in batches_of(batches, "body", 4 << 20):
            for text in batch.column(0).to_pylist():
                counts.update(words_of(text) & _KIND.keys())
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "texts"])

    return docs.select(F.col(f"`{text_col}`").alias("body")).mapInArrow(run, "term string, texts long").groupBy("term").agg(F.sum("texts").alias("texts"))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 where it is 0.5 or more); columns of those names are replaced."""
    packed = docs.sparkSession.sparkContext.broadcast((model.weights, model.intercept))

    def make():
        own = Model(*packed.value)

        def apply(texts: pa.Array) -> list:
            scores = [own.score(t) for t in texts.to_pylist()]
            return [scores, [int(s >= 0.5) for s in scores]]

        return apply

    return annotate(docs, text_col, [("score", T.DoubleType()), ("predicted", T.IntegerType())], make)


def held_out(id_col: str = "doc_id"):
    """Whether a row's labels stay out of the training: crc32 of its id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 5 == 0, F.lit(False))


def filter_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with the columns of ``docs``."""
    aside = {c: f"{c}__own" for c in docs.columns if c.lower() in ("score", "predicted")}
    scored = score(docs.withColumnsRenamed(aside), model, text_col).where("predicted = 0")
    return scored.select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])
