import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import toxicity as op
from tidemark.llm.queries import op9_toxicity


def test_swaps_of_identity_terms():
    pairs = op.swapped("The gay man sang. No one here!\nA Muslim cook")
    assert ({"the", "gay", "man", "sang"}, {"the", "lesbian", "man", "sang"}) in pairs
    assert ({"a", "muslim", "cook"}, {"a", "hindu", "cook"}) in pairs
    assert len(pairs) == 6 + 3 + 7 and op.swapped(None) == []
    assert ({"die", "türken"}, {"die", "spanier"}) in op.swapped("Die Türken!") and ({"un", "juif"}, {"un", "athée"}) in op.swapped("Un juif") and ({"un", "ateo"}, {"un", "judío"}) in op.swapped("un ateo")
    assert set(op._KIND["protestant"]) > {"jewish", "jude", "juif"}  # a word of three languages


def test_pairs_pull_the_weights_of_swapped_terms_together():
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for _ in range(400):
        toxic = rng.random() < 0.3
        term = 0 if rng.random() < (0.8 if toxic else 0.2) else 1  # a group that abuse mentions often
        rows.append([term] + ([2] if toxic and rng.random() < 0.8 else []))
        labels.append(float(toxic))
    pairs = [([0], [1]), ([1], [0])]
    free, _ = op.fit_weights(rows, np.array(labels), [], 3)
    held, intercept = op.fit_weights(rows, np.array(labels), pairs, 3, pair_weight=10)
    assert free[0] - free[1] > 1 and abs(held[0] - held[1]) < 0.2 * (free[0] - free[1])
    assert held[2] + intercept > 0 and max(held[0], held[1]) + intercept < 0  # neutral mentions pass


def test_held_out_accuracy_and_other_rows(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet").where(op.held_out())
    rows = op9_toxicity(spark, d).join(labels, "doc_id").collect()
    assert all(r.held_out for r in rows) and len(rows) > 700
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.97
    assert np.mean([r.predicted for r in rows if r.toxic]) > 0.85 and np.mean([r.predicted for r in rows if not r.toxic]) < 0.01


def test_nulls_repeats_empty_tables_and_one_class(spark):
    docs = spark.createDataFrame([(i, "you idiot here" if i % 2 else "kind words here", 0.1) for i in range(40)] * 2 + [(None, "idiot", 1.0), (90, None, 2.0), (91, "", 3.0)], "doc_id long, text string, Score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(1, 0), (None, 1), (5, None), (777, 1)], "doc_id long, toxic int")
    model = op.train(docs, labels)
    got = op.score(docs, model).collect()
    assert len(got) == 83 and all(0 <= r.score <= 1 for r in got)
    assert {(r.text, r.predicted) for r in got} == {("you idiot here", 1), ("kind words here", 0), ("idiot", 1), (None, 0), ("", 0)} or {r.predicted for r in got if not r.text} <= {0, 1}
    kept = op.filter_toxic(docs, model)
    assert kept.columns == docs.columns and kept.where("text like '%idiot%'").count() == 0
    assert op.score(docs, op.train(docs, labels.limit(0))).agg(F.max("score")).head()[0] == 0
    assert op.score(docs, op.train(docs, labels.where("toxic = 0"))).agg(F.max("score")).head()[0] < 0.5
    assert op.score(docs.limit(0), model).collect() == []
    small = op.train(docs, labels, max_rows=10)
    assert small.score("kind words here") == pytest.approx(op.train(docs, labels, max_rows=10).score("kind words here"))


def test_every_swap_counts_by_the_features_it_changes():
    text = "The gay man sang of Americans. An american and a german woman. " * 3 + "A muslim cook"
    names = [f for w in sorted(op.words_of(text) | op._KIND.keys()) for f in op.features_of(w)]
    number = {f: n for n, f in enumerate(dict.fromkeys(names))}
    code = lambda words: {number[f] for w in words for f in op.features_of(w)}
    want = {}
    for before, after in op.swapped(text):
        a, b = code(before), code(after)
        key = tuple(sorted(a - b)), tuple(sorted(b - a))
        want[key] = want.get(key, 0) + 1
    assert dict(op.swap_changes(text, number)) == want and sum(want.values()) > 64 and op.swap_changes(None, number) == {}


def test_terms_late_in_long_texts_are_regularised(spark):
    early = "An american came. " * 20
    rows = [(i, early + ("A muslim came. bad deed" if i % 2 else "A hindu came. kind deed"), i % 2) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    free, held = (op.train(docs, docs, pair_weight=w).weights for w in (0.0, 1000.0))
    gap = lambda w: sum(w.get(f, 0) for f in op.features_of("muslim")) - sum(w.get(f, 0) for f in op.features_of("hindu"))
    assert gap(free) > 1 and abs(gap(held)) < 0.3 * gap(free)


def made_up(rng, n):
    """Sentences in which abuse goes with some group terms, and neutral mentions of all."""
    rows = []
    for i in range(n):
        kind = rng.choice([("muslim", "christian", "hindu"), ("frau", "mann"), ("juif", "athée", "chrétien"), ("mexicanos", "alemanes", "rusos")])
        toxic = int(rng.random() < 0.4)
        often = rng.random() < (0.85 if toxic else 0.3)
        term = kind[0] if often else rng.choice(kind[1:])
        words = rng.choice(["scum", "vile", "trash", "stupid"] if toxic and rng.random() < 0.9 else ["cook", "friend", "doctor", "neighbour"])
        rows.append((i, f"Some said the {term} was a {words}. {rng.choice(['Later', 'Today', 'Here'])} it rained {rng.choice(['much', 'little'])}.", toxic))
    return rows


def test_swaps_move_held_out_scores_less_and_cost_no_accuracy(spark):
    import random

    rows = made_up(random.Random(4), 3000)
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3)
    assert {r.term: r.texts for r in op.count_terms(df).collect()}["muslim"] > 100
    learn, test = df.where(~op.held_out()), [r for r in df.where(op.held_out()).collect()]
    assert len(test) > 500
    moves, right, clean = {}, {}, {}
    for weight in (0.0, 1.0, 10.0):
        model = op.train(learn, learn, pair_weight=weight)
        moves[weight] = np.mean([abs(model.logit(a) - model.logit(b)) for r in test for a, b in op.swapped(r.text)])
        right[weight] = np.mean([(model.score(r.text) >= 0.5) == r.toxic for r in test])
        clean[weight] = np.mean([model.score(r.text) >= 0.5 for r in test if not r.toxic])
    assert moves[1.0] < 0.5 * moves[0.0] and moves[10.0] < 0.2 * moves[0.0]
    assert right[1.0] >= right[0.0] - 0.01 and right[10.0] >= right[0.0] - 0.01 and clean[10.0] <= clean[0.0]


def test_scores_against_an_independent_fit(spark):
    """The same loss minimised by Newton steps over a dense matrix, from features counted anew."""
    import random
    import re

    rows = made_up(random.Random(9), 400)
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3)
    model = op.train(df, df, min_docs=1, min_chi=0.0, pair_weight=2.0)
    feats = lambda t: {f for w in re.split(r"[^a-zäéíöüß]+", t.lower()) if w for f in [w] + [w[:n] + "-" for n in (4, 5, 6) if len(w) >= n]}
    names = sorted({f for _, t, _ in rows for f in feats(t)} | {f for term in op._KIND for f in [term]})
    at = {f: k for k, f in enumerate(names)}
    code = lambda words: np.bincount(sorted({at[f] for w in words for f in feats(w) if f in at}), minlength=len(names))
    x = np.array([np.append(code(re.split(r"[^a-zäéíöüß]+", t.lower())), 1) for _, t, _ in rows], float)
    y = np.array([r[2] for r in rows], float)
    d = np.array([np.append(code(a) - code(b), 0) for _, t, _ in rows for a, b in op.swapped(t)], float)
    theta = np.zeros(x.shape[1])
    keep = np.append(np.ones(len(names)), 0) * 1e-4
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ theta))
        gradient = x.T @ (p - y) / len(y) + 2 * keep * theta + 2 * 2.0 * d.T @ (d @ theta) / len(d)
        hessian = (x.T * (p * (1 - p))) @ x / len(y) + 2 * np.diag(keep) + 2 * 2.0 * d.T @ d / len(d) + 1e-9 * np.eye(len(theta))
        theta -= np.linalg.solve(hessian, gradient)
    got = {r.doc_id: r.score for r in op.score(df, model).collect()}
    own = 1 / (1 + np.exp(-x @ theta))
    assert max(abs(got[r[0]] - own[k]) for k, r in enumerate(rows)) < 0.02


def test_samples_come_from_the_rows_there_are_and_repeated_ids_are_defined(spark):
    docs = spark.createDataFrame([(i, f"{'vile scum' if i % 2 else 'kind word'} {i % 5}") for i in range(1000, 1060)] + [(1000, "zzz other text")] * 400 + [(1001, "long " * 50_000 + "vile scum")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(5000)], "doc_id long, toxic int")
    one = op.train(docs, labels, max_rows=50)
    assert one.score("vile scum") > 0.5 > one.score("kind word")
    again = op.train(docs.orderBy(F.rand(3)), labels.orderBy(F.rand(5)), max_rows=50)
    assert again.weights == one.weights and again.intercept == one.intercept


def test_the_tables_hold_no_identity_term(spark):
    """What the README says about the driver's tables."""
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet").join(spark.read.parquet(f"{d}/labels.parquet").select("doc_id"), "doc_id")
    assert docs.count() > 3900 and op.count_terms(docs).collect() == []


def test_very_long_texts_score_as_their_words_do(spark):
    rows = [(i, "vile scum here" if i % 2 else "kind words here", i % 2) for i in range(200)]
    model = op.train(spark.createDataFrame(rows, "doc_id long, text string, toxic int"), spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    texts = ["kind words here " * 200_000, "kind words here " * 200_000 + "vile scum", " " * 1_000_000, "vile"]
    got = {r.n: r.score for r in op.score(spark.createDataFrame(list(enumerate(texts)), "n int, text string"), model).collect()}
    assert [got[n] for n in range(4)] == [model.score(x) for x in ("kind words here", "kind words here vile scum", "", "vile")]
