import itertools
import zlib

import numpy as np

from tidemark.llm import line_quality as op
from tidemark.llm.queries import op11_line_quality


def test_forward_backward_against_all_labellings():
    rng = np.random.default_rng(2)
    lengths = [1, 5, 2, 1, 4]
    first = np.zeros(sum(lengths), bool)
    first[np.cumsum([0, *lengths[:-1]])] = True
    odds, table = rng.normal(size=sum(lengths)) * 3, rng.normal(size=(2, 2))
    single, pairs = op.forward_backward(odds, first, table)
    at = 0
    for n in lengths:
        ways = list(itertools.product((0, 1), repeat=n))
        weight = np.array([np.exp(sum(odds[at + t] for t in range(n) if way[t]) + sum(table[way[t - 1], way[t]] for t in range(1, n))) for way in ways])
        weight /= weight.sum()
        for t in range(n):
            assert np.isclose(single[at + t, 1], sum(w for w, way in zip(weight, ways, strict=True) if way[t]))
            for x, y in itertools.product((0, 1), repeat=2):
                assert np.isclose(pairs[at + t, x, y], sum(w for w, way in zip(weight, ways, strict=True) if t and way[t - 1] == x and way[t] == y))
        at += n


def test_features_see_neighbours_only_in_their_text():
    _, _, own = op.own_features("ONE!! ONE!!\n\n  two words é\nONE!! ONE!!")
    assert own.shape == (3, op.N_OWN)
    again = 10 * len(op.EDGES)
    assert own[:, again].tolist() == [0, 0, 1]  # the third line repeats the first
    both = op.with_neighbours(np.concatenate([own, own]), np.array([1, 0, 0, 1, 0, 0], bool))
    assert not both[3, op.N_OWN : 2 * op.N_OWN].any() and not both[2, 2 * op.N_OWN : 3 * op.N_OWN].any()
    assert (both[1, op.N_OWN : 2 * op.N_OWN] == own[0]).all() and (both[1, 2 * op.N_OWN : 3 * op.N_OWN] == own[2]).all()


def test_held_out_accuracy_and_bad_lines_within_documents(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = op11_line_quality(spark, d).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 700 and np.mean([r.predicted == r.quality for r in held]) > 0.99
    assert np.mean([r.predicted for r in held if r.quality]) > 0.998 and np.mean([r.predicted for r in held if not r.quality]) < 0.05


def test_lines_of_a_mixed_document(spark):
    good = ["A calm line of plain words, as people write them.", "Another sentence follows here; nothing repeats.", "The third one ends the paragraph well."]
    junk = ["BUY!! BUY!! NOW!! NOW!! BUY!!", "### $$$ %%% *** &&&", "win | win | win | win | win"]
    docs, labels = [], []
    for n in range(120):
        lines = [f"{x} {n}{k}" for k, x in enumerate(good * 2)]
        if n % 3 == 0:
            lines[2:5] = junk
        docs.append((n, "\n".join(lines), 0.5, "own"))
        labels.append((n, int(n % 3 > 0)))
    labels += [(0, 1), (1, None), (None, 0), (5000, 0)]
    table = spark.createDataFrame(docs + [(900, None, 0.1, "x"), (901, " \n ", 0.1, "x"), (902, "", 0.1, "x"), (None, good[0], 0.1, "x"), (3, docs[3][1], 0.5, "again")], "doc_id long, text string, Score double, lines string")
    model = op.train(table, spark.createDataFrame(labels, "doc_id long, quality int"))
    got = op.score(table, model, lines=True).collect()
    assert len(got) == 125 and set(got[0].asDict()) == {"doc_id", "text", "score", "predicted", "lines"}
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[n].predicted == int(n % 3 > 0) for n in range(120))
    assert [x.kept for x in by_id[3].lines] == [True, True, False, False, False, True] and "\n".join(x.line for x in by_id[3].lines) == docs[3][1]
    assert by_id[900].score == by_id[901].score == by_id[902].score and by_id[900].lines == []
    assert sum(r.doc_id == 3 for r in got) == 2


def test_one_class_no_labels_empty_table_and_a_very_long_text(spark):
    docs = spark.createDataFrame([(1, "some words\nin lines"), (2, "x\n" * 200_000 + "word " * 300_000)], "doc_id long, text string")
    none = op.train(docs, spark.createDataFrame([(7, 1)], "doc_id long, quality int"))
    assert [r.score for r in op.score(docs, none).collect()] == [0.0, 0.0]
    ones = op.train(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    assert [r.score for r in op.score(docs, ones).collect()] == [0.75, 0.75]
    assert op.score(docs.limit(0), ones).count() == 0
    rng = np.random.default_rng(3)
    model = op.Model(rng.normal(size=op.N_FEATURES), rng.normal(size=(2, 2)), (1.0, 0.0))
    assert all(0 <= r.score <= 1 for r in op.score(docs, model).collect())


def test_bounded_sample(spark):
    docs = spark.createDataFrame([(n, "GO!! GO!!\nGO!!" if n % 2 else f"calm words {n}\nand more of them") for n in range(300)] + [(999, "y\n" * 3000)], "doc_id long, text string")
    labels = spark.createDataFrame([(n, 1 - n % 2) for n in range(300)] + [(999, 1)], "doc_id long, quality int")
    model = op.train(docs, labels, max_rows=100, max_lines=1000)
    assert np.mean([r.predicted == 1 - r.doc_id % 2 for r in op.score(docs, model).collect() if r.doc_id < 300]) == 1
