import random
import re
from collections import Counter, defaultdict

from tidemark.llm import quality as op

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", "abcdefghijklmnopqrstuvwxyz000000000")


def brute(docs, limit, share, min_words):
    normal = lambda line: " ".join(WORD.findall(line.translate(FOLD)))
    holds = defaultdict(set)
    for _, text, host in docs:
        for line in (text or "").split("\n"):
            if WORD.search(line):
                holds[host or "", normal(line)].add(text)
    out = []
    for doc, text, host in docs:
        t = text or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        count = Counter(grams)
        covered = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(3)}
        gone = sum(len(WORD.findall(x)) for x in lines if len(holds[host or "", normal(x)]) > limit)
        base = len(w) < min_words or 100 * len(covered) > 50 * len(w)
        out.append((doc, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), base, gone, not base and len(w) - gone >= share * len(w)))
    return sorted(out, key=str)


def test_random_documents(spark):
    rng = random.Random(8)
    lines = ["Menu  Home 12", "menu home 7", "a b\tc #1", "x\x0by z", "une  ligne é", "   ", "\x85 q", "%% ** unique"]
    docs = [(i, "\n".join(rng.choice([*lines, f"own line {i} {rng.random()}"]) for _ in range(rng.randrange(9))), rng.choice(["h1", "h1", "h2", None])) for i in range(200)]
    docs += [(1, None, "h1"), (2, "", None), (None, "menu home 0", "h1"), (5, "a b c d e f " * 5000, "h2")] + [(9, "copied text\nMenu home 1", "h2")] * 150
    df = spark.createDataFrame([(*d, 3, "e") for d in docs], "doc_id long, text string, source string, n_words int, extra string").repartition(4)
    for limit, share in ((3, 0.5), (10, 0.9), (40, 0.2)):
        got = op.judge(df, ["doc_id", "extra"], line_limit=limit, kept_share=share, min_words=4).collect()
        assert all(r.extra == "e" for r in got)
        assert sorted([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.removed_words, r.kept) for r in got], key=str) == brute(docs, limit, share, 4)
    kept = op.filter_quality(df, line_limit=3, min_words=4)
    want = sorted([(r[0]) for r in brute(docs, 3, 0.5, 4) if r[-1]], key=str)
    assert kept.columns == df.columns and sorted([r.doc_id for r in kept.collect()], key=str) == want and {r.n_words for r in kept.collect()} <= {3}


def test_copies_are_not_rejected_for_being_copied(spark):
    text = "\n".join(" ".join(f"w{i}x{k}" for k in range(6)) for i in range(20))
    df = spark.createDataFrame([(i, text, "h") for i in range(500)], "doc_id long, text string, source string")
    assert op.judge(df).where("kept").count() == 500
    assert op.judge(df, count_copies=True).where("kept").count() == 0 and op.judge(df, line_limit=500, count_copies=True).where("kept").count() == 500
    assert op.judge(df.limit(0)).count() == 0


def test_lines_above_the_limit_are_taken_out_of_kept_texts(spark):
    own = [f"own first line {'abcdefghijklmnopqrstuvwxyz'[i]} é\n \n  Menu  HOME {i:02}\nown last line {'abcdefghijklmnopqrstuvwxyz'[i]}\n" for i in range(12)]
    docs = [(i, t, "h1", 7) for i, t in enumerate(own)] + [(20, own[0], "h1", 7), (21, own[1], None, 7), (22, "menu home 01\nmenu home 02\nrest", "h1", 7), (23, None, "h1", 7)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, KEPT int").repartition(3)
    out = op.filter_quality(df, line_limit=10, min_words=1)
    want = {(i, re.sub(r"  Menu  HOME \d+\n", "", t), "h1", 7) for i, t, *_ in docs[:12]} | {(20, re.sub(r"  Menu  HOME \d+\n", "", own[0]), "h1", 7), docs[13]}
    assert out.columns == df.columns and {tuple(r) for r in out.collect()} == want and out.count() == 14
    assert {tuple(r) for r in op.filter_quality(df, line_limit=100, min_words=1).collect()} == {d for d in docs if d[1]}


def test_pipeline_stage_takes_out_common_lines(spark):
    import corpus_pipeline

    body = lambda i: " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    df = spark.createDataFrame([(i, f"{body(i)}\nAll rights reserved {i:03}", "en", "h", 0) for i in range(150)], "doc_id long, text string, lang string, source string, n_chars int")
    out = corpus_pipeline.quality_stage(spark, df, "")
    assert out.schema == df.schema and {(r.doc_id, r.text, r.n_chars) for r in out.collect()} == {(i, body(i), len(body(i))) for i in range(150)}
