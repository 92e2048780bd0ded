"""Language by cross-parsing, filter audit and hard negatives: brute force, odd rows, held-out accuracy."""

from __future__ import annotations

import random
import zlib
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipweave.llm import filteraudit, hardneg, langid
from clipweave.llm.queries import QUERIES

# ------------------------------------------------------------------------------------ language


def phrases(text: str, reference: str) -> int:
    n = at = 0
    while at < len(text):
        to = at
        while to < len(text) and text[at : to + 1] in reference:
            to += 1
        at, n = max(to, at + 1), n + 1
    return n


@pytest.mark.parametrize("stretch", [7, 1000])
def test_phrases_equal_greedy_parsing(monkeypatch, stretch):
    monkeypatch.setattr(langid, "STRETCH", stretch)
    random.seed(1)
    for _ in range(150):
        reference = "".join(random.choice("abc é") for _ in range(random.randint(1, 60)))
        texts = ["".join(random.choice("abc éx😀") for _ in range(random.randint(0, 40))) for _ in range(5)]
        columns, active, text, lengths = langid._stretches(texts)
        got = np.bincount(text, langid.Automaton.of(reference).phrases(columns, active), len(texts)).tolist()
        want = [sum(phrases(t[i : i + stretch], reference) for i in range(0, len(t), stretch)) for t in texts]
        assert got == want and lengths.tolist() == [len(t) for t in texts]


def test_automaton_reads_substrings_only():
    random.seed(2)
    text = "".join(random.choice("ab") for _ in range(200))
    step = langid.suffix_automaton(text)
    for _ in range(500):
        word, state = "".join(random.choice("ab") for _ in range(random.randint(1, 12))), 0
        for x in word:
            state = step[state].get(x) if state is not None else None
        assert (state is not None) == (word in text)


LANGUAGE_ROWS = [(i, f"the house and the garden of number {i}", "en") for i in range(1, 40)] + [(i, f"das haus und der garten der nummer {i}", "de") for i in range(40, 80)]


def test_language_of_odd_rows(spark):
    odd = [(100, None, "en"), (101, "", "en"), (102, "12 :-) 34", "de"), (103, "Ω漢字", None), (None, "the garden", "xx"), (104, "und der garten " * 30_000, None), (104, "the garden", "en"), (104, "the garden", "en")]
    docs = spark.createDataFrame([(i, t, g, "x", 1, 0.1) for i, t, g in LANGUAGE_ROWS + odd], "doc_id long, text string, lang string, doc string, place int, score double")
    got = langid.identify(docs).collect()
    assert len(got) == len(LANGUAGE_ROWS) + len(odd) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc).encode()) % 5 == 0) if r.doc is not None else r.held_out is False for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc, set()).add((r.lang_pred, r.score > 0))
    assert by[100] == by[101] == by[102] == {("und", False)} and by[None] == {("en", True)} and {p for p, _ in by[103]} <= {"de", "en"}
    assert by[104] == {("de", True), ("en", True)} and by[5] == {("en", True)} and by[60] == {("de", True)}


def test_nothing_learned(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.identify(none).count() == 0
    alone = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in langid.identify(alone).collect()] == [(1, False, "und", 0.0)]
    one = spark.createDataFrame([(1, "some words", "q"), (2, "some words", "q")], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in langid.identify(one).collect()} == {("q", 1.0)}


def test_samples_stay_bounded_and_held_out_text_is_not_learned(spark):
    docs = spark.createDataFrame([(i, "secret " * 50 if zlib.crc32(str(i).encode()) % 5 == 0 else f"plain words {i} " * 20, "en") for i in range(300)], "doc_id long, text string, lang string")
    rows, size = langid.sample(docs, 2000, 10_000, 100)
    texts = [r.text for r in rows.collect()]
    assert size == 2000 and len(texts) == 20 and all(len(t) <= 100 and "secret" not in t for t in texts)
    assert {a.size for a in langid.learn(docs, 1500, 10_000, 100).values()} == {1500}


def test_language_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    told = QUERIES["op11_cross_parsing_language"](spark, d).filter("held_out").join(spark.read.parquet(f"{d}/documents.parquet"), "doc_id")
    right, all_of = told.filter("lang IS NOT NULL").agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("lang")).first()
    assert all_of > 150 and right / all_of > 0.97


# --------------------------------------------------------------------------------------- audit


def audited(docs: list[tuple], labels: list[tuple]) -> set[tuple]:
    """The whole audit by applying the filters one by one."""
    fails = []
    for i, text, _ in docs:
        t = text or ""
        w = [x for x in t.translate({ord(c): " " for c in "\t\n\v\f\r"}).split(" ") if x]
        again = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)
        tests = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), any(c in "#$%&*|" for c in t), again]
        fails.append({f for f, bad in zip("ABCDE", tests) if bad})
    good, toxic = ({i for i, q, x in labels if i is not None and (q, x)[k] == 1} for k in (0, 1))
    out = set()
    for part in {g or "" for _, _, g in docs}:
        inside = [k for k, d in enumerate(docs) if (d[2] or "") == part]
        runs = {}
        for order in permutations("ABCDE"):
            left, runs[order] = list(inside), []
            for f in order:
                gone = [k for k in left if f in fails[k]]
                left = [k for k in left if f not in fails[k]]
                runs[order].append((f, gone, len(left)))
        total = {f: sum(len(g) for r in runs.values() for x, g, _ in r if x == f) for f in "ABCDE"}
        for order, steps in runs.items():
            for step, (f, gone, kept) in enumerate(steps, 1):
                failing = [k for k in inside if f in fails[k]]
                out.add((part, "".join(order), step, kept, len(gone), len(failing) - len(gone), sum(fails[k] == {f} for k in inside),
                         sum(docs[k][0] in good for k in gone), sum(docs[k][0] in toxic for k in gone), total[f]))
    return out


def test_audit_equals_filters_applied_one_by_one(spark):
    random.seed(4)
    pool = [None, "", "A B C", " ".join(f"w{i}" for i in range(250)), "w " * 250, "x\v# y " * 150, "SHOUT " * 220, "é😀   " * 300, *[" ".join(random.choices(["a", "B", "#", "c|d", "x", "yy"], k=random.randint(150, 260))) for _ in range(6)]]
    docs = [(random.choice([None, *range(40)]), random.choice(pool), random.choice(["en", None, "", "de"])) for _ in range(120)]
    labels = [(random.choice([None, *range(40)]), random.choice([0, 1, None]), random.choice([0, 1, None])) for _ in range(60)]
    frame = spark.createDataFrame([(*d, "c", 3, True) for d in docs], "doc_id long, text string, lang string, part string, fails int, good boolean")
    marks = spark.createDataFrame([(*x, "c") for x in labels], "doc_id long, quality int, toxic int, part string")
    assert {tuple(r) for r in filteraudit.audit(frame, marks).collect()} == audited(docs, labels)


def test_audit_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filteraudit.audit(none, marks).count() == 0
    one = filteraudit.audit(spark.createDataFrame([(1, "x", "en")], none.schema), marks)
    assert one.count() == 600 and one.agg(F.sum("removed")).first()[0] == 120


def test_carry_save_counts():
    random.seed(5)
    for n in [0, 1, 2, 3, 4, 10, 1000, 4097]:
        words = np.array([random.getrandbits(32) for _ in range(n)], np.uint32)
        assert filteraudit.bit_counts(words).tolist() == [sum(int(w) >> b & 1 for w in words) for b in range(32)]


# ------------------------------------------------------------------------------- hard negatives


def mined(rows: list[tuple], every: int) -> list[tuple]:
    seen, out = [], []
    for i, vec, label in rows:
        if None in (i, label) or vec is None or any(x is None or not np.isfinite(x) for x in vec):
            continue
        row = (i, (label + 1) % 10 if i % 7 == 0 else label, tuple(int(np.floor(256 * float(np.float32(x)))) for x in vec))
        if row not in seen:
            seen.append(row)
    for a in [r for r in seen if r[0] % every == 0]:
        scored = sorted((-sum(x * y for x, y in zip(a[2], b[2])), b[0], b[1] == a[1]) for b in seen if b is not a)
        for s, p, _ in [x for x in scored if x[2]][:5]:
            negatives = [(n, -t) for t, n, same in scored if not same and 30 * -s <= 100 * -t <= 90 * -s][:10]
            out += [(a[0], p, k, n, -s, t) for k, (n, t) in enumerate(negatives, 1)]
    return sorted(out)


@pytest.mark.parametrize(("block", "anchors", "spread"), [(8192, 4096, 1.0), (16, 3, 0.02), (5, 2, 0.3)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, block, anchors, spread):
    monkeypatch.setattr(hardneg, "BLOCK", block)
    monkeypatch.setattr(hardneg, "ANCHORS", anchors)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(4, 6))
    rows = [(i, [round(float(x), 2) for x in 0.5 * centres[i % 4] + spread * rng.normal(size=6)], i % 4) for i in range(150)]
    rows += rows[:5] + [(200, None, 1), (201, [1.0] * 6, None), (None, [1.0] * 6, 1), (202, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (203, [float("nan")] * 6, 1), (204, [float("inf")] + [0.0] * 5, 1)]
    rows += [(210, [0.0] * 6, 2), (220, [1.0, 2.0], 3), (230, [], 3), *[(240 + k, [0.5] * 6, 3) for k in range(12)], (7, rows[8][1], 3)]
    frame = spark.createDataFrame([(*r, "c", 1) for r in rows], "vec_id long, embedding array<float>, label int, rid string, vec int").repartition(3)
    got = [tuple(r) for r in hardneg.mine(frame, every=10).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]
    assert sorted(got) == mined(rows, 10) and got


def test_threshold_stops_before_the_end():
    rng = np.random.default_rng(7)
    vec = rng.integers(-20, 20, (5000, 3))
    vec[:40] += 500
    lists, anchor = hardneg.SortedLists(vec), np.array([3, 1, 2])
    places, scores = lists.nearest(anchor, lambda p, s, t: len(s) >= 5 and t < np.sort(s)[-5])
    assert len(places) < 500 and sorted(scores)[-5:] == sorted(vec @ anchor)[-5:]


def test_hard_negatives_of_nothing(spark):
    assert hardneg.mine(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    alone = spark.createDataFrame([(0, [1.0, 2.0], 1)], "vec_id long, embedding array<float>, label int")
    assert hardneg.mine(alone).count() == 0
