"""Text, state, export and file rules on small literal tables."""

from __future__ import annotations

import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clipweave.functions import text as T
from clipweave.functions.registry import segmentation, segmentation_names
from clipweave.operators import segments as S
from clipweave.operators import state as ST
from clipweave.plans import export as X
from clipweave.sources.subtitles import parse_ass, parse_srt


def _one(spark, text, col):
    return spark.createDataFrame([(text,)], "t string").select(col.alias("r")).first()["r"]


@pytest.mark.parametrize(("text", "ratio", "want"), [
    ("はい。そうですね、分かりました。", 0.4, 3), ("はい。そうですね、分かりました。", 0.55, 9),
    ("あいうえおかきくけこ", 0.5, 5), ("", 0.5, 0), ("あ", 0.5, 1),
])
def test_apportion(spark, text, ratio, want):
    assert _one(spark, text, T.apportion(F.col("t"), F.lit(ratio))) == want


@pytest.mark.parametrize(("method", "text", "want"), [
    ("cut1", "一。二。三。四。五。六。七。八。九。", ["一。二。三。四。", "五。六。七。八。九。"]),
    ("cut1", "一。二。", ["一。二。"]),
    ("cut2", "一" * 30 + "。" + "二" * 30 + "。" + "三" * 10 + "。", ["一" * 30 + "。" + "二" * 30 + "。" + "三" * 10 + "。"]),
    ("cut3", "。一。二。。", ["一", "二"]),
    ("cut4", "pi is 3.14. yes. no", ["pi is 3.14. yes", " no"]),
    ("cut5", "a,b 3.5,c.", ["a,", "b 3.5,", "c."]),
    ("cut5", "...", []),
    ("cut0", "...", ["\n"]),
])
def test_segmentation(spark, method, text, want):
    assert _one(spark, text, segmentation(method)(F.col("t"))) == want


def test_groups_are_made_once(spark, tmp_path):
    """Number and digest share one split of a text, and no matches are extracted one after the other."""
    from clipweave.catalog import load

    spark.createDataFrame([(1, "a." * 9), (2, "b"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = load().QUERIES["cut_groups_of_four"](spark, str(tmp_path))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and plan.count("split(") == 1
    assert sorted((r.doc_id, r.n) for r in got.collect()) == [(1, 2), (2, 1), (3, 0)]


@pytest.mark.parametrize("text", [None, "", "\n", "a.\r", "a.b\u0085", "\n\na……b——c.\n\r\n", "．" * 9, "a。" * 8, "a。" * 9, "a!b" * 12])
def test_pieces_as_extracted(spark, text):
    """A split gives what extracting one match after the other gave."""
    cls = "".join("\\" + p for p in T.SPLIT_PUNCT)
    plain = F.regexp_replace(F.col("t"), r"^\n+|\n+$", "")
    whole = T.unify_ellipsis(plain)
    whole = F.when(whole.rlike(f"(?s)[{cls}]$") & ~whole.endswith("\n"), whole).otherwise(F.concat(whole, F.lit("。")))
    want = F.regexp_extract_all(whole, F.lit(f"(?s)[^{cls}]*[{cls}]"), F.lit(0))
    assert _one(spark, text, T.pieces(T.strip_newlines(F.col("t")))) == _one(spark, text, want)


def test_unknown_segmentation():
    with pytest.raises(ValueError, match="unknown segmentation"):
        segmentation("cut9")
    assert segmentation_names() == [f"cut{i}" for i in range(6)]


def test_merge_and_pack(spark):
    parts = F.split("t", "/")
    assert _one(spark, "ab/cd/e/fghij/k", T.merge_short(parts, 5)) == ["abcde", "fghijk"]
    assert _one(spark, "ab/c", T.merge_short(parts, 5)) == ["abc"]
    assert _one(spark, "aaaa,bbbb,cc", T.pack_long(F.col("t"), 5)) == ["aaaa,", "bbbb,", "cc"]


def test_pre_segment(spark):
    assert _one(spark, "你好。今天天气很好，我们出去玩！", T.pre_segment(F.col("t"))) == ["你好。今天天气很好，", "我们出去玩！"]
    assert _one(spark, "\n\n", T.pre_segment(F.col("t"))) == []


@pytest.mark.parametrize(("text", "want"), [
    ("中文123", [("zh", "中文123")]), ("123中文", [("zh", "123中文")]), ("123", [("zh", "123")]),
    ("abc12中", [("en", "abc12"), ("zh", "中")]), ("a12中文字", [("en", "a"), ("zh", "12中文字")]),
    ("かな한글", [("ja", "かな"), ("ko", "한글")]), ("?!", [("zh", "?!")]),
])
def test_language_runs(spark, text, want):
    assert [(r["lang"], r["text"]) for r in _one(spark, text, T.language_runs(F.col("t")))] == want


def _run_by_run(text):
    return T._inherit([(m.lastgroup, m[0]) for m in T._RULES.finditer(text or "")])


def test_language_runs_side_by_side(monkeypatch):
    """Many texts at once give what the rules give run by run, also where digit runs hang on each other."""
    monkeypatch.setattr(T, "RUN_BYTES", 300)
    draw = random.Random(7)
    some = ["a", "bb", "1", "22", "333", "あ", "カナ", "漢", "漢字", "한글", " ", ".", "，", "é", "\U00020000", "\n"]
    for kinds in (4, 6, len(some)):
        of = [*draw.sample(some, kinds), "1", "4444"]
        texts = [None, "", *("".join(draw.choices(of, k=draw.randrange(25))) for _ in range(500)), None]
        runs = T.language_runs.func(pa.array(texts, pa.string()).slice(1))
        want = [_run_by_run(t) for t in texts[1:]]
        assert [[(r["lang"], r["text"]) for r in row] for row in runs.to_pylist()] == want
        totals = [{r["lang"]: (r["runs"], r["chars"]) for r in row} for row in T.run_totals.func(runs).to_pylist()]
        assert totals == [{g: (sum(x == g for x, _ in w), sum(len(t) for x, t in w if x == g)) for g, _ in w} for w in want]


def test_language_runs_work():
    """Texts of many short runs cost less than a third of the run by run way."""
    texts = ["abカ漢한 12 " * 400] * 100
    began = time.process_time()
    for text in texts:
        _run_by_run(text)
    slow, began = time.process_time() - began, time.process_time()
    T.language_runs.func(pa.array(texts))
    T.language_runs.func(pa.array(texts[:1]))
    assert time.process_time() - began < slow / 3 + 0.5


def test_script_helpers(spark):
    assert _one(spark, "Hello, 3 worlds", T.all_english(F.col("t"))) is True
    assert _one(spark, "123", T.all_english(F.col("t"))) is False
    assert _one(spark, "abc漢字!12", T.cjk_only(F.col("t"))) == "漢字!12"
    runs = _one(spark, "abcかな 3かなdef", T.script_runs(F.col("t"), T.KANA, "ja", "x"))
    assert [(r["lang"], r["text"]) for r in runs] == [("x", "abc"), ("ja", "かな 3かな"), ("x", "def")]


def test_subtitles(spark):
    srt = "1\n00:00:01,000 --> 00:00:02,500\nHello\nthere\n\nbroken\n\n\n00:01:00.5 --> 00:01:02,000\nx\n\n3\n00:00:01,000 --> 00:00:02,000\n\n"
    got = parse_srt(spark.createDataFrame([(1, srt)], "item_id long, text string")).collect()
    assert [(r["start_ms"], r["end_ms"], r["text"]) for r in got] == [(1000, 2500, "Hello there"), (60_005, 62_000, "x")]
    line = r"Dialogue: 0,0:00:01.00,0:00:03.50,Default,,0,0,0,,{\an8}Hello\NWorld"
    ass = parse_ass(spark.createDataFrame([(1, 0, line), (1, 1, "Dialogue: 0,1")], "item_id long, line_no long, line string")).collect()
    assert [(r["start_ms"], r["end_ms"], r["text"]) for r in ass] == [(1000, 3500, "Hello World")]


CLIP = "ord long, item_id string, speaker string, language string, text string, start_ms long, end_ms long, score double"


def _clips(spark, rows):
    return spark.createDataFrame([(i, "m", sp, "JP", t, 0, ms, sc) for i, (sp, t, ms, sc) in enumerate(rows)], CLIP)


def test_export_per_speaker(spark):
    c = _clips(spark, [("s1", "a", 2000, None), ("s1", "b", 2000, None), ("s2", "c", 2000, None), ("s2", " ", 2000, None)])
    got = X.export_plan(c, per_speaker=True, val_ratio=0.5)
    assert sorted(r["path"] for r in got.filter("reason IS NULL").collect()) == [
        "s1/train/001.wav", "s1/val/001.wav", "s2/train/001.wav"]
    assert [r["reason"] for r in got.filter("reason IS NOT NULL").collect()] == ["blank"]
    assert sorted((r["speaker"], r["train"], r["val"]) for r in X.speaker_summary(got).collect()) == [("s1", 1, 1), ("s2", 1, 0)]


def test_export_orders_by_score_and_drops_low(spark):
    c = _clips(spark, [("s", "a", 2000, 20.0), ("s", "b", 2000, 90.0), ("s", "c", 2000, 70.0), ("s", "d", 2000, 10.0), ("s", "e", 2000, None)])
    got = X.export_plan(c, min_score=50)
    assert [r["text"] for r in got.filter("reason IS NULL").orderBy("seq").collect()] == ["b", "c", "e"]
    assert got.filter("reason = 'low score'").count() == 2


def test_export_does_not_depend_on_partitions(spark, tiny_cells):
    rows = [(f"s{i % 3}" if i % 7 else "", "x" if i % 5 else "", 500 + 100 * (i % 9), float(i % 4) * 25 if i % 2 else None) for i in range(60)]
    c = _clips(spark, rows)
    take = lambda df: sorted((r["ord"], r["seq"] if r["seq"] is not None else -1, r["path"] or "") for r in X.export_plan(df, per_speaker=True, val_ratio=0.25).collect())
    many = take(c.repartition(7))
    spark.conf.unset("clipweave.rowsPerCell")
    assert many == take(c.coalesce(1))


SEGS = "item_id long, seg_id string, start_ms long, end_ms long, text string, character_id string, locked boolean"


def test_locked_merge_restores_swallowed_rows(spark):
    stored = spark.createDataFrame([(1, "s1", 0, 4000, "hand", "cu", True)], SEGS)
    new = spark.createDataFrame([(1, "s1a", 0, 2000, "h", "ca", False), (1, "s1b", 2000, 4000, "d", "ca", False), (1, "s9", 10_000, 12_000, "o", "ca", False)], SEGS)
    got = {r["seg_id"]: r["character_id"] for r in ST.merge_locked(stored, new).collect()}
    assert got == {"s9": "ca", "s1": "cu"}
    none = stored.withColumn("locked", F.lit(False))
    assert sorted(r["seg_id"] for r in ST.merge_locked(none, new).collect()) == ["s1a", "s1b", "s9"]


def test_orphans(spark):
    ch = spark.createDataFrame([
        ("dead", ["x:1", "y:2"], None), ("live", ["a:1"], None), ("both", ["x:1", "a:2"], None), ("none", [], None),
        ("trained", ["x:1"], "m"), ("used", ["x:1"], None)], "char_id string, labels array<string>, exp string")
    seg = spark.createDataFrame([("used",), (None,)], "character_id string")
    valid = spark.createDataFrame([("a",)], "prefix string")
    assert [r["char_id"] for r in ST.orphan_characters(ch, seg, valid).collect()] == ["dead"]


def test_restore_order_inserts_at_old_index(spark):
    cur = spark.createDataFrame([(1, "a", 0), (1, "c", 1)], "item_id long, seg_id string, ord long")
    gone = spark.createDataFrame([(1, "b", 1), (1, "z", 9)], "item_id long, seg_id string, ord long")
    assert [r["seg_id"] for r in ST.restore_order(cur, gone).orderBy("ord").collect()] == ["a", "b", "c", "z"]


def test_cascade_with_a_cycle(spark):
    tasks = spark.createDataFrame([("a", "error"), ("b", "pending"), ("c", "pending"), ("d", "pending"), ("e", "pending")], "task_id string, status string")
    deps = spark.createDataFrame([("b", "a"), ("c", "b"), ("b", "c"), ("e", "ghost")], "task_id string, upstream string")
    got = {r["task_id"]: r["status"] for r in ST.cascade_failures(tasks, deps).collect()}
    assert got == {"a": "error", "b": "error", "c": "error", "d": "pending", "e": "error"}


def test_oversample_of_nothing(spark):
    empty = spark.createDataFrame([], "g string, ord long")
    assert S.oversample(empty, ["g"]).count() == 0


def test_backfill_is_idempotent(spark):
    rows = spark.createDataFrame([(1, "[]"), (2, "[9]")], "k long, s string")
    src = spark.createDataFrame([(1, "[1]"), (2, "[2]")], "k long, s string")
    once = ST.backfill(rows, src, "k", ["s"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, ST.backfill(once, src, "k", ["s"]).collect())) == [(1, "[1]"), (2, "[9]")]
