"""Numbered operators on small rows: nulls, empty and long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import hashlib
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clipweave.llm import bpe, common, decontam, linededup, minhash, pii, quality, rendering, repetition, substrings, warc, weaklabels
from clipweave.llm.common import screened, spread_join, written

ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "x" * 30_000), (5, "same words here again " * 40), (5, "same words here again " * 40), (None, "no id at all but a text of some words")]


@pytest.fixture(scope="module")
def odd(spark):
    # columns that clash with names used inside the operators
    return spark.createDataFrame([(i, t, "c", 1, "k", 0.5) for i, t in ODD], "doc_id long, text string, doc string, n int, kept string, score double")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_repetition_against_brute_force():
    random.seed(3)
    for _ in range(60):
        texts = [" ".join(random.choice("abc") for _ in range(random.randint(0, 30))) for _ in range(4)]
        words, triple, inside, longest, n, spans = repetition._measure(pa.array([*texts, None]), 4)
        for k, text in enumerate([*texts, ""]):
            w = text.split()

            def covered(m, w=w):
                at = {}
                for i in range(len(w) - m + 1):
                    at.setdefault(tuple(w[i : i + m]), []).append(i)
                return {i + o for p in at.values() if len(p) > 1 for i in p for o in range(m)}

            most = next(m for m in range(len(w) + 1) if not covered(m + 1))
            assert (words[k].as_py(), triple[k].as_py(), inside[k].as_py(), longest[k].as_py()) == (len(w), len(covered(3)), len(covered(4)), most)
            assert sum(s["end"] - s["start"] for s in spans[k].as_py()) == len(covered(4))


def test_odd_rows_everywhere(spark, odd, none):
    assert repetition.judge(repetition.repetition(odd)).count() == len(ODD)
    assert repetition.repetition(none).count() == 0
    assert quality.classify(odd, sample=10).count() == len(ODD)
    assert quality.keep(odd, sample=10).columns == odd.columns
    assert quality.classify(none).count() == 0
    found = {tuple(r) for r in minhash.near_duplicates(odd).select("doc", "n", "component_id").collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4)} <= found and {r[2] for r in found if r[0] is None} == {None}
    assert minhash.deduplicate(odd).columns == odd.columns and minhash.near_duplicates(none).count() == 0
    assert pii.find(odd).count() == len(ODD) and pii.find(none).count() == 0
    assert linededup.apply(odd).columns == odd.columns and linededup.marked(none).count() == 0
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = bpe.encode(odd, *vocabulary).collect()
    assert len(coded) == len(ODD) and all(r.round_trip for r in coded) and bpe.encode(none, *vocabulary).count() == 0
    assert {(r.doc_id, r.n_tokens) for r in coded if r.doc_id in (1, 2)} == {(1, 0), (2, 0)}
    assert substrings.dedup(odd).count() == len(ODD) and substrings.dedup(none).count() == 0
    items = spark.createDataFrame([(1, None), (2, ""), (None, "a b c d e f"), (3, "again same")], "item_id long, text string")
    assert {(r.doc, r.item_id) for r in decontam.contaminated(odd, items).collect()} == {(5, 3)}
    assert decontam.clean(none, items).count() == 0


def test_near_duplicates_link_through_others(spark):
    base = [f"w{i}" for i in range(400)]
    texts = {1: base, 2: base, 3: [*base[:-12], *[f"x{i}" for i in range(12)]], 4: [f"v{i}" for i in range(300)], 5: ["only", "three", "words"], 6: ["Only", "THREE", "words"]}
    for k in range(8):  # a chain: neighbours are alike, ends are not
        texts[10 + k] = [*[f"c{i}" for i in range(25 * k, 25 * k + 500)]]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    got = {r.doc: r.component_id for r in minhash.near_duplicates(docs).collect()}
    assert [got[i] for i in (1, 2, 3, 4, 5, 6)] == [1, 1, 1, 4, 5, 5]
    assert {got[10 + k] for k in range(8)} == {10}


def test_copies_of_shared_keys_are_never_broadcast(spark):
    """16 copies of a table that Spark takes for a small one (184,000 rows of 9 bytes) were 348 MB in the driver."""
    rows = written(spark.range(1000).select(F.col("id").alias("node"), (F.col("id") % 7).alias("key")), "rows")
    shared = written(spark.range(5).select(F.col("id").alias("key"), F.lit(2).alias("m")), "shared")
    both = spread_join(rows, shared, ["key"], F.col("node"), growing=True)
    assert "BroadcastExchange" not in both._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.node for r in both.collect()) == [i for i in range(1000) if i % 7 < 5]


def test_screen_lets_every_key_through_and_few_others(spark):
    keys = written(spark.range(5000).select(F.col("id").alias("a"), F.when(F.col("id") % 3 > 0, -F.col("id")).alias("b")), "keys")
    rows = spark.range(100_000).select(F.col("id").alias("a"), F.when(F.col("id") % 3 > 0, -F.col("id")).alias("b"), F.lit("x").alias("more"))
    found = screened(rows, keys, ["a", "b"])
    hits = {r.a for r in found.filter("_hit").collect()}
    assert found.columns == ["a", "b", "more", "_hit"] and found.filter("_hit is null").count() == 0
    assert hits >= set(range(5000)) and len(hits) < 5000 + 0.1 * 95_000
    assert screened(rows, written(keys.limit(0), "keys"), ["a"]).filter("_hit").count() == 0


def test_near_duplicates_without_broadcast_keys(spark, monkeypatch):
    """Keys of more than the few rows that are broadcast: same components, no broadcast but that of the screen."""
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(words[: 300 - k] if k < 12 else [f"v{k}-{i % 90}" for i in range(100)]) for k in range(24)]
    docs = spark.createDataFrame([*enumerate(texts), *((30 + k, t) for k, t in enumerate(texts)), (None, texts[0]), (3, None), (5, texts[5])], "doc_id long, text string")
    want = [0] * 12 + list(range(12, 24))

    def found():
        parts = [(r.doc, r.component_id) for r in minhash.near_duplicates(docs).collect()]
        kept = minhash.deduplicate(docs)
        return sorted(parts, key=str), sorted(map(tuple, kept.collect()), key=str), kept._jdf.queryExecution().executedPlan().toString()

    few, rows, _ = found()
    assert {p for p in few if p[0] is not None} == {*enumerate(want), *((30 + k, c) for k, c in enumerate(want)), (3, 3)}
    assert sorted(str(r[0]) for r in rows) == sorted(map(str, [0, *range(12, 24), 3, None]))
    monkeypatch.setattr(common, "FEW_ROWS", 0)
    many, again, plan = found()
    assert (many, again) == (few, rows)
    assert "SortMergeJoin" in plan and not [x for x in plan.splitlines() if "BroadcastHashJoin" in x and "_screen" not in x]


def test_blocks_of_unsettled_buckets():
    import numpy as np
    import pandas as pd

    sets = {1: range(100), 2: range(10, 110), 3: range(500, 600), 4: range(505, 605)}
    rows = pd.DataFrame([(7, 0, 0, n, n, 0, np.array(list(s), np.int64)) for n, s in sets.items()], columns=["key", "i", "j", "node", "comp", "block", "shingles"])
    out = [tuple(r.values()) for b in minhash._block_links(iter([pa.RecordBatch.from_pandas(rows[:2]), pa.RecordBatch.from_pandas(rows[2:])])) for r in b.to_pylist()]
    assert out == [(1, 2), (3, 4)]


def test_blocks_of_large_sets_compare_whole_hashes():
    """Sets at exactly 75 % and one shingle below, and sets whose hashes agree in their upper halves only."""
    import numpy as np
    import pandas as pd

    n = 600_000
    spread = np.arange(2 * n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    hashes = spread.view(np.int64)
    base = np.arange(n, dtype=np.int64) << 32
    # 600,000 of 800,000 are common; without the first of them one fewer is
    sets = {1: hashes[: n + n // 3], 2: hashes[:n], 3: hashes[1 : n], 4: base + 1, 5: base + 2}
    rows = pd.DataFrame([(7, 0, 0, k, k, 0, s) for k, s in sets.items()], columns=["key", "i", "j", "node", "comp", "block", "shingles"])
    one_by_one = [rows.iloc[[a, b]] for a, b in ((0, 1), (0, 2), (1, 2), (3, 4))]
    found = []
    for k, pair in enumerate(one_by_one):
        batches = minhash._block_links(iter([pa.RecordBatch.from_pandas(pair.assign(key=k), preserve_index=False)]))
        found += [tuple(r.values()) for b in batches for r in b.to_pylist()]
    assert found == [(1, 2), (2, 3)]


def test_line_dedup_keeps_first(spark):
    docs = spark.createDataFrame([(2, "a shared line\nown line of two"), (1, "A SHARED LINE \nshort\nshort\na shared line"), (3, "a shared line\nshort")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in linededup.apply(docs).collect()}
    assert got == {1: "A SHARED LINE \nshort\nshort\na shared line", 2: "own line of two", 3: "short"}
    long = "\n".join(f"line number {i % 70 if i % 3 else i}" for i in range(500))
    docs = spark.createDataFrame([(1, "\n".join(f"line number {i}" for i in range(70))), (9, long)], "doc_id long, text string")
    kept = [x for i, x in enumerate(long.split("\n")) if int(x.split()[-1]) >= 70]
    assert {r.doc_id: r.text for r in linededup.apply(docs).collect()}[9] == "\n".join(kept)


def test_substrings_frequent_digests(spark, monkeypatch):
    """Frequent digests by broadcast and the others by shuffle cut what one broadcast of all cuts."""
    lines = [f"line {k} of nine words that are not few" for k in range(6)]
    docs = spark.createDataFrame([(i, "\n".join(lines[: 1 + i % 6] + [f"only here {i} a b c d e f g"])) for i in range(40)], "doc_id long, text string")
    get = lambda: sorted((r.doc, r.body, r.n_removed, [tuple(s) for s in r.spans]) for r in substrings.cut_spans(docs, "line").collect())
    want = get()
    monkeypatch.setattr(substrings, "FEW", 4)
    monkeypatch.setattr(substrings, "FREQUENT", 25)
    assert get() == want and len(want) == 39
    assert "explode" not in substrings.cut_spans(docs, "line")._jdf.queryExecution().toString().lower()


def test_substrings_cut_at_offsets(spark):
    unit = "one passage of at least eight words stands here"
    docs = spark.createDataFrame([(1, f"é😀 first\n{unit}"), (2, f"start\n{unit.upper()}\nend\n{unit}")], "doc_id long, text string")
    got = {r.row.doc_id: (r.row.text, [(s.start, s.end) for s in r.spans]) for r in substrings.dedup(docs, "line").collect()}
    assert got[1][1] == [] and got[2][1] == [(6, 6 + len(unit)), (11 + len(unit), 11 + 2 * len(unit))]
    assert substrings.remaining(*got[2]) == "start\n\nend\n"


def test_passages_inside_lines_are_cut_and_short_lines_stay(spark):
    words = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    passage = f"Here {words('a', 20)}. Then\nit {words('b', 25)}."
    shared = f"A line of {words('s', 15)}."
    texts = {1: f"own {words('x', 9)}. {passage} {words('y', 30)}", 2: f"é😀 {words('z', 50)} in {passage}  on {words('v', 45)}\n{shared}", 3: f"{shared}\nNew {words('q', 60)}", 4: passage, 5: words("n", 200), 6: words("n", 200)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = {r.row.doc_id: (r.row.text, [(s.start, s.end) for s in r.spans], r.n_removed) for r in substrings.dedup(docs).collect()}
    assert [rows[i][2] for i in range(1, 7)] == [0, 1, 0, 1, 0, 1]
    (a, b), = rows[2][1]
    assert rows[2][0][a:b] == passage and substrings.remaining(*rows[4][:2]) == substrings.remaining(*rows[6][:2]) == ""


def test_passages_equal_brute_force(spark):
    random.seed(9)
    bits = ["One two", "three.", "Four", "five\n", " six", "seven!", "Eight  nine", "ten"]
    texts = [" ".join(random.choices(bits, k=random.randint(0, 40))) + random.choice(["", " ", "\n"]) for _ in range(25)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.row.doc_id: {p for s in r.spans for p in range(s.start, s.end)} for r in substrings.dedup(docs, min_words=4).collect()}
    seen, want = set(), {}
    for i, t in enumerate(texts):
        at = [m.span() for m in substrings.WORD.finditer(t)]
        word = [t[a:b] for a, b in at]
        begins = [k for k in range(len(at)) if k == 0 or "\n" in t[at[k - 1][1] : at[k][0]] or word[k - 1][-1] in ".!?" or word[k][0].isupper()]
        ends = [*[k - 1 for k in begins[1:]], len(at) - 1]
        want[i] = set()
        for k in begins:
            to = next((e for e in ends if e >= k + 3), None)
            if to is not None:
                key = " ".join(word[k : to + 1]).lower()
                want[i] |= set(range(at[k][0], at[to][1])) if key in seen else set()
                seen.add(key)
    assert got == want and sum(map(len, got.values())) > 100


def test_archives_round_trip(spark):
    big = "line\r\n\r\nWARC/1.1\r\n" * 20
    rows = [(3, "http://a", big), (1, "http://b\r\nX: y", big), (2, None, None), (None, "u", big), (5, "c", "tiny"), (6, "c", "tiny"), (7, "d", "é" * 90 + "\r\n"), (7, "d", "é" * 90 + "\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    out = warc.deduplicate(spark, warc.archive(pages))
    got = sorted(((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.resolve(spark, out).collect()), key=str)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(0, "response", None, len(big), sha(big)), (1, "response", None, len(big), sha(big)), (2, "response", None, 0, sha("")), (3, "revisit", 1, len(big), sha(big)),
            (5, "response", None, 4, sha("tiny")), (6, "response", None, 4, sha("tiny"))] + [(7, "response", None, 182, sha("é" * 90 + "\r\n"))] * 2
    assert got == sorted(want, key=str)
    full = {r.page_id: r.payload for r in warc.read_archive(spark, out, payload=True).filter("record_type = 'response'").collect()}
    assert full[1] == big and full[2] == ""


def test_encoding_equals_the_public_library(spark):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = bpe.read_ranks(f.read())
    public = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    random.seed(5)
    parts = ["a", "the", "ing", " ", "  ", "\n", "é", "漢", "😀", "1", "--", "'ll", " ", "\x00"]
    texts = [None, "", *["".join(random.choices(parts, k=random.randint(1, 40))) for _ in range(300)], "a" * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe.encode(docs, path, public_tokenizers.PATTERN, keep_ids=True).collect():
        assert list(r.ids) == public.encode_ordinary(texts[r.doc_id] or "") and r.round_trip and r.n_tokens == len(r.ids)


def test_long_texts_are_cut_between_words(monkeypatch):
    import public_tokenizers
    import regex
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = bpe.read_ranks(f.read())
    public = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    words = bpe.Words(regex.compile(public_tokenizers.PATTERN).findall, bpe.Transducer(ranks))
    random.seed(7)
    parts = ["a", "word", "é漢", "it's", "12345", "\n", "\nx", "--", "", "y\t"]
    texts = ["", " ", "a ", " a", "  ", *[" ".join(random.choices(parts, k=random.randint(1, 40))) for _ in range(200)]]
    for block in (1, 2, 7, 50):
        monkeypatch.setattr(bpe, "BLOCK", block)
        want = [" ".join(map(str, public.encode_ordinary(t))) for t in texts]
        assert [words.encode(t) for t in texts] == want and words.read(texts) == want


def test_transducer_without_kept_states(monkeypatch):
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"aa": 259, b"aaa": 260}
    kept = bpe.Transducer(ranks)
    pieces = ["".join(random.choices("abc", k=random.randint(1, 20))).encode() for _ in range(300)]
    first = [kept.encode(p) for p in pieces]
    assert kept.side_by_side(pieces) == [kept.walk(p) for p in pieces] == first
    monkeypatch.setattr(bpe, "MOST_STATES", 0)
    monkeypatch.setattr(bpe, "PAIRS", 4)  # nearly every check is made anew
    monkeypatch.setattr(bpe, "LONGEST_PIECE", 10)
    fresh = bpe.Transducer(ranks)
    assert fresh.side_by_side(pieces) == [fresh.walk(p) for p in pieces] == fresh.encode_all(pieces) == first


def test_utf8_in_any_cut():
    data = "aé漢😀z".encode()
    for size in range(1, 6):
        stream = bpe.Utf8Stream()
        assert "".join(stream.feed(data[i : i + size]) for i in range(0, len(data), size)) == "aé漢😀z" and stream.close()


def test_votes_reveal_reliable_labelers():
    random.seed(1)
    counts: dict[int, int] = {}
    for _ in range(3000):
        good = random.random() < 0.7
        votes = [(-1 if not good and random.random() < 0.6 else 0), (1 if good and random.random() < 0.9 else random.choice([-1, 0])), random.choice([-1, 0, 1])]
        p = sum((v + 1) * 3 ** (2 - i) for i, v in enumerate(votes))
        counts[p] = counts.get(p, 0) + 1
    chance, share, post = weaklabels.estimate(counts, 3)
    assert 0.6 < share < 0.8 and post[0 * 9 + 1 * 3 + 1] < 0.5 < post[1 * 9 + 2 * 3 + 1]
    assert chance[0]["bad"][0] > 0.4 and chance[0]["good"][0] < 0.1


def test_classifier_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    judged = quality.classify(docs).join(labels, F.col("doc") == F.col("doc_id"))
    got = {r.quality: r.share for r in judged.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert got[1] > 0.97 and got[0] < 0.6


def test_layout(spark):
    page = "<p>a<p>b <b>c</b>d<ul><li>x<li>y<ol start=3><li>n<li>m</ol></ul><table><tr><td>1<td>long cell<tr><td>333<td>z</table><div hidden>no</div>tail<br>next<pre> a\n  b</pre>&amp;&lt;<script>var t='</p>'</script>"
    assert rendering.render(page) == "a\n\nb cd\n\n- x\n- y\n  3. n\n  4. m\n\n1    long cell\n333  z\n\ntail\nnext\n\n a\n  b\n\n&<"
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "<div>" * 5000 + "deep"), (4, "<a href='x")], "page_id long, html string")
    assert {r.page_id: r.text for r in rendering.extract(rows).collect()} == {1: None, 2: "", 3: "deep", 4: ""}


@pytest.mark.parametrize(("page", "want"), [
    ("<table><tr><form><td>a<td>b</form><tr><td>c<td>d</table>end", "a  b\nc  d\n\nend"),
    ("<table><form><tr><td>a<td>b</form><tr><td>cc<td>d</table>", "a   b\ncc  d"),
    ("<form><table><tr><form><td>a</form><td>b</table>end</form>", "a  b\n\nend"),
    ("x<table><tr><b><td>a</b><td>b</table>", "x\n\na  b"),
    ("x<table><tr>loose<td>a<td>b</table>y", "xloose\n\na  b\n\ny"),
    ("<table><tbody>loose<tr><td>a<tbody><div>more</div><tr><td>b</table>", "loose\nmore\n\na\nb"),
    ("<table><tr><td>a<table><tr><td>in</table>z<td>b</table>", "a in z  b"),
    ("<table><tr><td>a<tr><table><tr><td>next</table>", "a\n\nnext"),
    ("<p>a<i aria-hidden=true>b</i><svg><title>no</title><desc>no</desc><text>c</text></svg><math><mi>d</mi></math>", "abcd"),
    ("<p>pick<select><option>one<option selected>two</select>end", "pick\none\ntwo\nend"),
])
def test_all_visible_text_of_tables_drawings_and_choices(page, want):
    assert rendering.render(page) == want


def test_short_items_are_found(spark):
    docs = spark.createDataFrame([(1, "one two three four five six"), (2, "three four"), (3, "zero")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "Three FOUR"), (2, "one two three four five"), (3, "zero")], "item_id long, text string")
    assert {(r.doc, r.item_id) for r in decontam.contaminated(docs, items).collect()} == {(1, 1), (2, 1), (1, 2), (3, 3)}
