import random
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.operators import corpus, metrics
from docloom.plans import queries
from docloom.schema import BLOCKS


def blocks(spark, *rows):
    names = ["doc_id", "pos", "kind", "level", "text", "ordered", "items", "rows", "alt", "path", "title", "language", "label"]
    return spark.createDataFrame([tuple({"doc_id": 1, "pos": i, **b}.get(n) for n in names) for i, b in enumerate(rows)], BLOCKS)


def md(spark, text):
    return spark.createDataFrame([(1, text)], "doc_id long, markdown string")


def test_structure_fidelity(spark):
    cell = lambda n: {"kind": "table", "rows": [{"cells": [{"text": "x", "rowspan": 1, "colspan": 1, "image": None}] * n}]}
    a, b = blocks(spark, {"kind": "heading", "level": 1, "text": "a"}, {"kind": "paragraph", "text": "p"}, cell(2)), blocks(spark, {"kind": "heading", "level": 2, "text": "a"}, {"kind": "paragraph", "text": "other"}, cell(1))
    r = metrics.structure_fidelity(a, b).first()
    assert (round(r.score, 4), r.errors) == (0.6667, 2)
    assert metrics.structure_fidelity(a, a).first().score == 1.0
    assert metrics.forest_distance([["a", [["b", []]]]], []) == (2, 2)


def test_heading_recall(spark):
    want = spark.createDataFrame([(1, 1, "Title"), (1, 2, "Lost"), (1, 3, "Other")], "doc_id long, level int, text string")
    r = metrics.heading_recall(want, md(spark, "# Title #\n\n### Lost\n#no\n####### seven\n")).first()
    assert (round(r.score, 4), r.errors) == (0.3333, 2)
    assert metrics.heading_recall(want.limit(0), md(spark, "# x\n")).first().score == 0.0


@pytest.mark.parametrize(
    ("text", "errors"),
    [("# Title\nBody\n- item\n| A | B |\n| --- | --- |\n", 4), ("# T\n\nok\n\n- a\n\n| a |\n| - |\n", 0), ("x", 1), ("a \n", 1), ("- a\n- b\n", 2), ("", 1)],
)
def test_lint(spark, text, errors):
    assert metrics.lint(md(spark, text)).first().errors == errors


@pytest.mark.parametrize(
    ("text", "errors"),
    [("| A | B |\n| --- | --- |\n| 1 | 2 |\n| 3 |\n", 1), ("| A |\n", 1), ("<table>\n", 1), ("<table></table>", 0), ("text", 1), ("| A | B |\n| :-- | --: |\n", 0)],
)
def test_table_integrity(spark, text, errors):
    r = metrics.table_integrity(md(spark, text)).first()
    assert (r.errors, r.score) == (errors, float(errors == 0))


def test_character_errors(spark):
    c = spark.createDataFrame([(1, "ja", "vertical", "日本", "日本"), (2, "ja", "vertical", "語", "吾"), (3, "en", "horizontal", "abc", "abc")], "ord int, language string, orientation string, expected string, actual string")
    got = {r.name: round(r.score, 4) for r in metrics.character_errors_by_group(c).collect()}
    assert got == {"ocr_cer:ja:vertical": 0.6667, "ocr_cer:en:horizontal": 1.0}


def test_structure_preserved(spark):
    p = spark.createDataFrame([(1, "# a\n```\n# no\n```\n- b\n", "# a\n- b\n"), (2, "text", "text")], "doc_id long, before string, after string")
    got = {r.doc_id: (round(r.score, 4), r.errors) for r in metrics.structure_preserved(p).collect()}
    assert got == {1: (0.3333, 2), 2: (0.0, 1)}


def test_gate():
    ok = dict.fromkeys(("structure_fidelity", "heading_recall", "table_integrity", "ocr_cer", "translation_structure_preserve"), 0.9)
    assert metrics.gate({"failed": 0, "lint_errors": 0}, ok) == []
    assert len(metrics.gate({"failed": 1, "lint_errors": 2}, {**ok, "ocr_cer": 2})) == 3


def test_inventory_and_pairing(spark):
    r = spark.createDataFrame([("a", "# x\n", None), ("b", " \n", None), ("c", None, "boom"), ("d", None, "timeout"), ("e", "# Unsupported input format: zip\n", None)], "path string, markdown string, error string").withColumn("elapsed_ms", F.lit(3))
    inv = corpus.inventory(r)
    assert {x.path: x.status for x in inv.collect()} == {"a": "ok", "b": "empty", "c": "error", "d": "timeout", "e": "error"}
    other = spark.createDataFrame([("a", "ok"), ("d", "ok"), ("z", "ok")], "path string, status string")
    assert {x.path: x.outcome for x in corpus.paired(inv, other).collect()} == {"a": "both_ok", "b": "neither", "c": "neither", "d": "b_only", "e": "neither", "z": "b_only"}
    files = spark.createDataFrame([("a",), ("c",), ("n",)], "path string")
    assert {x.path for x in corpus.remaining(files, inv, ["error"]).collect()} == {"c", "n"}


def test_languages(spark):
    texts = {"ja": "日本語の文章です。" * 20, "latin": "plain words " * 20, "mixed-ja-latin": "日本語words" * 30, "unknown": "short", "other": "12345 67890 " * 5 + "абвгд " * 30 + "a日" * 25}
    for want, t in texts.items():
        assert spark.createDataFrame([(t,)], "t string").select(corpus.language_of(F.col("t")).alias("l")).first().l == (want if want != "other" else "mixed-ja-latin")


@settings(max_examples=100, deadline=None)
@given(st.text(min_size=130, max_size=300), st.text(min_size=130, max_size=300))
def test_overlap_is_a_share(a, b):
    x = corpus.overlap_of(a, b)
    assert x is None or 0 <= x <= 1
    y = corpus.overlap_of(a, a)
    assert y is None or y == 1.0


def test_ctc(spark):
    r = spark.createDataFrame([([0, 1, 1, 0, 1, 2, 2],)], "p array<int>").select(corpus.ctc_greedy(F.col("p"), F.array(F.lit("a"), F.lit("b"))).alias("t")).first()
    assert r.t == "aab"


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = i, i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last if x == y else 1 + min(last, row[j + 1], row[j])
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("ab日é\n𝄞", max_size=40), st.text("ab日é\n𝄞", max_size=40))
def test_edit_distance(a, b):
    assert metrics.edit_distance(a, b) == slow_distance(a, b)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab日é\n𝄞", max_size=20), max_size=4), st.lists(st.text("ab日éx", max_size=20), max_size=3), st.sampled_from([(1, 1), (2, 3), (128, 128)]), st.booleans())
def test_joined_pieces_are_compared(long, short, fixed, sparse):
    """Both ways give the distance, however few lengths the upper bound follows."""
    a, b = "".join(long), "".join(short)
    if len(a) < len(b):
        long, short, a, b = short, long, b, a
    j = metrics._Joined()
    for t in short:
        j.add(t, False)
    for t in long or [""]:
        j.add(t, True)
    kept = metrics.BEAM, metrics.PRUNE, metrics._excess
    try:
        metrics.BEAM, metrics.PRUNE = fixed
        metrics._excess = kept[2] if sparse else lambda *x: 10**12  # a bound so high that columns are cheaper
        if sparse and b:
            j._flush()
            places = [metrics._Ends(np.concatenate([np.zeros(0, np.int32), *e]), j.n) for e in j.ends]
            got = j.n - len(b) + metrics._excess(j.word, places, j.n, metrics._excess(j.word, places, j.n))
        else:
            got = j.distance()
    finally:
        metrics.BEAM, metrics.PRUNE, metrics._excess = kept
    assert got == slow_distance(a, b)


def test_short_text_in_a_long_one_takes_no_column_for_each_character(monkeypatch):
    """Of a text that is hundreds of times as long, only the short one's characters are worked on."""
    rng = random.Random(3)
    names = "".join(f"src{rng.randrange(20)}" for _ in range(300))
    text = "".join(rng.choices("etaoinshrlducm 0123456789", [99] * 15 + [0.1] * 10, k=400_000))
    want = metrics.edit_distance(names, text)
    monkeypatch.setattr(metrics, "_columns", None)
    j = metrics._Joined()
    j.add(names, False)
    for i in range(0, len(text), 999):
        j.add(text[i : i + 999], True)
    assert j.distance() == want


def joined(short, long):
    j = metrics._Joined()
    j.add(short, False)
    j.add(long, True)
    j._flush()
    return j.word, [metrics._Ends(np.concatenate([np.zeros(0, np.int32), *e]), j.n) for e in j.ends], j.n


def numbers_in_words(rng, names, stretches):
    """Names ``src`` with a number, and a text of plain words with some stretches that have the names' digits, more in its first part."""
    short = "".join(f"src{rng.randrange(20)}" for _ in range(names))
    plain = lambda n: "".join(rng.choices("etaoinshrldum ", k=n))
    rare = lambda: "".join(rng.choices("0123456789c.sr ", k=rng.randrange(1, 30)))
    return short, "".join(plain(rng.randrange(40 if k % 3 else 12 * k + 1)) + rare() for k in range(stretches)) + plain(3 * stretches)


@pytest.mark.parametrize(("common", "near", "cells"), [(16, 64, 1 << 24), (2, 1, 20), (0, 0, 1), (10**9, 5, 100)])
def test_bounds_of_common_subsequences(monkeypatch, common, near, cells):
    """They never exceed what is left, and the search with them is exact or says that the distance is more."""
    for k, v in (("COMMON", common), ("NEAR", near), ("CELLS", cells), ("BEAM", 3), ("ROOM", (0, 0))):
        monkeypatch.setattr(metrics, k, v)
    rng = random.Random(5)
    for names in (1, 13, 14, 40, 90):
        short, long = numbers_in_words(rng, names, 2 * names)
        word, places, n = joined(short, long)
        b = metrics._Least(word, places, n).find()
        m, want = len(word), metrics.edit_distance(short, long) - n + len(word)
        for i in range(0, len(b.at), 1 + len(b.at) // 4):
            for left in range(0, m + 1, b.step):
                text = long[b.at[i] :]
                if len(text) >= left:
                    assert b.left(b.at[i : i + 1], left)[0] <= metrics.edit_distance(short[m - left :], text) - len(text) + left
        assert metrics._excess(word, places, n, None, b) >= want
        assert [metrics._excess(word, places, n, want + d, b) for d in (0, 1, 50)] == [want] * 3
        assert not want or metrics._excess(word, places, n, want - 1, b) == want


def test_few_lengths_are_followed(monkeypatch):
    """Where a name's digits are rare, what the rest of the text can give decides, so lengths far from the best way are left."""
    short, long = numbers_in_words(random.Random(7), 1500, 800)
    want, sizes, after = metrics.edit_distance(short, long), [], metrics._Ends.after
    monkeypatch.setattr(metrics, "_columns", None)
    monkeypatch.setattr(metrics._Ends, "after", lambda self, x: sizes.append(len(x)) or after(self, x))
    j = metrics._Joined()
    j.add(short, False)
    j.add(long, True)
    assert j.distance() == want
    assert sum(sizes) < 1000 * len(short)


def test_groups_without_texts_and_equal_places(spark):
    rows = [("a", None, 1, "xy", "x"), ("a", None, 1, "ab", None), (None, "1", 2, None, None), ("b", "1", None, "q", "longer than"), ("b", "1", 1, "r", " the other")]
    c = spark.createDataFrame(rows, "language string, orientation string, ord long, expected string, actual string")
    got = {(r.name, r.errors, round(r.score, 3)) for r in metrics.character_errors_by_group(c).collect()}
    assert got == {(None, 3, 0.25), (None, 0, 1.0), ("ocr_cer:b:1", slow_distance("qr", "longer than the other"), 0.0)}


def test_whole_texts_are_compared(spark, tmp_path):
    texts = ["日本語の文章です。" * 30, "plain words that go on " * 20 + "é", "", None, "ünï\nçødé " * 25, "z"]
    rows = [(i, t, "ja" if i % 3 else "en", f"src{i}") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    run = lambda n: queries.QUERIES[n](spark, str(tmp_path)).collect()
    flat = lambda t, f: "".join(f(t).split())
    cer = lambda a, b: 1 - min(slow_distance(a, b) / max(len(a), 1), 1)
    assert {r.doc_id: r.errors for r in run("q5_whole_texts")} == {i: None if t is None else slow_distance(t, t[::-1]) for i, t in enumerate(texts)}
    groups = {}
    for i, t, g, s in rows:
        a, b = groups.get(f"ocr_cer:{g}:{i % 2}", ("", ""))
        groups[f"ocr_cer:{g}:{i % 2}"] = (a + (t or ""), b + s)
    assert {r.name: r.errors for r in run("q6_whole_texts")} == {n: slow_distance(a, b) for n, (a, b) in groups.items()}
    got = {r.key: (r.strip, r.nfkc) for r in run("r19_engine_scores") if r.key.startswith("font:")}
    norm = lambda t: unicodedata.normalize("NFKC", t)
    assert got == {f"font:src{i}": (0.0, 0.0) if t is None else tuple(round(cer(flat(t, f), flat(t[::-1], f)), 6) for f in (str, norm)) for i, t in enumerate(texts)}
