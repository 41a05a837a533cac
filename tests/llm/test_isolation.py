"""Rule statistics against plain loops, the forest against one without arrays, verdicts on held-out labels."""

import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from metricmill.llm import isolation, queries
from metricmill.llm.common import remainder

ROOT = "/root/testdata/sf0.01"
ODD = [None, "", " \t\n", "one", "a b c a b c", "a a a a", "x\n\nx\n x\nx", "#|# &  z", "\r\n\r\n", "ñ é\x0bü\x0cß", "w " * 100]


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines, dup = [], 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.append(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), dup, len(inside)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(alphabet="ab \n#\t ", max_size=120)))
def test_counts_against_plain_loops(text):
    assert isolation.counted(text) == plain_counts(text)


def test_long_texts_take_the_array_path():
    draw = random.Random(2)
    words = [draw.choice("abcdefghijklmnop") * draw.randint(1, 3) for _ in range(6_000)]
    assert isolation.repeated_words([w.encode() for w in words]) == plain_counts(" ".join(words))[-1]


def plain_path(tree, row):
    at = 0
    for _ in range(tree.depth):
        if tree.below[at] == at:
            break
        at = tree.below[at] if row[tree.feature[at]] < tree.cut[at] else tree.above[at]
    return tree.length[at]


def test_forest_against_plain_walks():
    random_ = np.random.default_rng(4)
    rows = np.concatenate((random_.normal(size=(300, 3)), [[9, 9, 9]], np.zeros((40, 3))))
    forest = isolation.Forest([isolation.grow(rows[random_.choice(len(rows), 64)], 6, random_) for _ in range(30)], 64)
    usual = 2 * (math.log(63) + 0.5772156649015329) - 2 * 63 / 64
    want = [2 ** (-np.mean([plain_path(t, r) for t in forest.trees]) / usual) for r in rows]
    assert np.allclose(forest.scores(rows), want)
    assert forest.scores(rows).argmax() == 300


def test_leaves_hold_what_the_tree_was_grown_on():
    rows = np.random.default_rng(1).integers(0, 3, size=(50, 2)).astype(float)
    tree = isolation.grow(rows, 30, np.random.default_rng(2))
    for row in rows:  # equal rows end in one leaf, whose length counts the splits above it and its rows
        at, level, same = 0, 0, len(rows)
        part = rows
        while tree.below[at] != at:
            left = part[:, tree.feature[at]] < tree.cut[at]
            down = row[tree.feature[at]] < tree.cut[at]
            part, at, level = part[left == down], (tree.below if down else tree.above)[at], level + 1
        same = len(part)
        assert (part == row).all() and tree.length[at] == pytest.approx(level + float(isolation.usual_path(same)))


def test_query_rows(spark, docs, on_disk):
    rows = [(i, t, "en", "a") for i, t in enumerate(ODD)] + [(None, "null " * 60, None, None), (1, "id again", "en", "b")]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(len(ODD))], "doc_id long, quality int, toxic int")
    found = queries.QUERIES["op12_isolation_rules"](spark, on_disk(documents=docs(rows), labels=labels)).collect()
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"]), tuple(r)[1:7]) for r in found)
    want = []
    for ident, text, *_ in rows:
        n_words, chars, symbols, _, dup, repeated = plain_counts(text)
        failed = n_words < 50 or 100 * repeated > 50 * n_words
        want.append(((ident is None, ident or 0, n_words), (n_words, chars, symbols, dup, repeated, failed)))
    assert got == sorted(want)
    assert not any(r["kept"] for r in found if r["base_failed"])


def test_verdicts_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{ROOT}/{t}.parquet") for t in ("documents", "labels"))
    held = remainder("doc_id", 3) == 0
    stats = isolation.statistics(docs)
    judged = isolation.judge(stats, isolation.fit(stats, labels.where(~held))).join(labels.where(held), "doc_id")
    share = {r["quality"]: r["kept"] for r in judged.where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert share[1] > 0.95 and share[0] < 0.1


def test_result_does_not_depend_on_partitions(spark):
    docs, labels = (spark.read.parquet(f"{ROOT}/{t}.parquet") for t in ("documents", "labels"))
    stats = isolation.statistics(docs)
    one, two = isolation.fit(stats, labels), isolation.fit(stats.repartition(7), labels.repartition(5))
    assert one.threshold == two.threshold and one.size == two.size
    assert all((a.cut == b.cut).all() for a, b in zip(one.trees, two.trees))


def test_without_labels_only_the_plain_rules_count(spark, docs):
    table = docs(["word " * 10, " ".join(f"w{i}" for i in range(80))])
    stats = isolation.statistics(table)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    forest = isolation.fit(stats, labels)
    assert [r["kept"] for r in isolation.judge(stats, forest).orderBy("doc_id").collect()] == [False, True]
    assert isolation.fit(stats, spark.createDataFrame([(1, 1), (None, 0), (0, None)], "doc_id long, quality int")).trees == []
    assert isolation.judge(isolation.statistics(docs([])), forest).count() == 0


def test_keep_good_decides_by_row(spark):
    good = " ".join(f"w{i}" for i in range(80))
    rows = [(1, good, "x", 1), (1, "short", "y", 2), (None, good, "z", 3), (2, None, "u", 4)]
    table = spark.createDataFrame(rows, "doc_id long, text string, n_words string, __text long")
    kept = isolation.keep_good(table, isolation.Forest([], 0)).collect()
    assert sorted(r["n_words"] for r in kept) == ["x", "z"] and kept[0].asDict().keys() == set(table.columns)
