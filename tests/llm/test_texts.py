"""Encoding, language, toxicity, suffix-tree scores and repeated strings against plain versions."""

import collections
import hashlib
import math
import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from metricmill.llm import bpe, columns, langid, letters, queries, suffixtree, toxicity
from metricmill.llm.hashing import PerfectHash, Spans

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "\n\n  x", "don't we'll 'S ''s", "漢字 😀 é ½ ٣", "a" * 20_000, " " * 300, "x1y2 _-_　z\x85"]


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.read_ranks(RANKS))


@pytest.fixture(scope="module")
def library():
    ranks = {token: rank for rank, token in enumerate(bpe.read_ranks(RANKS))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("  \n\t'srtvemld1.")), max_size=60), max_size=4))
def test_encoding_is_the_library_s(encoder, library, texts):
    ids, upto = encoder.encode(texts)
    for i, text in enumerate(texts):
        assert ids[upto[i]: upto[i + 1]].tolist() == library.encode_ordinary(text)


def test_perfect_hash(encoder):
    assert sorted(encoder.whole.slots(encoder.keys).tolist()) == list(range(len(encoder.tokens)))
    assert (encoder.whole.slots(encoder.keys + np.uint64(1)) == -1).mean() > 0.999
    assert PerfectHash(np.zeros(0, np.uint64)).slots(np.array([3], np.uint64)).tolist() == [-1]


def test_byte_bpe_query(spark, docs, on_disk, library):
    texts = ODD + ["One text.", "One text."]
    got = queries.QUERIES["op8_byte_bpe"](spark, on_disk(documents=docs(texts).union(docs([(None, "x", None, None)])))).collect()
    assert len(got) == len(texts) + 1
    for row in got:
        text = "x" if row["doc_id"] is None else texts[row["doc_id"]] or ""
        ids = library.encode_ordinary(text)
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_bpe_general_interface(docs):
    df = bpe.decode(bpe.encode(docs(ODD), RANKS).withColumnRenamed("tokens", "ids"), RANKS, "ids")
    assert {r["doc_id"]: r["decoded"].decode() for r in df.collect()} == {i: t or "" for i, t in enumerate(ODD)}
    assert bpe.encode(docs([]), RANKS).count() == 0


def every_segmentation(word, theta, names):
    """Probability of a word by trying all ways to cut it."""
    if not word:
        return 1.0
    total = 0.0
    for k in range(1, len(word) + 1):
        if word[:k] in names:
            total += theta[names[word[:k]]] * every_segmentation(word[k:], theta, names)
        elif k == 1:
            total += theta[-1] * every_segmentation(word[1:], theta, names)
    return total


def test_forward_sums_all_segmentations():
    pieces = langid.Pieces(PIECES)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    theta = np.random.default_rng(1).random((pieces.count, 2))
    names = {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        codes, ends = letters.points([piece])
        slot = pieces.find.slots(Spans(codes)(ends[:-1], ends[1:]))[0]
        if slot >= 0:
            names[piece] = pieces.number[slot]
    for word in ("▁the", "▁water", "▁straße", "▁éé", "▁漢字x"):
        matrix = letters.points([word])[0][None]
        found = langid.forward(pieces.lattice(matrix), 1, theta)[-1, 0]
        assert np.allclose(found, [every_segmentation(word, theta[:, k], names) for k in range(2)])


def test_languages_held_out(spark):
    root = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.QUERIES["op9_language_id"](spark, root).collect()}
    true = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{root}/documents.parquet").collect()}
    held = [i for i in true if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i, r in got.items() if r["held_out"]} == set(held)
    assert np.mean([got[i]["lang_pred"] == true[i] for i in held]) > 0.98


def test_languages_of_odd_texts(docs):
    rows = [(i, t, lang, "a") for i, (t, lang) in enumerate([("the water is here and there", "en"), ("der Weg ist nicht weit und die", "de")] * 5)]
    model = langid.fit(docs(rows), PIECES)
    odd = [None, "", "12 !", "the", "der", "x" * 5000, "the " * 20_000]
    got = {r["doc_id"]: r for r in langid.identify(docs(odd), model).collect()}
    assert [got[i]["lang_pred"] for i in range(5)] == ["und", "und", "und", "en", "de"]
    assert got[0]["score"] == 0 and all(0 <= r["score"] <= 1 for r in got.values())
    assert got[6]["lang_pred"] == "en"
    kept = langid.keep_identified(docs(odd).selectExpr("*", "1 as score", "2 as lang_pred"), model)
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 6]
    nothing = langid.fit(docs([(1, "text", None, "a")]), PIECES)
    assert {r["lang_pred"] for r in langid.identify(docs(odd), nothing).collect()} == {"und"}
    assert langid.keep_identified(docs(odd), nothing).count() == 0
    assert langid.identify(docs([]), model).count() == 0


def test_toxicity_held_out(spark):
    root = "/root/testdata/sf0.1"
    got = queries.QUERIES["op4_toxicity"](spark, root).toPandas()
    labels = spark.read.parquet(f"{root}/labels.parquet").toPandas().merge(got, on="doc_id")
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]).all()
    held = labels[labels["held_out"]]
    toxic, clean = held[held["toxic"] == 1], held[held["toxic"] == 0]
    assert toxic["predicted"].mean() > 0.7 and clean["predicted"].mean() < 0.02
    assert (got["predicted"] == (got["score"] >= 0.5)).all() and got["score"].between(0, 1).all()


def test_toxicity_of_odd_texts(spark, docs):
    texts = [("you idiot moron" if i % 3 == 0 else "a fine day it is") + f" {i}" for i in range(60)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] + [(None, 1), (1, None), (2, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs(texts), labels)
    odd = [None, "", "x", "idiot moron", "a fine day", "idiot moron " * 30_000]
    got = {r["doc_id"]: r["predicted"] for r in toxicity.classify(docs(odd), model).collect()}
    assert got[3] == got[5] == 1 and got[0] == got[1] == got[4] == 0
    assert toxicity.classify(docs([]), model).count() == 0
    none = toxicity.fit(docs(texts), labels.limit(0))
    assert {r["predicted"] for r in toxicity.classify(docs(odd), none).collect()} == {0}


def test_grams_stay_in_their_text():
    texts = ["abcd", "", "ab", "abcdefg"]
    for (hashes, first), width in zip(toxicity.grams(texts), toxicity.ORDERS):
        assert np.diff(first).tolist() == [max(0, len(t) - width + 1) for t in texts]
        assert len(hashes) == first[-1]
        if width == 3:
            assert hashes[0] == hashes[first[3]]


def test_base_scores(spark, docs, on_disk):
    texts = ODD + ["the cat sat", "The CAT sat", "the dog ran off", "a b c " * 3000] * 4
    got = queries.QUERIES["op7_suffix_tree"](spark, on_disk(documents=docs(texts, 2))).collect()
    assert len(got) == len(texts)
    tokens = [(t or "").encode().lower().split() + [None] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))]
    counts = collections.Counter(w for t, h in zip(tokens, held) if not h for w in t)
    n, v = sum(counts.values()), len(counts)
    for r in got:
        own = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held[r["doc_id"]], len(own), n)
        assert r["n_known"] == sum(counts[w] > 0 for w in own)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), rel_tol=1e-9)
        assert r["score"] < 0


def test_suffix_tree_learns(spark):
    got = queries.QUERIES["op7_suffix_tree"](spark, "/root/testdata/sf0.1").toPandas()
    held = got[got["held_out"]]
    assert held["score"].sum() > held["base_score"].sum()


def test_tree_alone_learns(spark):
    documents = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = suffixtree.score(documents, queries.remainder("doc_id", 5) == 1, unigram=0.0).where("held_out").toPandas()
    assert got["score"].sum() > got["base_score"].sum()


def test_tree_distributions_sum_to_one(docs, spark):
    flat, at = suffixtree.normal([b"ab ab ac", b"ab ba", b""] * 50)
    keys, n = suffixtree.tally(suffixtree.grams(*suffixtree.sequence(flat, at)[:2]))
    import pandas as pd

    levels = []
    for depth in range(suffixtree.DEPTH + 1):
        short = (keys >> suffixtree.BITS * (suffixtree.DEPTH + 1 - depth) << suffixtree.BITS) | (keys & 511)
        own, count = suffixtree.tally(short, n)
        levels.append(pd.DataFrame({"ctx": own >> suffixtree.BITS, "sym": own & 511, "n": count}))
    tree = suffixtree.Tree(levels, 0.5, 2.0)
    assert len(tree.logs) > 3
    used = len(np.unique(levels[0]["sym"])) + 1  # and the start, which is never predicted
    never = suffixtree.SYMBOLS - used
    total = (10.0 ** tree.logs[:, :-1]).sum(axis=1) + never * 10.0 ** tree.logs[:, -1]
    assert np.allclose(total, 1, atol=1e-4)


def test_suffix_tree_without_training(docs):
    from pyspark.sql import functions as F

    got = suffixtree.score(docs(["a b", None]), F.lit(True)).collect()
    assert all(r["train_tokens"] == r["n_known"] == 0 and r["score"] < 0 for r in got)
    assert suffixtree.score(docs([]), F.lit(False)).count() == 0


def covered(texts, width):
    counts = collections.Counter(t[i:i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - width + 1):
            if counts[t[i:i + width]] > 1:
                gone[i:i + width] = True
        out.append(bytes(b for b, g in zip(t, gone) if not g))
    return out


@pytest.mark.parametrize("crowd", [3000, 3])
def test_repeats(docs, monkeypatch, crowd):
    monkeypatch.setattr(columns, "CROWD", crowd)
    draw = random.Random(9)
    some = lambda n: "".join(draw.choices("abcdé ", k=n))
    long, line = some(300), some(90)
    texts = [some(draw.randint(0, 200)) + x + some(draw.randint(0, 150)) for x in [long, long, line, line, line, line[:60], "", long[40:180]] * 3]
    texts += [None, "", "a" * 500, "ab" * 300, long, long, "x" * 64, "y" * 63, long[:64], some(64)]
    got = {r["doc_id"]: r for r in columns.repeats(docs(texts), width=64).collect()}
    raw = [(t or "").encode() for t in texts]
    for i, want in enumerate(covered(raw, 64)):
        assert got[i]["kept"] == want and got[i]["n_bytes"] == len(raw[i])
        assert sum(s["stop"] - s["start"] for s in got[i]["spans"]) == len(raw[i]) - len(want)
        assert all(a["stop"] < b["start"] for a, b in zip(got[i]["spans"], got[i]["spans"][1:]))


def test_repeats_of_repeated_rows(docs):
    text = "".join(random.Random(1).choices("abc", k=450))
    df = docs([(7, text, None, None), (7, text, None, None), (None, "q" + text[:380], None, None)])
    got = columns.repeats(df).collect()
    assert sorted(len(r["kept"]) for r in got) == [0, 0, 381]
    assert columns.repeats(docs([])).count() == 0


def test_pre_tokens_of_one_hash_are_told_apart(encoder, library):
    """A Thue-Morse word and its complement collide under every polynomial modulo 2 ** 64."""
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    data = np.frombuffer((word + other).encode(), np.uint8)
    assert len(set(Spans(data)(np.array([0, 2048]), np.array([2048, 4096])).tolist())) == 1
    texts = [word, other, f"x {other} {word} y", word[:1024], other[:1024], "y"]
    ids, upto = encoder.encode(texts)
    for i, text in enumerate(texts):
        assert ids[upto[i]: upto[i + 1]].tolist() == library.encode_ordinary(text)


@pytest.mark.parametrize("name", ["op7_suffix_tree", "op10_suffix_columns"])
def test_rows_are_the_same_however_scans_are_split(spark, tmp_path, monkeypatch, name):
    """Scans are planned for as many cores as there are; here their number changes between the scans of one query."""
    draw = random.Random(3)
    shared = ["".join(draw.choice("abcdefgh ") for _ in range(900)) for _ in range(6)]
    rows = [(i, "".join(draw.choice("abcdefgh ") for _ in range(draw.randint(0, 900))) + draw.choice([*shared, ""])) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.option("parquet.block.size", 4096).parquet(f"{tmp_path}/documents.parquet")
    want = {r["doc_id"]: tuple(r) for r in queries.QUERIES[name](spark, str(tmp_path)).collect()}
    monkeypatch.setattr(columns, "scratch", lambda *a, inner=columns.scratch: (spark.conf.set("spark.sql.files.maxPartitionBytes", "7k"), inner(*a))[1])
    monkeypatch.setattr(suffixtree, "scratch", lambda *a, inner=suffixtree.scratch: (spark.conf.set("spark.sql.files.maxPartitionBytes", "7k"), inner(*a))[1])
    monkeypatch.setattr(columns, "stage", lambda df, inner=columns.stage: (inner(df), spark.conf.set("spark.sql.files.maxPartitionBytes", "99k"))[0])
    monkeypatch.setattr(suffixtree, "stage", lambda df, inner=suffixtree.stage: (inner(df), spark.conf.set("spark.sql.files.maxPartitionBytes", "99k"))[0])
    try:
        got = {r["doc_id"]: tuple(r) for r in queries.QUERIES[name](spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 400 and all(got[i] == pytest.approx(want[i]) if name.startswith("op7") else got[i] == want[i] for i in want)


def test_tables_that_are_not_files_are_told_apart_too(docs):
    text = "".join(random.Random(1).choice("abc") for _ in range(600))
    table = docs([text, text, "short"])
    found = columns.repeats(table.union(table).repartition(3), width=400).collect()
    assert sorted(len(r["kept"]) for r in found) == [0, 0, 0, 0, 5, 5]


def test_runs_of_any_length_sum_all_segmentations(monkeypatch):
    """Long runs go through the lattice in logarithms; both ways agree, and no run is cut."""
    pieces = langid.Pieces(PIECES)
    draw = np.random.default_rng(2)
    theta = draw.random((pieces.count, 3))
    theta /= theta.sum(axis=0)
    model = langid.Model(["a", "b", "c"], theta, pieces, letters.classes())
    texts = ["waterfallstraße der Wasserfall", "x", "漢字仮名交じり文" * 2, "the end", ""]
    whole = model.score(texts)
    monkeypatch.setattr(langid, "LONG", 2)
    assert np.allclose(model.score(texts), whole)
    word = letters.points(["▁" + "waterfall" * 6 + "ß漢"])[0]
    arcs = pieces.long_lattice(word)
    plain = [np.ones(3)] + [np.zeros(3) for _ in word]
    for start, stop, piece in zip(*(x.tolist() for x in arcs)):
        plain[stop] = plain[stop] + plain[start] * theta[piece]
    assert np.allclose(langid.long_forward(arcs, len(word), np.log(theta))[-1], np.log(plain[-1]))


def test_expected_counts_of_long_runs(monkeypatch):
    pieces = langid.Pieces(PIECES)
    theta = np.random.default_rng(3).random((pieces.count, 2))
    word = letters.points(["▁waterfall"])[0]
    want = langid.expected(pieces.lattice(word[None]), np.array([[3.0, 0.5]]), theta)
    assert np.allclose(langid.long_expected(pieces.long_lattice(word), len(word), np.array([3.0, 0.5]), theta), want)


def test_long_runs_of_one_hash_are_told_apart():
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    groups, number, doc = langid.words_of([word, other, word, "ab"], letters.classes())
    assert number[0] == number[2] != number[1] and doc.tolist() == [0, 1, 2, 3]
    assert sorted(m.shape[1] for _, m in groups) == [3, 2049, 2049]


def most_taken(run):
    """The result of ``run`` and the most MB that Python and numpy held for it."""
    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("step", [columns.anchors, columns.windows])
def test_texts_are_hashed_in_small_slices(monkeypatch, step):
    """A task's arrays follow the slice, not the batch, and the rows do not depend on where slices end."""
    draw = random.Random(6)
    line = "".join(draw.choices("abcde ", k=800)).encode()
    texts = [bytes(draw.choices(b"abcde ", k=draw.randint(400, 3000))) + draw.choice([line, b""]) for _ in range(1500)]
    rid = pa.array([{"file": 1, "row": i} for i in range(len(texts))], columns.ROW_TYPE)
    ids, first = pa.array(range(len(texts))), pa.array([0] * len(texts), pa.int32())
    batch = {"anchors": [rid, texts], "windows": [rid, ids, first, texts]}[step.__name__]
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in batch], names=["rid", "id", "first"][: len(batch) - 1] + ["data"])
    rows, taken = most_taken(lambda: sum(x.num_rows for x in step(iter([batch]), 400)))
    assert rows and taken < 40
    found = pa.Table.from_batches(step(iter([batch]), 400))
    monkeypatch.setattr(columns, "SLICE", 10_000_000)
    assert found.equals(pa.Table.from_batches(step(iter([batch]), 400)))


def test_columns_are_laid_out_in_little_memory():
    draw = random.Random(8)
    shared = [bytes(draw.choices(b"abc", k=260)) for _ in range(40)]
    texts = [draw.choice(shared)[: draw.randint(100, 260)] + bytes(draw.choices(b"abc", k=draw.randint(0, 60))) for _ in range(3000)]
    groups, offsets = np.array([draw.randrange(30) for _ in texts]), np.array([draw.randint(0, 40) for _ in texts])
    (which, start), taken = most_taken(lambda: columns.sort_columns(groups, texts, offsets, 64))
    assert taken < 10
    seen = collections.defaultdict(list)
    for i, text in enumerate(texts):
        for at in range(len(text) - 63):
            seen[groups[i], at - offsets[i], text[at:at + 64]].append((i, at))
    assert sorted(zip(which.tolist(), start.tolist())) == sorted(x for same in seen.values() if len(same) > 1 for x in same)
