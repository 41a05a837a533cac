"""Spelling variants against comparing every two words."""

import collections
import random
import re
import zlib
from bisect import bisect_right

import numpy as np
import pytest

from metricmill.llm import queries, variants


def one_edit(a, b):
    """Exactly one code point inserted, deleted or replaced."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def plain_words(rows, least=7, one_in=31):
    held = collections.Counter()
    for ident, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            mark = zlib.crc32(f"{'' if ident is None else ident}:{run}".encode())
            if mark % one_in == 0:
                at = mark % len(run)
                run = run[:at] + run[at + 1:]
            if len(run) >= least:
                held[run] += 1
    return {w: n for w, n in held.items() if n >= 2}


def plain_groups(words, ratio=10):
    out, form = {}, {}
    for w, n in words.items():
        near = [v for v in words if one_edit(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= ratio * n else None
        out[w] = [form[w], None, n, len(near), words[form[w]] if form[w] else None]
    for w in words:
        last = w
        while form[last]:
            last = form[last]
        out[w][1] = last
    return {w: tuple(v) for w, v in out.items()}


def words_of(draw, letters, lengths, count):
    return sorted({"".join(draw.choice(letters) for _ in range(draw.choice(lengths))) for _ in range(count)})


@pytest.mark.parametrize("seed", range(40))
def test_shard_against_all_pairs(seed, monkeypatch):
    draw = random.Random(seed)
    monkeypatch.setattr(variants, "CELLS", draw.choice([40, 2_000, 1_000_000]))
    words = words_of(draw, "abÿ"[: draw.choice([1, 2, 3])], [3, 4, 7, 8, 9, 30], draw.randint(1, 120))
    members = np.array([draw.random() < 0.7 for _ in words])
    counts = np.array([draw.randint(1, 4) for _ in words])
    near = np.zeros(len(words), int)
    best = [set() for _ in words]
    for backwards in (False, True):
        found, top, _ = variants.near_in_shard(backwards, words, counts, members)
        near += found
        for i, j in enumerate(top):
            best[i] |= {j} - {-1}
    for i, w in enumerate(words):
        others = [j for j, v in enumerate(words) if members[j] and one_edit(w, v)]
        assert near[i] == len(others)
        want = min(others, key=lambda j: (-counts[j], words[j]), default=None)
        assert min(best[i], key=lambda j: (-counts[j], words[j]), default=None) == want


@pytest.mark.parametrize("seed", range(40))
def test_near_words_are_in_visited_shards(seed):
    draw = random.Random(seed)
    words = words_of(draw, "abc"[: draw.choice([1, 2, 3])], [3, 4, 7, 8, 9], draw.randint(1, 80))
    for backwards in (False, True):
        turned = [w[::-1] if backwards else w for w in words]
        bounds = sorted(draw.sample(turned, min(len(turned), draw.randint(0, 15))))
        shared = variants.shared_starts(bounds)
        for a, turned_a in zip(words, turned):
            own, seen = variants.shards_of(turned_a, bounds, shared, backwards)
            assert own in seen and len(set(seen)) == len(seen)
            for b, turned_b in zip(words, turned):
                half = min(len(a), len(b)) // 2
                if one_edit(a, b) and (a[:half] == b[:half]) != backwards:
                    assert bisect_right(bounds, turned_b) in seen


def test_far_against_all_prefixes():
    draw = random.Random(5)
    for _ in range(3_000):
        word, prefix = ("".join(draw.choice("ab") for _ in range(draw.randint(0, 7))) for _ in range(2))
        near = any(word[:i] == prefix or one_edit(word[:i], prefix) for i in range(len(word) + 1))
        assert variants.far(word, prefix) == (not near)


def test_query_against_all_pairs(spark, docs, on_disk, monkeypatch):
    monkeypatch.setattr(variants, "SHARD", 16)
    monkeypatch.setattr(variants, "HELD", 50)
    draw = random.Random(1)
    stems = words_of(draw, "aeéÿ×rst", [6, 7, 8, 9, 12], 40) + ["zwanzigst", "Zwanzigste", "ZWANZIGSTEN"]
    texts = [None, "", "short words only", "x" * 5_000, ("y" * 3_000 + " ") * 3, "Ünïcodé ÜNÏCODÉ ünïcodé"]
    for _ in range(120):
        words = [draw.choice(stems) for _ in range(30)]
        for i in range(3):
            at = draw.randrange(len(words[i]))
            words[i] = words[i][:at] + draw.choice(["", "q", words[i][at] * 2]) + words[i][at + 1:]
        texts.append(" ".join(words))
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)] + [(None, texts[-1], None, None), (7, texts[7], "en", "a")]
    found = queries.QUERIES["op13_spelling_variants"](spark, on_disk(documents=docs(rows))).collect()
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in found}
    want = plain_groups(plain_words([(r[0], r[1]) for r in rows]))
    assert len(found) == len(got) and got == want
    assert any(v[0] for v in got.values()) and any(v[3] == 0 for v in got.values())


def test_chains_are_followed_to_the_end(spark):
    words = ["abcdefg", "abcdefgh", "abcdefghi", "abcdefghij", "abcdefghijk", "abcdefghijkl"]
    table = spark.createDataFrame([(w, 2 * 10**i) for i, w in enumerate(words)] + [("different", 5)], "word string, n long")
    got = {r["word"]: (r["form"], r["root"]) for r in variants.group(table).collect()}
    assert got == {w: (f, words[-1]) for w, f in zip(words, [*words[1:], None])} | {"different": (None, "different")}


def test_ties_go_to_the_smaller_word(spark):
    table = spark.createDataFrame([("mountain", 2), ("mountaib", 20), ("mountaia", 20), ("mountais", 19)], "word string, n long")
    got = {r["word"]: r["form"] for r in variants.group(table).collect()}
    assert got["mountain"] == "mountaia" and got["mountais"] is None


def test_empty_tables(spark, docs):
    assert variants.spellings(docs([])).count() == 0
    assert variants.spellings(docs(["", None])).count() == 0


def test_other_columns_do_not_matter(spark):
    rows = [(1, "wanderer wanderers", "x", 1), (2, "wanderer wanderers", "y", 2)]
    table = spark.createDataFrame(rows, "doc_id long, text string, word string, __text long")
    got = {r["word"]: r["n_near"] for r in variants.spellings(table).collect()}
    assert got == {w: v[3] for w, v in plain_groups(plain_words([r[:2] for r in rows])).items()} and got
