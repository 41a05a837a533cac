import random
import re

import xxhash
from conftest_llm import classes
from metricmill.llm import queries, simhash
from metricmill.llm.components import components


def plain(text, shingle=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + shingle]) for i in range(len(words) - shingle + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


TEXTS = [
    None, "", " \n\t", "One", "one", "one two", "one two three four", "ONE two\tthree\nfour", "ÄB äb Äb ab", "a" * 50_000,
    "x y " * 30_000, "one two three", "one two three four five",
]


def test_fingerprints(docs):
    got = {r["doc_id"]: r["fp"] % (1 << 64) for r in simhash.fingerprints(docs(TEXTS)).collect()}
    assert got == {i: plain(t) for i, t in enumerate(TEXTS)}


def test_links_are_exact(spark):
    draw = random.Random(5)
    prints = set()
    for _ in range(40):
        seed = draw.getrandbits(64)
        prints.add(seed)
        for _ in range(12):
            x = seed
            for b in draw.sample(range(64), draw.randint(0, 4)):
                x ^= 1 << b
            prints.add(x)
    prints = sorted(prints)
    df = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(prints)], "id long, fp long")
    for most in (0, 1, 2):
        got = sorted(tuple(sorted(r)) for r in simhash.links(df, most).collect())
        want = [(i, j) for i in range(len(prints)) for j in range(i + 1, len(prints)) if (prints[i] ^ prints[j]).bit_count() <= most]
        assert got == want


def test_documents(spark, docs, on_disk):
    base = [" ".join(random.Random(i).choices("abcdefgh", k=400)) for i in range(5)]
    texts = TEXTS + base + base[:3] + [b.upper() for b in base[:2]] + [b + " z" for b in base]
    root = on_disk(documents=docs(texts + [(None, "one", "en", None)]))
    got = queries.QUERIES["op5_simhash_near_dedup"](spark, root).collect()
    prints = {i: plain(t) for i, t in enumerate(texts)}
    pairs = [(i, j) for i in prints for j in prints if i < j and (prints[i] ^ prints[j]).bit_count() <= 2]
    want = classes(prints, pairs)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got if r["doc_id"] is not None} == {
        i: (format(x, "016x"), want[i]) for i, x in prints.items()
    }
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [want[3]]
    kept = simhash.keep_one(spark.read.parquet(f"{root}/documents.parquet")).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted(set(want.values()))


def test_empty_and_extra_columns(spark, docs):
    assert simhash.near_duplicates(docs([])).count() == 0
    df = docs(["a b c", "a b c"]).selectExpr("*", "1 as fp", "2 as id", "3 as component_id", "4 as key")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and kept.count() == 1
    assert simhash.keep_one(df.union(df)).count() == 1


def test_rows_that_share_an_id(docs):
    a, b, c, d = (" ".join(random.Random(i).choices("abcdefgh", k=400)) for i in range(4))
    # Near copies of c and d.
    c2, d2, d3 = (next(y for y in (f"{x} {n}" for n in range(first, 1000)) if (plain(x) ^ plain(y)).bit_count() <= 2) for x, first in ((c, 0), (d, 0), (d, 200)))
    rows = [(3, a), (5, a), (5, b), (9, b), (9, c), (3, c2), (3, a), (7, "")]
    rows += [(None, a), (None, d), (None, d), (None, d2), (None, None), (8, d3), (None, "alone")]
    kept = simhash.keep_one(docs([(i, t, "en", None) for i, t in rows])).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == sorted([(3, a), (5, b), (3, c2), (7, ""), (8, d3), (0, "alone")])
    kept = simhash.keep_one(docs([(None, d, "en", None), (None, d, "en", None), (None, d2, "en", None), (None, a, "en", None)])).collect()
    assert len(kept) == 2 and a in [r["text"] for r in kept]


def test_components(spark):
    draw = random.Random(2)
    pairs = [(draw.randrange(300), draw.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)] + [(500, i) for i in range(501, 560)]
    df = spark.createDataFrame(pairs + [(None, 1)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(df).collect()}
    want = classes({x for p in pairs for x in p}, pairs)
    linked = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == {i: c for i, c in want.items() if i in linked}
    assert components(df.limit(0)).count() == 0
