"""Cross-tokenizer alignment against loops over the tokens' byte ranges."""

import collections
import hashlib

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from metricmill.llm import alignment, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "\n\n  x", "don't we'll 'S ''s", "漢字 😀 é ½ ٣", "a" * 3_000, " " * 300, "x1y2 _-_　z\x85", "▁ marks", "a▁b",
    "<|endoftext|> and <s> </s> <unk> <0x41>", "\x00\x01", "ﬁne ﬁ", "é", "One text.", "One text.", "Zwei Wörter, drei Wörter",
]


@pytest.fixture(scope="module")
def vocabularies():
    return alignment.Vocabularies.read(A, B)


@pytest.fixture(scope="module")
def aligner(vocabularies):
    return alignment.Aligner(vocabularies)


@pytest.fixture(scope="module")
def plain():
    """Both tokenizations as (id, bytes) lists, from the libraries and the files' entries alone."""
    tokenizer = Tokenizer.from_file(A)
    tokenizer.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=B)
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    table = {chr(b): b for b in shown}
    for b in range(256):
        if b not in shown:
            table[chr(256 + len(table) - len(shown))] = b

    def run(text):
        if not text:
            return [], []
        a = [(i, bytes(table[c] for c in tokenizer.id_to_token(i))) for i in tokenizer.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in pieces.encode(text):
            piece = pieces.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if pieces.is_byte(i) else piece.replace("▁", " ").encode()))
        whole = (" " + text).encode()
        ok = all(b"".join(x for _, x in side) == whole for side in (a, b))
        return (a, b) if ok else ([], [])

    return run


def spans(tokens):
    out, at = [], 0
    for ident, data in tokens:
        out.append((ident, at, at + len(data)))
        at += len(data)
    return out


def plain_links(a, b):
    """Overlapping pairs and groups by comparing ranges."""
    a, b = spans(a), spans(b)
    links = [(i, j) for i, s, t in a for j, u, v in b if s < v and u < t]
    cuts = sorted({t for _, _, t in a} & {t for _, _, t in b})
    groups, low = [], 0
    for cut in cuts:
        groups.append(([i for i, s, t in a if low < t <= cut], [j for j, s, t in b if low < t <= cut]))
        low = cut
    return links, groups


def plain_rows(plain, texts):
    made = [plain(t) for t in texts]
    every = [plain_links(*x) for x in made]
    count = collections.Counter(pair for links, _ in every for pair in set(links))
    most = collections.Counter()
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    rows = []
    for (a, b), (links, groups) in zip(made, every):
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append((
            len(a), len(b), len(groups), len(links), sum(count[x] == most[x[0]] for x in links), sum(count[x] for x in links),
            hashlib.sha256(written.encode()).hexdigest() if written else "",
        ))
    return rows


FIELDS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("hot", [alignment.HOT, 20, 1])
def test_scores_against_plain_loops(spark, docs, vocabularies, plain, hot):
    texts = ODD + [f"The {w} of the {w}s, don't they?" for w in ("house", "straße", "señor", "日本")]
    found = alignment.link_scores(docs(texts), vocabularies, hot=hot).collect()
    got = {r["doc_id"]: tuple(r[f] for f in FIELDS) for r in found}
    assert len(found) == len(texts)
    assert got == dict(enumerate(plain_rows(plain, texts)))


def test_query_rows(spark, docs, on_disk, plain):
    rows = [(i, t, "en", "a") for i, t in enumerate(ODD)] + [(None, "null id", None, None), (3, "id again", "de", "b")]
    found = queries.QUERIES["op11_token_alignment"](spark, on_disk(documents=docs(rows)))
    assert {f.name: f.dataType.simpleString() for f in found.schema.fields}["count_sum"] == "bigint"
    got = collections.Counter((r["doc_id"], *(r[f] for f in FIELDS)) for r in found.collect())
    want = plain_rows(plain, [r[1] for r in rows])
    assert got == collections.Counter((r[0], *w) for r, w in zip(rows, want))


@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("  \n\t'aeßñ1.")), max_size=40), max_size=4))
def test_slices_against_plain_loops(aligner, plain, texts):
    made = aligner.align(texts, tokens=True, digest=True) if texts else {}
    for i, text in enumerate(texts):
        a, b = plain(text)
        links, groups = plain_links(a, b)
        assert made["n_links"][i].as_py() == len(links)
        assert made["a_ids"][i].as_py() == [x for x, _ in a]
        assert made["b_ids"][i].as_py() == [x for x, _ in b]
        pairs = collections.Counter(x * len(aligner.b_bytes) + y for x, y in links)
        assert dict(zip(made["pairs"][i].as_py(), made["times"][i].as_py())) == pairs
        upto = [sum(len(g[side]) for g in groups[: k + 1]) for side in (0, 1) for k in range(len(groups))]
        assert made["a_stops"][i].as_py() + made["b_stops"][i].as_py() == upto


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(alphabet=st.sampled_from("  \n\t\x0b\x1c\x85\xa0\u2003\u3000ab'1.é"), max_size=30), min_size=1, max_size=4))
def test_pieces_do_not_change_the_ids(aligner, plain, texts):
    """Texts full of white space, which decides where pieces may be cut."""
    first, second = aligner.tokens(texts)
    for i, text in enumerate(texts):
        a, b = plain(text)
        assert first.lists[i].as_py() == [x for x, _ in a] and second.lists[i].as_py() == [x for x, _ in b]


@settings(max_examples=200, deadline=None)
@given(texts=st.lists(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("  \n\t'srtvemld1.<|endoftext|>")), max_size=60), max_size=4))
def test_both_libraries_agree(vocabularies, texts):
    """The faster library by ranks, and the one of the file, which others than plain byte-level files use."""
    marked = vocabularies.a_file.replace('"normalizer":null', '"normalizer":{"type":"Sequence","normalizers":[]}', 1)
    odd = alignment.Vocabularies(marked, b"", vocabularies.a_bytes, [])
    assert odd.a_file != vocabularies.a_file
    assert alignment.encoder_of(vocabularies)(texts) == alignment.encoder_of(odd)(texts)


def test_forgetting_pieces_changes_nothing(aligner, plain, monkeypatch):
    monkeypatch.setattr(alignment, "PIECES", 3)
    for texts in (["one two three four"], ["two five"], ["one two"], ["six", "", "two two"]):
        first, _ = aligner.tokens(texts)
        assert [x.as_py() for x in first.lists] == [[i for i, _ in plain(t)[0]] for t in texts]


def test_empty_table(spark, docs, vocabularies):
    assert alignment.link_scores(docs([]), vocabularies).count() == 0
    rows = alignment.link_scores(docs([None, ""]), vocabularies).collect()
    assert [tuple(r[f] for f in FIELDS) for r in rows] == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_clashing_columns(spark, vocabularies):
    table = spark.createDataFrame([(1, "A text.", 5, "x")], "doc_id long, text string, __no long, pairs string")
    assert alignment.link_scores(table, vocabularies).first()["n_links"] > 0
    table = spark.createDataFrame([("k", "A text.")], "__no string, pair string")
    assert alignment.link_scores(table, vocabularies, ident="__no", text="pair").first()["__no"] == "k"
