"""Cross-tokenizer alignment: two tokenizations of each text, cut into groups and linked, all on Arrow arrays.

Within a task, texts are encoded piece by piece (words, mostly), each different piece once. The documents'
token lists are flattened, running sums of token bytes that start anew with each document give the ends, and
a hash join on (document, end) lays both tokenizations side by side: the rows of the joined and sorted table
are the stretches between neighbouring ends, and each is one link of an A token with a B token. Spark writes the documents' links once, adds up the documents per id pair, and looks the
counts up again: those of the most frequent pairs in the task, the others by a join.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from metricmill.llm.common import slices
from metricmill.session import scratch, stage

# Pairs whose counts every task knows: those in more than one of HOT parts of all document-pair rows, so HOT at most.
HOT = 100_000
# Bits for the end within a document, in a key that begins with the document's place in its slice.
ENDS = 40
# Partial counts that a task holds before it hands them on.
HELD = 500_000
# Different pieces of text whose ids a task remembers, and those it encodes at a time.
PIECES, AT_ONCE = 120_000, 5_000
# A space at an end of the text or beside other white space.
BESIDE_SPACE = (
    r"^ | $|[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "
    r"| [\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


def byte_alphabet() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte: itself if it shows, else one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


@dataclass
class Vocabularies:
    """Both tokenizers as their files' contents, which travel to the tasks, and the bytes of every id."""

    a_file: str
    b_file: bytes
    a_bytes: list[bytes]
    b_bytes: list[bytes]

    @classmethod
    def read(cls, a_path: str, b_path: str) -> Vocabularies:
        with open(a_path, encoding="utf-8") as lines, open(b_path, "rb") as model:
            a_file, b_file = lines.read(), model.read()
        alphabet = byte_alphabet()
        names = {i: token for token, i in Tokenizer.from_str(a_file).get_vocab().items()}
        a_bytes = [bytes(alphabet[c] for c in names.get(i, "") if c in alphabet) for i in range(max(names) + 1)]
        pieces = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        b_bytes = [
            bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i)
            else pieces.id_to_piece(i).replace("▁", " ").encode()
            for i in range(pieces.get_piece_size())
        ]
        return cls(a_file, b_file, a_bytes, b_bytes)


def encoder_of(vocabularies: Vocabularies) -> Callable[[list[str]], list[list[int]]]:
    """Encodes texts by A's file. A plain byte-level file whose merges stand in the order of their ids is the same
    thing as a list of ranks, for which there is a faster library."""
    model = json.loads(vocabularies.a_file)
    split, plain = model["pre_tokenizer"] or {}, model["model"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in plain.get("merges", [])]
    ids = [plain["vocab"]["".join(m)] for m in pairs]
    ranked = (
        model["normalizer"] is None and split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]
        and not plain.get("ignore_merges") and not plain.get("dropout")
        and ids == list(range(256, 256 + len(ids))) and set(range(256)) == {plain["vocab"][c] for c in byte_alphabet()}
    )
    if ranked:
        ranks = {vocabularies.a_bytes[i]: i for i in range(256 + len(ids))}
        fast = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [fast.encode_ordinary(t) for t in texts]
    whole = Tokenizer.from_str(vocabularies.a_file)
    whole.encode_special_tokens = True
    return lambda texts: [e.ids for e in whole.encode_batch_fast(texts, add_special_tokens=False)]


class Tokens:
    """The tokens of one tokenizer over a slice of documents."""

    def __init__(self, lists: pa.ListArray, vocabulary: pa.Array):
        self.lists = lists
        self.ids = pc.list_flatten(self.lists)
        self.docs = pc.list_parent_indices(self.lists).cast(pa.int64())
        self.bytes = vocabulary.take(self.ids)

    def joined(self) -> pa.Array:
        """Each document's token bytes, one after the other."""
        return pc.binary_join(pa.ListArray.from_arrays(self.lists.offsets, self.bytes), b"")

    def keys(self) -> pa.Array:
        """(document, end of the token in the document's bytes) as one number."""
        upto = pa.concat_arrays([pa.array([0], pa.int64()), pc.cumulative_sum(pc.binary_length(self.bytes).cast(pa.int64()))])
        ends = pc.subtract(upto.slice(1), upto.take(self.lists.offsets).take(self.docs))
        return pc.add(pc.shift_left(self.docs, ENDS), ends)


def lists_of(values: pa.Array, places: pa.Array, n: int) -> pa.ListArray:
    """``values`` as n lists; ``places`` (ascending) says which list each value belongs to."""
    counts = np.bincount(places.to_numpy(zero_copy_only=False), minlength=n)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), values)


class Aligner:
    def __init__(self, vocabularies: Vocabularies):
        self.encode_a = encoder_of(vocabularies)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=vocabularies.b_file)
        self.a_bytes, self.b_bytes = pa.array(vocabularies.a_bytes, pa.binary()), pa.array(vocabularies.b_bytes, pa.binary())
        # Pieces can be encoded one by one if no entry of B goes on behind a word with a space.
        self.cut = not any(b" " in entry.lstrip(b" ") for entry in vocabularies.b_bytes if entry != b" ")
        self.known: dict[str, int] = {}
        self.held = [pa.array([], pa.list_(pa.int32()))] * 2

    def pieces(self, texts: list[str]) -> pa.ListArray:
        """Each text cut where a single space stands between two other characters, without that space.

        Neither tokenizer has a token that holds such a space anywhere but at its front, so the pieces are
        encoded apart from each other, each behind a space.
        """
        if not self.cut:
            return pa.array([[t] for t in texts], pa.list_(pa.string()))
        column = pa.array(texts, pa.string())
        parts = pc.split_pattern(column, " ")
        odd = np.flatnonzero(pc.match_substring_regex(column, BESIDE_SPACE).to_numpy(zero_copy_only=False))
        if not len(odd):
            return parts
        lists = parts.to_pylist()
        for i in odd:
            made: list[list[str]] = [[lists[i][0]]]
            for part in lists[i][1:]:
                before = made[-1][-1]
                if before and part and not before[-1].isspace() and not part[0].isspace():
                    made.append([part])
                else:
                    made[-1].append(part)
            lists[i] = [" ".join(x) for x in made]
        return pa.array(lists, pa.list_(pa.string()))

    def encode(self, pieces: list[str]) -> np.ndarray:
        """Where the ids of each piece are held. Pieces that a task has met are not encoded again."""
        if len(self.known) > PIECES:
            self.known, self.held = {}, [x.slice(0, 0) for x in self.held]
        new = [p for p in pieces if p not in self.known]
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            made: list[list[pa.Array]] = [[x] for x in self.held]
            for at in range(0, len(new), AT_ONCE):
                some = new[at: at + AT_ONCE]
                a = self.encode_a([" " + p for p in some])
                for side, x in zip(made, (a, self.b.encode(some, num_threads=1))):
                    side.append(pa.array(x, pa.list_(pa.int32())))
            self.held = [pa.concat_arrays(x) for x in made]
        return np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))

    def tokens(self, texts: list[str]) -> tuple[Tokens, Tokens]:
        """Both tokenizations; neither has tokens for an empty text or where one of them does not keep the bytes."""
        parts = self.pieces(texts)
        different = pc.list_flatten(parts).dictionary_encode()
        place = pa.array(self.encode(different.dictionary.to_pylist())).take(different.indices)
        plain = pc.binary_join_element_wise(pa.scalar(b" "), pa.array(texts, pa.string()).cast(pa.binary()), pa.scalar(b""))
        full = pa.array([bool(t) for t in texts])

        def lists(which: int) -> pa.ListArray:
            ids = self.held[which].take(place)
            return pa.ListArray.from_arrays(ids.offsets.take(parts.offsets), ids.flatten())

        sides = [Tokens(lists(0), self.a_bytes), Tokens(lists(1), self.b_bytes)]
        whole = pc.and_(full, pc.and_(*[pc.equal(side.joined(), plain) for side in sides]))
        if not pc.all(whole).as_py():
            kept = pc.if_else(whole, pa.array(range(len(texts)), pa.int64()), pa.scalar(None, pa.int64()))
            taken = [side.lists.take(kept) for side in sides]  # null lists, which hold nothing
            sides = [Tokens(pa.ListArray.from_arrays(x.offsets, x.flatten()), v) for x, v in zip(taken, (self.a_bytes, self.b_bytes))]
        return sides[0], sides[1]

    def align(self, texts: list[str], tokens: bool, digest: bool) -> dict[str, pa.Array]:
        """The columns of ``align`` for a slice of texts."""
        n = len(texts)
        a, b = self.tokens(texts)
        left, right = pa.table({"key": a.keys(), "a": a.ids}), pa.table({"key": b.keys(), "b": b.ids})
        pieces = left.join(right, "key", join_type="full outer", use_threads=False).combine_chunks()
        pieces = pieces.take(pc.sort_indices(pieces["key"])).combine_chunks()
        column = lambda name: pieces[name].combine_chunks() if pieces.num_rows else pa.array([], pieces.schema.field(name).type)
        key, a_here, b_here = column("key"), column("a"), column("b")
        doc = pc.shift_right(key, ENDS)
        both = pc.and_(a_here.is_valid(), b_here.is_valid())  # where a group ends
        pair = pc.add(
            pc.multiply(pc.fill_null_backward(a_here).cast(pa.int64()), pa.scalar(len(self.b_bytes), pa.int64())),
            pc.fill_null_backward(b_here).cast(pa.int64()),
        )
        per_doc = lambda docs: pa.array(np.bincount(docs.to_numpy(zero_copy_only=False), minlength=n).astype(np.int64))
        held = pa.table({"doc": doc, "pair": pair}).group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")])
        held = held.take(pc.sort_indices(held["doc"])).combine_chunks()
        of = pc.cast(held["doc"], pa.int64()).combine_chunks() if held.num_rows else pa.array([], pa.int64())
        flat = lambda name, kind: held[name].cast(kind).combine_chunks() if held.num_rows else pa.array([], kind)
        out = {
            "n_a": pc.list_value_length(a.lists).cast(pa.int64()),
            "n_b": pc.list_value_length(b.lists).cast(pa.int64()),
            "n_groups": per_doc(doc.filter(both)),
            "n_links": per_doc(doc),
            "pairs": lists_of(flat("pair", pa.int64()), of, n),
            "times": lists_of(flat("count_all", pa.int32()), of, n),
        }
        if not (tokens or digest):
            return out
        ends = np.flatnonzero(both.to_numpy(zero_copy_only=False))
        of_group = doc.filter(both)
        stops = [np.cumsum(x.is_valid().to_numpy(zero_copy_only=False))[ends] for x in (a_here, b_here)]
        if tokens:
            out |= {"a_ids": a.lists, "b_ids": b.lists}
            for name, own, upto in (("a_stops", a, stops[0]), ("b_stops", b, stops[1])):
                before = own.lists.offsets.to_numpy()[of_group.to_numpy()]
                out[name] = lists_of(pa.array(upto - before, pa.int32()), of_group, n)
        if digest:
            sides = []
            for ids, upto in ((a.ids, stops[0]), (b.ids, stops[1])):
                offsets = pa.array(np.concatenate(([0], upto)), pa.int32())
                sides.append(pc.binary_join(pa.ListArray.from_arrays(offsets, ids.cast(pa.string())), ","))
            groups = lists_of(pc.binary_join_element_wise(*sides, "|"), of_group, n)
            texts_of = pc.binary_join(groups, ";").to_pylist()
            out["groups_sha256"] = pa.array([hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts_of])
        return out


COLUMNS = {
    "n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "pairs": "array<long>", "times": "array<int>",
    "a_ids": "array<int>", "b_ids": "array<int>", "a_stops": "array<int>", "b_stops": "array<int>", "groups_sha256": "string",
}


def align(
    docs: DataFrame, vocabularies: Vocabularies, ident: str = "doc_id", text: str = "text", tokens: bool = False,
    digest: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: (ident, n_a, n_b, n_groups, n_links, pairs, times) and more on demand.

    A encodes a space and the text, B the text, to which it adds the space. Groups end where tokens of both
    end; a link is an A token and a B token with a byte in common. ``pairs`` holds the different linked ids
    of the text as a * (size of B) + b, ``times`` how many links each has. With ``tokens`` the ids of both
    and, for every group, how many of them its end completes; with ``digest`` the SHA-256 of the groups'
    ids as text. Null and empty texts, and those whose bytes one of the tokenizers does not keep, have no
    tokens: zeros, empty lists and an empty digest. A very long text is a slice of its own; null and
    repeated ids keep their rows; other columns are not read; an empty table gives an empty result.
    """
    names = [c for c in COLUMNS if c in ("n_a", "n_b", "n_groups", "n_links", "pairs", "times")
             or tokens and c in ("a_ids", "b_ids", "a_stops", "b_stops") or digest and c == "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = None
        for batch in slices(batches, "__text", 500_000):
            aligner = aligner or Aligner(vocabularies)
            made = aligner.align(batch.column(1).to_pylist(), tokens, digest)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(made[c] for c in names)], names=["__id", *names])

    rows = docs.select(F.col(ident).alias("__id"), F.col(text).cast("string").alias("__text"))
    kind = rows.schema["__id"].dataType.simpleString()
    schema = f"__id {kind}, " + ", ".join(f"{c} {COLUMNS[c]}" for c in names)
    return rows.mapInArrow(run, schema).withColumnRenamed("__id", ident)


def pair_counts(aligned: DataFrame, b_size: int) -> DataFrame:
    """(pair, a, b, n, top): in how many rows of ``aligned`` a pair is linked, and whether no pair of its A id has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def summed(tables: list[pa.Table]) -> pa.Table:
            return pa.concat_tables(tables).group_by("pair", use_threads=False).aggregate([("n", "sum")]).select(["pair", "n_sum"]).rename_columns(["pair", "n"])

        held: list[pa.Table] = []
        for batch in batches:
            pairs = pc.list_flatten(batch.column(0))
            held.append(pa.table({"pair": pairs, "n": pa.array(np.ones(len(pairs), np.int64))}))
            if sum(t.num_rows for t in held) > HELD:
                held = [summed(held)]
                if held[0].num_rows > HELD // 2:
                    yield from held.pop().to_batches()
        if held:
            yield from summed(held).to_batches()

    counts = aligned.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = stage(counts.withColumns({"a": F.expr(f"pair div {b_size}"), "b": F.col("pair") % b_size}))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))  # at most a row for each id of A
    return counts.join(F.broadcast(most), "a").select("pair", "a", "b", "n", (F.col("n") == F.col("most")).alias("top"))


def score_links(aligned: DataFrame, counts: DataFrame, row: str, hot: int = HOT) -> DataFrame:
    """``aligned`` (with a unique column ``row``) and n_best, count_sum: links of top pairs, counts over all links.

    Pairs in more than one of ``hot`` parts of all document-pair rows (so fewer than ``hot``) are looked up in
    the tasks; only what rarer pairs add goes through a shuffle, pre-added by nothing but these pairs, none of
    which is in more than that part of the rows.
    """
    total, all_pairs = counts.agg(F.sum("n"), F.count("*")).first()
    often = F.col("n") * hot > (total or 0)
    known = counts.where(often).select("pair", "n", "top").orderBy("pair").toPandas()
    keys, times_of, top_of = (np.append(known[c].to_numpy(), last) for c, last in (("pair", -1), ("n", 0), ("top", 0)))
    keys, times_of, top_of = keys[:-1].astype(np.int64), times_of.astype(np.int64), top_of.astype(np.int64)

    def find(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The row of each pair, the pair, its times, its place among the known (the last: unknown)."""
        lists = batch.column("pairs")
        pairs = pc.list_flatten(lists).to_numpy(zero_copy_only=False)
        at = np.searchsorted(keys, pairs)
        at = np.where(at < len(keys), at, len(keys))
        at = np.where((at < len(keys)) & (np.append(keys, -1)[at] == pairs), at, len(keys))
        times = pc.list_flatten(batch.column("times")).to_numpy(zero_copy_only=False).astype(np.int64)
        return pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64), pairs, times, at

    def add(of: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
        upto = np.concatenate(([0], np.cumsum(values)))
        return pa.array(np.diff(upto[np.searchsorted(of, np.arange(n + 1))]), pa.int64())

    rest = [c for c in aligned.columns if c not in ("pairs", "times")]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, _, times, at = find(batch)
            made = [add(of, times * top_of[at], batch.num_rows), add(of, times * times_of[at], batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *made], names=[*rest, "n_best", "count_sum"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in aligned.schema.fields if f.name in rest)
    scored = aligned.mapInArrow(near, f"{fields}, n_best long, count_sum long")
    if len(known) == all_pairs:
        return scored

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, pairs, times, at = find(batch)
            new = at == len(keys)
            made = [batch.column(row).take(pa.array(of[new])), pa.array(pairs[new], pa.int64()), pa.array(times[new], pa.int64())]
            yield pa.RecordBatch.from_arrays(made, names=["__row", "pair", "times"])

    kind = aligned.schema[row].dataType.simpleString()
    rare = aligned.select(row, "pairs", "times").mapInArrow(others, f"__row {kind}, pair long, times long")
    more = (
        rare.join(counts.where(~often).select("pair", "n", "top"), "pair").groupBy("__row")
        .agg(F.sum(F.when(F.col("top"), F.col("times")).otherwise(0)).alias("__best"), F.sum(F.col("times") * F.col("n")).alias("__sum"))
    )
    joined = scored.join(more, scored[row] == more["__row"], "left")
    return joined.select(
        *rest,
        (F.col("n_best") + F.coalesce("__best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("__sum", F.lit(0))).alias("count_sum"),
    )


def link_scores(
    docs: DataFrame, vocabularies: Vocabularies, ident: str = "doc_id", text: str = "text", hot: int = HOT
) -> DataFrame:
    """(ident, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum), one row per row of ``docs``.

    The alignment is written once to the shared folder, each row with a number of its own, and read from
    there by the counts and the look-up; odd texts and ids as in ``align``.
    """
    path = scratch(docs.sparkSession, "aligned")
    rows = align(docs, vocabularies, ident, text, digest=True).withColumnRenamed(ident, "__id")
    rows.withColumn("__no", F.monotonically_increasing_id()).write.parquet(path)
    aligned = docs.sparkSession.read.parquet(path)
    counts = stage(pair_counts(aligned, len(vocabularies.b_bytes)))
    return score_links(aligned, counts, "__no", hot).drop("__no").withColumnRenamed("__id", ident)
