"""Byte-level BPE: whole pre-tokens by a minimal perfect hash, the others by a heap over linked bytes.

The rank file is a public vocabulary; its bytes are read where the query is planned and travel with
the function. Within a task, texts are cut into pre-tokens by array operations, every different
pre-token of a slice is resolved once, and the ids are spread back over the texts. Pre-tokens are brought
together by hash and then compared byte by byte.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricmill.llm import letters
from metricmill.llm.common import runs, slices
from metricmill.llm.hashing import PerfectHash, Spans, unlike

# Merged pre-tokens that a task remembers: the last so many, and as many before them.
MEMORY = 150_000


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in order of rank."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    return [ranks[i] for i in range(len(ranks))]


def boundaries(codes: np.ndarray, docs: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where pre-tokens start, as the public pattern cuts them; ``docs`` has the texts' starts and the end.

    The pattern: an apostrophe with s, t, re, ve, m, ll or d; letters, numbers or other characters in a
    row, each with one space before them if there is one; white space, leaving its last character to
    what follows.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    cut = np.zeros(n + 1, bool)  # where a text starts or ends
    cut[docs] = True
    kinds = np.append(kind[codes], letters.SPACE)
    change = cut.copy()
    change[1:n] |= kinds[1:n] != kinds[: n - 1]
    start = change.copy()
    after = np.flatnonzero(change[1:n] & ~cut[1:n] & (kinds[: n - 1] == letters.SPACE)) + 1
    start[after - 1] = True
    start[after[codes[after - 1] == 0x20]] = False
    marks = np.flatnonzero((codes == 0x27) & start[:n])
    if len(marks):
        padded = np.append(codes, [0, 0, 0])
        inside = lambda at: ~cut[np.minimum(at, n)]  # noqa: E731  at is within the text that at - 1 is in
        first, second = padded[marks + 1], padded[marks + 2]
        one = inside(marks + 1)
        two = one & inside(marks + 2)
        short = one & np.isin(first, [ord(c) for c in "stmd"])
        long = np.zeros(len(marks), bool)
        for pair in ("re", "ve", "ll"):
            long |= two & (first == ord(pair[0])) & (second == ord(pair[1]))
        for at, length in ((marks[short], 2), (marks[long], 3)):
            start[at + 1] = False
            rest = np.minimum(at + length, n)
            start[rest] = True
    return np.flatnonzero(start[:n])


def merge(word: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Token ids of one pre-token: the pair of lowest rank, leftmost first, is joined until none is left.

    Parts are a linked list over the bytes (end and before of each start). A heap holds the pairs as one
    number each (rank, start, stop); an entry whose parts have changed meanwhile is passed over.
    """
    n = len(word)
    get, bits = ranks.get, n.bit_length()
    mask, high = (1 << bits) - 1, 2 * bits
    end = list(range(1, n + 1))
    before = list(range(-1, n))
    heap = []
    for i in range(n - 1):
        rank = get(word[i:i + 2])
        if rank is not None:
            heap.append(rank << high | i << bits | i + 2)
    heapify(heap)
    while heap:
        entry = heappop(heap)
        i, stop = entry >> bits & mask, entry & mask
        middle = end[i]
        if not middle or middle >= n or end[middle] != stop:
            continue
        end[i], end[middle], before[stop] = stop, 0, i
        if stop < n:
            rank = get(word[i:end[stop]])
            if rank is not None:
                heappush(heap, rank << high | i << bits | end[stop])
        left = before[i]
        if left >= 0:
            rank = get(word[left:stop])
            if rank is not None:
                heappush(heap, rank << high | left << bits | stop)
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i:end[i]]])
        i = end[i]
    return tuple(out)


class Encoder:
    """Two tiers: a perfect hash over the vocabulary, then merging by heap."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.ranks = {token: rank for rank, token in enumerate(tokens)}
        self.keys = vocabulary_keys(tokens)
        self.whole = PerfectHash(self.keys)
        self.rank_at = np.zeros(self.whole.n, np.int64)
        self.rank_at[self.whole.slots(self.keys)] = np.arange(len(tokens))
        self.kind = letters.classes()
        self.known: dict[bytes, tuple[int, ...]] = {}
        self.older: dict[bytes, tuple[int, ...]] = {}

    def resolve(self, keys: np.ndarray, words: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of different pre-tokens."""
        slots = self.whole.slots(keys)
        ranks = np.where(slots >= 0, self.rank_at[slots], -1).tolist()
        if len(self.known) > MEMORY:
            self.known, self.older = {}, self.known
        out = []
        for rank, word in zip(ranks, words):
            if rank >= 0 and self.tokens[rank] == word:
                out.append((rank,))
                continue
            ids = self.known.get(word)
            if ids is None:
                ids = self.known[word] = self.older.get(word) or merge(word, self.ranks)
            out.append(ids)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text's ids start (with the end as last entry)."""
        codes, docs = letters.points(texts)
        starts = boundaries(codes, docs, self.kind)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(docs), np.int64)
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        width = np.ones(len(codes), np.int64) + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
        place = np.concatenate((np.zeros(1, np.int64), np.cumsum(width)))
        first = place[starts]
        last = np.append(first[1:], len(data))
        _, at, which = np.unique(hashed := Spans(data)(first, last), return_index=True, return_inverse=True)
        raw = data.tobytes()
        odd = np.flatnonzero(unlike(data, first, last, at[which]))  # different pre-tokens of one hash
        if len(odd):
            new: dict[bytes, int] = {}
            which[odd] = [len(at) + new.setdefault(raw[first[i]:last[i]], len(new)) for i in odd]
            at = np.concatenate((at, [odd[(which[odd] == len(at) + k).argmax()] for k in range(len(new))]))
        words = [raw[a:b] for a, b in zip(first[at].tolist(), last[at].tolist())]
        found = self.resolve(hashed[at], words)
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for ids in found for i in ids), np.int32, int(lengths.sum()))
        offsets = np.cumsum(lengths) - lengths
        ids = flat[runs(offsets[which], lengths[which])]
        upto = np.concatenate((np.zeros(1, np.int64), np.cumsum(lengths[which])))
        return ids, upto[np.searchsorted(starts, docs)]


def vocabulary_keys(tokens: list[bytes]) -> np.ndarray:
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    stops = np.cumsum(lengths)
    return Spans(np.frombuffer(b"".join(tokens), np.uint8))(stops - lengths, stops)


class Decoder:
    """The bytes of token ids."""

    def __init__(self, tokens: list[bytes]):
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self.lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.starts = np.cumsum(self.lengths) - self.lengths

    def decode(self, ids: np.ndarray, upto: np.ndarray) -> pa.Array:
        """One value of bytes per list; list i holds the ids from upto[i] to upto[i + 1]."""
        lengths = self.lengths[ids]
        data = self.blob[runs(self.starts[ids], lengths)]
        stops = np.concatenate((np.zeros(1, np.int64), np.cumsum(lengths)))[upto]
        return pa.Array.from_buffers(pa.binary(), len(upto) - 1, [None, pa.py_buffer(stops.astype(np.int32)), pa.py_buffer(data)])


def encode(docs: DataFrame, ranks: str, ident: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """One row (ident, tokens) per row of ``docs``; tokens are the ids of the whole text, without special tokens.

    ``ranks`` is the path of the rank file, read here once. With ``decoded`` a column of that name holds the
    bytes that the ids stand for, as ``decode`` gives them. Null and empty texts have no tokens; null and
    repeated ids keep their rows; other columns are not read. An empty table gives an empty result.
    """
    vocabulary = read_ranks(ranks)
    encoder, decoder = Encoder(vocabulary), Decoder(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text", 1_000_000):
            ids, upto = encoder.encode(batch.column(1).to_pylist())
            made = [batch.column(0), pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(ids, pa.int32()))]
            names = ["__id", "tokens"]
            if decoded:
                made, names = [*made, decoder.decode(ids, upto)], [*names, "decoded"]
            yield pa.RecordBatch.from_arrays(made, names=names)

    rows = docs.select(F.col(ident).alias("__id"), F.col(text).cast("string").alias("__text"))
    kind = rows.schema["__id"].dataType.simpleString()
    schema = f"__id {kind}, tokens array<int>" + ", decoded binary" * decoded
    return rows.mapInArrow(run, schema).withColumnRenamed("__id", ident)


def decode(encoded: DataFrame, ranks: str, tokens: str = "tokens") -> DataFrame:
    """``encoded`` with a column ``decoded``: the bytes its token ids stand for (empty for null)."""
    decoder = Decoder(read_ranks(ranks))
    at = encoded.columns.index(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 500):
                batch = whole.slice(first, 500)
                lists = batch.column(at)
                counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                upto = np.concatenate((np.zeros(1, np.int64), np.cumsum(counts)))
                made = decoder.decode(lists.flatten().to_numpy(zero_copy_only=False), upto)
                yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{fields}, decoded binary")


def digests(docs: DataFrame, ranks: str, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(ident, n_tokens, ids_sha256, decoded_sha256): encoded, decoded again, and both summed up."""
    return encode(docs, ranks, ident, text, decoded=True).select(
        ident,
        F.size("tokens").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("tokens").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
