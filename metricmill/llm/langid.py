"""Language identification by unigrams over a fixed vocabulary, all segmentations summed.

Each language has a probability for every piece of a public vocabulary. A word's probability in a
language is the sum over all ways to cut it into pieces, by the forward algorithm; a text's is the
product over its words. The piece probabilities are learned by expectation maximisation: the backward
pass gives how often each piece is expected in the words of a language.

Words are the runs of letters of the lower-cased text, whole texts, each with the vocabulary's mark of
a word's start. Words of equal length go through the lattice together; a run of more than LONG letters (a sentence
in a script without spaces, say) goes through it alone and in logarithms, however long it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricmill.llm import letters
from metricmill.llm.common import apart, slices
from metricmill.llm.hashing import PerfectHash, Spans
from metricmill.session import stage

UNKNOWN = "und"
START = "▁"  # what the vocabulary writes where a word starts
LONG = 24


class Pieces:
    """The pieces of a vocabulary that words of letters can be made of, found by hash."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = (model.id_to_piece(i) for i in range(model.get_piece_size()))
        names = sorted({x for x in names if x != START and x.lstrip(START).isalpha() and x == x.lower()})
        codes, ends = letters.points(names)
        keys = Spans(codes)(ends[:-1], ends[1:])
        self.count, self.widest = len(names) + 1, max(map(len, names))  # the last number stands for any other letter
        self.find = PerfectHash(keys)
        self.number = np.zeros(self.find.n, np.int64)
        self.number[self.find.slots(keys)] = np.arange(len(names))

    def lattice(self, words: np.ndarray) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
        """For every end: (start, rows, pieces) of the pieces that end there, over equally long words."""
        rows, length = words.shape
        spans = Spans(words.ravel())
        base = np.arange(rows) * length
        arcs: list = [[] for _ in range(length + 1)]
        for start in range(length):
            for stop in range(start + 1, min(length, start + self.widest) + 1):
                slots = self.find.slots(spans(base + start, base + stop))
                at = np.flatnonzero(slots >= 0)
                if len(at):
                    arcs[stop].append((start, at, self.number[slots[at]]))
                if stop == start + 1 and len(at) < rows:
                    rest = np.flatnonzero(slots < 0)
                    arcs[stop].append((start, rest, np.full(len(rest), self.count - 1)))
        return arcs

    def long_lattice(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, stop, piece) of all pieces in one word, ordered by stop."""
        spans, n = Spans(word), len(word)
        found = []
        for width in range(1, min(self.widest, n) + 1):
            at = np.arange(n - width + 1)
            slots = self.find.slots(spans(at, at + width))
            piece = np.where(slots >= 0, self.number[slots], self.count - 1)
            own = np.flatnonzero((slots >= 0) | (width == 1))
            found.append((at[own], at[own] + width, piece[own]))
        start, stop, piece = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(stop, kind="stable")
        return start[order], stop[order], piece[order]


def long_forward(arcs: tuple[np.ndarray, np.ndarray, np.ndarray], n: int, logs: np.ndarray) -> np.ndarray:
    """Log probability of each prefix of one word, (n + 1, languages); logs is that of (pieces, languages)."""
    start, stop, piece = arcs
    bounds = np.searchsorted(stop, np.arange(n + 2)).tolist()
    alpha = np.zeros((n + 1, logs.shape[1]))
    for at in range(1, n + 1):
        own = slice(bounds[at], bounds[at + 1])
        ways = alpha[start[own]] + logs[piece[own]]
        top = ways.max(axis=0)
        alpha[at] = top + np.log(np.exp(ways - top).sum(axis=0))
    return alpha


def long_expected(arcs: tuple[np.ndarray, np.ndarray, np.ndarray], n: int, weights: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Expected piece counts of one word with a count for each language; the backward pass is the forward one turned round."""
    start, stop, piece = arcs
    logs = np.log(theta)
    alpha = long_forward(arcs, n, logs)
    turned = np.argsort(n - start, kind="stable")
    beta = long_forward(((n - stop)[turned], (n - start)[turned], piece[turned]), n, logs)[::-1]
    counts = np.zeros_like(theta)
    np.add.at(counts, piece, np.exp(alpha[start] + logs[piece] + beta[stop] - alpha[n]) * weights)
    return counts


def forward(arcs: list, rows: int, theta: np.ndarray) -> np.ndarray:
    """Probability of each prefix, (length + 1, rows, languages); theta is (pieces, languages)."""
    alpha = np.zeros((len(arcs), rows, theta.shape[1]))
    alpha[0] = 1
    for stop, found in enumerate(arcs):
        for start, at, piece in found:
            alpha[stop, at] += alpha[start, at] * theta[piece]
    return alpha


def expected(arcs: list, weights: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Expected piece counts (pieces, languages) of words with counts ``weights`` (words, languages)."""
    alpha = forward(arcs, len(weights), theta)
    beta = np.zeros_like(alpha)
    beta[-1] = weights / alpha[-1]
    counts = np.zeros_like(theta)
    for stop in range(len(arcs) - 1, 0, -1):
        for start, at, piece in arcs[stop]:
            on = theta[piece] * beta[stop, at]
            np.add.at(counts, piece, alpha[start, at] * on)
            beta[start, at] += on
    return counts


def words_of(texts: list[str], kind: np.ndarray) -> tuple:
    """Different words of the texts and where they stand.

    Returns the words by length, [(numbers, matrix of code points)], and for the running words their
    number and the text they are in.
    """
    codes, docs = letters.points([x.lower() for x in texts])
    mark = np.uint32(ord(START))
    letter = np.concatenate(([False], kind[codes] == letters.LETTER, [False]))
    edge = np.zeros(len(codes) + 1, bool)
    edge[docs] = True
    starts = np.flatnonzero(letter[1:] & (~letter[:-1] | edge))
    stops = np.flatnonzero(letter[:-1] & (~letter[1:] | edge))
    if not len(starts):
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    number = np.zeros(len(starts), np.int64)
    short = np.flatnonzero(stops - starts <= LONG)
    _, first, number[short] = np.unique(Spans(codes)(starts[short], stops[short]), return_index=True, return_inverse=True)
    first = short[first]
    begin, lengths = starts[first], (stops - starts)[first]
    groups = []
    for width in np.unique(lengths):
        own = np.flatnonzero(lengths == width)
        matrix = codes[begin[own][:, None] + np.arange(width)]
        groups.append((own, np.concatenate((np.full((len(own), 1), mark, np.uint32), matrix), axis=1)))
    long: dict[bytes, int] = {}
    for i in np.flatnonzero(stops - starts > LONG):  # told apart letter by letter
        word = codes[starts[i]:stops[i]]
        before = len(long)
        number[i] = len(first) + long.setdefault(word.tobytes(), before)
        if len(long) > before:
            groups.append((number[i:i + 1].copy(), np.concatenate(([mark], word)).astype(np.uint32)[None]))
    return groups, number, np.searchsorted(docs, starts, side="right") - 1


class Model:
    """Learned languages and the log probability of every word in them."""

    def __init__(self, languages: list[str], theta: np.ndarray, pieces: Pieces, kind: np.ndarray):
        self.languages, self.theta, self.pieces, self.kind = languages, theta, pieces, kind

    def score(self, texts: list[str]) -> np.ndarray:
        """Log probability of each text in each language."""
        groups, number, doc = words_of(texts, self.kind)
        found = np.zeros((int(number.max()) + 1 if len(number) else 0, len(self.languages)))
        for own, matrix in groups:
            if matrix.shape[1] > LONG + 1:
                found[own[0]] = long_forward(self.pieces.long_lattice(matrix[0]), matrix.shape[1], np.log(self.theta))[-1]
                continue
            for at in range(0, len(own), 20_000):
                part = matrix[at: at + 20_000]
                alpha = forward(self.pieces.lattice(part), len(part), self.theta)
                found[own[at: at + 20_000]] = np.log(alpha[-1])
        return np.stack([np.bincount(doc, found[number, k], len(texts)) for k in range(len(self.languages))], axis=1)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        logs = self.score(texts)
        best = logs.argmax(axis=1)  # languages are sorted: of equals the first by name
        share = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
        # Every word has a probability below one, so a sum of zero means that there are no words.
        silent = ~logs.any(axis=1)
        names = [UNKNOWN if s else self.languages[b] for s, b in zip(silent, best)]
        return names, np.where(silent, 0.0, share)


def fit(
    docs: DataFrame,
    vocabulary: str,
    text: str = "text",
    lang: str = "lang",
    ident: str = "doc_id",
    per_language: int = 1000,
    rounds: int = 3,
    smoothing: float = 0.1,
) -> Model:
    """Learn piece probabilities from rows that have a language.

    The fit takes a sample of about ``per_language`` documents of each language, chosen by the hash of
    the id, so that the sample is bounded and a rare language is used in full. Word counts and expected
    piece counts are summed by Spark; the driver gets one row per language and piece.
    """
    pieces, kind = Pieces(vocabulary), letters.classes()
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"),
        F.pmod(F.xxhash64(F.col(ident).cast("string")), F.lit(1 << 30)).alias("draw"),
    )
    held = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(held)
    model = Model(languages, np.full((pieces.count, len(languages)), 1 / pieces.count), pieces, kind)
    if not languages:
        return model
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, per_language / held[k]))])
    sample = rows.where(F.col("draw") < F.element_at(share, F.col("lang")) * (1 << 30)).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            names = batch.column(0).to_pylist()
            at = np.array([languages.index(x) for x in names])
            groups, number, doc = words_of(batch.column(1).to_pylist(), kind)
            if not len(number):
                continue
            tally = np.zeros((int(number.max()) + 1, len(languages)), np.int64)
            np.add.at(tally, (number, at[doc]), 1)
            for own, matrix in groups:
                row, where = np.nonzero(tally[own])
                words = ["".join(map(chr, x)) for x in matrix.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([words[i] for i in row], pa.string()), pa.array(where, pa.int32()), pa.array(tally[own][row, where])],
                    names=["word", "lang_no", "n"],
                )

    words = sample.mapInArrow(count, "word string, lang_no int, n long")
    words = stage(words.groupBy("word", "lang_no").agg(F.sum("n").alias("n")).withColumn("width", F.length("word")))

    for turn in range(rounds):
        theta = model.theta

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros_like(theta)
            for batch in batches:
                widths = batch.column(3).to_numpy()
                texts = np.array(batch.column(0).to_pylist(), dtype=object)
                for i in np.flatnonzero(widths > LONG + 1):
                    word, weights = letters.points([texts[i]])[0], np.zeros(len(languages))
                    weights[batch.column(1)[int(i)].as_py()] = batch.column(2)[int(i)].as_py()
                    total += long_expected(pieces.long_lattice(word), len(word), weights, theta)
                for width in np.unique(widths[widths <= LONG + 1]):
                    own = np.flatnonzero(widths == width)
                    matrix = letters.points(list(texts[own]))[0].reshape(len(own), width)
                    weights = np.zeros((len(own), len(languages)))
                    weights[np.arange(len(own)), batch.column(1).to_numpy()[own]] = batch.column(2).to_numpy()[own]
                    total += expected(pieces.lattice(matrix), weights, theta)
            piece, where = np.nonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(piece, pa.int32()), pa.array(where, pa.int32()), pa.array(total[piece, where])],
                names=["piece", "lang_no", "n"],
            )

        sums = words.mapInArrow(expect, "piece int, lang_no int, n double").groupBy("piece", "lang_no").agg(F.sum("n").alias("n"))
        got = sums.toPandas()
        counts = np.full(theta.shape, smoothing)
        counts[got["piece"].to_numpy(int), got["lang_no"].to_numpy(int)] += got["n"].to_numpy(float)
        model.theta = counts / counts.sum(axis=0)
    return model


def identify(docs: DataFrame, model: Model, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (ident, lang_pred, score) per row of ``docs``, from its text alone.

    lang_pred is the language under which the whole text is likeliest (of equals the first by name),
    score its posterior with all languages equally likely before. Null texts and texts without a letter
    give ``und`` with score 0, as does every text if no language was learned. Null and repeated ids keep
    their rows; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            if model.languages:
                names, scores = model.predict(batch.column(1).to_pylist())
            else:
                names, scores = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=["__id", "lang_pred", "score"],
            )

    rows = docs.select(F.col(ident).alias("__id"), F.col(text).cast("string").alias("__text"))
    kind = rows.schema["__id"].dataType.simpleString()
    return rows.mapInArrow(run, f"__id {kind}, lang_pred string, score double").withColumnRenamed("__id", ident)


def keep_identified(
    docs: DataFrame, model: Model, ident: str = "doc_id", text: str = "text", least: float = 0.5
) -> DataFrame:
    """The rows of ``docs`` whose text has a language with a posterior of at least ``least``, unchanged.

    Decided row by row: repeated and null ids do not matter, null and empty texts go, very long ones are
    read whole. Without a learned language and on an empty table nothing is left.
    """
    plain, (text,) = apart(docs, text)
    at = len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            if model.languages:
                names, scores = model.predict(batch.column(at).to_pylist())
                keep = pa.array((np.array(names, dtype=object) != UNKNOWN) & (scores >= least))
                kept = batch.filter(keep)
                yield pa.RecordBatch.from_arrays(kept.columns[:at], names=kept.schema.names[:at])

    schema = plain.schema
    return plain.withColumn("__text", F.col(text).cast("string")).mapInArrow(run, schema).toDF(*docs.columns)
