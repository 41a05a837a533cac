"""Spelling variants: words one edit apart, found by scanning sorted word lists with a reused edit matrix.

Two words one edit apart agree either on the first half of the shorter word or on the end behind it. So
the vocabulary is sorted twice, forwards and with every word reversed; both lists are cut into shards of
adjacent words. A word visits the shards that hold words beginning with its own half, unless the beginning
shared by a shard's words is already two edits away. In a shard all its words are compared at once: each
goes through the sorted list, keeps the matrix rows of the prefix that adjacent words share (their longest
common prefix), computes the rows of the new letters only, and passes over all words that share a prefix
which is more than one edit away.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricmill.llm.common import slices
from metricmill.session import stage

# Different words a task counts before it hands them on.
HELD = 200_000
# Words of a shard on average, and shards of a list at most (their first words are known to every task).
SHARD, SHARDS = 4_096, 50_000
# Cells of matrix rows that a task keeps at a time.
CELLS = 20_000_000
LAST = chr(0x10FFFF)


def counted_words(held: Counter[str]) -> pa.RecordBatch:
    columns = [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["word", "n"])


def runs_of(docs: DataFrame, ident: str = "doc_id", text: str = "text", least: int = 7, one_in: int = 31) -> DataFrame:
    """(word, n): the runs of letters of all texts, A to Z lower-cased, of ``least`` or more code points.

    A run whose crc32 of "<ident>:<run>" is divisible by ``one_in`` loses one letter, at that number modulo
    its length. A null id is empty text there; null and empty texts have no runs; repeated rows count again.
    """
    letters = re.compile("[a-zÀ-ÿ]{%d,}" % least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in slices(batches, "__text"):
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                start = zlib.crc32(key.encode() + b":")
                for word, n in Counter(letters.findall(text.encode().lower().decode())).items():
                    mark = zlib.crc32(word.encode(), start)
                    if mark % one_in == 0:
                        at = mark % len(word)
                        word = word[:at] + word[at + 1:]
                        if len(word) < least:
                            continue
                    held[word] += n
            if len(held) > HELD:
                yield counted_words(held)
                held.clear()
        yield counted_words(held)

    rows = docs.select(
        F.coalesce(F.col(ident).cast("string"), F.lit("")).alias("__id"), F.col(text).cast("string").alias("__text")
    )
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def halves(length: int, backwards: bool) -> int:
    """How many first letters a word certainly shares with the near words that its list is asked for."""
    return (length + 1) // 2 if backwards else (length - 1) // 2


def far(word: str, prefix: str) -> bool:
    """Whether no word that begins with ``prefix`` can be within one edit of ``word``."""
    same = len(commonprefix((word, prefix)))
    if same == len(prefix):
        return False
    rest = prefix[same + 1:]  # behind a letter of the prefix that is replaced or too many; or one is missing
    return not (word.startswith(rest, same + 1) or word.startswith(rest, same) or word.startswith(prefix[same:], same + 1))


def shards_of(word: str, bounds: list[str], shared: list[str], backwards: bool) -> tuple[int, list[int]]:
    """The shard a word stands in, and all shards where near words may stand."""
    own = bisect_right(bounds, word)
    start = word[: halves(len(word), backwards)]
    at, last = bisect_right(bounds, start), bisect_right(bounds, start + LAST)
    seen = []
    while at <= last:
        if far(word, shared[at]):  # and so are the shards whose words all begin like that
            at = max(at + 1, bisect_right(bounds, shared[at] + LAST))
        else:
            seen.append(at)
            at += 1
    return own, seen


def shared_starts(bounds: list[str]) -> list[str]:
    """What all words between two neighbouring bounds begin with; nothing is known of the first and the last shard."""
    return ["", *(commonprefix(pair) for pair in zip(bounds, bounds[1:])), ""]


def _transitions() -> tuple[np.ndarray, np.ndarray]:
    """The band of a matrix row (three cells, each 0, 1 or 2 for more) as a number, and the row that follows it.

    The next row depends on which of three letters of the word equal the list's letter; the second table
    tells rows without a cell of 0 or 1.
    """
    after = np.zeros((27, 8), np.int8)
    for state in range(27):
        a, b, c = state // 9, state // 3 % 3, state % 3
        for bits in range(8):
            x = min(a + (not bits & 4), b + 1, 2)
            y = min(b + (not bits & 2), c + 1, x + 1, 2)
            z = min(c + (not bits & 1), y + 1, 2)
            after[state, bits] = 9 * x + 3 * y + z
    return after, np.arange(27) == 26


AFTER, OVER = _transitions()
EXACT = 9 + 1  # the cells 1, 0, 1: all letters so far are equal


def scan(words: list[str], asked: list[str], backwards: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place in ``asked``, place in ``words``) one edit apart; ``words`` is sorted and without repeats.

    Of the pairs, only those that agree on the word's first half, as ``halves`` has it.
    """
    n = len(words)
    sizes = np.fromiter(map(len, words), np.int64, n)
    off = np.cumsum(sizes) - sizes
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    shared = np.full(n + 1, -1, np.int64)  # letters that a word shares with the one before it
    shared[1:n] = [len(commonprefix(pair)) for pair in zip(words, words[1:])]
    shared[0] = 0
    lower = np.full(n + 1, n, np.int64)  # the next word that shares less with the one before it
    stack: list[int] = []
    for i, value in enumerate(shared.tolist()):
        while stack and shared[stack[-1]] > value:
            lower[stack.pop()] = i
        stack.append(i)

    order = sorted(range(len(asked)), key=lambda k: len(asked[k]))
    found_q, found_w = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while order:
        longest = len(asked[order[-1]]) + 4
        part, order = order[-max(1, CELLS // longest):], order[: -max(1, CELLS // longest)]
        keys = np.array(part)
        size = np.fromiter((len(asked[k]) for k in part), np.int64, len(part))
        base = np.arange(len(part)) * longest  # of a word's letters (after one blank) and of its matrix rows
        letters = np.full(len(part) * longest, 0xFFFFFFFF, np.uint32)
        rows = np.zeros(len(part) * longest, np.int8)
        text = np.frombuffer("".join(asked[k] for k in part).encode("utf-32-le"), np.uint32)
        letters[np.repeat(base + 1 - (np.cumsum(size) - size), size) + np.arange(len(text))] = text
        least = np.fromiter((halves(len(asked[k]), backwards) for k in part), np.int64, len(part))
        at = np.fromiter((bisect_left(words, asked[k][:h]) for k, h in zip(part, least.tolist())), np.int64, len(part))
        starts = np.fromiter((i < n and words[i].startswith(asked[k][:h]) for k, i, h in zip(part, at.tolist(), least.tolist())), bool, len(part))
        live = np.flatnonzero(starts)
        at, deep = at[live], least[live]
        rows[base[live] + deep] = np.where(deep > 0, EXACT, EXACT + 9)
        while len(live):
            ended = deep == sizes[at]  # a word of the list that is nothing but the shared prefix
            letter = codes[np.where(ended, 0, off[at] + deep)]
            place = base[live] + deep
            bits = (letters[place] == letter) * 4 + (letters[place + 1] == letter) * 2 + (letters[place + 2] == letter)
            now = np.where(ended, rows[place], AFTER[rows[place], bits])
            over = OVER[now] & ~ended
            deep = deep + ~ended
            rows[base[live] + deep] = now
            whole = (deep == sizes[at]) & ~over
            if whole.any():
                gap = size[live] - deep + 1  # which cell of the band is the distance
                cell = np.where(gap == 0, now // 9, np.where(gap == 1, now // 3 % 3, now % 3))
                hit = whole & (gap >= 0) & (gap <= 2) & (cell == 1)
                found_q.append(keys[live[hit]])
                found_w.append(at[hit])
            move = over | whole
            if move.any():
                limit = np.where(over, deep - 1, deep)[move]
                to = at[move] + 1
                while (wide := shared[to] > limit).any():
                    to[wide] = lower[to[wide]]
                at[move] = to
                deep[move] = shared[to]
                stay = deep >= least[live]
                live, at, deep = live[stay], at[stay], deep[stay]
    return np.concatenate(found_q), np.concatenate(found_w)


def near_in_shard(backwards: bool, words: list[str], counts: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of ``words``: how many near words the shard has, and the place of the one of largest count (-1: none).

    ``members`` marks the words that stand in the shard; all of them ask. Words and places are forwards.
    """
    turned = [w[::-1] for w in words] if backwards else words
    inside = sorted(np.flatnonzero(members).tolist(), key=turned.__getitem__)
    q, w = scan([turned[i] for i in inside], turned, backwards)
    w = np.array(inside, np.int64)[w] if len(inside) else w
    # a pair counts in the forward list if the words agree on the first half of the shorter one, else in the other
    agree = np.fromiter(
        ((a := words[i])[: (h := min(len(a), len(b := words[j])) // 2)] == b[:h] for i, j in zip(q.tolist(), w.tolist())), bool, len(q)
    )
    q, w = q[agree != backwards], w[agree != backwards]
    near = np.bincount(q, minlength=len(words))
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    best = np.full(len(words), -1, np.int64)
    last_first = np.lexsort((-rank[w], counts[w], q))  # the last entry of each word is its best
    best[q[last_first]] = w[last_first]
    return near, best, counts


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, n, n_near, best, best_n) of a table (word, n) of different words, each of three or more letters.

    n_near counts the words exactly one inserted, deleted or replaced code point away, best is the one of
    largest n (ties: the smallest in code-point order), null without any. Exact at every size; an empty
    table gives no rows. The table is read several times, so it should be staged.
    """
    total = vocabulary.count()
    every = max(SHARD, -(-total // SHARDS))
    chosen = F.pmod(F.xxhash64("word"), F.lit(every)) == 0
    firsts = [r[0] for r in vocabulary.where(chosen).select("word").collect()]  # about SHARDS words at most
    bounds = [sorted(firsts), sorted(w[::-1] for w in firsts)]
    shared = [shared_starts(b) for b in bounds]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 20_000):
                batch = whole.slice(first, 20_000)
                out: tuple[list, ...] = ([], [], [], [])
                for row, word in enumerate(batch.column(0).to_pylist()):
                    for backwards in (0, 1):
                        own, seen = shards_of(word[::-1] if backwards else word, bounds[backwards], shared[backwards], bool(backwards))
                        for shard in seen:
                            for column, value in zip(out, (backwards, shard, shard == own, row)):
                                column.append(value)
                made = [pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.bool_())]
                yield pa.RecordBatch.from_arrays(
                    [*made, *(c.take(pa.array(out[3], pa.int32())) for c in batch.columns)],
                    names=["list", "shard", "member", "word", "n"],
                )

    def look(key: tuple, table: pa.Table) -> pa.Table:
        words, counts = table["word"].to_pylist(), table["n"].to_numpy()
        members = np.array(table["member"].to_pylist(), bool)
        near, best, counts = near_in_shard(bool(key[0].as_py()), words, counts, members)
        none = best < 0
        return pa.table({
            "word": table["word"],
            "n": table["n"],
            "n_near": pa.array(near, pa.int64()),
            "best": pa.array([None if b < 0 else words[b] for b in best.tolist()], pa.string()),
            "best_n": pa.array(counts[np.where(none, 0, best)] if len(counts) else counts, pa.int64(), mask=none),
        })

    parts = (
        vocabulary.select("word", "n").mapInArrow(deal, "list int, shard int, member boolean, word string, n long")
        .groupBy("list", "shard").applyInArrow(look, "word string, n long, n_near long, best string, best_n long")
    )
    return parts.groupBy("word").agg(
        F.max("n").alias("n"),
        F.sum("n_near").alias("n_near"),
        F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("best")))).alias("top"),
    ).select("word", "n", "n_near", F.col("top.best").alias("best"), (-F.col("top.n")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of a table (word, form) of links that have no circle: the last word of each chain.

    Every round doubles the links a word has followed, so a chain of k links takes log2 k rounds; each
    round is checkpointed.
    """
    chains = stage(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("open")))
    while chains.where("open").limit(1).count():
        further = chains.select(F.col("word").alias("root"), F.col("root").alias("next"))
        chains = stage(
            chains.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("open"))
        )
    return chains.select("word", "root")


def group(vocabulary: DataFrame, ratio: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n): every word of ``vocabulary`` (word, n) with the spelling it varies.

    A word's form is its near word of largest n, if that is at least ``ratio`` (over 1) times its own n, else
    null; root follows the forms to the last, the word itself if there is none. One row per word.
    """
    near = stage(near_words(vocabulary))
    is_form: Column = F.col("best_n") >= ratio * F.col("n")
    found = near.select(
        "word", "n", "n_near", F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")
    )
    last = roots(found.where("form is not null").select("word", "form"))
    joined = found.join(last.withColumnRenamed("word", "__word"), F.col("word") == F.col("__word"), "left")
    return joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spellings(docs: DataFrame, ident: str = "doc_id", text: str = "text", least: int = 7, often: int = 2, ratio: int = 10) -> DataFrame:
    """Words of all texts that occur ``often`` or more times, grouped by spelling: the columns of ``group``.

    Runs, their lost letters and null ids as in ``runs_of``. Null and empty texts have no words; a very long
    text is read by itself, and a very long word is a word like any other; repeated rows count again; other
    columns are not read; an empty table gives no rows.
    """
    return group(stage(runs_of(docs, ident, text, least).where(F.col("n") >= often)), ratio)
