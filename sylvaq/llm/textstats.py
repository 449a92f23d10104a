"""Per-document text quality statistics and a learned vote on what is natural prose."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylvaq.scratch import checkpointed
from sylvaq.ship import ship

#: Words of a piece, and the mean length beyond which it holds something else than words.
PIECE, LONG_WORD = 8, 14
#: Most frequent words of a language that count as its common words, and how often one text may count for a word.
TOP_WORDS, PER_TEXT = 40, 8
#: Texts looked at together (at most 2 ** (64 - MARK_BITS)) and their bytes; bounds the arrays of a task.
TOGETHER, BYTES, MARK_BITS = 512, 1 << 19, 53
#: Statistics of one text, in the order in which they come out.
STATS = {
    "n_chars": T.LongType(),
    "n_words": T.LongType(),
    "n_lines": T.LongType(),
    "mean_word_length": T.DoubleType(),
    "symbol_share": T.DoubleType(),
    "digit_share": T.DoubleType(),
    "lower_word_share": T.DoubleType(),
    "common_word_share": T.DoubleType(),
    "punctuated_line_share": T.DoubleType(),
    "top_word_share": T.DoubleType(),
    "distinct_word_share": T.DoubleType(),
    "words_per_line": T.DoubleType(),
    "sentence_share": T.DoubleType(),
    "running_share": T.DoubleType(),
}


SPACE, LETTER, DIGIT, SYMBOL = range(4)
_STEP = 0x9E3779B97F4A7C15  # odd, so it has an inverse in 64-bit arithmetic
_BACK = pow(_STEP, -1, 1 << 64)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per code point: its class, whether it is lower case, whether upper or title case, its lower-case form."""
    import unicodedata

    kind, low, high = np.full(0x110000, SYMBOL, np.uint8), np.zeros(0x110000, bool), np.zeros(0x110000, bool)
    fold = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x30000):
        ch = chr(c)
        if ch.isspace():
            kind[c] = SPACE
        elif (group := unicodedata.category(ch)) < "N" and group[0] in "LM":
            kind[c] = LETTER
            low[c], high[c] = ch.islower(), ch.isupper() or ch.istitle()
            if len(small := ch.lower()) == 1:
                fold[c] = ord(small)
        elif group[0] == "N":
            kind[c] = DIGIT
            low[c], high[c] = ch.islower(), ch.isupper()
    return kind, low, high, fold


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    both = []
    for base in (_STEP, _BACK):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        both.append(np.cumprod(p, dtype=np.uint64))
    return both[0], both[1]


def _mixed(h: np.ndarray) -> np.ndarray:
    """A number whose every bit depends on all of ``h``, one to one."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(_STEP)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(_STEP)
    return h ^ (h >> np.uint64(32))


class Words:
    """The words (runs without white space) of some texts as arrays; None counts as an empty text."""

    def __init__(self, texts: list[str | None]):
        texts = [t or "" for t in texts]
        self.size = np.array([len(t) for t in texts], np.int64)
        # a line break behind every text keeps words and lines apart
        self.code = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.begin = np.concatenate([[0], np.cumsum(self.size + 1)])
        kinds, low, high, fold = _tables()
        self.kind = kinds[self.code]
        ink = np.concatenate([[False], self.kind != SPACE])
        edge = np.flatnonzero(ink[1:] != ink[:-1])
        self.start, self.end = edge[0::2], edge[1::2]
        self.length = self.end - self.start
        self.text = np.searchsorted(self.begin, self.start, "right") - 1
        self.line = np.cumsum(self.code == 10)[self.start] if len(self.start) else np.zeros(0, np.int64)
        lows, highs = self.within(low[self.code]), self.within(high[self.code])
        self.lower, self.upper = (lows > 0) & (highs == 0), (highs > 0) & (lows == 0)
        n = 1 << max(4, int(len(self.code)).bit_length())
        power, back = _powers(n)
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(fold[self.code].astype(np.uint64) * power[: len(self.code)], dtype=np.uint64)])
        #: one number of MARK_BITS bits per spelling, whatever its case
        self.mark = _mixed((run[self.end] - run[self.start]) * back[self.start]) >> np.uint64(64 - MARK_BITS)

    def within(self, flag: np.ndarray) -> np.ndarray:
        """How many characters of each word have the flag."""
        run = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
        return run[self.end] - run[self.start]

    def of_texts(self, flag: np.ndarray) -> np.ndarray:
        """How many characters of each text have the flag."""
        run = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
        return run[self.begin[1:] - 1] - run[self.begin[:-1]]

    def spellings(self, take: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, mark, count) of every spelling in every text, in this order."""
        shift = np.uint64(MARK_BITS)
        both = np.sort((self.text[take].astype(np.uint64) << shift) | self.mark[take])
        at = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
        return (both[at] >> shift).astype(np.int64), both[at] & np.uint64((1 << MARK_BITS) - 1), np.diff(np.append(at, len(both)))


def word_marks(words: list[str]) -> np.ndarray:
    """The numbers by which words are known; blanks give none."""
    return np.unique(Words(list(words)).mark)


def _member(marks: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(marks), bool)
    return known[np.minimum(np.searchsorted(known, marks), len(known) - 1)] == marks


def text_stats(texts: list[str | None], common: np.ndarray) -> dict[str, np.ndarray]:
    """Statistics of each text; None counts as an empty one, whose shares are all 0.

    ``common``: sorted word_marks of the common words. A line runs if it has at least
    four words of which a seventh or more are common; ``sentence_share`` is the share of
    the characters that stand in such lines. ``running_share`` asks the same of pieces
    of eight words, whatever the line breaks: one word at least common, half of them in
    lower case or all in capitals, and of ordinary length. ``words_per_line`` is the mean
    over characters, not over lines; ``top_word_share`` the share of the words that
    equal the most frequent one, ``distinct_word_share`` that of different ones. All
    texts are worked on at once, as arrays of characters, words, lines and pieces.
    """
    w = Words(texts)
    n, m = len(w.size), len(w.start)
    out = {k: np.zeros(n) for k in STATS}
    out["n_chars"] = w.size
    ink = np.maximum(1, w.size - w.of_texts(w.kind == SPACE))
    out["symbol_share"], out["digit_share"] = w.of_texts(w.kind == SYMBOL) / ink, w.of_texts(w.kind == DIGIT) / ink
    if not m:
        return out
    count = np.bincount(w.text, minlength=n)
    some = np.maximum(1, count)
    letters = np.bincount(w.text, w.length, n)
    known = _member(w.mark, common)
    out["n_words"] = count
    out["mean_word_length"] = letters / some
    out["lower_word_share"] = np.bincount(w.text, w.lower, n) / some
    out["common_word_share"] = np.bincount(w.text, known, n) / some

    # lines: runs of words with the same line number
    at = np.flatnonzero(np.concatenate([[True], w.line[1:] != w.line[:-1]]))
    last = np.append(at[1:], m) - 1
    per, own = last - at + 1, w.text[at]
    breaks = np.flatnonzero(w.code == 10)
    line = w.line[at]
    chars = (breaks[line] - np.where(line > 0, breaks[line - 1] + 1, 0)).astype(float)
    tail, before = w.code[w.end[last] - 1], w.code[np.maximum(w.end[last] - 2, 0)]
    stop = np.isin(before, [33, 46, 63])
    ended = np.isin(tail, [33, 46, 63, 0x2026]) | (np.isin(tail, [34, 41]) & stop) | ((tail == 39) & (before == 46))
    runs = (per > 3) & (7 * np.add.reduceat(known.astype(np.int64), at) >= per)
    lines, width = np.bincount(own, minlength=n), np.maximum(1, np.bincount(own, chars, n))
    out["n_lines"] = lines
    out["punctuated_line_share"] = np.bincount(own, ended, n) / np.maximum(1, lines)
    out["words_per_line"] = np.bincount(own, chars * per, n) / width
    out["sentence_share"] = np.bincount(own, chars * runs, n) / width

    # pieces: eight words after another, from the start of each text
    place = np.arange(m) - (np.cumsum(count) - count)[w.text]
    at = np.flatnonzero(place % PIECE == 0)
    part, own = np.diff(np.append(at, m)), w.text[at]
    total = lambda x: np.add.reduceat(x.astype(np.int64), at)
    size = total(w.length)
    runs = (part > 3) & (total(known) > 0) & ((2 * total(w.lower) >= part) | (total(w.upper) == part)) & (size <= LONG_WORD * part)
    out["running_share"] = np.bincount(own, size * runs, n) / np.maximum(1, letters)

    t, _, times = w.spellings()
    first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
    often = np.zeros(n, np.int64)
    often[t[first]] = np.maximum.reduceat(times, first)
    out["top_word_share"] = often / some
    out["distinct_word_share"] = np.bincount(t, minlength=n) / some
    return out


def _portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of at most TOGETHER texts (second column) and, but for longer single texts, BYTES bytes."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    s = 0
    while s < batch.num_rows:
        past = upto[s - 1] if s else 0
        e = min(s + TOGETHER, max(s + 1, int(np.searchsorted(upto, past + BYTES, "right"))))
        yield batch.slice(s, e - s)
        s = e


def word_counts(df: DataFrame, text: str, language: str | None = None) -> DataFrame:
    """(language, mark, n): how often each word of small letters alone occurs in the texts of each language.

    One text counts at most PER_TEXT times for a word, so that a text that repeats
    itself does not make a word common. One pass over all texts; equal words of up to
    TOGETHER texts are counted before they leave the task. Languages are compared by their first two letters, in lower
    case; NULL, and every text without ``language``, is a language of its own.
    """
    ship(df.sparkSession)
    name = F.lower(F.substring(F.trim(F.col(f"`{language}`").cast("string")), 1, 2)) if language else F.lit(None).cast("string")
    narrow = df.select(name.alias("language"), F.col(f"`{text}`").cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _portions(batch):
                w = Words(part.column(1).to_pylist())
                plain = w.lower & (w.within(w.kind == LETTER) == w.length)
                enc = part.column(0).dictionary_encode()
                names = enc.indices.fill_null(len(enc.dictionary)).to_numpy(zero_copy_only=False)
                text, mark, n = w.spellings(plain)
                both, place = np.unique((names[text].astype(np.uint64) << np.uint64(MARK_BITS)) | mark, return_inverse=True)
                own = pa.array([*enc.dictionary.to_pylist(), None], pa.string()).take(pa.array((both >> np.uint64(MARK_BITS)).astype(np.int64)))
                mark = (both & np.uint64((1 << MARK_BITS) - 1)).astype(np.int64)
                n = np.bincount(place, np.minimum(n, PER_TEXT), len(both)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([own, pa.array(mark), pa.array(n)], names=["language", "mark", "n"])

    parts = narrow.mapInArrow(run, "language string, mark bigint, n bigint")
    return parts.groupBy("language", "mark").agg(F.sum("n").alias("n"))


def common_words(df: DataFrame, text: str, language: str | None = None, top: int = TOP_WORDS, least_share: float = 0.005) -> np.ndarray:
    """Sorted marks of the common words, learned from all texts: the ``top`` most frequent words of
    every language that holds ``least_share`` of all words (ties: the smaller mark).

    At most ``top / least_share`` numbers reach the driver. No texts, no common words.
    """
    counts = checkpointed(word_counts(df, text, language))
    totals = counts.groupBy("language").agg(F.sum("n").alias("total"))
    every = totals.agg(F.sum("total")).first()[0] or 0
    large = totals.where(F.col("total") >= least_share * every).select("language")
    # ranked first within 64 shares of a language, so that its words never meet in one task
    share = Window.partitionBy("language", F.pmod("mark", F.lit(64))).orderBy(F.desc("n"), "mark")
    some = counts.join(F.broadcast(large.withColumnRenamed("language", "__l")), F.col("language").eqNullSafe(F.col("__l"))).withColumn("r", F.row_number().over(share)).where(F.col("r") <= top)
    best = some.withColumn("r", F.row_number().over(Window.partitionBy("language").orderBy(F.desc("n"), "mark"))).where(F.col("r") <= top)
    return np.unique(np.array([r.mark for r in best.select("mark").collect()], np.int64).astype(np.uint64))


def document_stats(df: DataFrame, key: str, text: str, common: np.ndarray) -> DataFrame:
    """``key`` and the STATS of ``text``: a narrow map over whole texts, no shuffle.

    ``common``: marks of the common words, from common_words or word_marks. NULL and
    empty texts have counts and shares of 0; repeated rows stay; other columns are not read.
    """
    ship(df.sparkSession)
    narrow = df.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string").alias("__text"))
    schema = T.StructType([df.schema[key], *[T.StructField(k, t) for k, t in STATS.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _portions(batch):
                stats = text_stats(part.column(1).to_pylist(), common)
                cols = [pa.array(stats[k].astype(np.int64 if t == T.LongType() else np.float64)) for k, t in STATS.items()]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=schema.names)

    return narrow.mapInArrow(run, schema)


@dataclass(frozen=True)
class Vote:
    """A labelling function: junk or prose beyond a threshold of one statistic, no vote between."""

    stat: str
    junk_below: float | None = None
    junk_above: float | None = None
    prose_above: float | None = None

    def column(self) -> Column:
        """1 junk, 2 prose, 0 no vote."""
        c = F.col(self.stat)
        v = F.lit(0)
        if self.prose_above is not None:
            v = F.when(c >= self.prose_above, 2).otherwise(v)
        if self.junk_above is not None:
            v = F.when(c > self.junk_above, 1).otherwise(v)
        if self.junk_below is not None:
            v = F.when(c < self.junk_below, 1).otherwise(v)
        return v


#: Two look at common words, once along lines and once along words; the others at layout, case, characters and repetition.
VOTES = (
    Vote("sentence_share", junk_below=0.5, prose_above=0.5),
    Vote("running_share", junk_below=0.4, prose_above=0.55),
    Vote("words_per_line", junk_below=3.0, prose_above=12.0),
    Vote("punctuated_line_share", prose_above=0.6),
    Vote("lower_word_share", junk_below=0.25, prose_above=0.7),
    Vote("symbol_share", junk_above=0.3),
    Vote("digit_share", junk_above=0.2),
    Vote("mean_word_length", junk_below=2.0, junk_above=14.0),
    Vote("top_word_share", junk_above=0.35),
)


def learn_votes(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, tolerance: float = 1e-9) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior junk probability of each vote pattern, the votes' accuracies, and the junk share.

    Expectation-maximization of a two-class model in which every labelling function
    votes junk, prose or not at all with unknown probabilities per class, independent
    given the class. It starts from the majority of the votes. A pattern without any
    vote gets the prior. ``patterns``: patterns x functions, values 0, 1, 2.
    """
    junk, prose = (patterns == 1).sum(axis=1), (patterns == 2).sum(axis=1)
    post = np.clip((junk + 0.5) / (junk + prose + 1.0), 0.01, 0.99)
    onehot = np.stack([patterns == v for v in range(3)], axis=2).astype(float)
    for _ in range(rounds):
        weight = np.stack([post * counts, (1 - post) * counts])
        share = weight.sum(axis=1) + 1.0
        # one pseudo-count per value keeps every probability positive
        table = (np.einsum("cp,pfv->cfv", weight, onehot) + 1.0) / (weight.sum(axis=1)[:, None, None] + 3.0)
        log = np.einsum("pfv,cfv->pc", onehot, np.log(table)) + np.log(share / share.sum())
        new = 1.0 / (1.0 + np.exp(np.clip(log[:, 1] - log[:, 0], -700, 700)))
        moved = float(np.abs(new - post).max())
        post = new
        if moved < tolerance:
            break
    right = np.where(patterns == 1, post[:, None], 1 - post[:, None]) * (patterns > 0) * counts[:, None]
    cast = ((patterns > 0) * counts[:, None]).sum(axis=0)
    return post, right.sum(axis=0) / np.maximum(cast, 1), float((post * counts).sum() / counts.sum())


def _coded(stats: DataFrame, votes: tuple[Vote, ...]) -> DataFrame:
    code = F.lit(0)
    for v in votes:
        code = code * 3 + v.column()
    return stats.withColumn("__votes", code.cast("int"))


def _patterns(coded: DataFrame, m: int) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Vote patterns and their counts: at most 3**m rows reach the driver, however many documents."""
    rows = coded.groupBy("__votes").agg(F.count(F.lit(1)).alias("n")).orderBy("__votes").collect()
    codes = [r["__votes"] for r in rows]
    patterns = np.array([[c // 3 ** (m - 1 - j) % 3 for j in range(m)] for c in codes], np.int64).reshape(len(codes), m)
    return codes, patterns, np.array([r.n for r in rows], float)


def text_types(stats: DataFrame, votes: tuple[Vote, ...] = VOTES) -> DataFrame:
    """``stats`` with ``junk_probability`` and ``text_type`` ('prose' or 'other').

    Thresholds of the statistics are taken as noisy votes; their accuracies are
    learned from how they agree over all documents (learn_votes), and every
    document gets the posterior of its votes. An empty text is 'other' by
    definition. Empty input, no rows.
    """
    if len(votes) > 12:
        raise ValueError("at most 12 votes: the table of patterns must stay small")
    coded = _coded(stats, votes)
    codes, patterns, counts = _patterns(coded, len(votes))
    if not codes:
        return coded.drop("__votes").withColumns({"junk_probability": F.lit(0.0), "text_type": F.lit("")}).limit(0)
    post, _, _ = learn_votes(patterns, counts)
    table = stats.sparkSession.createDataFrame([(c, float(p)) for c, p in zip(codes, post)], "__votes int, junk_probability double")
    out = coded.join(F.broadcast(table), "__votes").drop("__votes")  # at most 3**12 rows of two numbers
    return out.withColumn("text_type", F.when((F.col("n_words") == 0) | (F.col("junk_probability") > 0.5), "other").otherwise("prose"))


def vote_report(stats: DataFrame, votes: tuple[Vote, ...] = VOTES) -> DataFrame:
    """(stat, votes_cast, accuracy): how often each labelling function votes and its learned accuracy."""
    _, patterns, counts = _patterns(_coded(stats, votes), len(votes))
    spark = stats.sparkSession
    if not len(counts):
        return spark.createDataFrame([], "stat string, votes_cast bigint, accuracy double")
    _, accuracy, _ = learn_votes(patterns, counts)
    cast = ((patterns > 0) * counts[:, None]).sum(axis=0)
    return spark.createDataFrame([(v.stat, int(n), float(a)) for v, n, a in zip(votes, cast, accuracy)], "stat string, votes_cast bigint, accuracy double")
