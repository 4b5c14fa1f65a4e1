"""Quality rules as weak supervision.

Each rule looks at a document and votes good (1), bad (-1) or abstains (0). Nobody trusts a single
rule: expectation-maximisation over the votes of all documents estimates how often each rule
votes and what it votes, given a good and given a bad document, and a document is kept if the posterior
probability that it is good reaches a threshold. A document that only one doubtful rule dislikes stays.

Documents with equal votes are alike to the model, so the statistics it needs are the numbers of documents per
vote pattern, counted over all documents in one aggregation. With nine rules there are at most 3^9
patterns, however large the corpus; only they reach the driver.

Defined results: a NULL text counts as empty, has no words and fails the base rules; repeated rows are judged alike; an empty table
gives an empty result; other columns of the input are ignored. A text is read whole, however long.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SYMBOLS = "#*$%&|<>"
BLANK = "\t\n\x0b\x0c\r "

MEASURES = (
    "word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_words long, n_upper long, "
    "n_letters long, n_digits long, n_marked long, n_distinct long, n_lines long, n_word_lines long, n_ends long"
)
NAMES = [m.split()[0] for m in MEASURES.split(", ")]


def repeated_words(words: list[bytes]) -> tuple[int, int]:
    """Words inside three-word windows that occur twice or more, and the number of distinct words."""
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    if len(ids) < 4:
        return 0, len(numbers)
    base = len(numbers)
    _, pairs = np.unique(ids[:-1] * base + ids[1:], return_inverse=True)
    triples = pairs[:-1] * base + ids[2:]
    _, place, counts = np.unique(triples, return_inverse=True, return_counts=True)
    twice = counts[place] >= 2
    covered = np.zeros(len(ids) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(covered, starts, 1)
    np.add.at(covered, np.minimum(starts + 3, len(ids)), -1)
    return int((np.cumsum(covered)[:-1] > 0).sum()), base


def measure(text: str | None) -> tuple[int, ...]:
    """The counts in `NAMES` for one text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # on bytes: the ASCII white space only
    word_chars = len(text) - sum(text.count(c) for c in BLANK)
    repeats, distinct = repeated_words(words)
    seen: set[str] = set()
    dup_lines = word_lines = ends = 0
    lines = text.split("\n")
    for line in lines:
        bare = line.strip(BLANK)
        if bare:
            word_lines += 1
            dup_lines += line in seen
            ends += bare[-1] in ".!?:\"'"
        seen.add(line)
    letters = len(LETTER.sub("", text)) if not text.isascii() else len(raw) - len(raw.translate(None, ASCII_LETTERS))
    upper = len(raw) - len(raw.translate(None, ASCII_UPPER)) + (0 if text.isascii() else len(OTHER_UPPER.findall(text)))
    digits = len(raw) - len(raw.translate(None, b"0123456789"))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS.encode()))
    marked = sum(w[-1] in MARKS for w in words)
    return (
        word_chars, symbols, dup_lines, repeats, len(words), upper,
        letters, digits, marked, distinct, len(lines), word_lines, ends,
    )


ASCII_UPPER = bytes(range(65, 91))
ASCII_LETTERS = ASCII_UPPER + bytes(range(97, 123))
LETTER = re.compile(r"[\W\d_]+")
#: Capital letters of the Latin alphabets beyond ASCII.
OTHER_UPPER = re.compile("[À-ÖØ-Þ]")
MARKS = b"#*$%&|<>!"


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs` as a struct `row`, and the columns of `MEASURES`; a narrow step without a shuffle."""
    at = docs.columns.index(text)
    row = docs.select(F.struct("*").alias("row"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = [measure(t.as_py()) for t in batch.column(0).field(at)]
            counts = np.array(rows, np.int64).reshape(len(rows), len(NAMES))
            columns = [batch.column(0), *(pa.array(counts[:, k]) for k in range(len(NAMES)))]
            yield pa.RecordBatch.from_arrays(columns, ["row", *NAMES])

    counts = T.StructType([T.StructField(n, T.LongType()) for n in NAMES])
    return row.mapInArrow(batches, T.StructType([*row.schema.fields, *counts.fields]))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def votes() -> list[Column]:
    """The rules. Each compares one share of the text with two bounds and abstains between them."""
    share = lambda part, whole: F.col(part) / F.greatest(F.col(whole), F.lit(1))
    symbols = share("n_symbols", "n_words")
    upper = share("n_upper", "n_letters")
    letters = share("n_letters", "word_chars")
    marked = share("n_marked", "n_words")
    repeats = share("n_repeat_words", "n_words")
    dup_lines = share("n_dup_lines", "n_word_lines")
    length = share("word_chars", "n_words")
    ends = share("n_ends", "n_word_lines")
    return [
        vote(symbols > 0.3, symbols < 0.05),
        vote(upper > 0.4, upper < 0.12),
        vote(letters < 0.8, letters > 0.93),
        vote(marked > 0.35, marked < 0.05),
        vote(repeats > 0.3, repeats < 0.08),
        vote(dup_lines > 0.4, (dup_lines < 0.05) & (F.col("n_word_lines") >= 3)),
        vote((length < 2.5) | (length > 12), (length >= 3.5) & (length <= 9)),
        vote((ends < 0.3) & (F.col("n_word_lines") >= 3), ends > 0.8),
        vote(F.col("n_words") < 60, F.col("n_words") >= 100),
    ]


def fit_votes(patterns: np.ndarray, counts: np.ndarray, steps: int = 200, tolerance: float = 1e-8) -> np.ndarray:
    """Posterior probability of a good document for each vote pattern.

    A mixture of two classes in which the rules are independent; each rule has its own probabilities of
    -1, 0 and 1 in each class. It starts from the majority of votes, which also fixes which class is the good one.
    One document's worth of even votes is added to every count, so that no probability is 0.
    """
    total = patterns.sum(axis=1)
    good = 1 / (1 + np.exp(-1.5 * total.astype(float)))
    weight = counts.astype(float)
    for _ in range(steps):
        sides = np.stack([1 - good, good], axis=1) * weight[:, None]
        prior = np.log((sides.sum(axis=0) + 1) / (weight.sum() + 2))
        seen = np.stack([(patterns == v).T.astype(float) @ sides for v in (-1, 0, 1)], axis=2)
        chance = np.log((seen + 1 / 3) / (seen.sum(axis=2, keepdims=True) + 1))
        scores = np.repeat(prior[None, :], len(patterns), axis=0)
        for rule in range(patterns.shape[1]):
            scores += chance[rule].T[patterns[:, rule] + 1]
        new = 1 / (1 + np.exp(np.clip(scores[:, 0] - scores[:, 1], -700, 700)))
        change = np.abs(new - good).max(initial=0.0)
        good = new
        if change < tolerance:
            break
    return good


def vote_pattern() -> Column:
    """All votes as one number in base 3."""
    return sum(((v + 1) * 3**k for k, v in enumerate(votes())), F.lit(0)).cast("int")


def pattern_quality(measures: DataFrame) -> DataFrame:
    """`pattern`, `quality`: at most 3^rules rows of twelve bytes, fitted to the votes of all documents."""
    table = measures.groupBy(vote_pattern().alias("pattern")).agg(F.count(F.lit(1)).alias("n")).toPandas()
    codes = table["pattern"].to_numpy(np.int64)
    patterns = codes[:, None] // 3 ** np.arange(len(votes())) % 3 - 1
    quality = fit_votes(patterns, table["n"].to_numpy(np.int64))
    rows = pd.DataFrame({"pattern": codes.astype(np.int32), "quality": quality})
    return measures.sparkSession.createDataFrame(rows, "pattern int, quality double")


def judge(measures: DataFrame, known: DataFrame, threshold: float = 0.5) -> DataFrame:
    """`measures` with `base_failed`, `quality` (the posterior of its votes in `known`) and `kept`."""
    voted = measures.withColumn("pattern", vote_pattern()).withColumn("base_failed", base_failed())
    kept = ~F.col("base_failed") & (F.col("quality") >= threshold)
    return voted.join(F.broadcast(known), "pattern").drop("pattern").withColumn("kept", kept)


def kept_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs` that are kept, as they are.

    Texts are measured twice, once to fit the rules and once to apply them, which costs less than moving or storing them.
    """
    measures = measured(docs, text)
    return judge(measures, pattern_quality(measures)).where("kept").select("row.*")
