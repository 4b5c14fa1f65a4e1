"""Benchmark decontamination by MinHash containment.

A test item is short and a document may be long, so their similarity is small even where the document
holds the whole item; what counts is containment, the share of the item's shingles that the document
has. Shingles are five words (an item with fewer words is one shingle of all its words); words are runs of letters and
digits in lower case.

Items are partitioned by size. In each partition an item is sketched by the minima of `n_hashes` hash functions over its
shingles; a minimum is a shingle drawn at random, so the share of minima that a document holds estimates
containment. A partition is searched only by documents with enough shingles to contain its items. Items with no
more shingles than hash functions are sketched by all of them. A document is a candidate if it has at
least `n_hashes / 5` of the minima: at containment 0.8 fewer than 4 of 20 come up with a probability under 1e-9. Candidates are
then verified by comparing the shingles themselves.

Items are the stated query set: they are read in blocks of at most `block_bytes` of text, each block is given to
all tasks and met with all documents in a pass without a shuffle. The number of passes grows with the benchmark, memory does not.

Defined results: a NULL or empty text has no shingles and is neither contained nor contains anything; repeated documents and items are reported as
often as they occur; ties cannot arise, all items at or over the threshold are reported; an empty table on either side
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import re
import sys
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORD = re.compile(r"[^\W_]+")
SHINGLE = 5
MASK = (1 << 64) - 1


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of splitmix64)."""
    x = values.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(ids: np.ndarray, length: int) -> np.ndarray:
    """Hash of the `length` word numbers from each position on; 0 where a word is unknown (-1)."""
    n = len(ids) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    code = np.zeros(n, np.uint64)
    known = np.ones(n, bool)
    for k in range(length):
        part = ids[k : k + n]
        known &= part >= 0
        code = mixed(code * np.uint64(31) + part.astype(np.uint64) + np.uint64(1))
    return np.where(known, code | np.uint64(1), np.uint64(0))


class Sketches:
    """The minima of a block of items, by shingle length and size partition."""

    def __init__(self, items: list[tuple[int, str]], n_hashes: int, threshold: float):
        self.n_hashes, self.threshold = n_hashes, threshold
        self.numbers: dict[str, int] = {}
        self.ids: list[int] = []
        self.tuples: list[set[tuple[str, ...]]] = []
        owners: dict[tuple[int, int], dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        self.n_minima: list[int] = []
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            length = min(SHINGLE, len(words))
            number = len(self.ids)
            self.ids.append(item_id)
            self.tuples.append(set(zip(*(words[k:] for k in range(length)))))
            numbers = np.array([self.numbers.setdefault(w, len(self.numbers)) for w in words], np.int64)
            minima = self.minima(np.unique(shingle_hashes(numbers, length)))
            self.n_minima.append(len(minima))
            size_class = len(self.tuples[-1]).bit_length()
            for value in minima.tolist():
                owners[length, size_class][value].append(number)
        self.partitions = []
        for (length, size_class), table in sorted(owners.items()):
            values = np.array(sorted(table), np.uint64)
            least = int(np.ceil(threshold * 2 ** (size_class - 1)))
            self.partitions.append((length, least, values, [table[v] for v in values.tolist()]))

    def minima(self, hashes: np.ndarray) -> np.ndarray:
        """Distinct minima over the hash functions, or all hashes if there are no more than functions."""
        if len(hashes) <= self.n_hashes:
            return hashes
        chosen = [hashes[np.argmin(mixed(hashes ^ np.uint64((f + 1) * 0x9E3779B97F4A7C15 & MASK)))] for f in range(self.n_hashes)]
        return np.unique(np.array(chosen, np.uint64))

    def search(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item number, shared shingles, shingles of the item) of all items that the text contains."""
        words = words_of(text)
        if not words:
            return []
        get = self.numbers.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        hashed: dict[int, np.ndarray] = {}
        found = []
        for length, least, values, owners in self.partitions:
            if len(words) - length + 1 < least:
                continue
            if length not in hashed:
                codes = shingle_hashes(ids, length)
                hashed[length] = codes[codes > 0]
            codes = hashed[length]
            place = np.searchsorted(values, codes)
            hit = np.unique(place[(place < len(values)) & (values[np.minimum(place, len(values) - 1)] == codes)])
            counts = Counter(number for at in hit.tolist() for number in owners[at])
            for number, n in sorted(counts.items()):
                if n >= min(self.n_minima[number], self.n_hashes) * self.threshold / 4:
                    found.append((number, length))
        out = []
        own: dict[int, set[tuple[str, ...]]] = {}
        for number, length in found:
            if length not in own:
                own[length] = set(zip(*(words[k:] for k in range(length))))
            wanted = self.tuples[number]
            shared = len(wanted & own[length])
            if shared >= self.threshold * len(wanted):
                out.append((number, shared, len(wanted)))
        return out


def blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most `block_bytes` of text, at least one item each."""
    block: list[tuple[int, str]] = []
    size = 0
    rows = benchmark.select(F.col(item_id).alias("i"), F.col(text).alias("t")).where("t IS NOT NULL").orderBy("i", "t")
    for row in rows.toLocalIterator():
        if block and size + len(row["t"]) > block_bytes:
            yield block
            block, size = [], 0
        block.append((row["i"], row["t"]))
        size += len(row["t"])
    if block:
        yield block


def contained_items(
    docs: DataFrame,
    benchmark: DataFrame,
    threshold: float = 0.8,
    n_hashes: int = 20,
    block_bytes: int = 16 << 20,
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """One row per document and item contained in it: `doc_id`, `item_id`, `n_shared`, `n_shingles`, `containment`.

    `docs` has `doc_id` and `text`.
    """
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    item_kind = benchmark.schema[item_id].dataType.simpleString()
    schema = f"doc_id {id_kind}, item_id {item_kind}, n_shared long, n_shingles long, containment double"
    chosen = docs.select("doc_id", "text")

    def search(it: Iterator[pa.RecordBatch], items: list[tuple[int, str]]) -> Iterator[pa.RecordBatch]:
        sketches = Sketches(items, n_hashes, threshold)
        for batch in it:
            rows: list[int] = []
            hits: list[tuple[int, int, int]] = []
            for at, text in enumerate(batch.column(1)):
                for hit in sketches.search(text.as_py()):
                    rows.append(at)
                    hits.append(hit)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    pa.array([sketches.ids[n] for n, _, _ in hits], kinds[1].type),
                    pa.array([s for _, s, _ in hits], pa.int64()),
                    pa.array([n for _, _, n in hits], pa.int64()),
                    pa.array([s / n for _, s, n in hits], pa.float64()),
                ],
                names=names,
            )

    from pyspark.sql.pandas.types import to_arrow_schema

    empty = docs.sparkSession.createDataFrame([], schema)
    kinds = to_arrow_schema(empty.schema)
    names = kinds.names
    kinds = [kinds.field(i) for i in range(len(names))]
    found = [
        chosen.mapInArrow(functools.partial(search, items=block), schema)
        for block in blocks(benchmark, item_id, item_text, block_bytes)
    ]
    return functools.reduce(DataFrame.unionByName, found, empty) if found else empty


def without_items(
    docs: DataFrame,
    benchmark: DataFrame,
    threshold: float = 0.8,
    n_hashes: int = 20,
    block_bytes: int = 16 << 20,
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """The rows of `docs` that contain no test item, as they are; narrow steps, one per block of items."""
    at = docs.columns.index("text")
    rows = docs.select(F.struct("*").alias("row"))

    def drop(it: Iterator[pa.RecordBatch], items: list[tuple[int, str]]) -> Iterator[pa.RecordBatch]:
        sketches = Sketches(items, n_hashes, threshold)
        for batch in it:
            clean = [not sketches.search(t.as_py()) for t in batch.column(0).field(at)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    for block in blocks(benchmark, item_id, item_text, block_bytes):
        rows = rows.mapInArrow(functools.partial(drop, items=block), rows.schema)
    return rows.select("row.*")
