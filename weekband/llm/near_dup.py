"""Near-duplicate documents by Order MinHash.

Words are runs of ASCII letters and digits and of all signs beyond ASCII, in lower case; a k-mer is five words with
the number of its occurrence in the text (a text of fewer words is one k-mer). An Order MinHash value takes the two smallest k-mers under a hash function and
keeps them in the order of the text, so it agrees with a probability near that of a small edit distance rather than of shared
vocabulary. Two texts are linked if a banded alignment of their k-mer sequences leaves at least 0.8 of all k-mers aligned
(aligned / (all of both - aligned)). Classes are the connected components.

* 64 values per text form 32 bands of two. At similarity 0.8 two texts share no band with a probability under 1e-6.
* Equal texts are one node from the start, so copies cost nothing later.
* In a bucket nobody is compared with everybody. A leader, the member with the largest buckets, is compared with all
  other members, and what is linked becomes a component.
* Where a bucket still has more than one component, which happens among texts that share a frequent passage, its texts go on to an exact search by
  prefix filter: two similar texts share one of the rarest fifth of their k-mers, whatever order of rarity is used. The order is by
  counts over all these texts, kept in a table of bytes of fixed size. There leaders, in
  more slices each round, are compared with all members of other components. Only a leader leaves the bucket after that, never
  what is linked to it, until one component is left: every pair of a bucket is linked, compared, or ruled out by sizes and places.
* Among leaders of bands a pair reaches the alignment only if at least 22 of its 64 values agree (at 0.8 fewer agree with a probability near
  1e-5); what this loses leaves the bucket mixed, and the exact search has no such bound.
* Components come from smallest labels with pointer jumping. Tables between rounds lie in the shared folder.

Defined results: a NULL text counts as empty; texts without words form classes of equal texts only; a class is named by
its smallest `doc_id` (NULL if it has no other); repeated rows are copies; an empty table gives an empty result; other columns are ignored. Texts are
read whole.
"""

from __future__ import annotations

import functools
import sys
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weekband.llm.common import doc_key, materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

K = 5
BANDS = 32
VALUES = 2 * BANDS
MIN_AGREE = 22
#: Leaders per bucket in the first round of the exact search; each later round has this many times more.
SLICES = 64
#: Counts of k-mers, by which the exact search orders them, go into so many places (one byte each, for any corpus), in so many parts.
#: K-mers that share a place, and counts over 255, only make the order less fine; no result rests on it.
COUNT_BITS, PART_BITS = 24, 6
#: K-mers that a task counts together.
COUNTED_TOGETHER = 1 << 21
PREFIX = "bucket long, key binary, n long, place long"
CACHE_WORDS = 500_000
#: ASCII signs that are neither letters nor digits become spaces.
ONLY_WORDS = bytes(
    b if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of splitmix64)."""
    x = values.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hash per word, remembered."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def kmers(text: str | None, memo: WordHashes) -> np.ndarray:
    """Hash of the k-mer at every position."""
    words = (text or "").lower().encode("utf-8", "replace").translate(ONLY_WORDS).split()
    hashes = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    n = max(len(words) - K + 1, min(len(words), 1))
    code = np.zeros(n, np.uint64)
    for k in range(min(K, len(words))):
        code = mixed(code * np.uint64(31) + hashes[k : k + n])
    return code


def labelled(code: np.ndarray) -> np.ndarray:
    """K-mers told apart by the number of their occurrence."""
    order = np.argsort(code, kind="stable")
    ordered = code[order]
    heads = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    if heads.all():
        return mixed(code)
    starts = np.flatnonzero(heads)
    number = np.arange(len(code)) - np.repeat(starts, np.diff(np.append(starts, len(code))))
    out = np.empty_like(code)
    out[order] = ordered + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mixed(out)


class OrderMinHash:
    """Sketch of a text: 64 Order MinHash values of 32 bits, as 32 bands of two."""

    def __init__(self, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.factor = (draw.integers(0, 1 << 63, VALUES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
        self.shift = draw.integers(0, 1 << 63, VALUES, dtype=np.uint64)

    def smallest(self, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the two smallest labels under every hash function, ties by position."""
        rows = np.arange(VALUES)
        best: list[np.ndarray] = []
        value: list[np.ndarray] = []
        # Columns in blocks that stay in the processor's cache.
        for at in range(0, len(labels), 2048):
            part = labels[at : at + 2048]
            table = part[None, :] * self.factor[:, None] + self.shift[:, None]
            for _ in range(min(2, len(part))):
                place = table.argmin(axis=1)
                best.append(place + at)
                value.append(table[rows, place].copy())
                table[rows, place] = np.uint64(0xFFFFFFFFFFFFFFFF)
        order = np.argsort(np.stack(value), axis=0, kind="stable")
        places = np.take_along_axis(np.stack(best), order, axis=0)
        return places[0], places[min(1, len(places) - 1)]

    def sketch(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bands, and the last byte of every value."""
        labels = labelled(code)
        one, two = self.smallest(labels)
        early, late = labels[np.minimum(one, two)], labels[np.maximum(one, two)]
        value = mixed(early * np.uint64(31) + mixed(late)) >> np.uint64(32)
        marks = (value & np.uint64(255)).astype(np.uint8).view(np.int8)
        return ((value[0::2] << np.uint64(32)) | value[1::2]).view(np.int64), marks


def sketches(docs: DataFrame) -> DataFrame:
    """`doc_id`, `key` (digest of the text), `n` k-mers, `bands` and `marks` (both empty without words); a narrow step."""
    keyed = docs.select("doc_id", text_key(F.col("text")).alias("key"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def lists(parts: list[np.ndarray], dtype: type) -> pa.ListArray:
        ends = np.cumsum([0, *(len(p) for p in parts)])
        values = np.concatenate(parts) if parts else np.zeros(0, dtype)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, tool = WordHashes(), OrderMinHash()
        nothing = np.zeros(0, np.int64), np.zeros(0, np.int8)
        for batch in it:
            codes = (kmers(text.as_py(), memo) for text in batch.column(2))
            found = [(len(code), *(tool.sketch(code) if len(code) else nothing)) for code in codes]
            sizes = pa.array([f[0] for f in found], pa.int64())
            bands, marks = lists([f[1] for f in found], np.int64), lists([f[2] for f in found], np.int8)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), sizes, bands, marks], ["doc_id", "key", "n", "bands", "marks"]
            )

    return keyed.mapInArrow(batches, f"doc_id {kind}, key binary, n long, bands array<long>, marks array<tinyint>")


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def aligned(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Length of the longest common subsequence of two sequences among matches at most `band` off the diagonal.

    Row by row with a window of the bit-parallel recurrence, which moves along the diagonal.
    """
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b, n = a[head:], b[head:], n - head
    differ = np.flatnonzero(a[::-1][:n] != b[::-1][:n])
    tail = int(differ[0]) if len(differ) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return head + tail
    places: dict[int, list[int]] = defaultdict(list)
    for j, symbol in enumerate(b.tolist()):
        places[symbol].append(j)
    width = 2 * band + 1
    full = (1 << width) - 1
    top = 1 << (width - 1)
    row, zeros = full, 0
    for i, symbol in enumerate(a.tolist()):
        low = i - band
        match = 0
        for j in places.get(symbol, ()):
            if low <= j <= i + band:
                match |= 1 << (j - low)
        if match:
            hit = row & match
            row = ((row + hit) | (row - hit)) & full
        zeros += not row & 1
        row = row >> 1 | top
    return head + tail + zeros + (width - row.bit_count())


def shared_kmers(a: np.ndarray, b: np.ndarray) -> int:
    """Number of k-mers two texts have in common, wherever they stand; no alignment has more."""
    return len(np.intersect1d(labelled(a), labelled(b), assume_unique=True))


def similarity(a: np.ndarray, b: np.ndarray, threshold: float) -> float:
    """Aligned share of all k-mers; 0 where the sizes alone rule the threshold out."""
    total, small = len(a) + len(b), min(len(a), len(b))
    if not small or small < threshold * max(len(a), len(b)):
        return 0.0
    if shared_kmers(a, b) < threshold / (1 + threshold) * total - 1e-9:
        return 0.0
    # A pair over the threshold leaves at most this many k-mers out, so its alignment stays in the band.
    band = int(total * (1 - threshold) / (1 + threshold)) + 1
    common = aligned(a, b, band)
    return common / (total - common)


def verified(pairs: DataFrame, threshold: float) -> DataFrame:
    """`a`, `b` of the pairs (with `a_text`, `b_text`) that are similar enough."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        last: tuple[bytes, np.ndarray] | None = None
        for batch in it:
            keep = []
            for a_text, b_key, b_text in zip(batch.column(2), batch.column(1), batch.column(3)):
                name = b_key.as_py()
                if last is None or last[0] != name:
                    last = (name, kmers(b_text.as_py(), memo))
                keep.append(similarity(kmers(a_text.as_py(), memo), last[1], threshold) >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "a_text", "b_text").mapInArrow(batches, "a binary, b binary")


def agreement(a: Column, b: Column) -> Column:
    """Number of values of two sketches whose last bytes are equal; values that differ add a quarter on average."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """`key`, `label`: the smallest key of the component, for all ends of `edges` (`a`, `b`)."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("key"), F.least("a", "m").alias("label")))
    for _ in range(max_rounds):
        seen = both.join(labels.select(F.col("key").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("m"))
        lower = labels.join(seen.withColumnRenamed("a", "key"), "key", "left").select(
            "key", F.col("label").alias("old"), F.least("label", F.coalesce("m", F.col("label"))).alias("label")
        )
        roots = labels.select(F.col("key").alias("label"), F.col("label").alias("root"))
        moved = materialize(
            lower.join(roots, "label", "left").select("key", "old", F.least("label", F.coalesce("root", F.col("label"))).alias("label"))
        )
        labels = moved.select("key", "label")
        if moved.where("label <> old").isEmpty():
            return labels
    raise RuntimeError("components did not settle")


def links(docs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """`key`, `label`: components of similar keys of `nodes` (`key`, `doc_id`, `n`, `bands`, `marks`), for keys that are linked."""
    spread = nodes.select("key", F.posexplode("bands").alias("band", "value")).select(
        "key", F.xxhash64("band", "value").alias("bucket")
    )
    crowded = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = materialize(spread.join(crowded, "bucket"))
    score = members.groupBy("key").agg(F.sum("size").alias("score"))
    wanted = materialize(score.join(nodes.drop("bands"), "key"))
    # Grouping uses the partitions and the order of the join, so texts move once.
    own = docs.select("text", doc_key(F.col("doc_id")).alias("id"), text_key(F.col("text")).alias("key"))
    texts = materialize(
        own.join(wanted.select(doc_key(F.col("doc_id")).alias("id"), "key"), ["id", "key"])
        .groupBy("id", "key")
        .agg(F.first("text").alias("text"))
        .select("key", "text")
    )
    sketch, scores = wanted.select("key", "n", "marks"), wanted.select("key", "score")
    empty = docs.sparkSession.createDataFrame([], "a binary, b binary")

    _, tested, found = compare(members.select("bucket", "key").join(scores, "key"), 1, 0, empty, sketch, texts, threshold)
    labels = components(found)
    named = members.select("bucket", "key").join(labels, "key", "left").withColumn("label", F.coalesce("label", F.col("key")))
    mixed_up = named.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    doubtful = materialize(members.join(mixed_up, "bucket", "left_semi").select("key").distinct())
    if doubtful.isEmpty():
        return labels
    rare = prefixes(materialize(doubtful.join(texts, "key")), threshold)
    pending = materialize(unsettled(rare.join(scores, "key"), labels))
    slices, at = SLICES, 1
    while not pending.isEmpty():
        leaders, likely, new = compare_rest(pending, slices, at, tested, texts, threshold)
        tested = tested.unionByName(likely)
        if not new.isEmpty():
            found = found.unionByName(new)
            labels = components(found)
        pending = materialize(unsettled(pending, labels, leaders))
        slices, at = slices * SLICES, at + 1
    return labels


def first_of_slices(members: DataFrame, slices: int, at: int) -> DataFrame:
    """`bucket`, `leader`: in each slice of each bucket the member with the best score."""
    part = F.pmod(F.xxhash64("key", F.lit(at)), F.lit(slices))
    best = members.groupBy("bucket", part.alias("part")).agg(F.max(F.struct("score", "key")).alias("top"))
    return materialize(best.select("bucket", F.col("top.key").alias("leader")))


def tested_now(met: DataFrame, tested: DataFrame, texts: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The pairs (`a`, `b`) of `met` (`key`, `leader`) not tested before, and those of them that are linked."""
    pairs = met.select(F.greatest("key", "leader").alias("a"), F.least("key", "leader").alias("b")).distinct()
    likely = materialize(pairs.join(tested, ["a", "b"], "left_anti"))
    both = likely.join(texts.withColumnsRenamed({"key": "a", "text": "a_text"}), "a").join(
        texts.withColumnsRenamed({"key": "b", "text": "b_text"}), "b"
    )
    return likely, materialize(verified(both, threshold))


def compare(
    members: DataFrame, slices: int, at: int, tested: DataFrame, sketch: DataFrame, texts: DataFrame, threshold: float
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The leaders (`bucket`, `leader`), the likely pairs (`a`, `b`) not tested before, and those that are linked.

    `members` has `bucket`, `key`, `score`. Each slice of a bucket has one leader, by score, and every member meets every
    leader of its bucket. Sizes too different, or too few equal values of the sketch (`n`, `marks`), end a pair in
    the join itself.
    """
    leaders = first_of_slices(members, slices, at)
    own = members.select("bucket", "key").join(sketch, "key")
    lead = leaders.withColumnRenamed("bucket", "l_bucket").join(
        sketch.withColumnsRenamed({"key": "leader", "n": "l_n", "marks": "l_marks"}), "leader"
    )
    near = F.least("n", "l_n") >= F.lit(threshold) * F.greatest("n", "l_n")
    alike = agreement(F.col("marks"), F.col("l_marks")) >= MIN_AGREE
    met = own.join(lead, (F.col("bucket") == F.col("l_bucket")) & (F.col("key") != F.col("leader")) & near & alike)
    return leaders, *tested_now(met, tested, texts, threshold)


def compare_rest(
    members: DataFrame, slices: int, at: int, tested: DataFrame, texts: DataFrame, threshold: float
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As `compare`, but only bounds without loss end a pair: one component, sizes too different, or too few k-mers after the place.

    `members` has `bucket`, `key`, `score`, `label`, `n`, `place`. In the first bucket that two texts share by place, no k-mer before is
    common, so one more than the shorter rest bounds what they share. A similar pair is met in that bucket at the latest.
    """
    leaders = first_of_slices(members, slices, at)
    own = members.select("bucket", "key", "label", "n", "place")
    lead = own.withColumnsRenamed({"key": "leader", "label": "l_label", "n": "l_n", "place": "l_place"}).join(leaders, ["bucket", "leader"])
    near = F.least("n", "l_n") >= F.lit(threshold) * F.greatest("n", "l_n")
    needed = F.lit(threshold / (1 + threshold)) * (F.col("n") + F.col("l_n")) - 1e-9
    enough = F.least(F.col("n") - F.col("place"), F.col("l_n") - F.col("l_place")) >= needed
    met = own.join(lead, "bucket").where((F.col("label") != F.col("l_label")) & near & enough)
    return leaders, *tested_now(met, tested, texts, threshold)


def unsettled(members: DataFrame, labels: DataFrame, leaders: DataFrame | None = None) -> DataFrame:
    """`members` without the `leaders` of their buckets, with `label`, in buckets of two components or more."""
    left = members.select("bucket", "key", "score", "n", "place")
    if leaders is not None:
        left = left.join(leaders.withColumnRenamed("leader", "key"), ["bucket", "key"], "left_anti")
    named = left.join(labels, "key", "left").withColumn("label", F.coalesce("label", F.col("key")))
    # Two components or more: the smallest and the largest label differ.
    mixed_up = named.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    return named.join(mixed_up, "bucket", "left_semi")


def prefixes(texts: DataFrame, threshold: float) -> DataFrame:
    """`bucket`, `key`, `n`, `place`: the k-mers of every text (`key`, `text`) among which a similar text must have one too.

    `n` is the number of all k-mers of the text, `place` that of the k-mer in the order, from 0.

    K-mers are in one order for all texts, frequent ones last. Of `n` k-mers two texts over the threshold share at least
    `threshold * n`, so not all of the first `n - threshold * n + 1` are missing in the other.
    """

    counts = texts.sparkSession.sparkContext.broadcast(kmer_counts(texts))

    def expand(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, often = WordHashes(), np.frombuffer(counts.value, np.uint8)
        for batch in it:
            flat: list[np.ndarray] = []
            whole: list[int] = []
            for text in batch.column(1):
                labels = labelled(kmers(text.as_py(), memo))
                whole.append(len(labels))
                n = len(labels) - int(np.ceil(threshold * len(labels) - 1e-9)) + 1
                order = np.lexsort((labels, often[labels >> np.uint64(64 - COUNT_BITS)]))
                flat.append(labels[order[:n]].view(np.int64))
            sizes = [len(f) for f in flat]
            keys = batch.column(0).take(pa.array(np.repeat(np.arange(len(flat)), sizes)))
            buckets = pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int64))
            n = pa.array(np.repeat(np.array(whole, np.int64), sizes))
            place = pa.array(np.concatenate([np.arange(size) for size in sizes]) if sizes else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([buckets, keys, n, place], ["bucket", "key", "n", "place"])

    return texts.select("key", "text").mapInArrow(expand, PREFIX)


def kmer_counts(texts: DataFrame) -> bytes:
    """How often a k-mer occurs in all of `texts` (`text`), up to 255, at the place of its first `COUNT_BITS` bits."""

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        slots, n = np.unique(np.concatenate(held), return_counts=True)
        cuts = np.searchsorted(slots, np.arange(1 << PART_BITS, dtype=np.uint32) << np.uint32(COUNT_BITS - PART_BITS))
        few = np.minimum(n, 255).astype(np.uint8)
        parts = [(i, s.tobytes(), c.tobytes()) for i, (s, c) in enumerate(zip(np.split(slots, cuts[1:]), np.split(few, cuts[1:]), strict=True)) if len(s)]
        return pa.RecordBatch.from_pylist([dict(zip(("part", "slots", "counts"), x, strict=True)) for x in parts], schema=pa.schema([("part", pa.int32()), ("slots", pa.binary()), ("counts", pa.binary())]))

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, held, size = WordHashes(), [], 0
        for batch in it:
            for text in batch.column(0):
                labels = labelled(kmers(text.as_py(), memo))
                held.append((labels >> np.uint64(64 - COUNT_BITS)).astype(np.uint32))
                size += len(labels)
                if size >= COUNTED_TOGETHER:
                    yield packed(held)
                    held, size = [], 0
        if size:
            yield packed(held)

    def added(table: pa.Table) -> pa.Table:
        part, width = table.column("part")[0].as_py(), 1 << (COUNT_BITS - PART_BITS)
        total = np.zeros(width, np.int64)
        for slots, counts in zip(table.column("slots"), table.column("counts"), strict=True):
            total[np.frombuffer(slots.as_buffer(), np.uint32) & np.uint32(width - 1)] += np.frombuffer(counts.as_buffer(), np.uint8)
        few = np.minimum(total, 255).astype(np.uint8).tobytes()
        return pa.table({"part": pa.array([part], pa.int32()), "counts": pa.array([few], pa.binary())})

    sent = texts.select("text").mapInArrow(count, "part int, slots binary, counts binary")
    whole = bytearray(1 << COUNT_BITS)
    width = len(whole) >> PART_BITS
    for row in sent.groupBy("part").applyInArrow(added, "part int, counts binary").collect():
        whole[row["part"] * width : (row["part"] + 1) * width] = row["counts"]
    return bytes(whole)


def classes(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """`doc_id`, `key`, `label`, `class_id`, `class_size` for every row of `docs` (`doc_id`, `text`).

    `key` is the digest of the text, `label` one of the keys of the class.
    """
    rows = materialize(sketches(docs))
    nodes = materialize(
        rows.groupBy("key").agg(
            F.min("doc_id").alias("doc_id"),
            F.count(F.lit(1)).alias("copies"),
            *(F.first(c).alias(c) for c in ("n", "bands", "marks")),
        )
    )
    labels = links(docs, nodes.where("n > 0").drop("copies"), threshold)
    joined = nodes.select("key", "doc_id", "copies").join(labels, "key", "left")
    member = materialize(joined.withColumn("label", F.coalesce("label", F.col("key"))))
    per_class = member.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.sum("copies").alias("class_size"))
    named = member.join(per_class, "label").select("key", "label", "class_id", "class_size")
    return rows.select("doc_id", "key").join(materialize(named), "key")


def one_per_class(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row of `docs` per class, that with the smallest `doc_id`, as it is."""
    columns = docs.columns
    row = docs.select(F.struct("*").alias("row"))
    plain = row.select("row.doc_id", "row.text")
    found = classes(plain, threshold).where(F.col("doc_id").eqNullSafe(F.col("class_id")))
    # Should rows with one id and different texts name a class, the smallest digest counts.
    chosen = found.groupBy("label").agg(F.min("key").alias("_key"), F.min(doc_key(F.col("doc_id"))).alias("_id"))
    own = row.withColumn("_id", doc_key(F.col("row.doc_id"))).withColumn("_key", text_key(F.col("row.text")))
    # Repeated rows with the id and text of the chosen one: the first by hash of all columns.
    others = F.xxhash64(*(F.col("row")[c] for c in columns))
    first = F.row_number().over(W.partitionBy("_id", "_key").orderBy(others))
    joined = own.join(chosen.select("_id", "_key"), ["_id", "_key"])
    return joined.withColumn("_n", first).where("_n = 1").select("row.*")
