"""Collocations: phrases whose words occur together more often than their parts would by chance.

Frequent phrases are mined by partitioning (SON). Documents are dealt to `SHARDS` shards by a hash of their id. A phrase with
`support` occurrences in a language has, in one shard at least, the part of them that is the shard's part of all words of the
language; so every shard is mined completely with its own, proportionally lower support, phrases frequent in any shard are united,
and one more pass counts all of them exactly over the whole corpus.

*Mining.* A shard is larger than a task. A task goes through blocks of text and counts phrases of each (language, shard) in a
block by 64-bit fingerprints; the counts of a shard meet by ranges of the fingerprint, as packed arrays. What is frequent is
marked in a bitmap of `BITS` places, the same size for any corpus. Longer phrases are counted only where the words are frequent in the
corpus and both halves of every two neighbouring words are marked. Collisions of fingerprints or places only add candidates.

*Counting.* Occurrences at marked fingerprints are counted as text, per block by the exact words and over all by the sum per
phrase in each range of fingerprints, so results do not rest on fingerprints. The counts of words and frequent phrases then give the score of every cut by joins. Products are decimals of
38 digits.

Defined results: a NULL or empty text has no words; a NULL language is `und`; repeated rows count as often as they are there; ties
in score and count go by phrase in byte order; an empty table gives no rows; other columns are ignored; rows with a NULL id are
dealt to one shard and count. A very long text makes a block of its own.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weekband.llm.blocks import Runs, blocks, text_bytes
from weekband.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHARDS = 8
MAX_WORDS = 5
#: Places of the bitmap of what is frequent (16 MB).
BITS = 27
#: Entries that meet in a range of fingerprints, about.
RANGE_ENTRIES = 1 << 21

#: Class of every byte: 0 in a word, 1 between words, 2 between pieces.
CLASS = np.zeros(256, dtype=np.uint8)
CLASS[[0x20, 0x09]] = 1
CLASS[[ord(c) for c in ".,;:!?"] + [0x0A, 0x0B, 0x0C, 0x0D]] = 2
MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(29))


class Words(Runs):
    """The words of texts, with the `piece` that each is in and the `hash` of each name."""

    def __init__(self, texts: pa.Array) -> None:
        data, start = text_bytes(texts)
        kind = CLASS[data]
        super().__init__(data, start, kind == 0)
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[self.at] + self.doc
        names = self.names.to_pylist()
        self.hash = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in names), dtype=np.uint64, count=len(names))


def language_hash(name: str) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(name, seed=1))


def marked(bits: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Whether the place of each fingerprint is set."""
    place = prints >> np.uint64(64 - BITS)
    return (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0


def phrases(words: Words, langs: np.ndarray, frequent: np.ndarray, pairs: np.ndarray | None, lengths: tuple[int, ...]):
    """For each length the fingerprint of the phrase that begins at each word, and where it may be frequent."""
    one = mixed(words.hash[words.code] ^ langs[words.doc])
    word = words.hash[words.code]
    fits, prints = marked(frequent, one), one
    linked = None
    for k in range(2, max(lengths) + 1):
        if len(prints) <= 1:
            return
        prints = mixed(prints[:-1] + word[k - 1 :] * MIX)
        fits = fits[:-1] & marked(frequent, one[k - 1 :]) & (words.piece[: len(prints)] == words.piece[k - 1 :])
        if pairs is not None:
            if k == 2:
                linked = marked(pairs, prints)
            fits &= linked[k - 2 :]
        if k in lengths:
            yield k, prints, fits


def groups(table: pa.Table) -> Iterator[tuple[str, int, pa.Array]]:
    """The texts of each (lang, shard)."""
    keys = table.select(["lang", "shard"]).to_pandas()
    for (lang, shard), rows in keys.groupby(["lang", "shard"], sort=True).indices.items():
        yield lang, int(shard), table.column("text").take(pa.array(rows)).combine_chunks()


WORD_SCHEMA = "lang string, shard int, word string, n long"
PACKED_SCHEMA = "range int, lang string, shard int, prints binary, counts binary"


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words per language (`shard` NULL), and of all words per language and shard (`word` NULL)."""
    types = [("lang", pa.string()), ("shard", pa.int32()), ("word", pa.string()), ("n", pa.int64())]
    for table in blocks(batches):
        keys = pc.dictionary_encode(table.column("lang").combine_chunks())
        for code, lang in enumerate(keys.dictionary.to_pylist()):
            own = table.filter(pc.equal(keys.indices, code))
            words = Words(own.column("text").combine_chunks())
            counts = np.bincount(words.code, minlength=len(words.names))
            shards = np.bincount(own.column("shard").to_numpy()[words.doc], minlength=SHARDS)
            n = len(counts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * (n + SHARDS), pa.string()),
                    pa.array([None] * n + list(range(SHARDS)), pa.int32()),
                    pa.concat_arrays([words.names.cast(pa.string()), pa.nulls(SHARDS, pa.string())]),
                    pa.array(np.concatenate([counts, shards]), pa.int64()),
                ],
                schema=pa.schema(types),
            )


def packed(prints: np.ndarray, counts: np.ndarray, lang: str, shard: int, range_bits: int) -> pa.RecordBatch:
    """Sorted fingerprints with their counts (255 for more), cut by ranges."""
    cuts = np.searchsorted(prints, np.arange(1, 1 << range_bits, dtype=np.uint64) << np.uint64(64 - range_bits))
    ends = np.concatenate(([0], cuts, [len(prints)])).astype(np.int32)
    full = np.flatnonzero(ends[1:] > ends[:-1])
    few = np.minimum(counts, 255).astype(np.uint8)
    n = len(ends) - 1
    blobs = [
        pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends * width), pa.py_buffer(values)]).take(pa.array(full))
        for width, values in ((8, np.ascontiguousarray(prints)), (1, few))
    ]
    own = [pa.array(full, pa.int32()), pa.array([lang] * len(full), pa.string()), pa.array([shard] * len(full), pa.int32())]
    return pa.RecordBatch.from_arrays(own + blobs, names=["range", "lang", "shard", "prints", "counts"])


def pack_words(range_bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints of words of (lang, word), as those of phrases."""
    for batch in batches:
        for lang in pc.unique(batch.column("lang")).to_pylist():
            own = batch.filter(pc.equal(batch.column("lang"), lang)).column("word").to_pylist()
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in own), dtype=np.uint64, count=len(own))
            prints = np.sort(mixed(hashes ^ language_hash(lang)))
            yield packed(prints, np.full(len(prints), 255), lang, 0, range_bits)


def pack_phrases(
    lengths: tuple[int, ...], frequent: Broadcast, pairs: Broadcast | None, range_bits: int, batches: Iterator[pa.RecordBatch]
) -> Iterator[pa.RecordBatch]:
    """Counts of the phrases of each shard in each block."""
    words_ok, pairs_ok = (None if b is None else np.frombuffer(b.value, np.uint8) for b in (frequent, pairs))
    for table in blocks(batches):
        for lang, shard, texts in groups(table):
            words = Words(texts)
            langs = np.full(len(texts), language_hash(lang))
            found = [prints[fits] for _, prints, fits in phrases(words, langs, words_ok, pairs_ok, lengths)]
            if found:
                prints, counts = np.unique(np.concatenate(found), return_counts=True)
                yield packed(prints, counts, lang, shard, range_bits)


def mine(range_bits: int, table: pa.Table) -> pa.Table:
    """The piece of the bitmap of one range of fingerprints: set where one is frequent in some shard."""
    here = table.column("range")[0].as_py()
    width = 1 << (BITS - range_bits)
    bits = np.zeros(width, dtype=np.uint8)
    keys = table.select(["lang", "shard", "support"]).to_pandas()
    blobs, counts = table.column("prints"), table.column("counts")
    for (_, _, support), rows in keys.groupby(["lang", "shard", "support"]).indices.items():
        prints = np.concatenate([np.frombuffer(blobs[i].as_buffer(), np.uint64) for i in rows.tolist()])
        n = np.concatenate([np.frombuffer(counts[i].as_buffer(), np.uint8) for i in rows.tolist()])
        order = np.argsort(prints, kind="stable")
        prints, n = prints[order], n[order]
        heads = np.flatnonzero(np.append(True, prints[1:] != prints[:-1]))
        often = prints[heads][np.add.reduceat(n, heads, dtype=np.int64) >= min(support, 255)]
        bits[(often >> np.uint64(64 - BITS)) & np.uint64(width - 1)] = 1
    packed_bits = np.packbits(bits, bitorder="little").tobytes()
    return pa.table({"range": pa.array([here], pa.int32()), "bits": pa.array([packed_bits], pa.binary())})


def bitmap(blobs: DataFrame, supports: DataFrame, range_bits: int) -> bytes:
    """What is frequent in some shard, as `BITS` places; the driver gets these bytes and nothing else."""

    def mined(table: pa.Table) -> pa.Table:
        return mine(range_bits, table)

    rows = blobs.join(supports, ["lang", "shard"])
    pieces = rows.groupBy("range").applyInArrow(mined, "range int, bits binary").collect()
    whole = bytearray(1 << (BITS - 3))
    width = len(whole) >> range_bits
    for piece in pieces:
        whole[piece["range"] * width : (piece["range"] + 1) * width] = piece["bits"]
    return bytes(whole)


COUNTED_SCHEMA = "range int, lang string, phrases array<string>, counts array<long>"


def count_marked(
    frequent: Broadcast, candidates: Broadcast, range_bits: int, batches: Iterator[pa.RecordBatch]
) -> Iterator[pa.RecordBatch]:
    """Exact counts of the phrases at marked fingerprints per block, packed by ranges of the fingerprint."""
    words_ok, marks = (np.frombuffer(b.value, np.uint8) for b in (frequent, candidates))
    for table in blocks(batches):
        keys = pc.dictionary_encode(table.column("lang").combine_chunks())
        for code, lang in enumerate(keys.dictionary.to_pylist()):
            texts = table.column("text").filter(pc.equal(keys.indices, code)).combine_chunks()
            words = Words(texts)
            langs = np.full(len(texts), language_hash(lang))
            found = []
            for k, prints, fits in phrases(words, langs, words_ok, marks, tuple(range(2, MAX_WORDS + 1))):
                at = np.flatnonzero(fits & marked(marks, prints))
                if not len(at):
                    continue
                ids = words.code[at].astype(np.int64)
                for j in range(1, k):  # a number for the first j + 1 words, without gaps
                    _, ids = np.unique(ids * len(words.names) + words.code[at + j], return_inverse=True)
                _, first, n = np.unique(ids, return_index=True, return_counts=True)
                parts = [words.names.take(pa.array(words.code[at[first] + j])) for j in range(k)]
                found.append((prints[at[first]] >> np.uint64(64 - range_bits), pc.binary_join_element_wise(*parts, " "), n))
            if found:
                ranges = np.concatenate([f[0] for f in found]).astype(np.int64)
                order = np.argsort(ranges, kind="stable")
                full, starts = np.unique(ranges[order], return_index=True)
                cuts = pa.array(np.append(starts, len(order)), pa.int32())
                texts_of = pa.concat_arrays([f[1] for f in found]).take(pa.array(order))
                counts = pa.array(np.concatenate([f[2] for f in found])[order], pa.int64())
                lists = [pa.ListArray.from_arrays(cuts, texts_of), pa.ListArray.from_arrays(cuts, counts)]
                own = [pa.array(full, pa.int32()), pa.array([lang] * len(full), pa.string())]
                yield pa.RecordBatch.from_arrays(own + lists, names=["range", "lang", "phrases", "counts"])


def add_up(support: int, table: pa.Table) -> pa.Table:
    """Sums of the packed counts of one range, where they reach the support."""
    table = table.combine_chunks()
    owner = pc.list_parent_indices(table.column("phrases"))
    flat = pa.table(
        {
            "lang": table.column("lang").take(owner),
            "phrase": pc.list_flatten(table.column("phrases")),
            "n": pc.list_flatten(table.column("counts")),
        }
    )
    total = flat.group_by(["lang", "phrase"]).aggregate([("n", "sum")])
    total = total.filter(pc.greater_equal(total.column("n_sum"), support))
    return pa.table({"lang": total.column("lang"), "phrase": total.column("phrase"), "n": total.column("n_sum")})


def dealt(docs: DataFrame) -> DataFrame:
    """`text`, `lang` and `shard` of the documents."""
    shard = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(SHARDS)).cast("int")
    return docs.select("text", F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), shard.alias("shard"))


def frequent_phrases(docs: DataFrame, support: int = 100) -> tuple[DataFrame, DataFrame]:
    """Words and phrases of 2 to 5 words with at least `support` occurrences (`lang`, `k`, `phrase`, `n`); all words per `lang` as `n`."""
    texts = dealt(docs)
    context = docs.sparkSession.sparkContext
    counted = materialize(texts.mapInArrow(count_words, WORD_SCHEMA).groupBy("lang", "shard", "word").agg(F.sum("n").alias("n")))
    totals = counted.where("word IS NULL").groupBy("lang", "shard").agg(F.sum("n").alias("own"))
    share = totals.join(totals.groupBy("lang").agg(F.sum("own").alias("all")), "lang").where("own > 0")
    lowered = F.expr(f"CAST(({support}L * own + all - 1) div all AS INT)")
    supports = materialize(share.select("lang", "shard", lowered.alias("support")))
    words = counted.where(F.col("word").isNotNull() & (F.col("n") >= support)).select("lang", "word", "n")
    size = totals.agg(F.coalesce(F.sum("own"), F.lit(0))).first()[0]
    range_bits = max(4, min(16, int(size // RANGE_ENTRIES).bit_length()))

    single = words.mapInArrow(functools.partial(pack_words, range_bits), PACKED_SCHEMA)
    always = single.select("lang", "shard").distinct().withColumn("support", F.lit(1))
    frequent = context.broadcast(bitmap(single, always, range_bits))
    marks, pairs = bytes(1 << (BITS - 3)), None
    for lengths in ((2,), tuple(range(3, MAX_WORDS + 1))):
        pack = functools.partial(pack_phrases, lengths, frequent, pairs, range_bits)
        own = bitmap(texts.mapInArrow(pack, PACKED_SCHEMA), supports, range_bits)
        marks = (np.frombuffer(marks, np.uint8) | np.frombuffer(own, np.uint8)).tobytes()
        pairs = context.broadcast(marks)

    def added(table: pa.Table) -> pa.Table:
        return add_up(support, table)

    exact = texts.mapInArrow(functools.partial(count_marked, frequent, pairs, range_bits), COUNTED_SCHEMA)
    longer = exact.groupBy("range").applyInArrow(added, "lang string, phrase string, n long")
    longer = longer.select("lang", F.size(F.split("phrase", " ")).alias("k"), "phrase", "n")
    single_words = words.select("lang", F.lit(1).alias("k"), F.col("word").alias("phrase"), "n")
    return materialize(single_words.unionByName(longer)), materialize(totals.groupBy("lang").agg(F.sum("own").alias("n")))


def collocations(docs: DataFrame, support: int = 100, closed: int = 100, top: int = 2000) -> DataFrame:
    """The first `top` phrases of each language by score; see the contract of the columns in the query.

    A phrase is dropped if a longer frequent one that holds it has at least `closed` per cent of its occurrences.
    """
    counts, totals = frequent_phrases(docs, support)
    several = counts.where("k > 1").withColumn("words", F.split("phrase", " "))
    part = lambda start, length: F.array_join(F.slice("words", start, length), " ")
    cut = several.select("lang", "phrase", F.col("n").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cut = cut.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("first"), part(F.col("cut") + 1, F.size("words")).alias("rest"))
    left = counts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    whole = totals.select("lang", F.col("n").cast("decimal(19,0)").alias("all"))
    score = F.expr("(CAST(a AS DECIMAL(19,0)) * 1000 * all) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))")
    scored = cut.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(whole, "lang").withColumn("score", score)
    worst = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r", "all")).alias("worst"))

    inner = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.col("k") - 1),
            lambda m: F.transform(F.sequence(F.lit(1), F.col("k") - m + 1), lambda s: F.array_join(F.slice("words", s, m), " ")),
        )
    )
    held = several.where("k > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "n")
    held = held.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    open_ones = worst.join(held, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * closed)
    )
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("worst.score"), F.desc("a"), "phrase"))
    return (
        open_ones.withColumn("rank", rank)
        .where(F.col("rank") <= top)
        .select(
            "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "worst.l", "worst.r",
            F.col("worst.all").cast("long").alias("n"), F.col("worst.score").alias("score"),
        )
    )
