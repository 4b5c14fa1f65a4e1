"""Removal of repeated byte strings, by prefix-free parsing.

Every byte covered by a string of `LENGTH` bytes that also starts earlier in the corpus is removed; earlier is a smaller `doc_id`, or
an earlier start in the same document.

Parse. A rolling hash runs over windows of `GRAM` bytes. A window triggers if its hash is the smallest (leftmost of
equal ones) in some string of `LENGTH` bytes, so every such string has one trigger, and equal strings have the same one at
the same offset. A phrase is a trigger with all the strings that belong to it; the text of a phrase depends on nothing around it, and no phrase is
part of another one with the same trigger. Repetitive text has few distinct phrases.

Dictionary. Occurrences of phrases are grouped by digest. All but the first occurrence of a phrase are repeats as a whole, the
first ones form the dictionary. A task first combines what it has read itself, so a phrase that a third of all
documents share is sent once per task.

Suffix arrays. Two different phrases can share strings only if they share their trigger. Only those phrases, mostly the ends of repeated
passages, are fetched with their text. Sorting the suffixes that start at the trigger, and the reversed prefixes that
end there, gives two arrays with longest common prefixes; strings at one offset are equal where both are long
enough. The first in corpus order stays. Phrases with a very frequent trigger are dealt in slices;
what is first in its slice meets the other slices by digest.

Texts are moved twice by `doc_id`: to fetch those phrases, and to remove the spans. Nothing is gathered whole in one task or the driver.

Defined results: a NULL text counts as empty; texts shorter than `LENGTH` keep everything; a NULL `doc_id` is the smallest; rows with the same `doc_id` and text are
one document and get equal results, rows with the same `doc_id` and other texts are ordered by a checksum; an empty table
gives an empty result; other columns are ignored. Texts are read whole, however long.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekband.llm.common import doc_key, materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LENGTH = 100
GRAM = 24
#: Grams in a string of LENGTH bytes.
CHOICE = LENGTH - GRAM + 1
#: Phrases a task combines before it sends them.
HELD = 1_500_000
#: Phrases of one trigger that are sorted together.
SLICE = 4096
SEGMENT = 1 << 23
PLACE = np.uint64(0xFFFFFF)
PHRASE = np.dtype([("s", "<u4"), ("extra", "u1"), ("left", "u1"), ("gram", "<u8"), ("slices", "<u2")])
ITEM = ("gram", "ctx", "doc", "tie", "s", "extra", "left")


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of splitmix64)."""
    x = values.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(data: np.ndarray) -> np.ndarray:
    """Polynomial hash of the GRAM bytes from each position on, by doubling."""
    width, powers = 1, {1: np.uint64(0x9E3779B97F4A7C15)}
    level = data.astype(np.uint64) + np.uint64(1)
    levels = {1: level}
    while width * 2 <= GRAM:
        level = level[:-width] * powers[width] + level[width:]
        powers[width * 2] = np.uint64(int(powers[width]) ** 2 % (1 << 64))
        width *= 2
        levels[width] = level
    # GRAM is a power of two or the sum of two: the first part moves up by the places of the second.
    rest = GRAM - width
    if rest:
        n = len(data) - GRAM + 1
        level = level[:n] * powers[rest] + levels[rest][width : width + n]
    return mixed(level)


def phrases(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """First string start, number of further strings, trigger offset, trigger hash and digest of every phrase."""
    import xxhash

    firsts, extras, lefts, grams = [], [], [], []
    digests: list[int] = []
    for at in range(0, len(raw) - LENGTH + 1, SEGMENT):
        piece = raw[at : at + SEGMENT + LENGTH - 1]
        gram = rolling(np.frombuffer(piece, np.uint8))
        low = (gram & ~PLACE) | np.arange(len(gram), dtype=np.uint64)
        width = 1
        while width * 2 <= CHOICE:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if CHOICE > width:
            low = np.minimum(low[: len(low) - (CHOICE - width)], low[CHOICE - width :])
        trigger = (low & PLACE).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(trigger[1:] != trigger[:-1]) + 1])
        last = np.append(first[1:] - 1, len(trigger) - 1)
        here = trigger[first]
        firsts.append(first + at)
        extras.append(last - first)
        lefts.append(here - first)
        grams.append(gram[here])
        digest = xxhash.xxh3_64_intdigest
        digests += [digest(piece[a:b]) for a, b in zip(first.tolist(), (last + LENGTH).tolist())]
    if not firsts:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), []
    return np.concatenate(firsts), np.concatenate(extras), np.concatenate(lefts), np.concatenate(grams), digests


def pack(items: dict[str, np.ndarray]) -> bytes:
    """Items as bytes; documents as differences, small fields compressed."""
    import zstandard

    n = len(items["gram"])
    steps = np.diff(items["doc"], prepend=items["doc"][:1])
    first = np.array([n, items["doc"][0]], "<i8").tobytes()
    small = b"".join(
        [steps.astype("<i8").tobytes(), items["tie"].astype("<u4").tobytes(), items["s"].astype("<u4").tobytes(),
         items["extra"].astype("u1").tobytes(), items["left"].astype("u1").tobytes()]
    )
    wide = items["gram"].astype("<u8").tobytes() + items["ctx"].astype("<u8").tobytes()
    return first + wide + zstandard.ZstdCompressor(level=3).compress(small)


def unpack(payload: bytes) -> dict[str, np.ndarray]:
    import zstandard

    n, first = np.frombuffer(payload, "<i8", 2).tolist()
    out = {"gram": np.frombuffer(payload, "<u8", n, 16), "ctx": np.frombuffer(payload, "<u8", n, 16 + 8 * n)}
    small = zstandard.ZstdDecompressor().decompress(payload[16 + 16 * n :])
    out["doc"] = np.cumsum(np.frombuffer(small, "<i8", n)) + first
    at = 8 * n
    for name, kind in (("tie", "<u4"), ("s", "<u4"), ("extra", "u1"), ("left", "u1")):
        out[name] = np.frombuffer(small, kind, n, at)
        at += n * np.dtype(kind).itemsize
    return out


def merged(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Union of spans as flat (start, end, start, end, ...), ascending."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    fresh = np.concatenate([[True], starts[1:] > ends[:-1]])
    heads = np.flatnonzero(fresh)
    return np.stack([starts[heads], ends[np.append(heads[1:] - 1, len(ends) - 1)]], axis=1).reshape(-1).astype("<u4")


def split_first(items: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """First occurrences per (gram, ctx) in the order of (gram, ctx), and all later ones."""
    order = np.lexsort((items["s"], items["tie"], items["doc"], items["ctx"], items["gram"]))
    items = {k: v[order] for k, v in items.items()}
    new = np.ones(len(order), bool)
    new[1:] = (items["gram"][1:] != items["gram"][:-1]) | (items["ctx"][1:] != items["ctx"][:-1])
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    same_place = (items["doc"] == items["doc"][head]) & (items["tie"] == items["tie"][head]) & (items["s"] == items["s"][head])
    return {k: v[new] for k, v in items.items()}, {k: v[~same_place] for k, v in items.items()}


def by_document(items: dict[str, np.ndarray]) -> Iterator[tuple[int, int, slice]]:
    """`items` must be in the order of (doc, tie); yields doc, tie and their rows."""
    doc, tie = items["doc"], items["tie"]
    if not len(doc):
        return
    heads = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1])]))
    for a, b in zip(heads.tolist(), np.append(heads[1:], len(doc)).tolist()):
        yield int(doc[a]), int(tie[a]), slice(a, b)


def in_document_order(items: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    order = np.lexsort((items["s"], items["tie"], items["doc"]))
    return {k: v[order] for k, v in items.items()}


#: Rows that move between the steps: phrases for a bucket (`payload`), or spans and open phrases of a document.
MOVED = "bucket int, doc long, tie long, spans binary, opens binary, payload binary"
NAMES = [c.split()[0] for c in MOVED.split(", ")]
KINDS = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(KINDS)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, KINDS)], NAMES)


def in_batches(rows: Iterator[tuple], size: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield as_batch(held)
            held = []
    if held:
        yield as_batch(held)


def span_rows(items: dict[str, np.ndarray], buckets: int) -> Iterator[tuple]:
    """One row per document with the union of the spans of its items."""
    items = in_document_order(items)
    ends = items["s"].astype(np.int64) + items["extra"] + LENGTH
    for doc, tie, rows in by_document(items):
        spans = merged(items["s"][rows].astype(np.int64), ends[rows])
        yield (doc ^ tie) % buckets, doc, tie, spans.tobytes(), None, None


def bucket_rows(items: dict[str, np.ndarray], buckets: int) -> Iterator[tuple]:
    """One row per bucket with its items, in document order for small differences."""
    bucket = (items["gram"] >> np.uint64(20)) % np.uint64(buckets)
    order = np.lexsort((items["s"], items["tie"], items["doc"], bucket))
    items, bucket = {k: v[order] for k, v in items.items()}, bucket[order]
    heads = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else []
    for a, b in zip(list(heads), [*list(heads)[1:], len(bucket)]):
        yield int(bucket[a]), None, None, None, None, pack({k: v[a:b] for k, v in items.items()})


def joined_items(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {k: np.concatenate([p[k] for p in parts]) for k in ITEM}


def parse(it: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Phrases of the documents (`doc`, `tie`, `text`), first occurrences by bucket; repeats within the task as spans."""
    held: list[dict[str, np.ndarray]] = []
    size = 0

    def flush() -> Iterator[tuple]:
        firsts, later = split_first(joined_items(held))
        yield from bucket_rows(firsts, buckets)
        yield from span_rows(later, buckets)

    for batch in it:
        docs, ties = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for doc, tie, text in zip(docs, ties, batch.column(2)):
            if not text.is_valid:
                continue
            raw = text.as_buffer().to_pybytes()
            if len(raw) < LENGTH:
                continue
            s, extra, left, gram, ctx = phrases(raw)
            n = len(s)
            held.append({
                "gram": gram, "ctx": np.array(ctx, np.uint64), "doc": np.full(n, doc, np.int64), "tie": np.full(n, tie, np.int64),
                "s": s, "extra": extra, "left": left,
            })
            size += n
            if size >= HELD:
                yield from in_batches(flush())
                held, size = [], 0
    if held:
        yield from in_batches(flush())


def arrived(it: Iterator[pa.RecordBatch], passed: list[tuple]) -> Iterator[bytes]:
    """Payloads of a partition; rows of documents are put into `passed`."""
    for batch in it:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[5] is not None:
                yield row[5]
            else:
                passed.append(row)


def settle(it: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Spans of phrases that occur earlier, and the first phrases that share their trigger with another one."""
    passed: list[tuple] = []
    parts = [unpack(p) for p in arrived(it, passed)]
    yield from in_batches(iter(passed))
    if not parts:
        return
    firsts, later = split_first(joined_items(parts))
    yield from in_batches(span_rows(later, buckets))
    heads = np.flatnonzero(np.concatenate([[True], firsts["gram"][1:] != firsts["gram"][:-1]]))
    sizes = np.diff(np.append(heads, len(firsts["gram"])))
    crowd = np.repeat(sizes, sizes)
    shared = {k: v[crowd > 1] for k, v in firsts.items()}
    shared["slices"] = np.minimum((crowd[crowd > 1] + SLICE - 1) // SLICE, 65535)
    shared = in_document_order(shared)
    records = np.zeros(len(shared["s"]), PHRASE)
    for name in PHRASE.names:
        records[name] = shared[name]
    yield from in_batches((0, doc, tie, None, records[rows].tobytes(), None) for doc, tie, rows in by_document(shared))


def fetch(it: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """The texts of open phrases, by bucket of trigger and slice."""
    import xxhash
    import zstandard

    held: dict[int, list[tuple[bytes, bytes]]] = {}
    size = 0

    def flush() -> Iterator[tuple]:
        for bucket, entries in sorted(held.items()):
            head = b"".join(e[0] for e in entries)
            body = np.array([len(entries)], "<i8").tobytes() + head + b"".join(e[1] for e in entries)
            yield bucket, None, None, None, None, zstandard.ZstdCompressor(level=3).compress(body)

    for batch in it:
        docs, ties, opens = (batch.column(k).to_pylist() for k in (0, 1, 3))
        for doc, tie, text, lists in zip(docs, ties, batch.column(2), opens):
            raw = text.as_buffer().to_pybytes()
            records = np.concatenate([np.frombuffer(o, PHRASE) for o in lists])
            for s, extra, left, gram, slices in records.tolist():
                own = raw[s : s + extra + LENGTH]
                part = xxhash.xxh3_64_intdigest(own) % slices if slices > 1 else 0
                bucket = (gram + part * 0x9E3779B1) % 0xFFFFFFFFFFFFFFC5 % buckets
                entry = np.array([(gram, doc, tie, s, extra, left, slices)], OPEN).tobytes()
                held.setdefault(bucket, []).append((entry, own))
                size += len(own) + 200
            if size >= 128 << 20:
                yield from in_batches(flush(), 50)
                held, size = {}, 0
    yield from in_batches(flush(), 50)


OPEN = np.dtype([("gram", "<u8"), ("doc", "<i8"), ("tie", "<u4"), ("s", "<u4"), ("extra", "u1"), ("left", "u1"), ("slices", "<u2")])


def common_prefixes(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of a byte table, and the bytes each has in common with the one before it."""
    order = np.argsort(np.ascontiguousarray(table).view(f"S{table.shape[1]}").reshape(-1), kind="stable")
    ordered = table[order]
    differ = ordered[1:] != ordered[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), table.shape[1])
    return order, np.concatenate([[0], common])


def compare(it: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Suffix arrays of phrases with common triggers: spans of strings that occur earlier.

    Strings of sliced triggers that are first here go on by digest.
    """
    import xxhash
    import zstandard

    entries, texts = [], []
    for payload in arrived(it, []):
        body = zstandard.ZstdDecompressor().decompress(payload)
        n = int(np.frombuffer(body, "<i8", 1)[0])
        entries.append(np.frombuffer(body, OPEN, n, 8))
        texts.append(body[8 + n * OPEN.itemsize :])
    if not entries:
        return
    phrase = np.concatenate(entries)
    text = np.frombuffer(b"".join(texts), np.uint8)
    size = phrase["extra"].astype(np.int64) + LENGTH
    begin = np.cumsum(size) - size
    # Rows that are repeated as a whole bring the same phrase of the same document twice.
    _, once = np.unique(phrase[["doc", "tie", "s"]], return_index=True)
    phrase, size, begin = phrase[once], size[once], begin[once]
    left = phrase["left"].astype(np.int64)
    gram = phrase["gram"].astype(">u8").view(np.uint8).reshape(-1, 8)

    def table(width: int, start: np.ndarray, step: int, most: np.ndarray) -> np.ndarray:
        """Trigger and up to `width` bytes from `start` on in the direction of `step`, 0 beyond the phrase."""
        out = np.zeros((len(phrase), 8 + width), np.uint8)
        out[:, :8] = gram
        for k in range(width):
            inside = np.flatnonzero(k < most)
            out[inside, 8 + k] = text[start[inside] + step * k]
        return out

    at = begin + left
    suffix_order, suffix_common = common_prefixes(table(LENGTH, at, 1, size - left))
    prefix_order, prefix_common = common_prefixes(table(CHOICE - 1, at - 1, -1, left))
    trigger = phrase["s"].astype(np.int64) + left
    rank = np.empty(len(phrase), np.int64)
    rank[np.lexsort((trigger, phrase["tie"], phrase["doc"]))] = np.arange(len(phrase))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    onward: list[tuple[np.ndarray, np.ndarray]] = []
    for offset in range(CHOICE):
        here = np.flatnonzero((left - phrase["extra"] <= offset) & (offset <= left))
        if not len(here):
            continue
        after, before = np.empty(len(phrase), np.int64), np.empty(len(phrase), np.int64)
        after[suffix_order] = np.cumsum(suffix_common < 8 + LENGTH - offset)
        before[prefix_order] = np.cumsum(prefix_common < 8 + offset)
        order = here[np.lexsort((rank[here], before[here], after[here]))]
        new = np.ones(len(order), bool)
        new[1:] = (after[order[1:]] != after[order[:-1]]) | (before[order[1:]] != before[order[:-1]])
        found.append((order[~new], trigger[order[~new]] - offset))
        first = order[new]
        first = first[phrase["slices"][first] > 1]
        onward.append((first, at[first] - offset))
    rows, starts = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2

    def items(rows: np.ndarray, starts: np.ndarray, gram: np.ndarray, ctx: np.ndarray) -> dict[str, np.ndarray]:
        zero = np.zeros(len(rows), np.int64)
        doc, tie = phrase["doc"][rows].astype(np.int64), phrase["tie"][rows].astype(np.int64)
        return {"gram": gram, "ctx": ctx, "doc": doc, "tie": tie, "s": starts, "extra": zero, "left": zero}

    none = np.zeros(len(rows), np.uint64)
    yield from in_batches(span_rows(items(rows, starts, none, none), buckets))
    rows, places = (np.concatenate(x) for x in zip(*onward)) if onward else (np.zeros(0, np.int64),) * 2
    if len(rows):
        raw = text.tobytes()
        digests = [xxhash.xxh3_128_intdigest(raw[p : p + LENGTH]) for p in places.tolist()]
        high = np.array([d >> 64 for d in digests], np.uint64)
        low = np.array([d & 0xFFFFFFFFFFFFFFFF for d in digests], np.uint64)
        starts = phrase["s"][rows].astype(np.int64) + places - begin[rows]
        yield from in_batches(bucket_rows(items(rows, starts, high, low), buckets))


def settle_strings(it: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Spans of single strings that occur earlier."""
    parts = [unpack(p) for p in arrived(it, [])]
    if parts:
        yield from in_batches(span_rows(split_first(joined_items(parts))[1], buckets))


def spans(docs: DataFrame) -> DataFrame:
    """`doc`, `tie`, `spans` (list of packed spans) of the documents that have any; `docs` has `doc_id` and `text`."""
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select(doc_key(F.col("doc_id")).alias("doc"), F.crc32("text").alias("tie"), "text").where("text IS NOT NULL")

    def step(df: DataFrame, work) -> DataFrame:
        return df.mapInArrow(functools.partial(work, buckets=buckets), MOVED)

    settled = materialize(step(step(keyed, parse).repartitionById(buckets, F.col("bucket")), settle).drop("bucket", "payload"))
    opens = settled.where("opens IS NOT NULL").groupBy("doc", "tie").agg(F.collect_list("opens").alias("opens"))
    texts = keyed.join(opens, ["doc", "tie"]).select("doc", "tie", "text", "opens")
    # The same document may be there more than once; its strings are then equal in place and count once.
    compared = materialize(step(step(texts, fetch).repartitionById(buckets, F.col("bucket")), compare))
    strings = compared.where("payload IS NOT NULL").repartitionById(buckets, F.col("bucket"))
    last = step(strings, settle_strings)
    each = [t.where("spans IS NOT NULL").select("doc", "tie", "spans") for t in (settled, compared, last)]
    return functools.reduce(DataFrame.unionByName, each).groupBy("doc", "tie").agg(F.collect_list("spans").alias("spans"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """`doc_id`, `n_bytes`, `removed` (array of byte spans, end exclusive) and `kept` (bytes) of every document."""
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", "text", doc_key(F.col("doc_id")).alias("doc"), F.crc32("text").alias("tie"))
    joined = keyed.join(spans(docs), ["doc", "tie"], "left").select("doc_id", "text", "spans")

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        for batch in it:
            sizes, removed, kept = [], [], []
            for text, lists in zip(batch.column(1), batch.column(2).to_pylist()):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                flat = np.frombuffer(b"".join(lists or ()), "<u4").astype(np.int64)
                flat = merged(flat[0::2], flat[1::2]).astype(np.int64) if len(flat) else flat
                edges = [0, *flat.tolist(), len(raw)]
                sizes.append(len(raw))
                removed.append([{"start": a, "end": b} for a, b in zip(edges[1:-1:2], edges[2:-1:2])])
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[0::2], edges[1::2])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.list_(span)), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "removed", "kept"],
            )

    return joined.mapInArrow(cut, f"doc_id {id_kind}, n_bytes long, removed array<struct<start:long,end:long>>, kept binary")
