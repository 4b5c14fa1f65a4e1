"""Token ids in Huffman-coded files.

A file set is a folder with two tables:

* `codebook`: `id`, `length` of the canonical code of every id that occurs. Codes are at most `MAX_BITS` long and optimal
  under that limit (package-merge over global counts). Codes of equal length rise with the id, so lengths are enough.
* `blocks`: one row per block of whole documents, with `shard`, `block`, the ids and token counts of its documents,
  `checkpoints`, and `payload`, the codes of all tokens, highest bit first. A checkpoint is the bit offset of every `STRIDE`-th
  token, so a block is decoded from all its checkpoints at once, by table look-up, and any stretch of it without the rest.

Shards are ranges of `doc_id`, blocks rise within a shard: read in the order of their first documents the tokens stand in
ascending `doc_id` order. Each document ends with `end_id`. Files are written by Spark's own committed writer, so a
lost executor leaves no half of one.

Documents are tokenized once and the ids written to the shared folder; counting and encoding read them from there. A task
sees its documents as a stream; what reaches the driver are the counts per id.

Defined results: a NULL or empty text has no tokens but the end id; repeated ids stand next to each other in the order of a hash of their
tokens; an empty table gives empty files; other columns are ignored. Texts are encoded whole.
"""

from __future__ import annotations

import codecs
import functools
import itertools
import re
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weekband.session import materialize, shared_folder

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_BITS = 18
STRIDE = 256
BLOCK_TOKENS = 1 << 17
#: Bytes of words and their ids that a task remembers, before it forgets those not met lately.
CACHE_BYTES = 24 << 20
#: Bytes of text that are split and looked up together.
SLICE_BYTES = 2 << 20
#: White space other than a space and a line feed, in any alphabet.
OTHER_SPACE = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Texts that are empty or hold white space other than single spaces and line feeds between other signs.
ODD_SPACE = r"\A\z|\A[ \n]|[ \n]\z|[ \n][ \n]|" + OTHER_SPACE.pattern
#: A single space between two other signs always begins a new piece of the tokenizer.
SAFE_SPACE = re.compile(r"(?<!\s) (?!\s)")
#: Latin, Greek and Cyrillic letters, and ASCII signs but the apostrophe, which may begin a piece of its own with letters.
LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0391-\u03a1\u03a3-\u03ce\u0400-\u0481]"
SIGNS = r"[!-&(-/:-@\[-`{-~]"
ONE_PIECE = rf"\A\n?{LETTERS}+\z"
TWO_PIECES = rf"\A(?P<core>\n?{LETTERS}+)(?P<tail>{SIGNS}*)\z"


def byte_signs() -> str:
    """The sign that stands for each byte in the vocabulary of a byte-level tokenizer."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = itertools.count(256)
    return "".join(chr(b if b in shown else next(hidden)) for b in range(256))


class WordEncoder:
    """Ids of texts, with a bounded memory of words already encoded.

    A byte-level tokenizer of this family never merges across a single space between two other signs, so the ids of a
    text are those of its words, each with its leading space or line feed. Nor does it merge letters with the signs after
    them. Arrow splits a slice of texts and finds its distinct words, and the library encodes those not in memory.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        # A line feed before a space is a piece of its own and one id, which no piece without white space contains.
        (self.line_feed,) = self.tool.encode("\n", add_special_tokens=False).ids
        self.feed = array("H", [self.line_feed]).tobytes()
        self.words, self.ids = pa.array([], pa.string()), pa.array([], pa.binary())
        self.signs = byte_signs()
        self.pieces = self.piece_tool()
        if self.pieces is not None:
            # Every sign of a token stands for one byte.
            self.id_bytes = np.array([len(self.tool.id_to_token(i) or "") for i in range(1 << 16)])

    def piece_tool(self):
        """The same model for lines that each are one piece of letters, without the search for pieces. None where pieces
        of the tokenizer may end elsewhere."""
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Split

        tool, before = self.tool, self.tool.pre_tokenizer
        usual = isinstance(before, ByteLevel) and before.use_regex and not before.add_prefix_space and tool.normalizer is None
        inside = re.compile(f"{LETTERS}*{SIGNS}*")
        if not usual or any(inside.fullmatch(t.content) for t in tool.get_added_tokens_decoder().values()):
            return None
        pieces = Tokenizer(tool.model)
        pieces.pre_tokenizer = Split(self.signs[10], "removed")
        return pieces

    def encode(self, texts: pa.Array, end: bytes) -> list[bytes]:
        """Little-endian 16-bit ids of every text with `end` after it."""
        # Offsets of 64 bits, since a text may be longer than 32 bits allow once it is split.
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, ODD_SPACE)
        # A line feed before the whole text makes its first word one that begins a line.
        lines = pc.replace_substring(texts.filter(pc.invert(odd)), "\n", " \n")
        feed, nothing = (pa.scalar(t, pa.large_string()) for t in ("\n", ""))
        split = pc.split_pattern(pc.binary_join_element_wise(feed, lines, nothing), " ")
        loose = [SAFE_SPACE.split(t) for t in texts.filter(odd).to_pylist()]
        heads = self.tool.encode_batch_fast([p[0] for p in loose], add_special_tokens=False)
        rest = pa.array(itertools.chain.from_iterable(p[1:] for p in loose), pa.large_string())

        words = pa.concat_arrays([split.flatten(), rest]).dictionary_encode()
        found = self.of_words(words.dictionary.cast(pa.string())).cast(pa.large_binary()).take(words.indices)
        bounds = np.frombuffer(found.buffers()[1], np.int64)[found.offset :] if len(found) else np.zeros(1, np.int64)
        raw = memoryview(found.buffers()[2] or b"")
        cuts = bounds[split.offsets.to_numpy()].tolist()
        plain = (bytes(raw[a + 2 : b]) + end for a, b in itertools.pairwise(cuts))
        sizes = [len(split.flatten()), *(len(p) - 1 for p in loose)]
        cuts = bounds[np.cumsum(sizes)].tolist()
        other = (array("H", h.ids).tobytes() + bytes(raw[a:b]) + end for h, (a, b) in zip(heads, itertools.pairwise(cuts)))
        return [next(other if o else plain) for o in odd.to_pylist()]

    def of_words(self, words: pa.Array) -> pa.Array:
        """Ids of distinct words without the space before them; those that begin a line have a line feed before them."""
        if self.pieces is None:
            return self.remembered(words)
        parts = pc.extract_regex(words, TWO_PIECES)
        cores = pc.coalesce(pc.struct_field(parts, "core"), words).dictionary_encode()
        tails = pc.fill_null(pc.struct_field(parts, "tail"), "").dictionary_encode()
        ends = self.tool.encode_batch_fast(tails.dictionary.to_pylist(), add_special_tokens=False)
        ends = pa.array([array("H", e.ids).tobytes() for e in ends], pa.binary())
        cores_ids = self.remembered(cores.dictionary).take(cores.indices)
        return pc.binary_join_element_wise(cores_ids, ends.take(tails.indices), b"")

    def remembered(self, words: pa.Array) -> pa.Array:
        """Ids of distinct words; new ones are learned. A full memory keeps the words of this call."""
        places = np.full(len(words), -1)
        # The table of these words is the smaller one to build.
        met = pc.index_in(self.words, value_set=words)
        places[met.drop_null().to_numpy()] = np.flatnonzero(met.is_valid().to_numpy(zero_copy_only=False))
        new = words.filter(pa.array(places < 0))
        known, ids = pa.concat_arrays([self.words, new]), pa.concat_arrays([self.ids, self.learned(new)])
        places[places < 0] = np.arange(len(self.words), len(known))
        found = ids.take(pa.array(places))
        full = known.nbytes + ids.nbytes > CACHE_BYTES
        self.words, self.ids = (words, found) if full else (known, ids)
        return found

    def learned(self, words: pa.Array) -> pa.Array:
        """Ids of words by the library."""
        if self.pieces is None:
            return self.by_lines(words.to_pylist())
        one = pc.match_substring_regex(words, ONE_PIECE)
        both = pa.concat_arrays([self.by_pieces(words.filter(one)), self.by_lines(words.filter(pc.invert(one)).to_pylist())])
        first = one.to_numpy(zero_copy_only=False)
        places = np.where(first, np.cumsum(first), first.sum() + np.cumsum(~first)) - 1
        return both.take(pa.array(places))

    def by_pieces(self, words: pa.Array) -> pa.Array:
        """Words of letters, many to a call; where each ends is told by the bytes that its ids stand for."""
        starts = pc.starts_with(words, "\n")
        texts = pc.if_else(starts, pc.replace_substring(words, "\n", ""), pc.binary_join_element_wise(" ", words, ""))
        ids = array("H")
        listed = texts.to_pylist()
        for at in range(0, len(listed), 4096):
            lines = ["\n".join(listed[k : k + 64]) for k in range(at, min(at + 4096, len(listed)), 64)]
            lines = [codecs.charmap_decode(t.encode(), "strict", self.signs)[0] for t in lines]
            for one in self.pieces.encode_batch_fast(lines, add_special_tokens=False):
                ids.extend(one.ids)
        met = np.cumsum(self.id_bytes[np.frombuffer(ids, np.uint16)]) if ids else np.zeros(0, np.int64)
        due = np.cumsum(pc.binary_length(texts).to_numpy())
        cuts = np.searchsorted(met, due)
        if not np.array_equal(met[cuts], due) or len(met) != (cuts[-1] + 1 if len(cuts) else 0):
            raise ValueError("the ids of the words do not stand for their bytes")
        bounds = (2 * np.concatenate([[0], cuts + 1])).astype(np.int32)
        found = pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(bounds), pa.py_buffer(ids.tobytes())])
        return pc.binary_join_element_wise(pc.if_else(starts, self.feed, b""), found, b"")

    def by_lines(self, words: list[str]) -> pa.Array:
        """Any words, a thousand at a time with line feeds between them; those with other white space one by one."""
        strange = OTHER_SPACE.search("".join(words)) is not None
        odd = [w for w in words if not w or "\n" in w[1:] or strange and OTHER_SPACE.search(w)]
        known = dict.fromkeys(odd, b"")
        starts = [w for w in words if w not in known and w[0] == "\n"]
        inner = [w for w in words if w not in known and w[0] != "\n"]
        self.learn_joined(known, starts, "", [w[1:] for w in starts], self.feed)
        self.learn_joined(known, inner, " ", inner, b"")
        for word, one in zip(odd, self.tool.encode_batch_fast([" " + w for w in odd], add_special_tokens=False)):
            known[word] = array("H", one.ids).tobytes()
        return pa.array([known[w] for w in words], pa.binary())

    def learn_joined(self, known: dict[str, bytes], words: list[str], before: str, texts: list[str], prefix: bytes) -> None:
        glue = "\n" + before
        for at in range(0, len(words), 1000):
            joined = before + glue.join(texts[at : at + 1000]) + "\n"
            ids = np.array(self.tool.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u2")
            ends = np.flatnonzero(ids == self.line_feed)
            raw, cuts = ids.tobytes(), (2 * ends).tolist()
            starts = [0, *(c + 2 for c in cuts[:-1])]
            known.update(zip(words[at : at + 1000], [prefix + raw[a:b] for a, b in zip(starts, cuts)], strict=True))


def slices(batch: pa.RecordBatch, column: int, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts have about `size` bytes; a longer text is one of its own or ends its run."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64))
    start = done = 0
    while start < batch.num_rows:
        stop = max(int(np.searchsorted(ends, done + size, side="right")), start + 1)
        yield batch.slice(start, stop - start)
        start, done = stop, int(ends[stop - 1])


def tokenized(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """`doc_id`, `ids` (little-endian 16-bit, compressed), `n_tokens`; a narrow step."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        tool, pack = WordEncoder(tokenizer), zstandard.ZstdCompressor(level=1)
        end = np.array([end_id], "<u2").tobytes()
        for batch in it:
            for part in slices(batch, 1):
                raw = tool.encode(part.column(1), end)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([pack.compress(r) for r in raw], pa.binary()),
                        pa.array([len(r) // 2 for r in raw], pa.int64()),
                    ],
                    ["doc_id", "ids", "n_tokens"],
                )
            # Else a worker keeps the space of its slices for as long as it lives.
            pa.default_memory_pool().release_unused()

    return docs.select("doc_id", "text").mapInArrow(batches, f"doc_id {kind}, ids binary, n_tokens long")


def unpacked(column: pa.Array) -> Iterator[np.ndarray]:
    import zstandard

    tool = zstandard.ZstdDecompressor()
    for value in column:
        yield np.frombuffer(tool.decompress(value.as_buffer()), "<u2")


def id_counts(tokens: DataFrame) -> DataFrame:
    """`id`, `n` over all documents; every task sends one row per id at most."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in it:
            for ids in unpacked(batch.column(0)):
                total += np.bincount(ids, minlength=1 << 16)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["id", "n"])

    return tokens.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Lengths of an optimal prefix code with at most `limit` bits, by package-merge."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    if n > 1 << limit:
        raise ValueError("too many ids for the length limit")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    level, is_leaf = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        merged = np.concatenate([leaves, pairs])
        place = np.argsort(merged, kind="stable")
        level = merged[place]
        is_leaf.append(place < n)
    lengths = np.zeros(n, np.int64)
    take = 2 * n - 2
    for leaf in reversed(is_leaf):
        own = int(leaf[:take].sum())
        lengths[:own] += 1  # the smallest counts come first on every level
        take = 2 * (take - own)
    out = np.zeros(n, np.int64)
    out[order] = lengths
    return out


def canonical(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and lengths in canonical order, and the codes: ascending by (length, id)."""
    order = np.lexsort((ids, lengths))
    ids, lengths = ids[order].astype(np.int64), lengths[order].astype(np.int64)
    steps = np.left_shift(np.int64(1), MAX_BITS - lengths)
    starts = np.concatenate([[0], np.cumsum(steps)[:-1]]) if len(ids) else np.zeros(0, np.int64)
    return ids, lengths, starts >> (MAX_BITS - lengths)


class Coder:
    """Both directions of one codebook."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        ids, lengths, codes = canonical(ids, lengths)
        self.code = np.zeros(1 << 16, np.uint64)
        self.bits = np.zeros(1 << 16, np.int64)
        self.code[ids], self.bits[ids] = codes.astype(np.uint64), lengths
        spread = np.left_shift(1, MAX_BITS - lengths)
        self.symbol = np.zeros(1 << MAX_BITS, np.uint16)
        self.length = np.zeros(1 << MAX_BITS, np.int64)
        used = int(spread.sum())
        self.symbol[:used], self.length[:used] = np.repeat(ids, spread), np.repeat(lengths, spread)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Payload and the bit offset of every `STRIDE`-th token."""
        bits = self.bits[ids]
        ends = np.cumsum(bits)
        starts = ends - bits
        total = int(ends[-1]) if len(ids) else 0
        # Each code fits into the four bytes from the one in which it starts; codes that start in the same byte are joined first.
        shifted = (self.code[ids] << (32 - bits - (starts & 7)).astype(np.uint64)).astype(np.uint32)
        first = starts >> 3
        heads = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]])) if len(ids) else np.zeros(0, np.int64)
        words = np.bitwise_or.reduceat(shifted, heads) if len(ids) else np.zeros(0, np.uint32)
        out = np.zeros((total + 7) // 8 + 8, np.uint8)
        at = first[heads]
        for k in range(4):
            out[at + k] |= ((words >> np.uint32(24 - 8 * k)) & np.uint32(255)).astype(np.uint8)
        return out.tobytes(), starts[::STRIDE].astype(np.int64)

    def decode(self, payload: bytes, checkpoints: np.ndarray, n_tokens: int) -> np.ndarray:
        """All tokens; one lane per checkpoint, all lanes step together."""
        data = np.frombuffer(payload, np.uint8)
        at = checkpoints.astype(np.int64)
        out = np.zeros((STRIDE, len(at)), np.uint16)
        tail = n_tokens - STRIDE * (len(at) - 1) if len(at) else 0
        # The 32 bits from every byte on.
        wide = data.astype(np.uint32)
        window = (wide[:-3] << 24) | (wide[1:-2] << 16) | (wide[2:-1] << 8) | wide[3:]
        for k in range(min(STRIDE, n_tokens)):
            if k == tail:
                at = at[:-1]
            look = (window[at >> 3] >> (32 - MAX_BITS - (at & 7)).astype(np.uint32)) & np.uint32((1 << MAX_BITS) - 1)
            out[k, : len(at)] = self.symbol[look]
            at = at + self.length[look]
        return out.T.reshape(-1)[:n_tokens]


def write_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, block_tokens: int = BLOCK_TOKENS) -> None:
    """Encode `docs` (`doc_id`, `text`) into the files of `folder`."""
    spark = docs.sparkSession
    tokens = materialize(tokenized(docs, tokenizer, end_id))
    counts = id_counts(tokens).toPandas().sort_values("id")
    ids = counts["id"].to_numpy(np.int64)
    lengths = code_lengths(counts["n"].to_numpy(np.int64))
    book = spark.createDataFrame(list(zip(ids.tolist(), lengths.tolist())), "id int, length int")
    book.coalesce(1).write.parquet(f"{folder}/codebook")

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"shard int, block int, doc_ids array<{kind}>, n_tokens array<long>, checkpoints array<long>, payload binary"
    )

    def encode(it: Iterator[pa.RecordBatch], ids: np.ndarray, lengths: np.ndarray) -> Iterator[pa.RecordBatch]:
        coder, shard, block = Coder(ids, lengths), TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        names: list = []
        size = 0

        def flush() -> pa.RecordBatch:
            payload, checkpoints = coder.encode(np.concatenate(held))
            values = [[shard], [block], [names], [[len(h) for h in held]], [checkpoints], [payload]]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(values, kinds)],
                ["shard", "block", "doc_ids", "n_tokens", "checkpoints", "payload"],
            )

        kinds: list = []
        for batch in it:
            id_type = batch.schema.field(0).type
            kinds = [pa.int32(), pa.int32(), pa.list_(id_type), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            for name, one in zip(batch.column(0).to_pylist(), unpacked(batch.column(1))):
                held.append(one)
                names.append(name)
                size += len(one)
                if size >= block_tokens:
                    yield flush()
                    held, names, size, block = [], [], 0, block + 1
        if held:
            yield flush()

    ranged = (
        tokens.withColumn("_tie", F.xxhash64("ids"))
        .repartitionByRange("doc_id", "_tie")
        .sortWithinPartitions("doc_id", "_tie")
        .select("doc_id", "ids")
    )
    blocks = ranged.mapInArrow(functools.partial(encode, ids=ids, lengths=lengths), schema)
    # The payload does not compress any further.
    blocks.write.option("compression", "uncompressed").parquet(f"{folder}/blocks")


def read_codebook(spark: SparkSession, folder: str) -> tuple[np.ndarray, np.ndarray]:
    """At most one row per id of the vocabulary."""
    book = spark.read.parquet(f"{folder}/codebook").toPandas()
    return book["id"].to_numpy(np.int64), book["length"].to_numpy(np.int64)


def decoded(spark: SparkSession, folder: str, per_document, schema: str) -> DataFrame:
    """`shard`, `block`, `place`, `doc_id`, `n_tokens` and what `per_document(ids)` returns for every document of the files."""
    blocks = spark.read.parquet(f"{folder}/blocks")
    ids, lengths = read_codebook(spark, folder)
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def decode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(ids, lengths)
        for batch in it:
            for row in range(batch.num_rows):
                names, counts, points = (batch.column(k)[row].values for k in (2, 3, 4))
                counts = counts.to_numpy(zero_copy_only=False)
                tokens = coder.decode(batch.column(5)[row].as_py(), points.to_numpy(zero_copy_only=False), int(counts.sum()))
                ends = np.cumsum(counts)
                values = [per_document(tokens[e - n : e]) for n, e in zip(counts, ends)]
                n = len(names)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, batch.column(0)[row].as_py(), np.int32)),
                        pa.array(np.full(n, batch.column(1)[row].as_py(), np.int32)),
                        pa.array((ends - counts).astype(np.int64)),
                        names,
                        pa.array(counts.astype(np.int64)),
                        pa.array(values),
                    ],
                    ["shard", "block", "place", "doc_id", "n_tokens", schema.split()[0]],
                )

    columns = f"shard int, block int, place long, doc_id {kind}, n_tokens long, {schema}"
    return blocks.select("shard", "block", "doc_ids", "n_tokens", "checkpoints", "payload").mapInArrow(decode, columns)


def crc_of_ids(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def document_starts(spark: SparkSession, folder: str) -> DataFrame:
    """`shard`, `block`, `start`: tokens before each block in the order of the files.

    Shards are ordered by their first document; the window over all of them has one row per shard, that over blocks one
    group per shard.
    """
    one = F.col("n_tokens")
    blocks = spark.read.parquet(f"{folder}/blocks").select(
        "shard", "block", F.aggregate(one, F.lit(0).cast("long"), lambda a, x: a + x).alias("n"), F.col("doc_ids")[0].alias("first")
    )
    shards = blocks.groupBy("shard").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    ordered = W.orderBy(F.col("first").asc_nulls_first(), "shard")
    base = shards.select("shard", (F.sum("n").over(ordered) - F.col("n")).alias("base"))
    inside = W.partitionBy("shard").orderBy("block")
    placed = blocks.withColumn("inside", F.sum("n").over(inside) - F.col("n"))
    return placed.join(base, "shard").select("shard", "block", (F.col("base") + F.col("inside")).alias("start"))


def write_and_read(docs: DataFrame, tokenizer: str, end_id: int = 0, folder: str | None = None) -> DataFrame:
    """Write the files and return `doc_id`, `start`, `n_tokens`, `ids_crc32` of every document as read back from them."""
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_files(docs, folder, tokenizer, end_id)
    read = decoded(spark, folder, crc_of_ids, "ids_crc32 long")
    starts = document_starts(spark, folder).withColumnsRenamed({"shard": "_s", "block": "_b"})
    return read.join(starts, (F.col("shard") == F.col("_s")) & (F.col("block") == F.col("_b"))).select(
        "doc_id", (F.col("start") + F.col("place")).alias("start"), "n_tokens", "ids_crc32"
    )
