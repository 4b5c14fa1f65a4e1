"""Language identification by compression.

A text compresses best with a dictionary of its own language. For every language a raw-content
zstandard dictionary is cut from a bounded sample of labelled documents; a text is then compressed
with each of them, piece by piece so that the dictionary and not the text itself does the
work, and the language with the smallest total wins. Where the second best is nearly as small the
prediction is marked as rejected.

Bounds, all parameters: `docs_per_language` sampled documents, spread over the corpus by hash, `chars_per_doc` of each, and
`dict_bytes` of dictionary per language. The dictionaries are the only thing that reaches the driver and the tasks.

Defined results: a NULL text, an empty one and one without a letter is `und` with score 0; without training rows every text is `und`; ties go to the
language first in code point order; repeated rows are judged alike; an empty table gives an empty result;
other columns of the input are ignored. A text is read whole, however long.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekband.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

UNKNOWN = "und"
#: ASCII signs that are no letters become spaces.
ONLY_LETTERS = bytes(b if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
PIECE = 4096


def plain(text: str | None) -> bytes:
    """The text in lower case with single spaces for all ASCII signs but letters; empty if it has no letter."""
    lower = (text or "").lower()
    body = b" ".join(lower.encode("utf-8", "replace").translate(ONLY_LETTERS).split())
    if body.isascii() or any(c.isalpha() for c in lower):
        return body
    return b""


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept out of training; a NULL id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def sample(labelled: DataFrame, docs_per_language: int, chars_per_doc: int) -> DataFrame:
    """`lang`, `text`: at most `docs_per_language` documents of each language, chosen by hash, and of longer
    texts `chars_per_doc` characters from a place that the hash of the id gives.

    Each language has that many slots; a slot keeps the document with the smallest hash, so a frequent
    language costs one aggregation with partial sums like any other.
    """
    rank = F.xxhash64("doc_id", F.lit("sample"))
    keyed = labelled.withColumn("_h", rank).withColumn("_slot", F.pmod(F.xxhash64("doc_id"), F.lit(docs_per_language)))
    # Written first: its size is then known, and small, so no text moves to meet it.
    chosen = materialize(keyed.groupBy("lang", "_slot").agg(F.min("_h").alias("_h")))
    # One text per slot, even if a document id occurs often; only a part of it moves.
    places = F.greatest(F.length("text") - chars_per_doc, F.lit(0)) + 1
    part = F.substr("text", (F.pmod(F.xxhash64("doc_id", F.lit("place")), places) + 1).cast("int"), F.lit(chars_per_doc))
    found = keyed.join(chosen, ["lang", "_slot", "_h"], "left_semi").withColumn("text", part)
    return found.groupBy("lang", "_slot").agg(F.min("text").alias("text"))


def dictionaries(rows: list[tuple[str, str]], dict_bytes: int, least_share: int) -> dict[str, bytes]:
    """Raw content per language: the same share of every sampled text, words that many texts use at the end.

    The share is `dict_bytes` over the number of texts, `least_share` at least, and begins at a word at a place that the text's checksum gives,
    so common beginnings do not fill the dictionary. zstandard finds what stands near the end of a dictionary most cheaply.
    """
    texts: dict[str, list[bytes]] = {}
    for lang, text in rows:
        body = plain(text)
        if body:
            texts.setdefault(lang, []).append(body)
    out = {}
    for lang, bodies in texts.items():
        share = max(least_share, dict_bytes // len(bodies))
        seen: dict[bytes, int] = {}
        for body in bodies:
            for word in set(body.split()):
                seen[word] = seen.get(word, 0) + 1
        common = sorted((w for w, n in seen.items() if n > 1), key=lambda w: (seen[w], w))[-dict_bytes // 32 :]
        out[lang] = (b" ".join(running_part(b, share) for b in bodies)[:dict_bytes] + b" " + b" ".join(common))[-dict_bytes - dict_bytes // 4 :]
    return out


def running_part(body: bytes, share: int) -> bytes:
    """About `share` bytes of running text, from the first word that begins after a place given by the checksum of the text."""
    at = zlib.crc32(body) % (max(len(body) - share, 0) + 1)
    return body[body.find(b" ", at - 1) + 1 if at else 0 :][:share]


class Compressor:
    """Sizes of texts under each language's dictionary, by a fast level and, where that leaves a narrow margin, a strong one."""

    def __init__(self, contents: dict[str, bytes], levels: tuple[int, int], narrow: float):
        self.langs = sorted(contents)
        self.narrow = narrow
        self.fast, self.strong = ([self.tool(contents[lang], level) for lang in self.langs] for level in levels)

    @staticmethod
    def tool(content: bytes, level: int) -> zstandard.ZstdCompressor:
        raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        raw.precompute_compress(level=level)
        return zstandard.ZstdCompressor(dict_data=raw, write_content_size=False, write_checksum=False, write_dict_id=False)

    @staticmethod
    def sizes(tools: list[zstandard.ZstdCompressor], body: bytes) -> np.ndarray:
        pieces = [body[at : at + PIECE] for at in range(0, len(body), PIECE)]
        return np.array([float(sum(len(tool.compress(piece)) for piece in pieces)) for tool in tools])

    def predict(self, text: str | None, margin: float) -> tuple[str, float, bool]:
        """Language, score and whether the margin is too narrow."""
        body = plain(text)
        if not body or not self.langs:
            return UNKNOWN, 0.0, True
        sizes = self.sizes(self.fast, body)
        if self.saving(sizes) < self.narrow:
            sizes = self.sizes(self.strong, body)
        best = int(np.argmin(sizes))
        # Every byte less than another language halves the odds of that one.
        score = 1 / np.exp2(np.maximum(sizes.min() - sizes, -60)).sum()
        return self.langs[best], float(score), self.saving(sizes) < margin

    @staticmethod
    def saving(sizes: np.ndarray) -> float:
        """What the best language saves against the second, as a share of its own size."""
        first, *others = np.sort(sizes)[:2]
        return (others[0] - first) / max(first, 16.0) if others else 1.0


def predict(
    docs: DataFrame,
    labelled: DataFrame,
    docs_per_language: int = 400,
    chars_per_doc: int = 4096,
    dict_bytes: int = 96 * 1024,
    least_share: int = 64,
    levels: tuple[int, int] = (3, 12),
    narrow: float = 0.06,
    margin: float = 0.02,
) -> DataFrame:
    """`doc_id`, `lang_pred`, `score`, `rejected` for every row of `docs` (`doc_id`, `text`).

    `labelled` has `doc_id`, `text` and `lang`; rows without a language are left out. Of each language `docs_per_language` texts are a sample, of
    each `chars_per_doc` characters give words and `max(least_share, dict_bytes / texts)` bytes go into the dictionary as running text. `margin` is the least
    saving against the second language, as a share of the compressed size, that is not rejected; `narrow` is the saving under
    which the stronger of the two zstandard `levels` decides.
    """
    train = labelled.where("lang IS NOT NULL AND text IS NOT NULL")
    picked = sample(train, docs_per_language, chars_per_doc)
    rows = [(r["lang"], r["text"]) for r in picked.orderBy("lang", "_slot").collect()]
    contents = dictionaries(rows, dict_bytes, least_share)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Compressor(contents, levels, narrow)
        for batch in it:
            found = [tool.predict(t.as_py(), margin) for t in batch.column(1)]
            lang, score, weak = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(weak, pa.bool_())],
                ["doc_id", "lang_pred", "score", "rejected"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(batches, f"doc_id {kind}, lang_pred string, score double, rejected boolean")
