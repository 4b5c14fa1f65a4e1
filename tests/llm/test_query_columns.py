"""The columns of the queries themselves, recomputed in plain Python on the smallest tables; the pipeline on odd and no rows."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import TESTDATA
from odd_rows import ODD

import corpus_pipeline
from weekband.llm import queries as q

SMALL = str(TESTDATA / "sf0.001")

pytestmark = pytest.mark.skipif(not TESTDATA.exists(), reason="test tables are not here")


def documents(spark):
    """(doc_id, text, source) in the order of ids."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "source").collect()
    return sorted((tuple(r) for r in docs), key=lambda r: r[0])


def test_columns_of_repeated_strings(spark):
    seen, expected = set(), {}
    for doc_id, text, _ in documents(spark):
        raw = (text or "").encode()
        covered = np.zeros(len(raw) + 1, int)
        for at in range(len(raw) - 99):
            piece = raw[at : at + 100]
            if piece in seen:
                covered[at] += 1
                covered[at + 100] -= 1
            seen.add(piece)
        gone = np.cumsum(covered)[:-1] > 0
        spans = int(np.sum(gone & ~np.concatenate([[False], gone[:-1]])))
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        expected[doc_id] = (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    found = q.QUERIES["op2_repeated_strings"](spark, SMALL).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert {r[0]: tuple(r[1:]) for r in found} == expected and len(found) == len(expected)


def test_columns_of_secrets(spark):
    kinds = [
        ("assign", r"(?i:(?:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 12),
        ("access", r"AKIA[A-Z0-9]+", 0, 18),
        ("hex", r"[0-9a-f]+", 0, 16),
    ]
    expected = {}
    for doc_id, text, _ in documents(spark):
        hits = [
            (m.start(), k, m.end()) for k, (_, rule, group, least) in enumerate(kinds) for m in re.finditer(rule, text or "") if len(m[group]) >= least
        ]
        joined = ",".join(f"{kinds[k][0]}:{a}:{b}" for a, k, b in sorted(hits))
        n = Counter(k for _, k, _ in hits)
        expected[doc_id] = (n[0], n[1], n[2], hashlib.sha256(joined.encode()).hexdigest())
    found = q.QUERIES["op5_secrets"](spark, SMALL).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256").collect()
    assert {r[0]: tuple(r[1:]) for r in found} == expected and len(found) == len(expected)


def test_columns_of_the_mixture(spark):
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in documents(spark)}
    source = {i: s for i, _, s in documents(spark)}
    total = Counter()
    for i, n in sizes.items():
        total[source[i]] += n
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + at % 3 for at, s in enumerate(names)}
    capped: set = set()
    while True:
        rest = sum(total.values()) - sum(3 * total[s] for s in capped)
        target = {s: 3.0 * total[s] if s in capped else rest * weight[s] / sum(weight[o] for o in names if o not in capped) for s in names}
        over = {s for s in names if target[s] > 3 * total[s]}
        if not over:
            break
        capped |= over
    taken = Counter()
    found = q.QUERIES["op9_mixture"](spark, SMALL).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert len(found) == len(sizes)
    for doc_id, size, source_size, goal, took in found:
        name = source[doc_id]
        assert (size, source_size) == (sizes[doc_id], total[name]) and abs(goal - target[name]) <= 1e-9 * goal
        assert 0 <= took <= 3 * size and (size == 0 or took % size == 0)
        taken[name] += took
    assert all(abs(taken[s] - target[s]) <= 3 for s in names)


def test_columns_of_token_files(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    expected, start = {}, 0
    for doc_id, text, _ in documents(spark):
        ids = [*tool.encode(text or "", add_special_tokens=False).ids, 0]
        expected[doc_id] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    found = q.QUERIES["op10_token_files"](spark, SMALL).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert {r[0]: tuple(r[1:]) for r in found} == expected and len(found) == len(expected)


@pytest.mark.parametrize("pairs", [ODD, []], ids=["odd", "empty"])
def test_pipeline_of_odd_and_no_rows(spark, tmp_path, pairs):
    """Odd documents beside good ones leave gapless places in the token files; an empty table gives an empty result."""
    given = spark.read.parquet(f"{SMALL}/documents.parquet")
    values = {"doc_id": 0, "text": 1}
    rows = [tuple(p[values[c]] if c in values else None for c in given.columns) for p in pairs]
    odd = spark.createDataFrame(rows, given.schema)
    (odd.unionByName(given) if pairs else odd).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SMALL}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "n_tokens").collect()
    if not pairs:
        assert found == []
        return
    places = sorted((r["start"], r["n_tokens"]) for r in found)
    ends = np.cumsum([n for _, n in places])
    assert len(found) > 50 and [s for s, _ in places] == [0, *ends[:-1].tolist()]
