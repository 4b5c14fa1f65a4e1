"""Collocations and spelling variants against brute force, odd rows, and what their methods promise."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import TESTDATA
from odd_rows import ODD, docs_of

from weekband.llm import collocations, spellings
from weekband.llm import queries as q

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def all_phrases(docs, support):
    """Collocations by counting everything."""
    f, n = Counter(), Counter()
    for lang, text in docs:
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOW)):
            w = re.findall(r"[^ \t]+", piece)
            n[lang or "und"] += len(w)
            f.update((lang or "und", tuple(w[i : i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    often = {p: c for p, c in f.items() if len(p[1]) > 1 and c >= support}
    held = {}
    for (lang, w), c in often.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                key = (lang, w[i : i + m])
                held[key] = max(held.get(key, 0), c)
    out = {}
    for (lang, w), a in often.items():
        if held.get((lang, w), 0) >= a:
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]], n[lang]))
    return {
        (lang, i, p.decode(), -a, left, right, n, -s)
        for lang, v in out.items()
        for i, (s, a, p, left, right, n) in enumerate(sorted(v)[:2000], 1)
    }


def found(df):
    return {tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}


def phrase_docs(seed, n=600):
    draw = random.Random(seed)
    words = ["To", "be", "or", "not", "é́t", "ÉT", "漢字", "x", "that's", "-"]
    gaps = [" ", " ", " ", " ", "  ", "\t", ", ", ".", "!\n", "\r\n", " \x0b", " "]
    rows = []
    for i in range(n):
        text = "".join(draw.choice(words) + draw.choice(gaps) for _ in range(draw.randint(0, 60)))
        rows.append((draw.choice(["en", "fr", None]), text if draw.random() < 0.9 else draw.choice([None, "", "to be or not to be to be"])))
    return rows


def test_phrases_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(collocations, "RANGE_ENTRIES", 50)  # several ranges
    rows = phrase_docs(1)
    docs = spark.createDataFrame([(i, t, g) for i, (g, t) in enumerate(rows)], "doc_id long, text string, lang string")
    expected = all_phrases(rows, 10)
    assert len(expected) > 100
    assert found(collocations.collocations(docs.repartition(5), support=10)) == expected


def test_no_frequent_phrase_is_below_every_local_support():
    """SON: with supports by share of words, a phrase that misses all of them is below the global one."""
    draw = random.Random(3)
    for _ in range(2000):
        own = [draw.randint(1, 1000) for _ in range(collocations.SHARDS)]
        support = draw.randint(1, 200)
        local = [-(-support * x // sum(own)) for x in own]
        assert sum(t - 1 for t in local) < support


def test_phrases_of_odd_rows(spark):
    docs = docs_of(spark, ODD)
    got = found(collocations.collocations(docs, support=3))
    assert got == all_phrases([("en", t) for _, t in ODD], 3)
    assert found(collocations.collocations(docs.limit(0))) == set()


def all_variants(docs):
    n = Counter()
    for i, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    one_off = lambda a, b: abs(len(a) - len(b)) <= 1 and a != b and edits(a, b)
    near = {a: [b for b in n if one_off(a, b)] for a in n}
    form = {}
    for a in n:
        best = min(near[a], key=lambda b: (-n[b], b), default=None)
        form[a] = best if best and n[best] >= 2 * n[a] else None
    out = set()
    for a in n:
        root = a
        while form[root]:
            root = form[root]
        out.add((a, form[a], root, n[a], len(near[a]), n[form[a]] if form[a] else None))
    return out


def edits(a, b):
    a, b = sorted((a, b), key=len)
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def variant_docs(seed, n=200):
    draw = random.Random(seed)
    base = ["color", "house", "naïveté", "ÿæøåß", "running", "aaaaaa", "abcde"]
    rows = []
    for i in range(n):
        words = []
        for _ in range(draw.randint(0, 30)):
            w = draw.choice(base)
            for _ in range(draw.choice([0, 0, 0, 1, 1, 2])):
                p = draw.randrange(len(w))
                w = draw.choice([w[:p] + w[p + 1 :], w[:p] + draw.choice("abeéÿx") + w[p:], w[:p] + draw.choice("aoé") + w[p + 1 :]])
            words.append(draw.choice([w, w.upper(), w.capitalize()]))
        rows.append((i, draw.choice([" ", "3", "Ā", "–", "\n", "×"]).join(words)))
    return rows


@pytest.mark.parametrize("parts", [(1, 4), (2, 3), (1, 3)])
def test_variants_equal_brute_force(spark, monkeypatch, parts):
    monkeypatch.setattr(spellings, "FIRST", parts[0])
    monkeypatch.setattr(spellings, "SECOND", parts[1])
    rows = variant_docs(parts[1])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = all_variants(rows)
    assert sum(r[1] is not None for r in expected) > 50
    got = {tuple(r) for r in spellings.variants(docs.repartition(3)).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == expected


@pytest.mark.parametrize("parts", [(1, 4), (1, 5), (2, 3), (2, 4), (3, 1)])
def test_near_multisets_share_a_signature(parts):
    draw = random.Random(7)
    pairs = []
    for _ in range(3000):
        a = "".join(draw.choice("aabcdeé") for _ in range(draw.randint(2, 12)))
        p = draw.randrange(len(a))
        b = draw.choice([a[:p] + a[p + 1 :], a[:p] + "z" + a[p:], a[:p] + "a" + a[p + 1 :]])
        pairs.append((a, "".join(draw.sample(b, len(b)))))
    one, two = (spellings.signatures([p[i] for p in pairs], *parts) for i in (0, 1))
    assert (one == two).any(axis=1).all()
    far = spellings.signatures(["abcdefgh"], *parts) == spellings.signatures(["ijklmnop"], *parts)
    assert not far.any()


def test_variants_of_odd_rows(spark):
    docs = docs_of(spark, ODD)
    got = {tuple(r) for r in spellings.variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == all_variants(ODD)
    assert spellings.variants(docs.limit(0)).count() == 0


def test_long_chain_of_forms(spark):
    """Counts that double from word to word: the root is the last one."""
    words = ["aaaaa", "aaaab", "aaabb", "aabbb", "abbbb", "bbbbb"]
    forms = spark.createDataFrame([(a, b) for a, b in zip(words, words[1:], strict=False)], "word string, form string")
    assert {r["word"]: r["root"] for r in spellings.roots(forms, 3 * 2**5).collect()} == {w: "bbbbb" for w in words[:-1]}


def test_runs_are_letters_of_two_byte_rows():
    texts = pa.array(["aÀÿ×b", "Āa", None, "éÉ̀x"])
    batch = pa.table({"key": ["1:", "2:", "3:", "4:"], "text": texts}).to_batches()
    out = pa.Table.from_batches(spellings.count_runs(10**12, iter(batch)))
    assert out.num_rows == 1 and out.column("word")[0].as_py() == "aÀÿ×b" and np.all(out.column("n").to_numpy() == 1)


@pytest.mark.skipif(not TESTDATA.exists(), reason="test tables are not here")
def test_spelling_query(spark):
    folder = str(TESTDATA / "sf0.001")
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = {tuple(r) for r in q.spelling_variants(spark, folder).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == all_variants(docs)
