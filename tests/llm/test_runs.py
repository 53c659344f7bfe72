"""Periodic runs against brute force: LCE queries, runs, dropped words, and the registered query."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from assaylake.llm import queries, runs


def plain_runs(words):
    """All runs by their definition: rows ``(start, length, period)``."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if i > start and length >= max(6, 4 * q):
                found.setdefault((start, length), q)
            i += i == start
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_drop(words):
    drop = [False] * len(words)
    for start, length, q in plain_runs(words):
        for i in range(start + q, start + length):
            drop[i] = True
    return drop


def made(rng):
    out = []
    for _ in range(rng.randint(1, 6)):
        n, k = rng.choice([0, 1, 5, 6, 7, 30, 100, 300]), rng.choice([1, 2, 3, 20])
        text = [rng.randrange(k) for _ in range(n)]
        if n > 20 and rng.random() < 0.6:
            a = rng.randrange(n)
            p = 1 + rng.randrange(max(1, (n - a) // 3))
            text = [text[i] if i < a else text[a + (i - a) % p] for i in range(n)]
        out.append(np.array(text, dtype=np.int64))
    return out


def test_cover():
    assert {(a - b) % runs.MODULUS for a in runs.COVER for b in runs.COVER} == set(range(runs.MODULUS))


@pytest.mark.parametrize("seed", range(8))
def test_runs_against_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(30):
        texts = made(rng)
        for text, found in zip(texts, runs.runs_of(texts), strict=True):
            assert [tuple(r) for r in found.tolist()] == plain_runs(text.tolist())
            assert runs.dropped(len(text), found).tolist() == plain_drop(text.tolist())


@pytest.mark.parametrize("seed", range(4))
def test_extensions_against_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(10):
        array = np.concatenate([np.concatenate((t, [1000 + i])) for i, t in enumerate(made(rng))]).tolist()
        n = len(array)
        pairs = [(i, j) for i, j in ((rng.randrange(n), rng.randrange(n)) for _ in range(100)) if i != j]

        def plain(i, j, array=array, n=n):
            k = 0
            while max(i, j) + k < n and array[i + k] == array[j + k]:
                k += 1
            return k

        found = runs.CommonExtensions(np.array(array))
        if pairs:
            one, other = np.array(pairs).T
            assert found.common(one, other).tolist() == [plain(i, j) for i, j in pairs]


def test_long_texts():
    assert [r.tolist() for r in runs.runs_of([np.zeros(0, dtype=np.int64), np.zeros(20_000, dtype=np.int64)])] == [[], [[0, 20_000, 1]]]


def rebuilt(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def expected_row(doc_id, text):
    words = rebuilt(doc_id, text)
    found, drop = plain_runs(words), plain_drop(words)
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id, len(found), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
        digest("".join(f"{s},{n},{q}\n" for s, n, q in found)), digest(" ".join(w for w, d in zip(words, drop, strict=True) if not d)),
    )


def test_registered_query(llm, docs, tmp_path):
    """On a written table: nulls, empty and long texts, repeated rows, columns with clashing names, planted periods."""
    more = llm.createDataFrame([(f"a b c d e f {'g h ' * (i % 30)} {'x ' * (i % 9)} end", 1000 + i, "d", 1, "x") for i in range(120)], docs.schema)
    docs.where("length(coalesce(text, '')) < 9000").unionByName(more).write.parquet(f"{tmp_path}/documents.parquet")
    given = [(r.doc_id, r.text) for r in llm.read.parquet(f"{tmp_path}/documents.parquet").collect()]
    found = queries.QUERIES["op11_periodic_runs"](llm, str(tmp_path))
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in found.collect()), key=key) == sorted((expected_row(*g) for g in given), key=key)
    assert sum(r[1] > 0 for r in (expected_row(*g) for g in given)) > 50


def test_operator_keeps_rows(llm, docs, no_docs):
    found = runs.periodic_runs(docs).collect()
    assert len(found) == docs.count() and sum(r.doc_id is None for r in found) == 2
    assert all(r.collapsed == "" and r.runs == [] for r in found if r.n_words == 0)
    assert runs.periodic_runs(no_docs).count() == 0
