"""Exact, SimHash and suffix-array deduplication against plain versions."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from assaylake.llm import exact_dedup, simhash, suffix_arrays, suffix_dedup
from assaylake.llm.components import components


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("support", [0.001, 0.05, 0.9])
def test_exact_groups(docs, support):
    found = rows(exact_dedup.exact_groups(docs, support=support))
    given = [(r.doc_id, r.text or "") for r in docs.collect()]
    groups = defaultdict(list)
    for doc_id, text in given:
        groups[hashlib.sha256(re.sub("[\x20\x09-\x0d]", "", text).encode()).hexdigest()].append((-len(text), doc_id is None, doc_id))
    assert sorted((r[0] is None, r[0] or 0, r[4]) for r in found) == sorted(
        (i is None, i or 0, hashlib.sha256(re.sub("[\x20\x09-\x0d]", "", t).encode()).hexdigest()) for i, t in given
    )
    for doc_id, keep_id, size, kept, digest in found:
        assert size == len(groups[digest]) and keep_id == min(groups[digest])[2]
        assert not kept or doc_id == keep_id
    assert sum(r[3] for r in found) == len(groups)


def test_exact_dedup_keeps_columns_and_rows_without_id(docs):
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns
    assert kept.where("doc_id is null").count() == 2


def plain_fingerprint(text, k=3):
    found = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not found:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(found[i : i + k]), 42) for i in range(max(1, len(found) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint(texts, monkeypatch):
    expected = [plain_fingerprint(t) for t in texts]
    assert [simhash.fingerprint(t) for t in texts] == expected
    monkeypatch.setattr(simhash, "WINDOW", 7)  # windows of a few bytes give the same
    assert [simhash.fingerprint(t) for t in texts] == expected


def union(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    return {n: find(n) for n in nodes}


def test_links_are_complete(llm):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, 30, dtype=np.int64)
    values = set(centres.tolist())
    for c in centres.tolist():
        for _ in range(40):
            flips = rng.integers(0, 64, rng.integers(1, 4))
            for f in flips.tolist():
                c ^= (1 << f) if f < 63 else -(1 << 63)
            values.add(c)
    values = sorted(values)
    found = rows(simhash.links(llm.createDataFrame([(v,) for v in values], "fingerprint long")))
    plain = {(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if bin((a ^ b) & (2**64 - 1)).count("1") <= 2}
    assert len(found) == len(set(found)) and set(found) == plain


def test_near_groups(docs):
    found = rows(simhash.near_groups(docs))
    given = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.collect()]
    prints = {f for _, f in given}
    root = union([(a, b) for a in prints for b in prints if a < b and bin(a ^ b).count("1") <= 2], prints)
    least = {}
    for doc_id, f in given:
        if doc_id is not None:
            least[root[f]] = min(least.get(root[f], doc_id), doc_id)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(found, key=key) == sorted(((i, f"{f:016x}", least.get(root[f])) for i, f in given), key=key)


def test_near_dedup_keeps_one_of_each_group(docs):
    groups = {r.component_id for r in simhash.near_groups(docs.where("doc_id is not null")).collect()}
    kept = simhash.near_dedup(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.where("doc_id is not null").collect()} == groups
    assert kept.where("doc_id is null").count() == 2


def test_components_of_chains_and_stars(llm):
    pairs = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5001), (5001, 5000), (7, 7)]
    found = dict(rows(components(llm.createDataFrame(pairs, "a long, b long"))))
    expected = union(pairs, {x for p in pairs for x in p})
    same = defaultdict(set)
    for node, root in found.items():
        same[root].add(expected[node])
    assert len(found) == len(expected) and all(len(x) == 1 for x in same.values()) and len(same) == 3
    assert components(llm.createDataFrame([], "a long, b long")).count() == 0


def plain_repeats(given, size=50):
    """Removed bytes of each row: strings that start in a document with a smaller id."""
    first = {}
    big = float("inf")
    for doc_id, data in given:
        for p in range(len(data) - size + 1):
            gram = data[p : p + size]
            first[gram] = min(first.get(gram, big), big if doc_id is None else doc_id)
    out = []
    for doc_id, data in given:
        mark = np.zeros(len(data), dtype=bool)
        for p in range(len(data) - size + 1):
            if first[data[p : p + size]] < (big if doc_id is None else doc_id):
                mark[p : p + size] = True
        out.append((doc_id, mark))
    return out


@pytest.mark.parametrize("settings", [{}, {"block": 2000, "shard": 4000}, {"block": 3000, "hot": 0}])
def test_repeated_spans(docs, settings, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "ARRAY", 3000)  # several suffix arrays for a shard
    found = rows(suffix_dedup.repeated_spans(docs, **settings))
    given = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    expected = []
    for (doc_id, mark), (_, data) in zip(plain_repeats(given), given, strict=True):
        edges = np.flatnonzero(np.diff(np.concatenate(([0], mark.astype(int), [0])))).tolist()
        spans = list(zip(edges[::2], edges[1::2], strict=True))
        expected.append((doc_id, len(data), spans, np.frombuffer(data, dtype=np.uint8)[~mark].tobytes()))
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    made = [(a, b, [tuple(s) for s in c], bytes(d)) for a, b, c, d in found]
    assert sorted(made, key=key) == sorted(expected, key=key)


def test_without_repeats_keeps_columns(docs):
    made = suffix_dedup.without_repeats(docs)
    assert made.dtypes == docs.dtypes and made.count() == docs.count()
    texts = {r.doc_id: r.text for r in made.collect()}
    assert texts[40] == "" or len(texts[40].encode()) < 50  # a copy of document 0


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(2)
    for alphabet in (2, 5, 250):
        text = rng.integers(0, alphabet, 700)
        order, rank = suffix_arrays.suffix_array(text)
        plain = sorted(range(len(text)), key=lambda i: text[i:].tolist())
        assert order.tolist() == plain and (rank[order] == np.arange(len(text))).all()
        starts, lengths = np.array([0, 300]), np.array([250, 400])
        common = suffix_arrays.common_prefixes(text, order, rank, starts, lengths, 6)
        for place in [*range(250), *range(300, 700)]:
            at = int(rank[place])
            other = plain[at - 1] if at else None
            n = 0
            while other is not None and n < 6 and max(place, other) + n < len(text) and text[place + n] == text[other + n]:
                n += 1
            assert common[place] == n


def test_merging_by_binary_search():
    rng = np.random.default_rng(8)
    rows_of = lambda n: np.unique(rng.integers(0, 4, (n, 3)).astype(np.uint64), axis=0)
    a, b = rows_of(30), rows_of(40)
    made = suffix_arrays.merged(suffix_arrays.Grams(a, np.arange(len(a))), suffix_arrays.Grams(b, 100 + np.arange(len(b))))
    assert (made.words == np.unique(np.concatenate([a, b]), axis=0)).all()
    expected = {tuple(r): i for r, i in [*zip(b.tolist(), 100 + np.arange(len(b)), strict=True), *zip(a.tolist(), range(len(a)), strict=True)] for r in [tuple(r)]}
    assert [expected[tuple(r)] for r in made.words.tolist()] == made.smallest.tolist()


def test_empty_tables(no_docs):
    assert exact_dedup.exact_groups(no_docs).count() == 0
    assert simhash.near_groups(no_docs).count() == 0
    assert suffix_dedup.repeated_spans(no_docs).count() == 0
    assert suffix_dedup.without_repeats(no_docs).columns == no_docs.columns


def clashing(spark):
    """Repeated rows and ids that several texts share; each group of equal texts and the text that stays."""
    made = [("twice", 1), ("twice", 1), ("x y", 2), ("alone", 2), ("xy", 1), ("xy", 0), ("a b", 3), ("a\nb", 3), ("ab", 4), ("often", 5)]
    made += [("often", 5)] * 20 + [("twice", 6), ("no id", None), ("no id", None)]
    df = spark.createDataFrame([(t, i, "d") for t, i in made], "text string, doc_id long, digest string").repartition(3)
    return df, [("a\nb", 3), ("alone", 2), ("no id", None), ("no id", None), ("often", 5), ("twice", 1), ("x y", 2)]


def test_exact_dedup_keeps_each_text_once(llm, docs):
    df, expected = clashing(llm)
    assert sorted((r.text, r.doc_id) for r in exact_dedup.exact_dedup(df).collect()) == expected
    plain = lambda t: re.sub("[\x20\x09-\x0d]", "", t or "")
    kept = [plain(r.text) for r in exact_dedup.exact_dedup(docs).where("doc_id is not null").collect()]
    assert len(kept) == len(set(kept)) and set(kept) == {plain(r.text) for r in docs.where("doc_id is not null").collect()}


def test_minimizers_are_counted_in_full(llm):
    """A minimizer of one block only becomes hot by its real number of segments, not by 127 of a block."""
    rng = np.random.default_rng(6)
    some = lambda: "".join(chr(c) for c in rng.integers(97, 123, 60))
    given = [(some() + "one string in many documents" + some(), i) for i in range(400)]
    stored = suffix_dedup.blocks(llm.createDataFrame(given, "text string, doc_id long").coalesce(1), "text", "doc_id")
    row = stored.collect()
    assert len(row) == 1
    names, count = np.unique(suffix_dedup.Block(row[0].texts, row[0].sizes).segments()[2], return_counts=True)
    assert count.max() > 300
    shared = suffix_dedup.minimizers(stored, 3).groupBy("bucket").applyInArrow(suffix_dedup._compare(300), "block long, shared binary")
    data = np.concatenate([np.frombuffer(r.shared, dtype=np.uint8).reshape(-1, 7) for r in shared.collect()])
    found = suffix_dedup._from_six(data[:, :6])[data[:, 6] > 0]
    assert sorted(found.tolist()) == sorted(names[count > 300].tolist())
