"""The n-gram Jaccard join against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from test_dedup import union

from assaylake.llm import jaccard_join, queries

FIELDS = "text string, doc_id long, node string, n int, key string"


def plain_set(text):
    found = (text or "").encode().lower().split()
    return {tuple(found[i : i + 4]) for i in range(max(1, len(found) - 3))} if found else set()


def plain_groups(rows):
    """``(doc_id, n_shingles, component_id)`` of every ``(doc_id, text)``."""
    made = [plain_set(t) for _, t in rows]
    pairs = []
    for i, x in enumerate(made):
        for j in range(i):
            both = len(x & made[j])
            if both and 100 * both >= 85 * (len(x) + len(made[j]) - both):
                pairs.append((i, j))
    root = union(pairs, range(len(rows)))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root[k]] = min(least.get(root[k], i), i)
    return sorted(((i, len(made[k]), least.get(root[k])) for k, (i, _) in enumerate(rows)), key=str)


def changed(rng, text, places):
    out = list(text)
    for p in rng.sample(range(len(out)), places):
        out[p] = f"x{rng.randrange(10**6)}"
    return out


@pytest.fixture(scope="module")
def rows():
    """Pairs on both sides of 0.85, chains, a large group of near copies, shared passages, short and odd texts."""
    rng = random.Random(7)
    some = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    made, passage = [], some(60)
    for changes in [0, 1, 2, 3, 4, 5] * 6:
        text = some(rng.randint(60, 200))
        made += [text, changed(rng, text, changes)]
    chain = some(120)
    for _ in range(12):
        chain = changed(rng, chain, 1)
        made.append(chain)
    base = some(150)
    made += [changed(rng, base, rng.choice([0, 1, 1, 2, 3, 4, 6])) for _ in range(120)]
    other = base[:100] + some(50)  # shares much with the large group and is no part of it
    made += [changed(rng, other, rng.choice([0, 1])) for _ in range(15)]
    made += [some(rng.randint(5, 40)) + passage + some(rng.randint(5, 40)) for _ in range(40)] + [passage, passage + ["end"]]
    texts = [" ".join(t) for t in made]
    texts += ["One two", "one  TWO", "one two three four", "one two three four\n", None, "", " \t", "É one", "é one", "word " * 3000]
    out = [(i, t) for i, t in enumerate(texts)]
    return [*out, (3, texts[3]), (None, texts[5]), (None, "nothing like it at all"), (5, "another text under a known id"), (-4, texts[60])]


@pytest.fixture(scope="module")
def expected(rows):
    return plain_groups(rows)


def groups(llm, rows, parts=5):
    found = jaccard_join.jaccard_groups(llm.createDataFrame([(t, i, "a", 1, "k") for i, t in rows], FIELDS).repartition(parts))
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_against_brute_force(llm, rows, expected):
    assert groups(llm, rows) == expected


def test_lists_in_blocks_and_no_leaders(llm, rows, expected, monkeypatch):
    """Small blocks, texts asked for by a shuffle, and no relation between sets give the same."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    monkeypatch.setattr(jaccard_join, "LOOKUP", 0)
    monkeypatch.setattr(jaccard_join, "_KEYS", np.zeros(1, dtype=np.uint64) + np.uint64(3))
    assert groups(llm, rows) == expected


def test_sets(rows):
    hasher = jaccard_join.Hasher()
    for _, text in rows:
        assert len(hasher(text)) == len(plain_set(text))


def test_windows_give_the_same(rows, monkeypatch):
    whole = [jaccard_join.Hasher()(t).tolist() for _, t in rows]
    monkeypatch.setattr(jaccard_join, "WINDOW", 9)
    monkeypatch.setattr(jaccard_join, "KNOWN", 5)
    hasher = jaccard_join.Hasher()
    assert [hasher(t).tolist() for _, t in rows] == whole


def test_thresholds():
    for n in range(1, 300):
        for m in range(1, n + 1):
            least = next((o for o in range(m + 1) if 100 * o >= 85 * (n + m - o)), m + 1)
            assert min(jaccard_join.needed(n, m), m + 1) == least
        assert jaccard_join.prefix_size(n) == n - min(m for m in range(1, n + 1) if 100 * m >= 85 * n) + 1


def test_groups_stay_whole(monkeypatch):
    monkeypatch.setattr(jaccard_join, "GATHERED", 4)
    keys = [1] * 9 + [2, 3, 3, 3, 3, 3, 4]
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + 2]), pa.array(range(i, min(i + 2, 16)))], ["k", "v"]) for i in range(0, 16, 2)]
    found = list(jaccard_join._whole_groups(iter(batches), 1))
    assert np.concatenate([f[0] for f in found]).tolist() == keys
    assert all(a[0][-1] != b[0][0] for a, b in zip(found, found[1:], strict=False))


def test_registered_query(llm, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    given = [(r.doc_id, r.text) for r in docs.collect()]
    found = queries.QUERIES["op12_ngram_jaccard_join"](llm, str(tmp_path))
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain_groups(given)


def test_empty(llm, no_docs):
    assert jaccard_join.jaccard_groups(no_docs).count() == 0


def test_wide_bitmaps_never_exceed_the_difference():
    rng = np.random.default_rng(3)
    for n, m, both in ((1, 1, 0), (1, 1, 1), (300, 900, 200), (5000, 5200, 4900), (5000, 70, 0), (40_000, 41_000, 39_000)):
        values = np.unique(rng.integers(0, 1 << 63, n + m, dtype=np.uint64))
        one, other = values[:n], np.concatenate((values[:both], values[n : n + m - both]))
        wide = [np.frombuffer(jaccard_join.wide_parities(x), dtype=np.uint8) for x in (one, other)]
        apart = len(np.setxor1d(one, other))
        bound = jaccard_join.least_apart(*wide)
        assert bound == jaccard_join.least_apart(*wide[::-1]) and bound <= apart, (n, m, both)
        # Between sets of like sizes the bound is of use: much of the difference is seen.
        assert bound >= 0.4 * apart or m < n // 2 or n < 10, (n, m, both)


def test_lists_give_only_pairs_within_reach(llm, monkeypatch):
    """Copies of one text that are all just out of reach of each other: the lists do not give all pairs of them."""
    rng, given, plain = random.Random(5), [], jaccard_join.met
    base = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join(changed(rng, base, 2))) for i in range(200)]

    def watched(*args):
        found = plain(*args).checkpoint()
        given.append(found.count())
        return found

    monkeypatch.setattr(jaccard_join, "met", watched)
    assert groups(llm, rows) == plain_groups(rows)
    assert given and max(given) < 10 * len(rows)


def test_texts_hashed_together_give_the_same(rows, monkeypatch):
    """Also with texts that pass the window, nulls, empty ones, slices and words of any length."""
    given = [t for _, t in rows] + ["", "x" * 70 + " " + "X" * 70 + " " + "x" * 71, "12345678 123456789 1234567 a", None, " \n", "end"]
    hasher = jaccard_join.Hasher()
    for together, window in ((1 << 18, 1 << 20), (50, 400), (1, 1)):
        monkeypatch.setattr(jaccard_join, "TOGETHER", together)
        monkeypatch.setattr(jaccard_join, "WINDOW", window)
        found = [x.tolist() for hashes, each in hasher.each(pa.array(["cut off", *given]).slice(1)) for x in np.split(hashes, np.cumsum(each)[:-1])]
        assert found == [hasher(t).tolist() for t in given]
        assert [len(x) for x in found] == [len(plain_set(t)) for t in given]


def test_one_pair_of_two_components_leaves_the_lists(llm):
    """Thirty sets of each of two components that all meet: one pair, not nine hundred, in however many lists."""
    rows = [(token, node, node % 2, 100, 100, 100) for token in (7, 8, 9) for node in range(60)]
    lists = llm.createDataFrame(rows, "token long, leader long, comp long, low int, high int, rest int").repartition(3)
    spans = llm.createDataFrame([(node, 0, 100, [node] + [0] * 7) for node in range(60)], "node long, off long, high int, bits array<long>")
    assert jaccard_join.met(lists, spans, 85).count() == 900
    (found,) = jaccard_join.met(lists, spans, 85, True).collect()
    assert (found.low, found.high, found.more) == (0, 1, True) and bin(found.a ^ found.b).count("1") == 1


def test_small_tasks_see_common_n_grams(llm):
    """An n-gram that each of many small tasks sees twice is known as a common one."""
    texts = [(i, i, "a b c d" if i % 3 == 0 else f"t{i} u v w{i} x y{i}") for i in range(120)]
    made = jaccard_join.sets(llm.createDataFrame(texts, "doc_id long, key long, text string").repartitionByRange(20, "doc_id"))
    bucket = int(jaccard_join.Hasher()("a b c d")[0] >> np.uint64(43))
    assert made.where(f"bucket = {bucket}").groupBy().sum("seen").first()[0] >= 30
