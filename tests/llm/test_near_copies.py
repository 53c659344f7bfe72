"""The near-duplicate stage of the pipeline against brute-force Jaccard similarity."""

import random
import tracemalloc

import pyarrow as pa
import pytest
from test_dedup import clashing, union

import corpus_pipeline
from assaylake.llm import jaccard_join, near_copies

FIELDS = "text string, doc_id long, digest string"


def plain_shingles(text, k=5):
    found = (text or "").encode().lower().split()
    return {tuple(found[i : i + k]) for i in range(max(1, len(found) - k + 1))} if found else set()


def plain_stay(texts):
    """The numbers of the texts that stay: the first of each group that pairs at 0.8 or more connect."""
    sets = [plain_shingles(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
    root = union(pairs, range(len(texts)))
    least = {}
    for i in range(len(texts)):
        least.setdefault(root[i], i)
    return set(least.values())


@pytest.fixture(scope="module")
def near_texts():
    """Copies with one to six changed words at similarities on both sides of 0.8, and one large group."""
    rng = random.Random(11)
    some = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    made = []
    for changes in [1, 2, 3, 4, 6] * 12:
        text = some(rng.randint(60, 160))
        made.append(text)
        copy = list(text)
        for place in rng.sample(range(len(copy)), changes):
            copy[place] = "changed"
        made.append(copy)
    text = some(200)
    for places in (rng.sample(range(200), rng.choice([1, 2, 5, 7])) for _ in range(80)):
        made.append([f"x{rng.randrange(10**6)}" if p in places else w for p, w in enumerate(text)])
    return [" ".join(t) for t in made] + ["Few words", "few  words", "", " ", None, "alone"]


def test_near_copies_against_brute_force(llm, near_texts):
    """Thin groups and a crowded one: exactly what brute force leaves."""
    df = llm.createDataFrame([(t, i, "d") for i, t in enumerate(near_texts)], FIELDS).repartition(3)
    kept = near_copies.near_dedup(df)
    assert kept.columns == df.columns
    expected = plain_stay(near_texts)
    assert {r.doc_id for r in kept.collect()} == expected and len(near_texts) - len(expected) > 70


def test_clashing_ids_lose_no_other_text(llm):
    words = [f"w{i}" for i in range(80)]
    near, far = " ".join(words), " ".join(reversed(words))
    rows = [(near, 1, "d"), (near + " end", 2, "d"), (far, 2, "d"), (near + " fin", 1, "d"), (near, None, "d"), (far + " x", None, "d")]
    found = near_copies.near_dedup(llm.createDataFrame(rows, FIELDS)).collect()
    assert sorted(r.text for r in found if r.doc_id is None) == sorted([near, far + " x"])
    stayed = [r.text for r in found if r.doc_id is not None]
    assert far in stayed and len(stayed) == 2


def test_stages_keep_each_text_once(llm, tmp_path):
    """Repeated rows and ids that texts share, through the stages of the pipeline before text is cut."""
    df, expected = clashing(llm)
    llm.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        stage(llm, df, str(tmp_path)).write.parquet(f"{tmp_path}/{number}")
        df = llm.read.parquet(f"{tmp_path}/{number}")
    assert sorted((r.text, r.doc_id) for r in df.collect()) == expected


def test_empty(no_docs):
    assert near_copies.near_dedup(no_docs).count() == 0


def test_what_simhash_links_is_not_compared_again(llm, monkeypatch):
    """The first comparisons are those of SimHash anchors, and the later ones leave out what these have connected."""
    rng, calls, anchors = random.Random(2), [], {}
    overlaps, anchored = jaccard_join.overlaps, near_copies._anchors

    def watched_overlaps(*args):
        found = overlaps(*args)
        calls.append([(r.a, r.b, r.linked) for r in found.collect()])
        return found

    def watched_anchors(*args):
        found = anchored(*args)
        for r in found.collect():
            anchors.setdefault(r.node, set()).add((r.family, r.anchor))
        return found

    monkeypatch.setattr(jaccard_join, "overlaps", watched_overlaps)
    monkeypatch.setattr(near_copies, "_anchors", watched_anchors)
    texts = []
    for changes in [1, 2, 3, 4] * 6:
        text = [f"w{rng.randrange(3000)}" for _ in range(150)]
        texts += [" ".join(text), " ".join([*text, "end"]), " ".join("changed" if i % (150 // changes) == 7 else w for i, w in enumerate(text))]
    near_copies.near_groups(llm.createDataFrame([(t, i, "d") for i, t in enumerate(texts)], FIELDS)).count()
    first, nodes = calls[0], sorted(anchors)
    assert any(linked for _, _, linked in first) and all(anchors[a] & anchors[b] for a, b, _ in first)
    place = {node: i for i, node in enumerate(nodes)}
    root = union([(place[a], place[b]) for a, b, linked in first if linked], range(len(nodes)))
    assert any(calls[1:]) and all(root[place[a]] != root[place[b]] for call in calls[1:] for a, b, _ in call)


def test_a_worker_keeps_no_words():
    """Texts of 120,000 different words: what a task of the near stage holds is the counts of buckets and little more."""

    class Texts:
        def mapInArrow(self, run, schema):
            self.run = run
            return self

    texts = [" ".join(f"w{400 * i + k}" for k in range(400)) for i in range(300)]
    batches = [pa.RecordBatch.from_arrays([pa.array([i] * 100), pa.array([i] * 100), pa.array(texts[i : i + 100])], ["doc_id", "key", "text"]) for i in (0, 100, 200)]
    run = jaccard_join.sets(Texts(), near_copies.WORDS).run
    tracemalloc.start()
    try:
        assert sum(len(b) for b in run(iter(batches))) >= 300
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 24e6
