"""Quality, chat and search against plain versions and held-out rows."""

import itertools
import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from assaylake.llm import chat, quality, topk

LABELS = "doc_id long, quality int, toxic int"


def plain_counts(texts):
    out = {}
    for text in texts:
        tokens = re.findall(r"\w+|[^\w\s]+", (text or "").lower())
        tokens += ["= ="] * sum(a == b == c for a, b, c in zip(tokens, tokens[1:], tokens[2:], strict=False))
        for token in tokens:
            bucket = xxhash.xxh64_intdigest(token) % quality.BUCKETS
            out[bucket] = out.get(bucket, 0) + 1
    return out


@pytest.fixture(scope="module")
def corpus(llm):
    rng = random.Random(9)
    good, junk = [f"word{i}" for i in range(300)], ["zap", "buy", "now", "click"]
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        text = " ".join(rng.choice(good) for _ in range(80))
        rows.append((i, text + " " + " ".join(rng.choices(junk, k=15)) if bad else text))
        if i < 300:
            labels.append((i, int(not bad), int(bad and i % 10 == 0)))
    return llm.createDataFrame(rows, "doc_id long, text string"), llm.createDataFrame(labels, LABELS)


def test_counts_and_ratios(corpus):
    docs, labels = corpus
    found = {r.bucket: (r.raw, r.target) for r in quality.counts(docs, quality._labels(labels, 1000), "doc_id", "text").collect()}
    good = {r.doc_id for r in labels.collect() if r.quality == 1 and r.toxic == 0}
    texts = {r.doc_id: r.text for r in docs.collect()}
    raw, target = plain_counts(texts.values()), plain_counts(t for i, t in texts.items() if i in good)
    assert found == {b: (n, target.get(b, 0)) for b, n in raw.items()}
    ratio = quality.log_ratios(np.array([100.0, 100, 100, 90, 1, 0]), np.array([50.0, 50, 50, 0, 0, 0]))
    assert ratio[:3].tolist() == [0, 0, 0] and ratio[3] < -3 and ratio[4] == 0 and ratio[5] == 0


def test_held_out_documents(corpus):
    docs, labels = corpus
    selected = {r.doc_id: r.selected for r in quality.resampled(docs, labels).collect()}
    held_out = [(i % 5 != 0, selected[i]) for i in range(300, 600)]
    assert np.mean([s for good, s in held_out if good]) > 0.98 and np.mean([s for good, s in held_out if not good]) < 0.05
    kept = {r.doc_id for r in quality.accepted(docs, labels).collect()}
    assert kept == {i for i, s in selected.items() if s}


def test_top_k_of_gumbel_keys(llm):
    rng = random.Random(1)
    rows = [(i, float(rng.choice([rng.gauss(0, 1), 0.5, 7.0]))) for i in range(5000)] + [(None, 0.5)]
    keys = llm.createDataFrame(rows, "doc_id long, key double")
    order = sorted(rows, key=lambda r: (-r[1], r[0] is None, r[0]))
    for k in (1, 2, 1700, 3400, 4999, 5001):
        assert quality.kth_key(keys, k) == (order[k - 1][1], order[k - 1][0])


def test_gumbel_noise(llm):
    keys = [r[0] for r in llm.range(4000).select(quality.gumbel_key(F.lit(0.0), F.col("id"))).collect()]
    assert abs(np.mean(keys) - 0.5772) < 0.08 and abs(np.var(keys) - math.pi**2 / 6) < 0.2


def test_quality_of_odd_rows(docs, no_docs, llm):
    labels = llm.createDataFrame([(0, 1, 0), (1, 0, 0), (1, 1, 0), (2, None, 0), (None, 1, 0), (3, 1, 1)], LABELS)
    found = quality.resampled(docs, labels)
    assert found.count() == docs.count() and found.where("log_weight is null or selected is null").count() == 0
    assert quality.accepted(docs, labels).columns == docs.columns
    none = llm.createDataFrame([], LABELS)
    assert quality.accepted(docs, none).count() == docs.count()  # nothing known, nothing rejected
    assert quality.resampled(no_docs, labels).count() == 0 and quality.accepted(no_docs, none).count() == 0


def model(rng):
    n = len(chat.STATES)
    log = lambda *shape: np.log(rng.dirichlet(np.ones(shape[-1]), shape[:-1]))
    values = [{"none", "user", "assistant", "system"}, {"blank", "short", "middle", "long"}, {"asks", "tells"}, {"upper", "other"}, {"start", "blank", "text"}]
    return chat.Model(log(n), log(n, n), [{v: log(n) for v in sorted(kind)} for kind in values], [np.full(n, -9.0)] * len(values))


def test_viterbi_is_the_best_of_all_paths():
    rng = np.random.default_rng(3)
    for _ in range(8):
        m, lines = model(rng), ["User: Hello?", "", "fine.", "Bot: yes"][: rng.integers(1, 5)]
        emitted = [sum(m.seen[k].get(v, m.unseen[k]) for k, v in enumerate(chat.features(x, y))) for x, y in zip(lines, [None, *lines], strict=False)]

        def score(path, m=m, emitted=emitted):
            return m.first[path[0]] + sum(e[s] for e, s in zip(emitted, path, strict=True)) + sum(m.step[a, b] for a, b in zip(path, path[1:], strict=False))

        best = max(map(score, itertools.product(range(6), repeat=len(lines))))
        assert math.isclose(score(m.states(lines)), best)


@pytest.fixture(scope="module")
def conversations(llm):
    rng, rows = random.Random(5), []
    for conv in range(200):
        for turn in range(rng.randint(2, 7)):
            role = "user" if turn % 2 == 0 else "assistant"
            text = "What is the " + rng.choice("abc") + "?" if role == "user" else "\n".join("It is known that " + "x " * rng.randint(8, 20) for _ in range(rng.randint(1, 3)))
            rows.append((conv, turn, role, text))
    return llm.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_roles_of_held_out_transcripts(conversations):
    known = chat.transcripts(conversations).cache()
    fitted = chat.fit(known.where("conv_id < 100").select("known"))
    found = chat.formatted(known, fitted, ["conv_id", "known"]).where("conv_id >= 100")
    right = [r[0] for r in found.select(chat.same_roles(F.col("turns"), F.col("known"))).collect()]
    assert len(right) == 100 and np.mean(right) > 0.95


def test_markers_and_rendering():
    assert chat.marker("**Human**: hi") == ("user", "hi") and chat.marker("### Answer:") == ("assistant", "")
    assert chat.marker("Users: hi") == ("none", "Users: hi") and chat.marker("[System]: x")[0] == "system"
    assert chat.render([("user", "a <|b|>"), ("assistant", "c")]) == "<|user|>\na <\\|b|>\n<|end|>\n<|assistant|>\nc\n<|end|>\n"


def test_odd_conversations(llm, conversations):
    schema = "role string, conv_id long, text string, turn long, part string"
    rows = [("user", None, "x", 0, "p"), (None, 1, None, None, "p"), ("SYSTEM", 1, "", 0, "p"), ("tool", 1, "y" * 50_000, 1, "p"), ("user", 2, "z", 0, "p"), ("user", 2, "z", 0, "p"), ("user", 3, "a", 500, "p")]
    known = chat.transcripts(llm.createDataFrame(rows, schema))
    assert sorted((r.conv_id, r.part) for r in known.collect()) == [(1, -1), (1, 0), (2, 0), (3, 7)]
    fitted = chat.fit(known.select("known"))
    found = {(r.conv_id, r.part): r for r in chat.formatted(known, fitted, ["conv_id", "part"]).collect()}
    assert len(found[2, 0].turns) == 1 and found[2, 0].turns[0].text == "z" and found[1, -1].turns == []
    empty = chat.transcripts(llm.createDataFrame([], schema))
    assert empty.count() == 0 and chat.formatted(empty, chat.fit(empty.select("known")), ["conv_id"]).count() == 0
    odd = llm.createDataFrame([(1, None), (2, ""), (3, "\n\n")], "id long, transcript string")
    assert [(r.turns, r.rendered) for r in chat.formatted(odd, fitted, ["id"]).collect()] == [([], "")] * 3


def plain_top_k(rows, k, every):
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, query) in enumerate(usable):
        if q % every == 0:
            others = [(i, v) for m, (i, v) in enumerate(usable) if m != n and len(v) == len(query)]
            scores = sorted((-sum(a * b for a, b in zip(query, v, strict=True)), i) for i, v in others)
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("settings", [{}, {"shard": 100, "group": 7}])
def test_top_k(llm, settings, monkeypatch):
    monkeypatch.setattr(topk, "LEAF", 8)
    monkeypatch.setattr(topk, "QUERY_LEAF", 2)
    rng = np.random.default_rng(7)
    centres = rng.normal(0, 1, (6, 4))
    rows = [(i, (centres[i % 6] + rng.normal(0, 0.02, 4)).round(2).tolist()) for i in range(400)]
    rows += [(400 + i, rows[0][1]) for i in range(12)]  # ties
    rows += [(500, None), (510, []), (520, [1.0, None, 0.0, 0.0]), (530, [float("nan")] * 4), (540, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4), (550, [1.0, 2.0]), (560, [3.0])]
    rows += [rows[10]] * 2 + [rows[11]] * 9 + [(20, rows[33][1]), (30, [1.0, 2.0])]  # repeated rows, and ids with other vectors
    frame = llm.createDataFrame([(v, i, "x", 1.0) for i, v in rows], "embedding array<double>, vec_id long, vector string, score double")
    found = sorted(tuple(r) for r in topk.top_k(frame, every=10, **settings).collect())
    assert found == plain_top_k(rows, 5, 10)


def test_search_prunes_what_is_far(monkeypatch):
    rng = np.random.default_rng(1)
    vectors = np.floor(256 * np.concatenate([rng.normal(c, 0.01, (500, 3)) for c in ([1, 0, 0], [0, 1, 0], [0, 0, 1], [-1, 0, 0])]))
    monkeypatch.setattr(topk, "LEAF", 50)
    search, seen = topk.Search(np.arange(4), vectors[:4], np.arange(2000), np.arange(2000), vectors, 5), []
    leaves = search._leaves
    search._leaves = lambda rows, columns: (seen.append(len(columns)), leaves(rows, columns))
    search.run()
    assert sum(seen) < 1000


def test_top_k_of_few_rows(llm):
    schema = "vec_id long, embedding array<float>"
    assert topk.top_k(llm.createDataFrame([], schema)).count() == 0
    assert topk.top_k(llm.createDataFrame([(0, [1.0])], schema)).count() == 0
    assert [tuple(r) for r in topk.top_k(llm.createDataFrame([(0, [1.0]), (1, [-0.5])], schema)).collect()] == [(0, 1, 1, 256 * -128)]


def test_top_k_where_some_columns_are_asked_for(llm):
    rows = [(i, [float(i % 7), float(i % 3)]) for i in range(40)]
    found = topk.top_k(llm.createDataFrame(rows, "vec_id long, embedding array<double>"), every=10)
    expected = plain_top_k(rows, 5, 10)
    assert found.count() == len(expected)
    assert sorted(r[0] for r in found.select("vec_id").collect()) == sorted(e[2] for e in expected)
