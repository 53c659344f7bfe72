"""The corpus pipeline, stage by stage, against plain versions of the operators on a small corpus."""

import random
import re

import numpy as np
import pytest
from test_dedup import plain_repeats
from test_models import plain_counts
from test_near_copies import plain_stay
from test_tokens import check_packing

import __spark_entry__
import corpus_pipeline
from assaylake.llm import packing, quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(llm, tmp_path_factory):
    rng, rows, labels = random.Random(4), [], []
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    for i in range(260):
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(40, 160)))
        if i % 6 == 0:
            text += " " + " ".join(rng.choice(["spam", "idiot", "!!"]) for _ in range(30))
        elif i % 10 == 1:
            text += " " + passage
        elif i > 20 and i % 13 == 0:
            text = rows[i - 13][1]
        elif i > 20 and i % 17 == 0:
            text = rows[i - 17][1] + " "
        elif i > 20 and i % 19 == 0:
            text = rows[i - 19][1].replace(" ", "\n", 3) + " end"
        rows.append((i, text, "en", f"src{i % 3}", len(text)))
        if i % 2 == 0:
            labels.append((i, int(i % 6 != 0), int(i % 12 == 0)))
    rows += [(300, None, None, None, None), (301, "", "en", "s", 0), (302, "one", "en", "s", 3), (303, "one", "en", "s", 3), (304, "y" * 30_000, "en", "s", 1)]
    path = str(tmp_path_factory.mktemp("sf"))
    llm.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5).write.parquet(f"{path}/documents.parquet")
    llm.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def stages(llm, folder, tmp_path_factory):
    """Rows before and after every stage."""
    docs, out, path = llm.read.parquet(f"{folder}/documents.parquet"), [], tmp_path_factory.mktemp("out")
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(llm, docs, folder).write.parquet(str(path / str(number)))
        docs = llm.read.parquet(str(path / str(number)))
        if number < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == COLUMNS
        out.append((before, docs.collect()))
    return out


def ids(rows):
    return {r.doc_id for r in rows}


def test_quality(llm, folder, stages):
    before, after = stages[0]
    good = {r.doc_id: r.quality == 1 and r.toxic == 0 for r in llm.read.parquet(f"{folder}/labels.parquet").collect()}
    raw, target = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    for row in before:
        for bucket, n in plain_counts([row.text]).items():
            raw[bucket] += n
            target[bucket] += n * good.get(row.doc_id, False)
    ratio = quality.log_ratios(raw, target)
    found = {r.doc_id: r for r in quality.resampled(llm.read.parquet(f"{folder}/documents.parquet"), llm.read.parquet(f"{folder}/labels.parquet")).collect()}
    for row in before:
        counted = plain_counts([row.text])
        weight = quality.SCALE * sum(ratio[b] * n for b, n in counted.items()) / (sum(counted.values()) + quality.PRIOR)
        assert abs(found[row.doc_id].log_weight - weight) < 1e-6
    chosen = [i for i, r in found.items() if r.selected]
    assert ids(after) == set(chosen)
    assert set(sorted(found, key=lambda i: (-found[i].gumbel_key, i))[: len(chosen)]) == set(chosen)
    clean = [i for i, g in good.items() if g]
    # Some of the good ones are copies of junk texts.
    assert np.mean([i in chosen for i in clean]) > 0.9 and not any(i in chosen for i, g in good.items() if not g)


def test_exact(stages):
    before, after = stages[1]
    best = {}
    for row in before:
        key = re.sub("[\x20\x09-\x0d]", "", row.text or "")
        best[key] = min(best.get(key, (1, 0)), (-len(row.text or ""), row.doc_id))
    assert ids(after) == {i for _, i in best.values()} and len(after) < len(before)


def test_near(stages):
    """Of texts that pairs at a similarity of 0.8 or more connect, the one with the smallest id stays."""
    before, after = stages[2]
    before = sorted(before, key=lambda r: r.doc_id)
    stay = plain_stay([r.text for r in before])
    assert ids(after) == {r.doc_id for i, r in enumerate(before) if i in stay} and len(after) < len(before)


def test_repeats(stages):
    before, after = stages[3]
    given = [(r.doc_id, (r.text or "").encode()) for r in before]
    expected = {i: np.frombuffer(data, dtype=np.uint8)[~mark].tobytes().decode(errors="ignore") for (i, mark), (_, data) in zip(plain_repeats(given), given, strict=True)}
    assert {r.doc_id: r.text for r in after} == expected
    assert all(r.n_chars == len(r.text) for r in after) and any(len(r.text or "") != len(expected[r.doc_id]) for r in before)


def test_packing(llm, stages):
    before, after = stages[4]
    check_packing(after, packing.CAPACITY)
    assert ids(after) == ids(before)
    sequences, bound = packing.certificate(llm.createDataFrame([(r.length, r.sequence_id) for r in after], "length long, sequence_id long"))
    assert bound <= sequences <= bound + 1


def test_run_and_registration(llm, folder, stages):
    assert len(corpus_pipeline.STAGES) == 5 and "pipeline" in __spark_entry__.queries()
    made = corpus_pipeline.run(llm, folder)
    assert sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in made.collect()) == sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in stages[4][1])


def test_empty_corpus(llm, tmp_path):
    llm.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    llm.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(llm, str(tmp_path)).count() == 0


def test_every_operator_is_registered():
    names = [n for n in __spark_entry__.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14))
