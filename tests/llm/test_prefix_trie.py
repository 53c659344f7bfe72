"""The trie of conversations against a plain one, and the registered query on a written table."""

import hashlib
import random
import zlib

import pytest

from assaylake.llm import prefix_trie, queries

FIELDS = "conv_id long, turn long, role string, text string, depth string, c int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_sequences(rows):
    found = {}
    for r in rows:
        if r[0] is not None:
            found.setdefault(r[0], []).append((r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    return {c: [x[2:] for x in sorted(turns)] for c, turns in found.items()}


def plain_rebuilt(given):
    out = {}
    for c, own in given.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = given.get(c - c % 5, [])[:h] + own[h:]
    return out


def plain_trie(sequences):
    members, children = {}, {}
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)

    rows, done = [], {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        saved = (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0) + sum(done[n][0] for n in below)
        done[node] = saved, sum(done[n][1] for n in below) or 1
        ends = ",".join(str(c) for c in sorted(members[node]) if len(sequences[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        rows.append((min(members[node]), len(node), parent, len(members[node]), len(below), done[node][1], saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=str)


@pytest.fixture(scope="module")
def given():
    """Shared starts, null and repeated turn numbers, repeated rows, nulls, negative ids, and a hot conversation."""
    rng, rows = random.Random(5), []
    openings = [("user", "hello"), ("system", "é be brief"), (None, None), ("user", "")]
    for c in [*range(-6, 60), 2000, 2001, 5004]:
        for turn in range(rng.choice([1, 2, 3, 7, 12])):
            role, text = rng.choice(openings) if rng.random() < 0.7 else ("assistant", f"answer {rng.randrange(4)}")
            rows.append((c, turn if rng.random() < 0.9 else rng.choice([None, 1]), role, text, "x", 1))
    rows += [rows[3], rows[3], (None, 1, "user", "no conversation", "x", 1)]
    long = [(("user", "assistant")[k % 2], f"t{k % 5}") for k in range(700)]
    for c, n in ((100, 700), (101, 640), (102, 64), (103, 65), (104, 300)):
        rows += [(c, k, *long[k], "x", 1) for k in range(n)] + ([(c, n, "user", "other", "x", 1)] if c == 104 else [])
    return rows


def found(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_registered_query(llm, given, tmp_path):
    llm.createDataFrame(given, FIELDS).repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    made = queries.QUERIES["op13_conversation_trie"](llm, str(tmp_path))
    assert found(made) == plain_trie(plain_rebuilt(plain_sequences(given)))


@pytest.mark.parametrize("span", [2, 4, 64])
def test_trie(llm, given, span, monkeypatch):
    """Short spans are sequences of sequences of spans."""
    monkeypatch.setattr(prefix_trie, "SPAN", span)
    rows = [r for r in given if r[0] is None or r[0] < 100 or span == 64]
    made = prefix_trie.prefix_trie(llm.createDataFrame(rows, FIELDS).repartition(3))
    assert found(made) == plain_trie(plain_sequences(rows))


def test_many_ends_at_one_node(llm):
    rows = [(c, 0, "user", "hi", "x", 1) for c in range(0, 9000, 2)]
    assert found(prefix_trie.prefix_trie(llm.createDataFrame(rows, FIELDS))) == plain_trie(plain_sequences(rows))


def test_turnless_conversations(llm):
    sequences = llm.createDataFrame([(7, 0), (3, 0)], "c long, n long")
    none = llm.createDataFrame([], "c long, d long, k1 long, k2 long, n_bytes long")
    assert found(prefix_trie.trie(none, sequences)) == plain_trie({7: [], 3: []})


def test_empty(llm):
    assert found(prefix_trie.prefix_trie(llm.createDataFrame([], FIELDS))) == []
