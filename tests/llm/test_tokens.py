"""BPE, token counts, token-id files and packing against the library and plain versions."""

import gc
import hashlib
import math
import random
import zlib
from itertools import groupby

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from assaylake.llm import bpe, packing, token_counts, token_files
from assaylake.llm.word_tokens import WordEncoder

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def byte_library():
    return Tokenizer.from_file(BYTES)


@pytest.fixture(scope="module")
def word_library():
    return Tokenizer.from_file(WORDS)


@pytest.fixture(scope="module")
def merges():
    return bpe.MergeList(BYTES)


def random_texts(n=400):
    rng = random.Random(11)
    kinds = ["abcdefghij", "the and of ing tion's'll", "aaaaab", "éüñ漢字🙂 \n\t", "!?.,;:-='", "0123456789 ", "　\xa0\x85\x1c​x ", "İΣ́̈ß"]
    return ["".join(rng.choice(rng.choice(kinds) + " ") for _ in range(rng.choice([1, 5, 30, 300]))) for _ in range(n)]


def test_lookahead_of_a_small_list():
    assert bpe.sufficient_lookahead([(b"a", b"b")]) == 2
    # (b, c) may take the b that (a, b) would take, so three bytes decide about the first token.
    assert bpe.sufficient_lookahead([(b"b", b"c"), (b"a", b"b")]) == 3
    with pytest.raises(ValueError):
        bpe.sufficient_lookahead([(b"ab", b"c"), (b"a", b"b")])


def test_encode_and_decode_equal_the_library(merges, byte_library, texts):
    for text in [*random_texts(), *[t or "" for t in texts]]:
        ids = np.frombuffer(b"".join(merges.encode(text)), dtype="<u4")
        expected = byte_library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == expected
        assert "".join(merges.decode(ids, size=3)) == byte_library.decode(expected, skip_special_tokens=False)


@pytest.mark.parametrize("alphabet", ["abcdefghijklmnopqrstuvwxyz", "ab", "é", "=-", "0"])
def test_stream_emits_what_the_whole_would(merges, byte_library, alphabet):
    rng = random.Random(4)
    text = "".join(rng.choice(alphabet) for _ in range(6000))
    parts = list(merges.stream(text.encode(), read=1))
    assert len(parts) > 3 and all(len(p) <= 2 * merges.lookahead + 1 for p in parts)
    assert [i for p in parts for i in p] == byte_library.encode(text, add_special_tokens=False).ids


def test_decoding_bytes_that_are_no_text(merges, byte_library):
    rng = random.Random(6)
    for _ in range(50):
        ids = [rng.randrange(50257) for _ in range(40)]
        assert "".join(merges.decode(np.array(ids, dtype="<u4"), size=1)) == byte_library.decode(ids, skip_special_tokens=False)


def test_encode_frame(docs, no_docs, byte_library):
    made = bpe.decode(bpe.encode(docs, BYTES), BYTES)
    assert made.columns == [*docs.columns, "ids", "decoded"] and made.count() == docs.count()
    for row in made.collect():
        assert row.decoded == (row.text or "")
        assert np.frombuffer(row.ids, dtype="<u4").tolist() == byte_library.encode(row.text or "", add_special_tokens=False).ids
    digest = bpe.digests(made).where("doc_id = 3").first()
    text = docs.where("doc_id = 3").first().text
    assert digest.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode(no_docs, BYTES).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(docs, BYTES, into="label")


def test_counts_equal_the_library(byte_library, texts, docs, no_docs):
    counter = token_counts.Counter(BYTES)
    given = [*random_texts(), *texts, "z" * 9000, "".join(random.Random(1).choice("abc") for _ in range(12_000))]
    expected = [len(byte_library.encode(t or "", add_special_tokens=False).ids) for t in given]
    assert counter.counts(given) == expected
    assert counter.counts(given) == expected  # from memory
    found = token_counts.token_counts(docs, BYTES, limit=100).join(docs.select("doc_id", "text").distinct(), "doc_id").collect()
    for row in found:
        assert row.n_bytes == len((row.text or "").encode())
        assert row.n_tokens == len(byte_library.encode(row.text or "", add_special_tokens=False).ids)
        assert row.over_limit == (row.n_tokens > 100)
    assert token_counts.token_counts(docs, BYTES).count() == docs.count()
    assert token_counts.token_counts(no_docs, BYTES).count() == 0


def test_word_encoder_equals_the_library(word_library, texts):
    encoder, given = WordEncoder(WORDS), [*random_texts(), *texts, "Don't STOP!!, it's 42% <|endoftext|>x ÀÉ, ﬁ"]
    for _ in range(2):
        made = encoder.encode(given)
        assert [np.frombuffer(x, dtype="<u2").tolist() for x in made] == [word_library.encode(t or "", add_special_tokens=False).ids for t in given]


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_planes_and_files_round_trip(kind, tmp_path):
    rng = np.random.default_rng(1)
    ids = [rng.integers(0, 1 << 16, n).astype("<u2") for n in (0, 1, 7, 1000, 3, 257)]
    assert (token_files.from_planes(token_files.to_planes(ids[3], kind), 1000, kind) == ids[3]).all()
    path = tmp_path / "x.idpl"
    with path.open("wb") as out:
        writer = token_files.Writer(out, kind, block=100)
        for i, x in enumerate(ids):
            writer.add(i, x.tobytes())
        writer.close()
    from pyarrow import fs

    with fs.LocalFileSystem().open_input_file(str(path)) as source:
        reader = token_files.Reader(source)
        whole = np.concatenate(ids)
        assert (reader.ids(5, 905) == whole[5:905]).all() and len(reader.ids(4, 4)) == 0
        start = 0
        for (i, begin, parts), x in zip(reader.documents(), ids, strict=True):
            assert begin == start and np.concatenate([np.zeros(0, dtype="<u2"), *parts]).tolist() == x.tolist()
            start += len(x)


def test_token_files(docs, no_docs, word_library, monkeypatch):
    found = [tuple(r) for r in token_files.token_files(docs, WORDS).collect()]
    given = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in docs.collect()))
    assert len(found) == len(given)
    of = lambda text: word_library.encode(text, add_special_tokens=False).ids + [2]
    expected = {(i if known else None, len(of(t)), zlib.crc32(np.array(of(t), dtype="<u4").tobytes())) for known, i, t in given}
    assert {(r[0], r[2], r[3]) for r in found} == expected
    place = 0
    for row in sorted(found, key=lambda r: r[1]):
        assert row[1] == place
        place += row[2]
    ids = [r[0] for r in sorted(found, key=lambda r: r[1])]
    assert ids[:2] == [None, None] and ids[2:] == sorted(ids[2:])
    assert token_files.token_files(no_docs, WORDS).count() == 0


def test_token_files_in_several_files(docs, llm, tmp_path):
    known = docs.where("doc_id is not null")
    bounds = token_files.file_bounds(known, docs_per_file=10)
    manifest = token_files.write_files(token_files.encoded(known, WORDS, 2), bounds, f"file://{tmp_path}")
    assert len(bounds) > 3 and manifest.count() > 3
    assert sorted(p.name for p in tmp_path.iterdir()) == sorted(r.path.rpartition("/")[2] for r in manifest.collect())
    again = token_files.read_files(llm, f"file://{tmp_path}", manifest)
    whole = token_files.token_files(known, WORDS)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, whole.collect()))


def test_lower_bounds_never_exceed_the_best_packing():
    rng = random.Random(2)
    for _ in range(60):
        capacity = 20
        lengths = [rng.randint(1, 20) for _ in range(rng.randint(1, 8))]

        def best(rest, rooms):
            if not rest:
                return len(rooms)
            found, tried = math.inf, set()
            for i, room in enumerate(rooms):
                if room >= rest[0] and room not in tried:
                    tried.add(room)
                    found = min(found, best(rest[1:], [*rooms[:i], room - rest[0], *rooms[i + 1 :]]))
            return min(found, best(rest[1:], [*rooms, capacity - rest[0]]))

        least = best(sorted(lengths, reverse=True), [])
        bound = packing.lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        bins, offsets, room = packing.best_fit_decreasing(np.array(lengths), capacity)
        assert math.ceil(bound - 1e-9) <= least <= len(room)
        assert all(r >= 0 for r in room) and (offsets + np.array(lengths) <= capacity).all()


def check_packing(rows, capacity):
    rows = sorted(rows, key=lambda r: (r.sequence_id, r.offset))
    for _, mine in groupby(rows, key=lambda r: r.sequence_id):
        end = 0
        for row in mine:
            assert row.offset == end
            end += row.length
        assert end <= capacity


def test_packing_exchanges_between_groups(llm):
    items = llm.range(3000).select(
        F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"),
        (F.pmod(F.xxhash64("id"), F.lit(60)) + 1).alias("length"), F.lit(0).cast("long").alias("ids_crc32"),
    )
    made = packing.packed(items, capacity=100, per_group=200).cache()
    rows = made.collect()
    assert sorted(r.doc_id for r in rows) == list(range(3000))
    check_packing(rows, 100)
    sequences, bound = packing.certificate(made, 100)
    assert bound <= sequences <= bound + 2 < bound + 15  # the groups alone would lose one each


def test_best_fit_packing(docs, no_docs, word_library):
    made = packing.best_fit_packing(docs, WORDS, capacity=256)
    rows = made.collect()
    check_packing(rows, 256)
    ids = {r.doc_id: word_library.encode(r.text or "", add_special_tokens=False).ids + [1] for r in docs.where("doc_id is not null").collect()}
    for row in rows:
        if row.doc_id is not None:
            part = ids[row.doc_id][row.start : row.start + row.length]
            assert len(part) == row.length and row.start == 256 * row.piece
            assert row.ids_crc32 == zlib.crc32(np.array(part, dtype="<u4").tobytes())
    assert sum(r.length for r in rows) == sum(len(word_library.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect())
    sequences, bound = packing.certificate(made, 256)
    assert bound <= sequences <= bound + 1
    assert packing.best_fit_packing(no_docs, WORDS).count() == 0


def test_collector_rests_while_words_are_encoded():
    """The collector would go through all known pieces again and again; ids stay what the library gives."""
    encoder = WordEncoder(WORDS)
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choice("abcdeéXY,'") for _ in range(rng.randint(1, 6))) for _ in range(400)) for _ in range(150)]
    runs = []
    gc.callbacks.append(lambda phase, info: runs.append(phase))
    try:
        gc.collect()
        before = len(runs)
        found = encoder.encode(texts)
        assert len(runs) == before > 0 and gc.isenabled()
    finally:
        gc.callbacks.pop()
    library = [np.array(encoder.library.encode(t, add_special_tokens=False).ids, dtype="<u2").tobytes() for t in texts]
    assert found == library
