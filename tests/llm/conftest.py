import random

import pytest

from assaylake.llm.shared import prepare

FIELDS = "text string, doc_id long, digest string, shard int, label string"


@pytest.fixture(scope="session")
def llm(spark):
    return prepare(spark)


def words(rng, n, alphabet="abcdeé"):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Texts with copies, near copies, shared passages, odd white space, nulls, empty and very long ones."""
    rng = random.Random(3)
    base = [words(rng, rng.choice([1, 2, 5, 60, 200])) for _ in range(40)]
    passage = words(rng, 30)
    made = [*base, *base[:6], base[6].replace(" ", "\n"), base[7] + " ", "\t" + base[7]]
    made += [words(rng, 20) + " " + passage + " " + words(rng, 20) for _ in range(6)]
    for text in base[10:20]:
        parts = text.split(" ")
        parts[len(parts) // 2] = "changed"
        made.append(" ".join(parts))
    made += [None, "", "   \n", "a", "<|endoftext|>a<|endoftext|>", "x" * 20_000, words(rng, 15_000), "naïve 漢字 🙂 fin", "ab" * 400, "\x1c\x1d odd  \x85space"]
    return made


@pytest.fixture(scope="session")
def docs(llm, texts):
    """Extra columns have names that operators use inside; two rows have no id, one row occurs twice."""
    rows = [(t, i, "d", i % 3, "x") for i, t in enumerate(texts)]
    rows += [(texts[0], None, "d", 0, "x"), ("no id", None, None, None, None), rows[5]]
    return llm.createDataFrame(rows, FIELDS).repartition(4)


@pytest.fixture(scope="session")
def no_docs(llm):
    return llm.createDataFrame([], FIELDS)
