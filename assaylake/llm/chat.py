"""Chat formatting: transcripts are parsed with a hidden Markov model before turns are rendered.

The hidden state of a line is a role, and whether the line begins a turn. What is seen of a line is the
speaker marker at its start and a few features of the rest. Transition and emission counts come from lines
whose roles are known; Viterbi gives the most likely states of a transcript. Lines of a turn are joined, the
marker is taken off, and turns are rendered in one canonical form.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

ROLES = ("system", "user", "assistant")
STATES = [(role, first) for role in ROLES for first in (True, False)]
# Speaker names as they are found at the start of lines. The first of each role is the plain one.
SPEAKERS = {
    "system": ("System", "Instructions", "Context"),
    "user": ("User", "Human", "Q", "Customer", "Prompt"),
    "assistant": ("Assistant", "AI", "A", "Bot", "Model", "Answer"),
}
_ROLE_OF = {name.lower(): role for role, names in SPEAKERS.items() for name in names}
_MARKER = re.compile(r"^\s*(?:#{1,4}\s*|\*\*|\[|<)?(" + "|".join(sorted(_ROLE_OF, key=len, reverse=True)) + r")(?:\*\*|\]|>)?\s*(:|$)\s*", re.IGNORECASE)
PART = 64  # turns that one transcript of the query holds at most
BEGIN, END = "<|", "|>"


def marker(line: str) -> tuple[str, str]:
    """The role whose speaker marker a line starts with (or ``none``), and the rest of the line."""
    found = _MARKER.match(line)
    return (_ROLE_OF[found[1].lower()], line[found.end() :]) if found else ("none", line)


def features(line: str, before: str | None = None) -> tuple[str, ...]:
    """What is seen of a line and of the end of the one before it, one value for each kind of feature."""
    role, rest = marker(line)
    words = len(rest.split())
    size = "blank" if not words else "short" if words < 8 else "middle" if words < 40 else "long"
    opening = "start" if before is None else "blank" if not before.strip() else "named" if _MARKER.fullmatch(before) else "text"
    return role, size, "asks" if rest.rstrip().endswith("?") else "tells", "upper" if rest[:1].isupper() else "other", opening


@dataclass
class Model:
    """Log probabilities: of first states, of steps between states, and of each feature value per state."""

    first: np.ndarray
    step: np.ndarray
    seen: list[dict[str, np.ndarray]]
    unseen: list[np.ndarray]

    def states(self, lines: list[str]) -> list[int]:
        """Viterbi: the most likely states of the lines of a transcript; ties go to the earlier state."""
        if not lines:
            return []
        emitted = np.array([sum(self.seen[k].get(v, self.unseen[k]) for k, v in enumerate(features(x, y))) for x, y in zip(lines, [None, *lines], strict=False)])
        best, back = self.first + emitted[0], np.zeros((len(lines), len(STATES)), dtype=np.int64)
        for i in range(1, len(lines)):
            ways = best[:, None] + self.step
            back[i] = ways.argmax(axis=0)
            best = ways.max(axis=0) + emitted[i]
        path = [int(best.argmax())]
        for i in range(len(lines) - 1, 0, -1):
            path.append(int(back[i, path[-1]]))
        return path[::-1]

    def turns(self, text: str | None) -> list[tuple[str, str]]:
        """Roles and texts of the turns of a transcript. Blank lines around a turn are not part of it."""
        lines = (text or "").splitlines()
        found: list[tuple[str, list[str]]] = []
        for line, state in zip(lines, self.states(lines), strict=True):
            role, begins = STATES[state]
            named, rest = marker(line)
            if begins or not found or found[-1][0] != role:
                found.append((role, [rest if named == role else line]))
            else:
                found[-1][1].append(line)
        made = [(role, "\n".join(rest).strip()) for role, rest in found]
        return [(role, rest) for role, rest in made if rest]


def render(turns: list[tuple[str, str]]) -> str:
    """Canonical form: a head line with the role, the text, an end mark. Marks inside texts are escaped."""
    return "".join(f"{BEGIN}{role}{END}\n{text.replace(BEGIN, '<\\|')}\n{BEGIN}end{END}\n" for role, text in turns)


def observations(lines: DataFrame) -> DataFrame:
    """``kind, state, value, n`` counts from ``lines`` (array of structs ``role, first, line``) per transcript."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for found in batch.column(0).to_pylist():
                before, line = "begin", None
                for item in found or []:
                    state = str(STATES.index((item["role"], item["first"])))
                    out.append(("step", before, state))
                    out += [(f"seen{k}", state, value) for k, value in enumerate(features(item["line"], line))]
                    before, line = state, item["line"]
            columns = zip(*out, strict=True) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(list(x), type=pa.string()) for x in columns], ["kind", "state", "value"])

    return lines.mapInArrow(run, "kind string, state string, value string").groupBy("kind", "state", "value").agg(F.count("*").alias("n"))


def fit(lines: DataFrame) -> Model:
    """A model from transcripts whose lines are known. Only counts reach the driver, a few hundred at most."""
    n = len(STATES)
    first, step = np.full(n, 0.1), np.full((n, n), 0.1)
    seen: list[dict[str, np.ndarray]] = [{} for _ in features("")]
    for kind, state, value, count in observations(lines).collect():
        if kind == "step":
            if state == "begin":
                first[int(value)] += count
            else:
                step[int(state), int(value)] += count
        else:
            seen[int(kind[4:])].setdefault(value, np.full(n, 0.1))[int(state)] += count
    log = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
    totals = [sum(values.values(), np.full(n, 0.1)) for values in seen]
    return Model(
        log(first), log(step), [{v: np.log(x / t) for v, x in values.items()} for values, t in zip(seen, totals, strict=True)], [np.log(0.1 / t) for t in totals]
    )


def formatted(df: DataFrame, model: Model, id_cols: list[str], text_col: str = "transcript") -> DataFrame:
    """Add ``turns`` (array of role and text) and ``rendered`` to the id columns of each transcript.

    Null and empty transcripts have no turns and render as an empty text. Repeated rows stay repeated.
    """
    place = len(id_cols)
    turn = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.turns(x) for x in batch.column(place).to_pylist()]
            columns = [
                pa.array([[{"role": r, "text": t} for r, t in turns] for turns in found], type=turn),
                pa.array([render(turns) for turns in found], type=pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:place], *columns], [*id_cols, "turns", "rendered"])

    source = df.select(*id_cols, F.col(text_col).cast("string").alias("transcript"))
    fields = ", ".join(f"`{c}` {t}" for c, t in source.dtypes[:place])
    return source.mapInArrow(run, f"{fields}, turns array<struct<role: string, text: string>>, rendered string")


def transcripts(conversations: DataFrame) -> DataFrame:
    """Plain transcripts of stored turns: ``conv_id, part, transcript, known``.

    Each transcript has its own way of naming speakers, leaves some speakers unnamed, and may part turns by
    blank lines, all by hashes of the conversation and the turn. ``known`` has role and place in its turn of every
    line. Roles other than system and assistant are user. A transcript holds at most 64 turn numbers; rows that
    repeat in full count once, and rows without a conversation are left out.
    """
    role = F.when(F.lower("role").isin("system", "assistant"), F.lower("role")).otherwise("user")
    text = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\r\n]+", "\n"), F.lit("\n"))
    rows = conversations.where("conv_id is not null").select("conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), role.alias("role"), text.alias("text")).distinct()
    style = F.pmod(F.xxhash64("conv_id"), F.lit(60)).cast("int")
    named = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4)) > 0
    speakers = F.create_map(*[x for r, names in SPEAKERS.items() for x in (F.lit(r), F.array(*map(F.lit, names)))])
    choice = F.element_at(speakers, F.col("role"))
    speaker = F.element_at(choice, F.pmod(style, F.size(choice)) + 1)
    head = F.when(style % 3 == 0, F.concat(F.lit("**"), speaker, F.lit("**: "))).when(style % 3 == 1, F.concat(F.lit("### "), speaker, F.lit(":\n"))).otherwise(F.concat(speaker, F.lit(": ")))
    body = F.concat(F.when(named, head).otherwise(""), "text", F.when(style % 2 == 0, "\n").otherwise(""))
    lines = F.transform(F.split(body, "\n"), lambda x, i: F.struct(F.col("role"), (i == 0).alias("first"), x.alias("line")))
    turns = rows.select("conv_id", F.floor(F.col("turn") / PART).alias("part"), F.struct("turn", "role", "text", lines.alias("lines")).alias("item"))
    known = F.flatten(F.transform(F.array_sort(F.collect_list("item")), lambda x: x["lines"]))
    grouped = turns.groupBy("conv_id", "part").agg(known.alias("known"))
    return grouped.select("conv_id", "part", F.array_join(F.transform("known", lambda x: x["line"]), "\n").alias("transcript"), "known")


def same_roles(turns: Column, known: Column) -> Column:
    """Whether the recovered roles are those of the known turns with text, turn by turn."""
    starts = F.filter(known, lambda x: x["first"])
    return F.transform(turns, lambda x: x["role"]) == F.transform(starts, lambda x: x["role"])
