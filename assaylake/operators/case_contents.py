"""Contents of cases of any size: hash, prompt and draft lines, without a result list in a row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .. import fixed_values as fv
from ..functions import ids, texts
from ..schemas import CASE_KEYS, RESULT_FIELDS
from .gold import CONTEXT_COLUMNS, case_results, case_summaries, status_and_time

ABNORMAL_LINES, NORMAL_LINES, PROMPT_LINES = "abnormal_lines", "normal_lines", "prompt_lines"


def content_hashes(silver: DataFrame) -> DataFrame:
    """``context_hash`` per case, the same as of its nested row.

    Results are sorted by case and ``result_id`` inside partitions, which spills, and one running SHA-256 per
    case goes over the sorted rows: a task holds one batch, however many results a case has. The hash of a
    case is sequential by its definition, so each case is hashed by one task.
    """
    item = F.to_json(ids.hashed_result(F.struct(*RESULT_FIELDS))).alias("item")
    ordered = (
        case_results(silver)
        .select(*CASE_KEYS, "result_id", item)
        .repartition(*CASE_KEYS)
        .sortWithinPartitions(*CASE_KEYS, "result_id")
        .select(*CASE_KEYS, "item")
    )
    names = [*CASE_KEYS, "context_hash"]

    def running(batches):
        import hashlib

        import pyarrow as pa

        def rows(done):
            return pa.record_batch([pa.array(c, pa.string()) for c in zip(*done, strict=True)], names=names)

        case, digest = None, None
        for batch in batches:
            *keys, items = (column.to_pylist() for column in batch.columns)
            cases, done, start = list(zip(*keys, strict=True)), [], 0
            while start < len(cases):
                end = start + 1
                while end < len(cases) and cases[end] == cases[start]:
                    end += 1
                if cases[start] == case:
                    digest.update(b",")
                else:
                    if digest is not None:
                        digest.update(b"]")
                        done.append((*case, digest.hexdigest()))
                    case = cases[start]
                    digest = hashlib.sha256("".join(key + "|" for key in case if key is not None).encode() + b"[")
                digest.update(",".join(items[start:end]).encode())
                start = end
            if done:
                yield rows(done)
        if digest is not None:
            digest.update(b"]")
            yield rows([(*case, digest.hexdigest())])

    return ordered.mapInArrow(running, ", ".join(f"{name} string" for name in names))


def _joined(lines: DataFrame, **columns: str) -> DataFrame:
    """Lines of a case as text, in their order; ``columns`` are conditions on ``kind`` and ``place``."""
    pick = "listagg(case when {} then line end, '\n') within group (order by place)"
    return lines.groupBy(*CASE_KEYS).agg(*[F.expr(pick.format(when)).alias(name) for name, when in columns.items()])


def prompt_lines(silver: DataFrame, max_results: int = fv.PROMPT_RESULT_LINES) -> DataFrame:
    """The first result lines of a case's prompt, as one text per case; the rest is cut before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*CASE_KEYS).orderBy("result_id"))
    first = case_results(silver).withColumn("place", place).where(F.col("place") <= max_results)
    lines = first.select(*CASE_KEYS, "place", texts.prompt_line(F.struct(*RESULT_FIELDS)).alias("line"))
    return _joined(lines, **{PROMPT_LINES: "true"})


def draft_lines(silver: DataFrame) -> DataFrame:
    """The first abnormal and the first normal lines of a case's draft, as two texts per case."""
    kind = F.when(F.col("abnormal_flag").isin(fv.FLAG_HIGH, fv.FLAG_LOW), "A").when(F.col("abnormal_flag") == fv.FLAG_NORMAL, "N")
    place = F.row_number().over(Window.partitionBy(*CASE_KEYS, "kind").orderBy("result_id"))
    first = (
        case_results(silver)
        .withColumn("kind", kind)
        .where(F.col("kind").isNotNull())
        .withColumn("place", place)
        .where(F.col("place") <= max(fv.DRAFT_ABNORMAL_LINES, fv.DRAFT_NORMAL_LINES))
    )
    lines = first.select(*CASE_KEYS, "kind", "place", texts.draft_line(F.struct(*RESULT_FIELDS)).alias("line"))
    return _joined(
        lines,
        **{
            ABNORMAL_LINES: f"kind = 'A' and place <= {fv.DRAFT_ABNORMAL_LINES}",
            NORMAL_LINES: f"kind = 'N' and place <= {fv.DRAFT_NORMAL_LINES}",
        },
    )


def case_contexts(silver: DataFrame, *, generated_at=None) -> DataFrame:
    """Case contexts without their result lists: keys, counts, span, status and hash."""
    found = case_summaries(silver).join(content_hashes(silver), CASE_KEYS)
    return found.withColumns(status_and_time(generated_at)).select(*[c for c in CONTEXT_COLUMNS if c != "results"])


def with_draft_reports(contexts: DataFrame, silver: DataFrame) -> DataFrame:
    """Contexts with the template draft of each case as ``report_text``."""
    text = texts.draft_report(F.col(ABNORMAL_LINES), F.col(NORMAL_LINES))
    return contexts.join(draft_lines(silver), CASE_KEYS, "left").withColumn("report_text", text).drop(ABNORMAL_LINES, NORMAL_LINES)


def with_context_texts(contexts: DataFrame, silver: DataFrame, max_results: int = fv.PROMPT_RESULT_LINES) -> DataFrame:
    """Contexts with their prompt text as ``context_text``."""
    text = texts.context_text(max_results, F.col(PROMPT_LINES))
    return contexts.join(prompt_lines(silver, max_results), CASE_KEYS, "left").withColumn("context_text", text).drop(PROMPT_LINES)


def case_flag_split(silver: DataFrame) -> DataFrame:
    """How many results of a case carry each kind of flag, from its counts."""
    return case_summaries(silver).select(
        *CASE_KEYS,
        F.col("abnormal_results_count").cast("int").alias("abnormal_count"),
        F.col("normal_results_count").cast("int").alias("normal_count"),
        F.col("unknown_flag_results_count").cast("int").alias("unknown_count"),
    )
