"""The registered queries of this package and their DuckDB SQL, where SQL can state them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import bpe, chat, exact_dedup, jaccard_join, packing, prefix_trie, quality, runs, simhash, suffix_dedup, token_counts, token_files, topk
from .shared import cut, prepare, table

QUERIES, ORACLES = {}, {}

# The crc32 of a decimal number ``x`` (text), bit by bit: a byte is added, then eight steps.
CRC32_SQL = """xor(4294967295, list_reduce(
    flatten(list_transform(string_split(x, ''), lambda y: [unicode(y)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda r, y: CASE WHEN y >= 0 THEN xor(r, y) ELSE xor(r >> 1, (r & 1) * 3988292384) END, 4294967295::BIGINT))"""


def register(name: str, sql: str | None = None):
    def keep(function):
        QUERIES[name] = lambda spark, sf_dir: function(prepare(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = sql
        return function

    return keep


@register("op1_simhash_near_dedup")
def op1(spark, sf_dir):
    return simhash.near_groups(table(spark, sf_dir, "documents"))


@register(
    "op3_exact_dedup",
    r"""
    WITH n AS (
        SELECT doc_id, length(coalesce(text, '')) AS chars,
            sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
        FROM documents
    ), g AS (
        SELECT doc_id, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
            count(*) OVER (PARTITION BY text_sha256) AS group_size, text_sha256
        FROM n
    )
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
    """,
)
def op3(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@register("op2_bpe_encode_decode")
def op2(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path).select("doc_id", "ids")
    return bpe.digests(bpe.decode(encoded, path))


@register("op5_token_counts")
def op5(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@register("op4_bit_plane_token_files")
def op4(spark, sf_dir):
    return token_files.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@register("op7_best_fit_packing")
def op7(spark, sf_dir):
    return packing.best_fit_packing(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@register(
    "op9_exact_top_k",
    """
    WITH v AS (
        SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
        WHERE vec_id IS NOT NULL AND len(embedding) > 0
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
        SELECT a.r, a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
        FROM v a JOIN v b ON a.r <> b.r AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0
    )
    SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
        vec_id, score
    FROM s QUALIFY rank <= 5
    """,
)
def op9(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"))


@register("op10_suffix_array_dedup")
def op10(spark, sf_dir):
    found = suffix_dedup.repeated_spans(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@register("op6_importance_resampling")
def op6(spark, sf_dir):
    return quality.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op8_chat_transcripts")
def op8(spark, sf_dir):
    known = cut(chat.transcripts(table(spark, sf_dir, "conversations")))
    # Fitted on the transcripts of half of the conversations; the other half is held out.
    model = chat.fit(known.where("xxhash64(conv_id, 1) % 2 = 0").select("known"))
    found = chat.formatted(known, model, ["conv_id", "part", "known"])
    return found.select(
        "conv_id",
        "part",
        F.size("turns").alias("n_turns"),
        F.array_join(F.transform("turns", lambda x: x["role"]), " ").alias("roles"),
        chat.same_roles(F.col("turns"), F.col("known")).alias("recovered"),
        (F.expr("xxhash64(conv_id, 1) % 2") != 0).alias("held_out"),
        F.sha2("rendered", 256).alias("rendered_sha256"),
    )


def rebuilt_words(doc_id, text):
    """Words with a planted period at the end, for one document in ten by the crc32 of its id; other texts as they are."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    found = F.struct(words.alias("w"), F.size(words).alias("n"), F.crc32(doc_id.cast("string").cast("binary")).alias("h"))
    g, n = (lambda x: F.floor(x["h"] / 10)), (lambda x: x["n"])
    start = lambda x: g(x) % n(x)
    period = lambda x: 1 + F.floor((n(x) - start(x)) / (3 + g(x) % 8))
    place = lambda x, i, a, p: F.when(i < a, i).otherwise(a + (i - a) % p)
    planned = F.transform(F.array(found), lambda x: F.struct(x["w"].alias("w"), start(x).alias("a"), period(x).alias("p")))
    planted = F.transform(planned, lambda x: F.array_join(F.transform(x["w"], lambda w, i: F.get(x["w"], place(x, i, x["a"], x["p"]).cast("int"))), " "))
    return F.when((found["h"] % 10 == 0) & (found["n"] > 0), planted[0]).otherwise(text)


@register("op11_periodic_runs")
def op11(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = runs.periodic_runs(docs.withColumn("text", rebuilt_words(F.col("doc_id"), F.col("text"))))
    # Greatest length first, then smallest start, then smallest period.
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    return found.withColumn("longest", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.start")).alias("start"),
        F.col("longest.length").alias("length"),
        (-F.col("longest.period")).alias("period"),
        F.floor(1000 * F.col("longest.length") / -F.col("longest.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def rebuilt_conversations(rows):
    """Conversations whose first turns are those of the first conversation of their five; and all their lengths."""
    head, base = F.crc32(F.col("c").cast("string").cast("binary")) % 9, F.col("c") - F.pmod("c", F.lit(5))
    sizes = cut(rows.groupBy("c").agg(F.max("d").alias("n")).select("c", "n", head.alias("h"), base.alias("base")))
    given = sizes.where("c = base").select(F.col("c").alias("_base"), F.col("n").alias("_n"))
    shared = F.least("h", F.coalesce("_n", F.lit(0))).cast("long")
    plans = cut(sizes.join(given, F.col("base") == F.col("_base"), "left").select("c", "n", "h", "base", shared.alias("shared")))
    first = rows.where("d <= 8 and pmod(c, 5) = 0").withColumnRenamed("c", "base").join(plans.drop("n"), "base").where("d <= h")
    rest = rows.join(plans, "c").where("d > h").withColumn("d", F.col("d") - F.col("h") + F.col("shared"))
    columns = ["c", "d", "k1", "k2", "n_bytes"]
    lengths = plans.select("c", (F.col("shared") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("long").alias("n"))
    return first.select(columns).union(rest.select(columns)), lengths


@register(
    "op13_conversation_trie",
    """
    WITH t AS (
        SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS d,
            coalesce(role, '') AS role, coalesce(text, '') AS text
        FROM conversations WHERE conv_id IS NOT NULL
    ), s AS (SELECT c, max(d) AS n, crc AS h, c - ((c % 5) + 5) % 5 AS base FROM t JOIN (
        SELECT c, @crc@ % 9 AS crc FROM (SELECT DISTINCT c, CAST(c AS VARCHAR) AS x FROM t)) USING (c) GROUP BY c, crc
    ), p AS (
        SELECT s.c, s.n, s.h, s.base, least(s.h, coalesce(b.n, 0)) AS shared FROM s LEFT JOIN s b ON b.c = s.base
    ), r AS (
        SELECT p.c, t.d, role, text FROM p JOIN t ON t.c = p.base WHERE t.d <= p.h
        UNION ALL SELECT p.c, t.d - p.h + p.shared, role, text FROM p JOIN t ON t.c = p.c WHERE t.d > p.h
    ), k AS (
        SELECT c, d, strlen(text) AS b,
            list(sha256(concat(length(role), ':', role, text))) OVER (PARTITION BY c ORDER BY d) AS name,
            max(d) OVER (PARTITION BY c) AS n
        FROM r
        UNION ALL SELECT p.c, 0, 0, [], coalesce(m.n, 0) FROM p LEFT JOIN (SELECT c, max(d) AS n FROM r GROUP BY c) m USING (c)
    ), g AS (
        SELECT d, name, min(c) AS rep, count(*) AS n_convs, min(b) AS b, count(*) FILTER (d < n) = 0 AS leaf,
            coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (d = n), '') AS ends
        FROM k GROUP BY d, name
    ), a AS (
        SELECT x.d, x.name, sum((y.n_convs - 1) * y.b) AS saved, count(*) FILTER (y.leaf) AS leaves,
            count(*) FILTER (y.d = x.d + 1) AS children
        FROM g y JOIN k z ON z.c = y.rep AND z.d <= y.d JOIN g x ON x.d = z.d AND x.name = z.name GROUP BY x.d, x.name
    )
    SELECT g.rep AS conv_id, CAST(g.d AS BIGINT) AS depth, u.rep AS parent_conv_id, CAST(g.n_convs AS BIGINT) AS n_convs,
        CAST(children AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
        sha256(g.ends) AS ends_sha256
    FROM g JOIN a ON a.d = g.d AND a.name = g.name
    LEFT JOIN g u ON u.d = g.d - 1 AND u.name = g.name[:g.d - 1]
    """.replace("@crc@", CRC32_SQL),
)
def op13(spark, sf_dir):
    rows = cut(prefix_trie.turns(table(spark, sf_dir, "conversations")))
    rebuilt, lengths = rebuilt_conversations(rows)
    return prefix_trie.trie(cut(rebuilt), cut(lengths))


@register(
    "op12_ngram_jaccard_join",
    r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
        FROM documents
    ), s AS (
        SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
            ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END) AS shingle
        FROM w
    ), n AS (
        SELECT doc_id, count(shingle) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY doc_id
    ), o AS (
        SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
        GROUP BY a.doc_id, b.doc_id
    ), l AS (
        SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)
    ), r AS (
        SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b
    )
    SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id
    FROM n JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) ON a = doc_id
    """,
)
def op12(spark, sf_dir):
    return jaccard_join.jaccard_groups(table(spark, sf_dir, "documents"))
