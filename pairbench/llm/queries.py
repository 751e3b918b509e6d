"""The registered queries of the operators, and the SQL that checks them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairbench.llm import (
    decontaminate,
    lexical,
    mixing,
    ngram_join,
    phrases,
    pii,
    quality,
    rans,
    secrets,
    suffix_dedup,
    topk,
    toxicity,
    warc,
)
from pairbench.llm.common import table
from pairbench.workload.registry import query

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _count(spans, kind: str):
    return F.size(F.filter(spans, lambda s: s.kind == kind)).cast("long")


@query("op1_secret_scan")
def op1_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scan(table(spark, folder, "documents"))
    return found.select(
        "doc_id",
        *[_count("base", k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        secrets.digest("base", True).alias("base_sha256"),
        secrets.digest("spans", False).alias("spans"),
        _count("spans", "random").alias("n_random"),
    )


@query("op2_suffix_array_dedup")
def op2_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.deduplicated(table(spark, folder, "documents"))


@query("op3_pii")
def op3_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.scan(table(spark, folder, "documents"))
    return found.select(
        "doc_id",
        *[_count("base", k).alias(f"n_{k}") for k in pii.BASE],
        secrets.digest("base", True).alias("base_sha256"),
        secrets.digest("spans", False).alias("spans"),
    )


@query("op4_benchmark_decontamination")
def op4_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op5_token_id_output")
def op5_token_id_output(spark: SparkSession, folder: str) -> DataFrame:
    return rans.read(rans.write(table(spark, folder, "documents"), TOKENIZER))


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.fit(toxicity.labelled(docs, table(spark, folder, "labels")))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        toxicity.held_out().alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


@query("op8_mixing_to_weights")
def op8_mixing_to_weights(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return mixing.interleave(docs).drop("order")


@query(
    "op9_ngram_jaccard_join",
    """
    WITH RECURSIVE w AS (
        SELECT doc_id, list_filter(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words
        FROM documents
    ), s AS (
        SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 3
            THEN list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' '))
            WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingle
        FROM w
    ), n AS (
        SELECT doc_id, count(shingle) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY doc_id
    ), common AS (
        SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
        FROM s AS a JOIN s AS b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL
    ), links AS (
        SELECT a, b FROM common JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b
        WHERE 100 * c >= 90 * (x.n + y.n - c)
    ), reach AS (
        SELECT doc_id, doc_id AS other FROM n
        UNION
        SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other
    )
    SELECT doc_id, n AS n_shingles, min(other) AS component_id FROM reach JOIN n USING (doc_id) GROUP BY ALL
    """,
)
def op9_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.similar_components(table(spark, folder, "documents"), words=3, percent=90)


@query(
    "op6_warc",
    """
    WITH p AS (
        SELECT page_id, coalesce(html, '') AS body, unhex(sha1(coalesce(html, ''))) AS raw FROM pages
    ), bits AS (
        SELECT page_id, body, raw, list_transform(range(32), lambda i: substr(bitstring_of, i * 5 + 1, 5)) AS groups
        FROM (SELECT page_id, body, raw, CAST(raw AS BIT)::VARCHAR AS bitstring_of FROM p)
    ), ranked AS (
        SELECT page_id, octet_length(encode(body)) AS payload_bytes,
            list_aggregate(list_transform(groups,
                lambda g: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(CAST(g AS BIT) AS INTEGER) + 1, 1)
            ), 'string_agg', '') AS payload_digest,
            max(page_id) OVER (PARTITION BY body) AS target
        FROM bits
    )
    SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
        CASE WHEN target = page_id THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN target <> page_id THEN target END AS refers_to
    FROM ranked
    """,
)
def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.read(warc.write(table(spark, folder, "pages")))


@query(
    "op10_exact_top_k",
    """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
        FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
        SELECT q.vec_id AS query_id, c.vec_id,
            CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
        FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id
        WHERE q.vec_id % 100 = 0
    )
    SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score
    FROM s
    WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
    QUALIFY row_number() OVER w <= 10
    """,
)
def op10_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_products(table(spark, folder, "embeddings"))


@query(
    "op11_ranked_lexical_search",
    """
    WITH words AS (
        SELECT doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
        FROM documents
    ), totals AS (
        SELECT CAST(count(*) FILTER (len(terms) > 0) AS BIGINT) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM words
    ), tf AS (
        SELECT doc_id, n, term, count(*) AS tf
        FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM words) GROUP BY ALL
    ), items AS (
        SELECT DISTINCT item_id, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
        FROM benchmark
    ), weights AS (
        SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w
        FROM tf, totals GROUP BY term, n_docs
    ), scored AS (
        SELECT item_id, doc_id, CAST(sum(
            w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
        FROM items JOIN weights USING (term) JOIN tf USING (term), totals GROUP BY ALL
    )
    SELECT item_id, CAST(row_number() OVER best AS INTEGER) AS rank, doc_id, score
    FROM scored WHERE score > 0
    WINDOW best AS (PARTITION BY item_id ORDER BY score DESC, doc_id)
    QUALIFY row_number() OVER best <= 10
    """,
)
def op11_ranked_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op12_quality_classifier")
def op12_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = quality.fit(docs, table(spark, folder, "labels"))
    return quality.score(docs.select("doc_id", "text"), model).select(
        "doc_id",
        quality.held_out().alias("held_out"),
        "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


@query(
    "op13_phrase_collocations",
    """
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
        FROM documents WHERE text IS NOT NULL
    ), w AS (
        SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS words FROM pieces
    ), totals AS (
        SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM w GROUP BY lang
    ), grams AS (
        SELECT lang, unnest(flatten(list_transform(range(1, 6), lambda k: list_transform(
            range(1, len(words) - k + 2), lambda i: array_to_string(words[i:i + k - 1], ' '))))) AS phrase
        FROM w
    ), f AS (
        SELECT lang, phrase, string_split(phrase, ' ') AS words, count(*) AS n FROM grams GROUP BY ALL HAVING count(*) >= 100
    ), cuts AS (
        SELECT lang, phrase, n AS a, unnest(range(1, len(words))) AS k, words FROM f
    ), scored AS (
        SELECT c.lang, c.phrase, a, x.n AS l, y.n AS r, t.n, k,
            CAST((1000::HUGEINT * a * t.n) // (x.n::HUGEINT * y.n) AS BIGINT) AS score
        FROM cuts AS c JOIN totals AS t USING (lang)
        JOIN f AS x ON x.lang = c.lang AND x.phrase = array_to_string(c.words[1:k], ' ')
        JOIN f AS y ON y.lang = c.lang AND y.phrase = array_to_string(c.words[k + 1:], ' ')
    ), best AS (
        SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
    )
    SELECT lang, row_number() OVER rank AS rank, phrase, a, l, r, n, score
    FROM best
    WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.lang = best.lang AND f.n >= best.a AND f.phrase <> best.phrase
        AND contains(' ' || f.phrase || ' ', ' ' || best.phrase || ' '))
    WINDOW rank AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)
    QUALIFY row_number() OVER rank <= 2000
    """,
)
def op13_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"))
