"""The queries of the thirteen operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import docs_table as documents


def vocabulary() -> str:
    """The public vocabulary file that op5 is checked against; an argument of the operator itself."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    vectors = embeddings(spark, sf_dir)
    return nearest(vectors, vectors.filter("vec_id % 20 = 0"), k=20)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import find_secrets

    out = find_secrets(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(documents(spark, sf_dir), words=2, percent=80)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import drop_repeated_lines

    out = drop_repeated_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode

    out = encode(documents(spark, sf_dir).select("doc_id", "text"), vocabulary(), decode=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    return scan_licenses(documents(spark, sf_dir))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import KINDS, find_pii, span_text

    out = find_pii(documents(spark, sf_dir))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, lambda k: k == F.lit(n))).cast("long").alias(f"n_{name}") for n, name in enumerate(KINDS[:4])]
    both = F.concat_ws(",", *(F.when(F.size(c) > 0, span_text(F.col(c), k)) for c, k in (("base", None), ("terms", 4))))
    return out.select("doc_id", *counts, F.sha2(span_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), both.alias("spans"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit_on, held_out, score

    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_counts

    return mix_counts(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    vectors = embeddings(spark, sf_dir)
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .alignment import align

    return align(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngramjoin import jaccard_components

    return jaccard_components(documents(spark, sf_dir))


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .centroids import centroid_digests, cluster_vectors

    out, final = cluster_vectors(embeddings(spark, sf_dir))
    digests = F.array(*map(F.lit, centroid_digests(final))) if final else F.array().cast("array<string>")
    return out.withColumn("centroid_sha256", F.try_element_at(digests, F.col("cluster") + 1))


QUERIES = {f.__name__: f for f in (op1_ann, op2_secrets, op3_near_duplicates, op4_line_dedup, op5_bpe, op6_licenses, op7_pii, op8_quality, op9_mixing, op10_top_k, op11_alignment, op12_ngram_join, op13_clusters)}

_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_SPACE = r"'[\x20\x09-\x0D]+'"



def _lloyd_sql(clusters: int = 16, rounds: int = 3) -> str:
    """Each round as tables: long form of the centroids, distances, assignment, exact floors of the means."""
    parts = [
        "v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, q) - 1 AS k, q AS c FROM v QUALIFY k < {clusters})",
    ]
    for n in range(rounds + 1):
        parts.append(f"d{n} AS (SELECT r, k, list_sum(list_transform(list_zip(q, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS far FROM v CROSS JOIN c{n})")
        parts.append(f"a{n} AS (SELECT r, k, far FROM d{n} QUALIFY row_number() OVER (PARTITION BY r ORDER BY far, k) = 1)")
        if n < rounds:
            parts.append(f"s{n} AS (SELECT k, i, sum(x) AS s, count(*) AS n FROM (SELECT a.k, unnest(v.q) AS x, generate_subscripts(v.q, 1) AS i FROM a{n} a JOIN v USING (r)) GROUP BY k, i)")
            parts.append(f"m{n} AS (SELECT k, list(((s - ((s % n) + n) % n) / n)::HUGEINT::BIGINT ORDER BY i) AS c FROM s{n} GROUP BY k)")
            parts.append(f"c{n + 1} AS (SELECT k, coalesce(m{n}.c, c{n}.c) AS c FROM c{n} LEFT JOIN m{n} USING (k))")
    return f"""
        WITH {", ".join(parts)}
        SELECT vec_id, k::INT AS cluster, far AS distance, sum(far) OVER (PARTITION BY k)::BIGINT AS cluster_inertia, sum(far) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM a{rounds} JOIN v USING (r) JOIN c{rounds} USING (k)"""


def _jaccard_sql(words: int, percent: int, more: str = "") -> str:
    """Pairs by a join on shingles, links by their sizes and common shingles, the smallest reachable id by recursion."""
    gram = " || ' ' || ".join(f"w[i + {k}]" if k else "w[i]" for k in range(words))
    return rf"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), {_LETTERS}), {_SPACE}), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {words} THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - {words - 2}), lambda i: {gram})) END AS s FROM w),
        g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
        pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS common
            FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id),
        links AS (SELECT u, v FROM pairs WHERE 100 * common >= {percent} * (n + m - common)), every AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.v FROM reach r JOIN every e ON r.b = e.u),
        least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
        SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id{more} FROM s JOIN least ON a = doc_id"""


#: The other operators' columns hold what SQL can't express (trained or inferred models, an index, a vocabulary's merges,
#: draws); the tests hold those queries against plain versions, the library or held-out rows instead.
ORACLES: dict[str, str] = {
    "op3_near_duplicates": _jaccard_sql(2, 80, ", doc_id = component_id AS kept"),
    "op4_line_dedup": rf"""
        WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents), l AS (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS n FROM t),
        k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {_LETTERS}) AS key FROM l),
        listed AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
        told AS (SELECT k.*, coalesce(last <> doc_id, false) AS gone FROM k LEFT JOIN listed USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256 FROM told GROUP BY doc_id""",
    "op10_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.x, v.x)::BIGINT AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)
        SELECT query_id, (row_number() OVER w)::INT AS rank, vec_id, score FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5""",
    "op12_ngram_join": _jaccard_sql(4, 85),
    "op13_clusters": _lloyd_sql(),
}
