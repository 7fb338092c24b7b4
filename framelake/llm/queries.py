"""Queries of the training-data operators, each over its whole table, and their SQL where SQL can express them."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.common import read

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from framelake.llm.bpe import decode, encode

    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    decoded = decode(encode(read(spark, sf_dir, "documents"), tokenizer), tokenizer)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framelake.llm.urls import judge

    return judge(read(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"), "page_id")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framelake.llm import secrets

    spans = F.col("spans")
    base = secrets.base_only(spans)
    return secrets.scan(read(spark, sf_dir, "documents")).select(
        "doc_id",
        *(secrets.count_of(spans, k).alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(secrets.joined(base), 256).alias("base_sha256"),
        secrets.joined(spans).alias("spans"),
    )


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framelake.llm.toxicity import fit, score

    docs = read(spark, sf_dir, "documents")
    return score(docs, fit(docs, read(spark, sf_dir, "labels")))


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from framelake.llm import arrow_store

    manifest = arrow_store.write(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return arrow_store.with_crc(arrow_store.read(manifest))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framelake.llm.exact import groups

    return groups(read(spark, sf_dir, "documents"))


def op7_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framelake.llm.media import read_back, store

    return read_back(store(read(spark, sf_dir, "documents")))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framelake.llm.jaccard import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framelake.llm.mixing import mix

    _, documents = mix(read(spark, sf_dir, "documents"))
    return documents.drop("row_id", "place")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framelake.llm.quality import fit, score

    docs = read(spark, sf_dir, "documents")
    return score(docs, fit(docs, read(spark, sf_dir, "labels")))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framelake.llm.audit import interactions

    return interactions(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framelake.llm.clusters import clustered

    return clustered(read(spark, sf_dir, "embeddings"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framelake.llm.substrings import removed_words, repeated_spans

    return repeated_spans(read(spark, sf_dir, "documents")).select("doc_id", "n_words", removed_words().alias("n_removed"), "kept_sha256")


_FUNCTIONS = (op1_bpe, op2_url_filters, op3_secret_scan, op4_toxicity, op5_token_store, op6_exact_dedup, op7_media_chunks, op8_ngram_jaccard_join, op9_source_mixing, op10_quality)
QUERIES = {f.__name__: f for f in (*_FUNCTIONS, op11_filter_audit, op12_centroid_clusters, op13_substring_dedup)}


def _clustering_sql(rounds: int = 10) -> str:
    """The rounds of op12 one after the other, each comparing every vector with every centroid."""
    steps = []
    for t in range(rounds + 1):
        steps.append(f"""a{t} AS MATERIALIZED (SELECT vec_id, v, j, d FROM (
            SELECT vec_id, v, j, list_sum(list_transform(generate_series(1, 64), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::BIGINT AS d FROM kept, c{t})
            QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, j) = 1)""")
        if t < rounds:
            steps.append(f"""s{t} AS (SELECT j, i, sum(v[i])::BIGINT AS s, count(*)::BIGINT AS n FROM a{t}, generate_series(1, 64) g(i) GROUP BY j, i),
            m{t} AS (SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{t} GROUP BY j),
            c{t + 1} AS MATERIALIZED (SELECT c{t}.j, coalesce(m{t}.c, c{t}.c) AS c FROM c{t} LEFT JOIN m{t} ON m{t}.j = c{t}.j)""")
    return f"""
        WITH kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
        c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS j, v AS c FROM (SELECT sha256('3:' || vec_id) AS h, v FROM kept ORDER BY h LIMIT 8)),
        {", ".join(steps)}
        SELECT vec_id, a.j::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.j))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
               sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM a{rounds} a JOIN c{rounds} c ON a.j = c.j"""


ORACLES = {
    "op2_url_filters": r"""
        WITH rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
        parts AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                         regexp_extract(r, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM rest),
        rules(rh, rp, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block'))
        SELECT page_id, host, path,
               (SELECT max_by(rh || rp, length(rh || rp)) FROM rules WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS rule,
               coalesce((SELECT max_by(v, length(rh || rp)) FROM rules WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)), 'allow') AS verdict
        FROM parts""",
    "op6_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
        g AS (SELECT t, min(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM n GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)""",
    "op11_filter_audit": r"""
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
        w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d),
        f AS (SELECT part, (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT
                     + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(w.doc_id > first_id, false)::INT AS bits, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
              FROM w LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id) l ON l.doc_id = w.doc_id),
        g AS (SELECT part, bits, count(*) AS n, count(*) FILTER (good) AS ng, count(*) FILTER (toxic) AS nt FROM f GROUP BY part, bits),
        l(c, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
        o AS (SELECT a.c || b.c || x.c || d.c || e.c AS filter_order, [a.b, b.b, x.b, d.b, e.b] AS bs FROM l a, l b, l x, l d, l e WHERE a.b + b.b + x.b + d.b + e.b = 31 AND a.b | b.b | x.b | d.b | e.b = 31),
        s AS (SELECT filter_order, step::INT AS step, bs[step] AS own, coalesce(list_sum(bs[1:step - 1]), 0)::INT AS before FROM o, generate_series(1, 5) t(step)),
        r AS (SELECT part, filter_order, step, own,
                     sum(n) FILTER (bits & (before | own) = 0) AS kept, sum(n) FILTER (bits & before = 0 AND bits & own > 0) AS removed, sum(n) FILTER (bits & before > 0 AND bits & own > 0) AS redundant,
                     sum(n) FILTER (bits = own) AS unique_fails, sum(ng) FILTER (bits & before = 0 AND bits & own > 0) AS good_lost, sum(nt) FILTER (bits & before = 0 AND bits & own > 0) AS toxic_lost
              FROM g, s GROUP BY part, filter_order, step, own)
        SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
               coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, (sum(coalesce(removed, 0)) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r""",
    "op12_centroid_clusters": _clustering_sql(),
    "op13_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        p AS (SELECT doc_id, unnest(generate_series(1, len(ws)::BIGINT)) AS i, unnest(ws) AS word FROM d WHERE len(ws) > 0),
        w AS (SELECT doc_id, i, md5(array_to_string(list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING), ' ')) AS h, count(*) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING) AS n FROM p),
        o AS (SELECT h, min(doc_id) AS least FROM w WHERE n = 50 GROUP BY h),
        r AS (SELECT p.doc_id, p.i, p.word, max(CASE WHEN w.n = 50 AND o.least < p.doc_id THEN p.i END) OVER (PARTITION BY p.doc_id ORDER BY p.i) AS last
              FROM p JOIN w ON w.doc_id = p.doc_id AND w.i = p.i LEFT JOIN o ON o.h = w.h),
        k AS (SELECT doc_id, count(*)::BIGINT AS n_words, count(*) FILTER (coalesce(last > i - 50, false)) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT coalesce(last > i - 50, false)) AS kept FROM r GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
}
