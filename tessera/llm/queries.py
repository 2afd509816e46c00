"""The registered queries of this package, one per operator, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, filter_audit, line_dedup, ngram_join, packing, quality, repeats, secret_scan, topk, toxicity, vector_codes, warc

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_scan(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "class_id", "n_links")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.line_dedup(table(spark, sf_dir, "documents"), exact=1)
    return kept.select("doc_id", F.col("removed_lines").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select(F.col("id").alias("doc_id"), "log_weight", "n_grams", "p_target", "kept")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "coverage", "item_id", "n_items", "leaked")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.encode(table(spark, sf_dir, "embeddings")).drop("label", "codes")


def queries() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (
            op4_exact_dedup, op7_packing, op2_secrets, op10_warc, op8_ngram_jaccard, op9_line_dedup, op6_quality, op1_decontaminate, op3_suffix_dedup, op5_toxicity, op11_filter_audit, op12_top_k,
            op13_vector_codes,
        )
    }


USABLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def codes_sql(n: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Lloyd's rounds written out, each from all parts."""
    nearest = """SELECT vec_id, p, arg_min(e, (far, e)) AS e, min(far) AS far FROM (
        SELECT x.vec_id, x.p, b.e, list_sum(list_transform(list_zip(x.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS far FROM x JOIN b{r} b ON b.p = x.p) GROUP BY vec_id, p"""
    steps = ""
    for r in range(rounds):
        steps += f""", a{r} AS ({nearest.format(r=r)}), m{r} AS (SELECT p, e, list(m ORDER BY k) AS x FROM (
            SELECT a.p, a.e, k, CAST(sum(x.x[k]) - ((sum(x.x[k]) % count(*)) + count(*)) % count(*) AS BIGINT) // count(*) AS m FROM a{r} a JOIN x ON x.vec_id = a.vec_id AND x.p = a.p CROSS JOIN ks GROUP BY a.p, a.e, k) GROUP BY p, e),
            b{r + 1} AS (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM b{r} b LEFT JOIN m{r} m USING (p, e))"""
    return f"""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE {USABLE}),
        x AS (SELECT vec_id, p, v[p * (len(v) // {n}) + 1:(p + 1) * (len(v) // {n})] AS x FROM v CROSS JOIN (SELECT unnest(range({n})) AS p)),
        ks AS (SELECT unnest(range(1, (SELECT max(len(v)) // {n} FROM v) + 1)) AS k),
        f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM v ORDER BY vec_id LIMIT {entries}),
        b0 AS (SELECT x.p, f.e, x.x FROM f JOIN x USING (vec_id)){steps}, a AS ({nearest.format(r=rounds)}),
        c AS (SELECT vec_id, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, CAST(sum(far) AS BIGINT) AS error FROM a GROUP BY vec_id)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
               (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256 FROM c JOIN v USING (vec_id)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op11_filter_audit": r"""
            WITH RECURSIVE t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
                 w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM t),
                 m AS (SELECT doc_id, part, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text),
                              regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > first, false)] AS bad FROM w),
                 d AS (SELECT part, bad, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = m.doc_id AND quality = 1) AS good, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = m.doc_id AND toxic = 1) AS toxic FROM m),
                 c AS (SELECT part, bad, count(*) AS n, count(*) FILTER (WHERE good) AS n_good, count(*) FILTER (WHERE toxic) AS n_toxic FROM d GROUP BY 1, 2),
                 o AS (SELECT '' AS f UNION ALL SELECT o.f || x.x FROM o, (SELECT unnest(string_split('ABCDE', '')) AS x) x WHERE instr(o.f, x.x) = 0),
                 s AS (SELECT f, k, ascii(f[k]) - 64 AS own, list_transform(string_split(f[:k - 1], ''), lambda x: ascii(x) - 64) AS before FROM o CROSS JOIN (SELECT unnest(range(1, 6)) AS k) WHERE length(f) = 5),
                 r AS (SELECT part, f, k, own, bad[own] AS fails, len(list_filter(before, lambda x: x > 0 AND bad[x])) > 0 AS gone, len(list_filter(bad, lambda x: x)) = 1 AS alone, n, n_good, n_toxic FROM c CROSS JOIN s),
                 z AS (SELECT part, f AS filter_order, k AS step, own, sum(n) FILTER (WHERE NOT gone AND NOT fails) AS kept, sum(n) FILTER (WHERE NOT gone AND fails) AS removed, sum(n) FILTER (WHERE gone AND fails) AS redundant,
                              sum(n) FILTER (WHERE alone AND fails) AS unique_fails, sum(n_good) FILTER (WHERE NOT gone AND fails) AS good_lost, sum(n_toxic) FILTER (WHERE NOT gone AND fails) AS toxic_lost FROM r GROUP BY 1, 2, 3, 4)
            SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
                   CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
                   CAST(coalesce(sum(removed) OVER (PARTITION BY part, own), 0) AS BIGINT) AS shapley FROM z""",
        "op12_top_k": f"""
            WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE {USABLE}),
                 s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)
            SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY rank <= 20""",
        "op13_vector_codes": codes_sql(),
        "op10_warc": """
            WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
                 k AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS keeper FROM p)
            SELECT page_id, n AS payload_bytes, h AS payload_digest,
                   CASE WHEN n >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN n >= 1000 AND page_id <> keeper THEN keeper END AS refers_to
            FROM k""",
        "op8_ngram_jaccard": r"""
            WITH RECURSIVE t AS (SELECT coalesce(text, '') AS text, min(doc_id) AS id FROM documents GROUP BY 1),
                 w AS (SELECT id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM t),
                 s AS (SELECT DISTINCT id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                              ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
                       FROM w WHERE len(w) > 0),
                 n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
                 c AS (SELECT a.id AS a, b.id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.id <> b.id GROUP BY 1, 2),
                 l AS (SELECT a, b FROM c JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE common >= 0.8 * (x.n + y.n - common) - 1e-9),
                 r AS (SELECT id AS node, id AS reach FROM t UNION SELECT r.node, l.b FROM r JOIN l ON r.reach = l.a),
                 k AS (SELECT node, min(reach) AS class_id FROM r GROUP BY node),
                 m AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
            SELECT d.doc_id, CASE WHEN EXISTS (SELECT 1 FROM n WHERE n.id = t.id) THEN k.class_id ELSE d.doc_id END AS class_id,
                   coalesce(m.n_links, 0) AS n_links
            FROM documents d JOIN t ON t.text = coalesce(d.text, '') JOIN k ON k.node = t.id LEFT JOIN m ON m.a = t.id""",
        "op9_line_dedup": r"""
            WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line
                       FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
                 u AS (SELECT line, length(line) AS n, min((doc_id, pos)) AS place FROM l WHERE length(line) >= 20 OR regexp_matches(line, '[^ \t\n\x0B\f\r]') GROUP BY 1, 2),
                 c AS (SELECT a.line, b.line AS other FROM u a JOIN u b ON least(a.n, b.n) >= 20 AND b.n BETWEEN a.n - 1 AND a.n + 1 AND b.place < a.place
                       WHERE left(a.line, (a.n - 1) // 2) = left(b.line, (a.n - 1) // 2) OR right(a.line, (a.n - 1) // 2) = right(b.line, (a.n - 1) // 2)),
                 z AS (SELECT DISTINCT line FROM c WHERE levenshtein(line, other) <= 1),
                 k AS (SELECT l.*, u.line IS NULL OR (u.place = (l.doc_id, l.pos) AND z.line IS NULL) AS stays
                       FROM l LEFT JOIN u ON u.line = l.line LEFT JOIN z ON z.line = l.line)
            SELECT doc_id, count(*) FILTER (WHERE NOT stays) AS n_removed,
                   sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE stays), '')) AS kept_sha256
            FROM k GROUP BY doc_id""",
        "op4_exact_dedup": r"""
            WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                              sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents)
            SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
                   row_number() OVER w = 1 AS kept, h AS text_sha256
            FROM d WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id)""",
    }
