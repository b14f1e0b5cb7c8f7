"""The queries of this subpackage: opN_<name>(spark, sf_dir), and the SQL that expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import extraction, fingerprint, lexical, licenses, ngram_join, packing, passages, pieces, quality, toxicity, variants, vptree, warc
from ._util import table


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edit_report(table(spark, sf_dir, "documents"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeats(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return vptree.knn(rows, rows.where(F.col("vec_id") % 100 == 0), k=10)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op10_pieces(spark: SparkSession, sf_dir: str, model_path: str = PIECE_MODEL) -> DataFrame:
    """doc_id, ids, n_ids, and whether decoding the ids gives the text again."""
    vocabulary = pieces.load(spark, model_path)
    rows = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary)
    rows = pieces.decode(rows, vocabulary, out="decoded")
    return rows.select("doc_id", "ids", F.size("ids").cast("long").alias("n_ids"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("same_again"))


def unigram_pieces(spark: SparkSession, sf_dir: str, model_path: str = PIECE_MODEL) -> DataFrame:
    """Like op10_pieces, by Viterbi over the same pieces as a unigram model."""
    vocabulary = pieces.by_rank(pieces.load(spark, model_path))
    rows = pieces.decode(pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary), vocabulary, out="decoded")
    return rows.select("doc_id", "ids", F.size("ids").cast("long").alias("n_ids"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("same_again"))


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents"))


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.write_and_read(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_fingerprint, op2_ngram_join, op3_packing, op4_passages, op5_quality, op6_extraction, op7_nearest, op8_toxicity, op9_licenses, op10_pieces, op11_variants, op12_search, op13_warc, unigram_pieces)}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op11_variants": f"""
        WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda b: list_reduce([b] || [0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
        r AS (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[A-Za-zÀ-ÿ]+')) AS w FROM documents) WHERE length(w) >= 6 GROUP BY ALL),
        u AS (SELECT w, c, list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [195, unicode(x) - 64] END) AS b FROM r),
        h AS (SELECT w, c, xor(4294967295, list_reduce([CAST(4294967295 AS BIGINT)] || CAST(flatten(b) AS BIGINT[]), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]))) AS h FROM u, crc),
        e AS (SELECT CASE WHEN h % 199 = 0 THEN w[1:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word, c FROM h),
        v AS MATERIALIZED (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM e WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
        d AS MATERIALIZED (SELECT word, n, i, word[1:i-1] || word[i+1:] AS s FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
        p AS (SELECT a.word AS word, b.word AS near, b.n AS near_n FROM d a JOIN d b ON a.s = b.s AND a.i = b.i AND a.word <> b.word
              UNION SELECT a.word, b.word, b.n FROM d a JOIN v b ON a.s = b.word UNION SELECT b.word, a.word, a.n FROM d a JOIN v b ON a.s = b.word),
        k AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM p GROUP BY word),
        f AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n FROM v LEFT JOIN k USING (word)),
        t AS (SELECT word, word AS root FROM f UNION ALL SELECT t.word, f.form FROM t JOIN f ON f.word = t.root WHERE f.form IS NOT NULL)
        SELECT f.word, f.form, t.root, f.n, f.n_near, f.form_n FROM f JOIN t USING (word) JOIN f g ON g.word = t.root WHERE g.form IS NULL""",
    "op12_search": f"""
        WITH q AS MATERIALIZED (SELECT DISTINCT item_id, unnest({_TERMS.format(_LOWER.format("text"))}) AS t FROM benchmark),
        o AS MATERIALIZED (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest({_TERMS.format(_LOWER.format("text"))}) AS t FROM documents) GROUP BY ALL),
        l AS MATERIALIZED (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM o GROUP BY doc_id),
        z AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM l),
        w AS MATERIALIZED (SELECT t, CAST(floor(1000 * ln((2 * any_value(nn) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM o, z GROUP BY t),
        s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll)))) AS BIGINT) AS score FROM q JOIN o USING (t) JOIN w USING (t) JOIN l USING (doc_id), z GROUP BY item_id, doc_id)
        SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 50""",
    "op13_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        k AS (SELECT payload_digest, max(page_id) AS keeper FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN keeper IS NULL OR keeper IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN keeper IS DISTINCT FROM page_id THEN keeper END AS refers_to
        FROM (SELECT p.*, k.keeper FROM p LEFT JOIN k ON p.payload_digest = k.payload_digest AND p.payload_bytes >= 1000)""",
    "op2_ngram_join": """
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
        g AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM w),
        n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
        both_ways AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT a AS doc_id, a AS c FROM both_ways UNION SELECT t.b, r.c FROM r JOIN both_ways t ON t.a = r.doc_id)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.c, d.doc_id) AS component_id FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m USING (doc_id)""",
    "op7_nearest": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        d AS (SELECT q.vec_id AS query_id, v.vec_id, list_distance(q.e, v.e) AS score FROM v q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id)
        SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d) WHERE rank <= 10""",
}
