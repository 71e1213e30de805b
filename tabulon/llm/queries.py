"""Query keys of the operators: each applies one operator to its whole table; SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
import public_tokenizers

from tabulon.llm import ann, lexical, licenses, quality, sentencepieces, toxicity, vector_codes, warc, wavelet
from tabulon.llm.exact_dedup import exact_groups
from tabulon.llm.ngram_join import link_counts
from tabulon.llm.packing import pack
from tabulon.llm.shared import table
from tabulon.llm.substring_dedup import remove_repeats


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_counts(table(spark, sf_dir, "documents"))


def op1_ngram_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op1_ngram_join under its former key."""
    return op1_ngram_join(spark, sf_dir)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return warc.lookup(warc.write(pages), pages, "url").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, shards = wavelet.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return wavelet.read(folder, shards)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_removed", "text")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.codes(table(spark, sf_dir, "embeddings"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(licenses.scan(table(spark, sf_dir, "documents")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_ngram_join, op1_ngram_links, op2_exact_dedup, op3_ann, op4_warc, op5_sentencepiece, op6_packing,
                                   op7_token_output, op8_substring_dedup, op9_toxicity, op10_quality, op11_lexical_search,
                                   op12_vector_codes, op13_license_scan, pipeline)}

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x20\x09-\x0D]+')"""

ORACLE_SQL = {
    "op1_ngram_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5
          THEN [array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)]
          WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS reach FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON r.reach = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, coalesce(k.n_links, 0) AS n_links
FROM documents d LEFT JOIN n USING (doc_id)
JOIN (SELECT node AS doc_id, min(reach) AS component_id FROM r GROUP BY node) m USING (doc_id)
LEFT JOIN (SELECT a AS doc_id, count(*) AS n_links FROM e GROUP BY a) k USING (doc_id)""",
    "op2_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
}

_TERMS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

ORACLE_SQL["op11_lexical_search"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
c AS (SELECT r, doc_id, w, count(*) AS tf FROM (SELECT r, doc_id, unnest({_TERMS}) AS w FROM d) GROUP BY ALL),
l AS (SELECT r, sum(tf)::BIGINT AS n FROM c GROUP BY r),
t AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM l),
f AS (SELECT w, floor(1000 * ln((2 * max(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM c, t GROUP BY w),
i AS (SELECT item_id, w, count(*) AS q FROM (SELECT item_id, unnest({_TERMS}) AS w FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
m AS (SELECT r, 100 - 25 + (25 * n * docs) // total AS m FROM l, t),
s AS (SELECT item_id, r, doc_id, sum(q * weight * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
      FROM i JOIN c USING (w) JOIN f USING (w) JOIN m USING (r) GROUP BY item_id, r, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
WHERE rank <= 20"""



def _codes_sql(rounds: int = 4) -> str:
    """Lloyd rounds unrolled: x are the parts, b the codebooks, m the nearest entry (distance, index) of every part."""
    near = """SELECT r, part, min(struct_pack(d := list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e := e)) AS m
      FROM x JOIN b{k} b USING (part) GROUP BY r, part"""
    steps = "".join(f"""
m{k} AS MATERIALIZED ({near.format(k=k)}),
s{k} AS (SELECT part, m.e AS e, place, floor(sum(value)::DOUBLE / count(*))::BIGINT AS value
      FROM (SELECT part, m, unnest(v) AS value, generate_subscripts(v, 1) AS place FROM m{k} JOIN x USING (r, part)) GROUP BY ALL),
b{k + 1} AS MATERIALIZED (SELECT part, e, coalesce(n.v, b.v) AS v FROM b{k} b LEFT JOIN (SELECT part, e, list(value ORDER BY place) AS v FROM s{k} GROUP BY ALL) n USING (part, e)),"""
                    for k in range(rounds))
    return f"""
WITH u AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)::BIGINT) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
x AS MATERIALIZED (SELECT r, part, list_slice(v, part * (len(v) // 4) + 1, (part + 1) * (len(v) // 4)) AS v FROM u, range(4) p(part)),
b0 AS (SELECT part, r AS e, v FROM x WHERE r < 256),{steps}
a AS ({near.format(k=rounds)}),
c AS (SELECT r, string_agg(printf('%02x', m.e), '' ORDER BY part) AS code, sum(m.d)::BIGINT AS error FROM a GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM u JOIN c USING (r), h"""


ORACLE_SQL["op12_vector_codes"] = _codes_sql()
ORACLE_SQL["op1_ngram_links"] = ORACLE_SQL["op1_ngram_join"]
