"""Driver queries of this subpackage: one for each operator, over its whole table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bitplane import read_index, write_ids
from .bpe import bpe_encode
from .common import table
from .embed_dedup import near_vectors
from .exact_dedup import exact_dedup
from .langid import identify_language
from .line_dedup import line_dedup
from .mixing import mix
from .ngram_join import ngram_join
from .pii import find_pii
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .treaps import ranked_search
from .vector_codes import codebooks_digest, compress_vectors, with_label_errors

END_ID = 2


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_dedup(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("hash")


def op6_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, END_ID)
    return read_index(spark, path)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress_vectors(table(spark, sf_dir, "embeddings"))
    return with_label_errors(codes).select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_suffix_dedup, op2_ngram_join, op3_pii, op4_line_dedup, op5_mixing, op6_token_planes, op7_bpe, op8_language, op9_exact_dedup, op10_embedding_dedup, op11_ranked_search, op12_vector_codes, op13_substring_dedup)}

def _codes_sql(rounds: int = 4) -> str:
    """The rounds of op12 one after another: a<k> assigns by the codebooks b<k>, of which b<k + 1> follows."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
        a{k} AS MATERIALIZED (
          SELECT r, part, min(d * 256 + entry) AS z
          FROM (SELECT c.r, c.part, b.entry, sum((c.x - b.x) * (c.x - b.x))::BIGINT AS d FROM c JOIN b{k} b ON b.part = c.part AND b.pos = c.pos GROUP BY ALL) GROUP BY ALL
        )""")
        if k < rounds:
            steps.append(f"""
        b{k + 1} AS MATERIALIZED (
          SELECT b.part, b.entry, b.pos, coalesce((m.s - ((m.s % m.n) + m.n) % m.n) // m.n, b.x)::BIGINT AS x
          FROM b{k} b LEFT JOIN (SELECT a.part, a.z % 256 AS entry, c.pos, sum(c.x) AS s, count(*) AS n FROM a{k} a JOIN c ON c.r = a.r AND c.part = a.part GROUP BY ALL) m
          ON m.part = b.part AND m.entry = b.entry AND m.pos = b.pos
        )""")
    return f"""
        WITH k AS (
          SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        s AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS r, vec_id, label, v, len(v) // 4 AS w FROM k),
        c AS MATERIALIZED (SELECT r, i // w AS part, i % w AS pos, v[i + 1] AS x FROM (SELECT r, w, v, unnest(range(len(v))) AS i FROM s)),
        b0 AS MATERIALIZED (SELECT part, r - 1 AS entry, pos, x FROM c WHERE r <= 256),{",".join(steps)},
        e AS MATERIALIZED (
          SELECT s.vec_id, s.label, string_agg(format('{{:02x}}', a.z % 256), '' ORDER BY a.part) AS code, sum(a.z // 256)::BIGINT AS error
          FROM s JOIN a{rounds} a ON a.r = s.r GROUP BY s.r, s.vec_id, s.label
        )
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
               (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, pos)) FROM b{rounds}) AS codebooks_sha256
        FROM e
    """


ORACLE_SQL: dict[str, str] = {
    "op11_ranked_search": r"""
        WITH t AS (
          SELECT row_number() OVER () AS r, doc_id,
                 regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
          FROM documents
        ),
        d AS (SELECT r, doc_id, ts, len(ts)::BIGINT AS n FROM t WHERE len(ts) > 0),
        g AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM d),
        p AS (SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, n, unnest(ts) AS term FROM d) GROUP BY ALL),
        q AS (
          SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
          FROM benchmark
        ),
        w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), g),
        s AS (
          SELECT q.item_id, p.r, p.doc_id, sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (100 - 90 + ((90 * p.n * g.n_docs) // g.n_terms)))))::BIGINT AS score
          FROM q JOIN p ON p.term = q.term JOIN w ON w.term = q.term, g GROUP BY ALL
        )
        SELECT item_id, rank::INTEGER AS rank, doc_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10
    """,
    "op12_vector_codes": _codes_sql(),
    "op13_substring_dedup": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
        win AS (SELECT r, i, md5(array_to_string(ws[i:i + 34], ' ')) AS m FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 33, 1))) AS i FROM d)),
        s AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY m) AS c FROM win) WHERE c > 1),
        b AS (SELECT r, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i FROM d),
        c AS (
          SELECT b.r, b.i, b.x, max(s.i) OVER (PARTITION BY b.r ORDER BY b.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
          FROM b LEFT JOIN s ON s.r = b.r AND s.i = b.i
        ),
        a AS (SELECT r, count(*) FILTER (gone) AS n_removed, string_agg(x, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY r)
        SELECT d.doc_id, len(d.ws) AS n_words, coalesce(a.n_removed, 0) AS n_removed, sha256(coalesce(a.kept, '')) AS kept_sha256
        FROM d LEFT JOIN a ON a.r = d.r
    """,
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
    "op1_suffix_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        p AS (SELECT doc_id, h, length(h) // 2 AS n FROM d),
        w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS m FROM (SELECT doc_id, h, unnest(range(0, greatest(n - 199, 0))) AS i FROM p)),
        s AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY m) AS c FROM w) WHERE c > 1),
        b AS (SELECT doc_id, unnest(range(0, n)) AS i, unnest(regexp_extract_all(h, '..')) AS x FROM p),
        c AS (
          SELECT b.doc_id, b.i, b.x, max(s.i) OVER (PARTITION BY b.doc_id ORDER BY b.i ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
          FROM b LEFT JOIN s ON s.doc_id = b.doc_id AND s.i = b.i
        ),
        e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM c),
        a AS (
          SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, string_agg(x, '' ORDER BY i) FILTER (NOT gone) AS kept
          FROM e GROUP BY doc_id
        )
        SELECT p.doc_id, p.n AS n_bytes, coalesce(a.n_removed, 0) AS n_removed, coalesce(a.n_spans, 0) AS n_spans, sha256(unhex(coalesce(a.kept, ''))) AS kept_sha256
        FROM p LEFT JOIN a ON a.doc_id = p.doc_id
    """,
    "op10_embedding_dedup": """
        WITH RECURSIVE v AS (
          SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings
        ),
        link AS (
          SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
          WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93
        ),
        reach(node, root) AS (
          SELECT vec_id, vec_id FROM v
          UNION
          SELECT l.b, r.root FROM reach r JOIN link l ON l.a = r.node WHERE r.root < l.b
        ),
        part AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
        SELECT v.vec_id, (SELECT count(*) FROM link WHERE link.a = v.vec_id) AS n_links, p.component_id, v.vec_id = p.component_id AS kept
        FROM v JOIN part p ON p.node = v.vec_id
    """,
    "op4_line_dedup": r"""
        WITH doc AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
        win AS (
          SELECT doc_id, i AS pos, lines[i:i + 2] AS w
          FROM (SELECT doc_id, lines, unnest(range(1, len(lines) - 1)) AS i FROM doc)
        ),
        later AS (SELECT doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS n FROM win) WHERE n > 1),
        gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM later, (SELECT unnest([0, 1, 2]) AS k)),
        line AS (SELECT doc_id, unnest(lines) AS x, unnest(range(1, len(lines) + 1)) AS pos FROM doc),
        kept AS (
          SELECT l.doc_id, string_agg(l.x, chr(10) ORDER BY l.pos) AS text
          FROM line l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos WHERE g.doc_id IS NULL GROUP BY l.doc_id
        ),
        lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
        SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE len(d.lines) END AS n_lines, coalesce(o.n, 0) AS n_removed,
               CASE WHEN d.text IS NULL THEN NULL ELSE sha256(coalesce(k.text, '')) END AS kept_sha256
        FROM doc d LEFT JOIN kept k ON k.doc_id = d.doc_id LEFT JOIN lost o ON o.doc_id = d.doc_id
    """,
}
