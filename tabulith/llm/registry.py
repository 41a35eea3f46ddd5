"""The opN_ queries of this subpackage and SQL for those that SQL can express."""

from __future__ import annotations

from tabulith.llm.embedding_dedup import op3_embedding_dedup
from tabulith.llm.line_dedup import op6_line_dedup
from tabulith.llm.packing import op7_packing
from tabulith.llm.pieces import op2_pieces
from tabulith.llm.quality import op4_quality
from tabulith.llm.sharding import op5_sharding
from tabulith.llm.simhash import op8_simhash
from tabulith.llm.token_files import op1_token_files
from tabulith.llm.toxicity import op10_toxicity
from tabulith.llm.warc import op9_warc

QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_pieces": op2_pieces,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_quality": op4_quality,
    "op5_sharding": op5_sharding,
    "op6_line_dedup": op6_line_dedup,
    "op7_packing": op7_packing,
    "op8_simhash": op8_simhash,
    "op9_warc": op9_warc,
    "op10_toxicity": op10_toxicity,
}

ORACLE_SQL = {
    "op3_embedding_dedup": """
        WITH RECURSIVE sound AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
            WHERE list_cosine_similarity(a.v, b.v) >= 0.9
        ), reached AS (
            SELECT vec_id AS a, vec_id AS b FROM embeddings
            UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
        ), components AS (SELECT a, min(b) AS component_id FROM reached GROUP BY a),
        counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, e.vec_id = component_id AS kept
        FROM embeddings e JOIN components c ON c.a = e.vec_id LEFT JOIN counts k ON k.a = e.vec_id
    """,
    "op9_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
        q AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY h) ELSE page_id END AS first_id FROM p)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN first_id <> page_id THEN first_id END AS refers_to FROM q
    """,
}
