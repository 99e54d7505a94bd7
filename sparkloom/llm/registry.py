"""Queries of this subpackage and the SQL that says the same where SQL can."""

from __future__ import annotations

from . import decontam, jaccard, langid, licenses, neardup, packing, pii, quality, sharding, tokencount

QUERIES = {
    "op1_reshard_min_cost_flow": sharding.op1,
    "op2_ngram_jaccard_join": jaccard.op2,
    "op2_ngram_jaccard_links": jaccard.op2_links,
    "op3_greedy_string_tiling": decontam.op3,
    "op4_pii_surrogates": pii.op4,
    "op5_token_separator_scan": tokencount.op5,
    "op6_license_sentence_rules": licenses.op6,
    "op7_random_indexing_quality": quality.op7,
    "op8_best_two_fit_packing": packing.op8,
    "op9_word_first_langid": langid.op9,
    "op10_rp_forest_near_dedup": neardup.op10,
}

#: All links by comparing every pair that shares a shingle; components by recursion.
_OP2 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\v\f\r]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w
), n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s
), x AS (SELECT doc_id, unnest(s) AS h FROM s
), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r(doc_id, k) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.k)
SELECT doc_id, n AS n_shingles, component_id FROM n JOIN (SELECT doc_id, min(k) AS component_id FROM r GROUP BY doc_id) USING (doc_id)
"""

#: The same with each document's links counted.
_OP2_LINKS = _OP2.replace("SELECT doc_id, n AS n_shingles, component_id FROM n", "SELECT doc_id, n AS n_shingles, component_id, (SELECT count(*) FROM e WHERE e.a = n.doc_id) AS n_links FROM n")

#: All pairs of a label, compared in double precision.
_OP10 = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
), l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.98
), r(vec_id, k) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.k
), c AS (SELECT vec_id, min(k) AS component_id FROM r GROUP BY vec_id)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = c.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM c
"""

ORACLES: dict[str, str] = {"op2_ngram_jaccard_join": _OP2, "op2_ngram_jaccard_links": _OP2_LINKS, "op10_rp_forest_near_dedup": _OP10}
