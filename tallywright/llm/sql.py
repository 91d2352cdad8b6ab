"""SQL of the training-data queries, where SQL can express them.

The others rest on NFKC words, whole-table overlaps, packings or fitted
distances; tests hold them against brute force on small tables.
"""

from __future__ import annotations

_STRATUM = "lower(trim(regexp_replace({}, '^[\\s\\x{{A0}}]+|[\\s\\x{{A0}}]+$', '', 'g')))"


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": f"""WITH c AS (SELECT split, {_STRATUM.format('stratum')} AS k, label, count(*) AS n FROM eval_rows GROUP BY ALL)
            SELECT t.plan_id, t.stratum, t.label FROM sample_targets t LEFT JOIN c ON t.split IS NOT DISTINCT FROM c.split
            AND {_STRATUM.format('t.stratum')} IS NOT DISTINCT FROM c.k AND t.label IS NOT DISTINCT FROM c.label
            WHERE coalesce(c.n, 0) < greatest(coalesce(t.min_rows, 0), round(coalesce(t.target_share * t.sample_size, 0))::BIGINT)""",
        "p6_found": """SELECT p.pack_id, d.doc_id FROM pack_plans p JOIN documents d ON p.source IS NULL OR p.source = d.source
            WHERE d.text IS NOT NULL AND octet_length(encode(d.text)) + 1 > p.capacity""",
        "p6_validity": """WITH s AS (SELECT p.pack_id, p.capacity, octet_length(encode(d.text)) + 1 AS size FROM pack_plans p JOIN documents d ON p.source IS NULL OR p.source = d.source WHERE d.text IS NOT NULL)
            SELECT pack_id, count(*) AS documents, sum(size)::BIGINT AS used, count(*) FILTER (size > capacity) AS split, 0::BIGINT AS overfull, 0::BIGINT AS needless, 0::BIGINT AS incomplete FROM s GROUP BY pack_id""",
    }
