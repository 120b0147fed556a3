"""DuckDB SQL of the queries that SQL can express."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

ORACLE: dict[str, str] = {
    "op5_exact_dedup": f"""
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
      doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
    FROM (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS norm FROM documents)
    WINDOW g AS (PARTITION BY norm)""",
    "op11_filter_audit": f"""
    WITH words AS (
      SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
        regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+') AS w
      FROM documents),
    facts AS (
      SELECT w.doc_id, part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
        len(w) < 50 AS a, 100 * list_unique(w) < 65 * len(w) AS b,
        100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t) AS c,
        regexp_matches(t, '[#$%&*|]') AS d,
        coalesce(min(w.doc_id) OVER (PARTITION BY t) < w.doc_id, false) AS e
      FROM words w LEFT JOIN (
        SELECT doc_id, max((quality = 1)::int) AS good, max((toxic = 1)::int) AS toxic
        FROM labels GROUP BY doc_id) l ON w.doc_id = l.doc_id),
    cells AS (
      SELECT part, a::int + 2 * b::int + 4 * c::int + 8 * d::int + 16 * e::int AS p,
        count(*) AS n, sum(good)::bigint AS good, sum(toxic)::bigint AS toxic
      FROM facts GROUP BY ALL),
    letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
    orders AS (
      SELECT l1.x || l2.x || l3.x || l4.x || l5.x AS filter_order
      FROM letters l1, letters l2, letters l3, letters l4, letters l5
      WHERE list_unique([l1.x, l2.x, l3.x, l4.x, l5.x]) = 5),
    steps AS (
      SELECT filter_order, step::int AS step, 1 << (ascii(filter_order[step]) - 65) AS f,
        list_sum([1 << (ascii(x) - 65) FOR x IN string_split(filter_order[:step - 1], '') IF x <> '']) AS s
      FROM orders, range(1, 6) r(step)),
    results AS (
      SELECT part, filter_order, step, f,
        sum(CASE WHEN p & (coalesce(s, 0)::bigint | f) = 0 THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN p & f <> 0 AND p & coalesce(s, 0)::bigint = 0 THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN p & f <> 0 AND p & coalesce(s, 0)::bigint <> 0 THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN p = f THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN p & f <> 0 AND p & coalesce(s, 0)::bigint = 0 THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN p & f <> 0 AND p & coalesce(s, 0)::bigint = 0 THEN toxic ELSE 0 END) AS toxic_lost
      FROM cells, steps GROUP BY ALL)
    SELECT part, filter_order, step, kept::bigint AS kept, removed::bigint AS removed,
      redundant::bigint AS redundant, unique_fails::bigint AS unique_fails,
      good_lost::bigint AS good_lost, toxic_lost::bigint AS toxic_lost,
      sum(removed) OVER (PARTITION BY part, f)::bigint AS shapley
    FROM results""",
    "op12_lexical_search": f"""
    WITH docs AS (
      SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_TERM}') AS terms
      FROM documents),
    totals AS (SELECT count(*) AS n_all, sum(len(terms))::bigint AS total FROM docs WHERE len(terms) > 0),
    items AS (
      SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_TERM}')) AS term
      FROM benchmark),
    found AS (
      SELECT r, doc_id, term, count(*) AS tf, any_value(n) AS n
      FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM docs)
      WHERE term IN (SELECT term FROM items) GROUP BY r, doc_id, term),
    weights AS (
      SELECT term, floor(1000 * ln((2 * any_value(n_all) + 2) / (2 * count(*) + 1)))::bigint AS w
      FROM found, totals GROUP BY term),
    scores AS (
      SELECT item_id, doc_id, r,
        sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_all) // total))))::bigint AS score
      FROM items JOIN found USING (term) JOIN weights USING (term), totals
      GROUP BY item_id, doc_id, r),
    ranked AS (
      SELECT item_id, doc_id, score,
        row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r)::int AS rank
      FROM scores WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50""",
}
