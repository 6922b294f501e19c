"""DuckDB statements of sentence packing: recursive statements that take one sentence, or one piece, at a time."""

from __future__ import annotations

COLLAPSED = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
SENTENCES = "list_filter(string_split(regexp_replace({0}, '([.!?]) ([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: trim(s) <> '')"


def words(t: str) -> str:
    return f"len(list_filter(string_split({t}, ' '), lambda w: w <> ''))"


def estimate(t: str) -> str:
    return f"ceil({words(t)} * 1.3::DOUBLE)::INT"


def hard_split(source: str, budget: int, overlap: int, name: str = "walk") -> str:
    """CTE `name` (keys of source, nr of the first piece, pieces, rest) for a table `source` (g, i, t); rows of many pieces come last."""
    stride = budget - overlap
    first = f"length(regexp_extract(substr(rest, 1, {budget}), '(?s)^(.*?)[.!?](\\s|\\z)', 1))"
    return f"""{name} AS (
        SELECT g, i, 0::BIGINT AS nr, []::VARCHAR[] AS pieces, t AS rest, 0::BIGINT AS upto FROM {source}
        UNION ALL
        SELECT g, i, upto, p, CASE WHEN length(rest) > {budget} AND f > {budget * 0.5} THEN substr(rest, f + 2) END, upto + len(p) FROM (
            SELECT *, CASE WHEN length(rest) <= {budget} THEN [rest] WHEN f > {budget * 0.5} THEN [substr(rest, 1, f + 1)]
                ELSE list_transform(range(0, ceil((length(rest) - {budget}) / {stride}.0)::BIGINT + 1), lambda k: substr(rest, k * {stride} + 1, {budget})) END AS p
            FROM (SELECT *, {first} AS f FROM {name} WHERE rest IS NOT NULL)))"""


def packed(tokens: bool, budget: int, overlap: int) -> str:
    """CTEs from `snt` (g, i, s) to `chk` (g, nr, text). Needs WITH RECURSIVE."""
    measure = estimate("s") if tokens else "length(s)"
    share = words("t") if tokens else "length(t) + 1"
    total = (lambda d: f"ceil(({d}) * 1.3::DOUBLE)") if tokens else (lambda d: f"({d}) - 1")
    tail = "CASE WHEN back >= open THEN back ELSE open END" if overlap else "-1"
    tail_sum = "CASE WHEN back >= open THEN back_sum ELSE open_sum END" if overlap else "0"
    return f"""
    big AS (SELECT g, i, s AS t FROM snt WHERE {measure} > {budget}),
    {hard_split("big", budget, overlap, "cuts")},
    part AS (SELECT g, i, nr + generate_subscripts(pieces, 1) - 1 AS nr, unnest(pieces) AS t FROM cuts),
    itm0 AS (SELECT g, i, 0 AS nr, s AS t, 0 AS kind FROM snt WHERE {measure} <= {budget} UNION ALL SELECT g, i, nr, t, CASE WHEN nr = 0 THEN 1 ELSE 2 END FROM part),
    itm1 AS (SELECT g, row_number() OVER w - 1 AS k, t, kind, {share} AS share, sum({share}) OVER w AS upto FROM itm0 WINDOW w AS (PARTITION BY g ORDER BY i, nr)),
    back AS (SELECT e.g, e.k, min(b.k) AS back FROM itm1 e JOIN itm1 b ON b.g = e.g AND b.k <= e.k
        AND (b.k = e.k OR {total("e.upto - b.upto + b.share")} <= {overlap} AND {total("e.upto - b.upto")} < {overlap}) GROUP BY ALL),
    itm AS MATERIALIZED (SELECT x.g, x.k, x.t, x.kind, x.upto, x.upto - x.share AS before, p.back, q.upto - q.share AS back_sum
        FROM itm1 x LEFT JOIN back p ON p.g = x.g AND p.k = x.k - 1 LEFT JOIN itm1 q ON q.g = p.g AND q.k = p.back),
    fold AS (
        SELECT DISTINCT g, 0::BIGINT AS k, -1::BIGINT AS open, 0::HUGEINT AS open_sum, -1::BIGINT AS carried, 0::HUGEINT AS carried_sum, []::STRUCT(a BIGINT, b BIGINT, trimmed BOOLEAN)[] AS emitted FROM itm
        UNION ALL
        SELECT g, k + 1,
            CASE WHEN kind > 0 THEN -1 WHEN goes THEN open WHEN c >= 0 THEN c ELSE k END,
            CASE WHEN kind > 0 THEN 0 WHEN goes THEN open_sum WHEN c >= 0 THEN c_sum ELSE before END,
            CASE WHEN kind > 0 THEN k WHEN goes THEN carried ELSE c END, CASE WHEN kind > 0 THEN before WHEN goes THEN carried_sum ELSE c_sum END,
            CASE WHEN closes THEN [{{'a': open, 'b': k - 1, 'trimmed': true}}] ELSE [] END
                || CASE kind WHEN 1 THEN [{{'a': CASE WHEN c >= 0 THEN c ELSE k END, 'b': k, 'trimmed': false}}] WHEN 2 THEN [{{'a': k, 'b': k, 'trimmed': false}}] ELSE [] END
        FROM (SELECT *, CASE WHEN closes THEN {tail} ELSE carried END AS c, CASE WHEN closes THEN {tail_sum} ELSE carried_sum END AS c_sum FROM (
            SELECT *, open >= 0 AND kind = 0 AND NOT closes AS goes FROM (
                SELECT fold.*, t, kind, upto, before, back, back_sum, open >= 0 AND (kind = 1 OR kind = 0 AND {total("upto - open_sum")} > {budget}) AS closes FROM fold JOIN itm USING (g, k))))
    ),
    ends AS (SELECT g, max(k) + 1 AS n FROM itm GROUP BY g),
    rng AS (SELECT g, k, generate_subscripts(emitted, 1) AS pos, unnest(emitted) AS r FROM fold
        UNION ALL SELECT g, k + 1, 0, {{'a': open, 'b': k - 1, 'trimmed': true}} FROM fold JOIN ends USING (g) WHERE k = n AND open >= 0),
    num AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY k, pos) - 1 AS nr, r FROM rng),
    chk AS (SELECT num.g, nr, CASE WHEN any_value((r).trimmed) THEN trim(string_agg(t, ' ' ORDER BY itm.k)) ELSE string_agg(t, ' ' ORDER BY itm.k) END AS text
        FROM num JOIN itm ON itm.g = num.g AND itm.k BETWEEN (r).a AND (r).b GROUP BY num.g, nr)"""


#: Documents whose every line begins a section headed Start or Part: ln (doc_id, k from 0, n, body, start).
HEADED = """
    ls AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
    ln0 AS (SELECT doc_id, len(l) AS n, generate_subscripts(l, 1) - 1 AS k, unnest(l) AS line FROM ls),
    ln AS (SELECT doc_id, k, n, line || CASE WHEN k < n - 1 THEN chr(10) ELSE '' END AS body,
        8 * (k + 1) + coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM ln0)"""
