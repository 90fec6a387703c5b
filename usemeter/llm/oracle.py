"""SQL for DuckDB where it can say what an operator says.

The other operators hash, learn, encode or search approximately; their tests compare them with brute force.
"""

from __future__ import annotations

import math

from usemeter.llm.quality_rules import SIGNALS

_ASCII = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"[^\x20\x09-\x0D]+"

MAIN_TEXT = r"""
WITH a AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)(</article>|$)', 1, 's') AS x FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(x, '</?(h1|p|br)>', chr(10), 'g'), '</?b>', '', 'g') AS x FROM a),
c AS (
  SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(
           x, '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g') AS x FROM b),
d AS (SELECT page_id, url, trim(regexp_replace(x, '\s+', ' ', 'g')) AS text FROM c)
SELECT page_id, url, text, length(text) AS n_chars FROM d"""

JACCARD = f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_ASCII}, '{_WORDS}') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] ELSE list_distinct(list_transform(
           range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words),
long AS (SELECT doc_id, len(s) AS n, unnest(s) AS sh FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM long a JOIN long b ON a.sh = b.sh AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id, doc_id AS other FROM sets
          UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.other = links.a)
SELECT doc_id, any_value(len(s)) AS n_shingles, min(other) AS component_id
FROM reach JOIN sets USING (doc_id) GROUP BY doc_id"""


def quality(risk: float = 0.02, error: float = 0.05, gain: float = 0.1) -> str:
    """Base counts and verdicts; the binomial tail as a sum over the logarithms of its terms."""
    tests = ", ".join(
        f"('{s}', {at}, {cutoff})" for s, (_, grid) in SIGNALS.items() for at, cutoff in enumerate(grid)
    )
    values = " UNION ALL ".join(
        f"SELECT doc_id, stratum, good, '{s}' AS signal, coalesce({value}, 0)::DOUBLE AS value FROM judged"
        for s, (value, _) in SIGNALS.items()
    )
    rule_sets = math.prod(len(grid) + 1 for _, grid in SIGNALS.values())

    def tail(k: str) -> str:
        return f"""CASE WHEN {k} > n_good * {risk} THEN 1.0 ELSE list_sum(list_transform(range(0, {k}::BIGINT + 1), lambda i: exp(
           lgamma(n_good + 1) - lgamma(i + 1) - lgamma(n_good - i + 1) + i * ln({risk}) + (n_good - i) * ln(1 - {risk})))) END"""

    order = " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(SIGNALS))
    return f"""
WITH words AS (SELECT doc_id, lang AS stratum, coalesce(text, '') AS t,
                      regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1),
          lambda i: [w[i], w[i + 1], w[i + 2]])) AS g FROM words WHERE len(w) > 3),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) v(k) GROUP BY 1),
lines AS (SELECT doc_id, count(*) AS n, count(DISTINCT line) AS d
          FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM words)
          WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY 1),
counted AS (
  SELECT doc_id, stratum, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         coalesce(lines.n - lines.d, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
         coalesce(lines.n, 0) AS n_lines
  FROM words LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
based AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted),
marks AS (SELECT doc_id, min(quality) >= 1 AS good FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1),
judged AS (SELECT based.*, good FROM based LEFT JOIN marks USING (doc_id)),
measured AS ({values}),
holdout AS (SELECT m.* FROM measured m JOIN based USING (doc_id) WHERE NOT base_failed AND good IS NOT NULL),
tests AS (
  SELECT stratum, h.signal, cutoff, count(*) FILTER (WHERE good) AS n_good, count(*) FILTER (WHERE NOT good) AS n_bad,
         count(*) FILTER (WHERE good AND value > cutoff) AS k, count(*) FILTER (WHERE NOT good AND value > cutoff) AS k_bad
  FROM holdout h JOIN (VALUES {tests}) v(signal, nth, cutoff) ON h.signal = v.signal GROUP BY 1, 2, 3),
level AS (SELECT {error} / ({rule_sets} * count(*)) AS level FROM (SELECT DISTINCT stratum FROM holdout)),
safe AS (
  SELECT * FROM (SELECT *, round(coalesce(k_bad / nullif(n_bad, 0), 0) - k / n_good, 6) AS gain, {tail("k")} AS p
                 FROM tests WHERE n_good > 0), level WHERE gain >= {gain} AND p <= level),
best AS (SELECT stratum, signal, n_good, max_by(cutoff, [gain, cutoff]) AS cutoff, max(gain) AS gain FROM safe GROUP BY 1, 2, 3),
proposed AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY gain DESC, CASE signal {order} END) AS nth FROM best),
lost AS (
  SELECT h.stratum, doc_id, min(nth) AS nth FROM holdout h
  JOIN proposed p ON h.stratum IS NOT DISTINCT FROM p.stratum AND h.signal = p.signal WHERE good AND value > cutoff GROUP BY 1, 2),
joint AS (
  SELECT p.*, (SELECT count(*) FROM lost l WHERE l.stratum IS NOT DISTINCT FROM p.stratum AND l.nth <= p.nth) AS k_all FROM proposed p),
chosen AS (SELECT stratum, signal, cutoff FROM (SELECT *, {tail("k_all")} AS p FROM joint), level WHERE p <= level),
rejected AS (
  SELECT doc_id, string_agg(m.signal, ', ' ORDER BY CASE m.signal {order} END) AS rules
  FROM measured m JOIN chosen c ON m.stratum IS NOT DISTINCT FROM c.stratum AND m.signal = c.signal JOIN based USING (doc_id)
  WHERE value > cutoff AND NOT base_failed GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND rules IS NULL AS kept, coalesce(rules, '') AS rejected_by
FROM based LEFT JOIN rejected USING (doc_id)"""


def clustering(k: int = 8, rounds: int = 10, seed: str = "3") -> str:
    """Lloyd's rounds in plain SQL: every distance of every round."""
    parts = [
        """v AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x::DOUBLE))) = 64)""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, x) - 1 AS cluster, x AS c FROM v QUALIFY cluster < {k})""",
    ]
    for n in range(rounds + 1):
        parts.append(
            f"""a{n} AS MATERIALIZED (
  SELECT r, vec_id, x, cluster, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS distance
  FROM v, c{n} QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, cluster) = 1)"""
        )
        if n < rounds:
            parts.append(
                f"""m{n} AS MATERIALIZED (
  SELECT cluster, list(floor(s / n)::BIGINT ORDER BY i) AS c
  FROM (SELECT cluster, i, sum(e)::DOUBLE AS s, count(*) AS n
        FROM (SELECT cluster, unnest(x) AS e, unnest(range(1, 65)) AS i FROM a{n}) GROUP BY 1, 2) GROUP BY 1),
c{n + 1} AS MATERIALIZED (SELECT cluster, coalesce(m.c, o.c) AS c FROM c{n} o LEFT JOIN m{n} m USING (cluster))"""
            )
    return f"""
WITH {", ".join(parts)}
SELECT vec_id, cluster::INT AS cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia,
       sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (cluster)"""


_TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

RANKED = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, unnest(regexp_extract_all({_ASCII}, '{_TERMS}')) AS term FROM documents),
tf AS (SELECT r, doc_id, term, count(*) AS tf FROM docs GROUP BY 1, 2, 3),
lens AS (SELECT r, count(*) AS n FROM docs GROUP BY 1),
total AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM lens),
norms AS (SELECT r, 10 + (90 * n * n_docs) // n_terms AS m FROM lens, total),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, total),
items AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_ASCII}, '{_TERMS}')) AS term FROM benchmark),
scores AS (
  SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM items JOIN tf USING (term) JOIN weights USING (term) JOIN norms USING (r) GROUP BY 1, 2, 3)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10"""

ARCHIVE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first_id FROM p),
r AS (SELECT *, CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to FROM f)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM r"""


ORACLE: dict[str, str] = {
    "op2_html_extraction": MAIN_TEXT,
    "op4_ngram_join": JACCARD,
    "op5_quality_rules": quality(),
    "op11_centroid_clustering": clustering(),
    "op12_ranked_search": RANKED,
    "op13_warc_archive": ARCHIVE,
}
