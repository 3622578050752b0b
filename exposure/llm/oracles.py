"""SQL forms of the corpus queries, where SQL can say what they compute."""

from __future__ import annotations

from exposure.llm.url_filter import SOFT, STRICT

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

#: A-Z alone are folded
LOWER_WORDS = WORDS.replace(
    "coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
)
#: as integers, which keeps the joins small
SHINGLES = f"""
    docs AS (SELECT doc_id, {LOWER_WORDS} AS w FROM documents),
    spread AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM docs WHERE len(w) > 0),
    shingles AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, p, p + 4), ' ') AS s FROM spread)
"""



def _spans_sql(kinds: list[tuple[str, str, str]], n_base: int) -> str:
    """Spans of kinds (name, pattern, condition on v, bef and aft), as counts, digest and list."""
    found = " UNION ALL ".join(
        f"""SELECT r, {rank} AS rank, '{name}' AS kind, m AS v, coalesce(lag(g) OVER w, '') AS no, right(g, 40) AS bef,
                   left(lead(g) OVER w, 40) AS aft,
                   (sum(length(g) + coalesce(length(m), 0)) OVER w - coalesce(length(m), 0))::BIGINT AS s
            FROM (SELECT r, unnest(string_split_regex(text, '{pattern}')) AS g,
                         unnest(regexp_extract_all(text, '{pattern}')) AS m,
                         unnest(range(len(regexp_extract_all(text, '{pattern}')) + 1)) AS i FROM texts)
            WINDOW w AS (PARTITION BY r ORDER BY i)"""
        for rank, (name, pattern, _) in enumerate(kinds)
    )
    keep = " OR ".join(f"(rank = {rank} AND ({check}))" for rank, (_, _, check) in enumerate(kinds))
    counts = ", ".join(f"count(*) FILTER (rank = {rank})::BIGINT AS n_{kinds[rank][0]}" for rank in range(n_base))
    zero = ", ".join(f"coalesce(n_{kinds[rank][0]}, 0) AS n_{kinds[rank][0]}" for rank in range(n_base))
    return f"""
        WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
        found AS ({found}),
        spans AS (SELECT r, rank, s, kind || ':' || s || ':' || (s + length(v)) AS span FROM found WHERE v IS NOT NULL AND ({keep})),
        told AS (SELECT r, {counts}, string_agg(span, ',' ORDER BY s, rank) AS spans,
                        string_agg(span, ',' ORDER BY s, rank) FILTER (rank < {n_base}) AS base FROM spans GROUP BY r)
        SELECT doc_id, {zero}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM texts LEFT JOIN told USING (r)
    """


_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = f"""length({_DIGITS}) BETWEEN 12 AND 19 AND list_sum(list_transform(range(length({_DIGITS})), lambda i:
    CASE WHEN i % 2 = 0 THEN substr({_DIGITS}, (length({_DIGITS}) - i)::INT, 1)::INT
         ELSE [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][substr({_DIGITS}, (length({_DIGITS}) - i)::INT, 1)::INT + 1] END)) % 10 = 0"""
_TURNED = "(substr(replace(v, ' ', ''), 5) || left(replace(v, ' ', ''), 4))"
_MOD_97 = f"""(array_to_string(list_transform(string_split({_TURNED}, ''),
    lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE (ascii(c) - 55)::VARCHAR END), '')::HUGEINT) % 97 = 1"""
_ALONE = "NOT regexp_matches(bef, '[A-Za-z0-9]$') AND NOT regexp_matches(aft, '^[A-Za-z0-9]')"
_BESIDE = r"regexp_matches(lower({0}), '(^|[^a-z])(ssn|social security|identity|id number)($|[^a-z])')"
_ASSIGN = (
    r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"
    r"|[aA][pP][iI]_?[kK][eE][yY])[\"'']?\x20*[:=]\x20*[\"'']?[A-Za-z0-9+/_.=-]+"
)


def _terms_sql(terms) -> str:
    """Distinct terms that stand free in the lower-cased URL ``u``."""
    return "list_filter([" + ", ".join(f"'{t}'" for t in terms) + "], lambda t: regexp_matches(u, '(^|[^a-z0-9])' || t || '($|[^a-z0-9])'))"


_WEIGHT = "CASE t " + " ".join(f"WHEN '{t}' THEN {w}" for t, w in SOFT.items()) + " END"

_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_AZ}', '{_AZ.lower()}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLES = {
    "op2_url_filter": rf"""
        WITH parts AS (SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1) AS h,
                       regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
                       translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS u FROM pages),
        low AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path,
                len({_terms_sql(STRICT)})::BIGINT AS n_strict, {_terms_sql(SOFT)} AS soft FROM parts),
        rules(rh, rp, rv) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                              ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
        fits AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS rv FROM low JOIN rules
                 ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id),
        weighed AS (SELECT *, len(soft)::BIGINT AS n_soft,
                    coalesce(round(list_sum(list_transform(soft, lambda t: ({_WEIGHT})::DOUBLE)), 6), 0.0)::DOUBLE AS weight FROM low)
        SELECT page_id, host, path, rule, n_strict, n_soft, weight, coalesce(rv, CASE WHEN n_strict > 0 OR n_soft >= 3 OR weight >= 1.8
               THEN 'block' ELSE 'allow' END) AS verdict
        FROM weighed LEFT JOIN fits USING (page_id)
    """,
    "op6_exact_top_k": """
        WITH ints AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
                      WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
        scored AS (SELECT q.vec_id AS query_id, r.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * r.v[i]))::BIGINT AS score
                   FROM ints q JOIN ints r ON q.vec_id % 100 = 0 AND r.vec_id <> q.vec_id)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
        FROM scored QUALIFY rank <= 10
    """,
    "op1_pii": _spans_sql([
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
         "list_max(list_transform(string_split(v, '.'), lambda x: x::HUGEINT)) <= 255"),
        ("card", r"[0-9](?:[\x20-]?[0-9])+", _LUHN),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15"),
        ("iban", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}", f"{_ALONE} AND {_MOD_97}"),
        ("id_number", r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
         f"{_ALONE} AND NOT regexp_matches(v, '^(000|666|9)|-00-|-0000$') AND ({_BESIDE.format('bef')} OR {_BESIDE.format('aft')})"),
    ], 4),
    "op4_secret_scan": _spans_sql([
        ("assign", _ASSIGN, r"length(regexp_extract(v, '[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 6"),
        ("access", "AKIA[A-Z0-9]+", "length(v) >= 20"),
        ("hex", "[0-9a-f]+", "length(v) >= 24"),
        ("private_key", "-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", "true"),
        ("github", "gh[opsu]_[A-Za-z0-9]{36,}", "true"),
        ("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "true"),
    ], 3),
    "op3_source_mixing": r"""
        WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
        sums AS (SELECT source, sum(size)::BIGINT AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sized GROUP BY source),
        weighed AS (SELECT *, [5, 2, 1][rank % 3 + 1] AS w, 2 * n AS cap FROM sums),
        levels AS (SELECT *, (1.5 * sum(n) OVER () - coalesce(sum(cap) OVER below, 0))::DOUBLE
                   / (sum(w) OVER () - coalesce(sum(w) OVER below, 0)) AS level
                   FROM weighed WINDOW below AS (ORDER BY cap::DOUBLE / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        met AS (SELECT level FROM levels WHERE level * w <= cap ORDER BY cap::DOUBLE / w, rank LIMIT 1),
        targets AS (SELECT source, n, least(met.level * w, cap::DOUBLE) AS target, rank FROM levels, met),
        flow AS (SELECT doc_id, size, n, target, (rank % 3)::INT AS class, round(target)::BIGINT AS wanted,
                   (sum(size) OVER (PARTITION BY rank ORDER BY left(md5(doc_id::VARCHAR), 16), doc_id) - size)::BIGINT AS went
                   FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source),
        copies AS (SELECT *, greatest(least(size, wanted - went), 0) AS c0, greatest(least(size, wanted - went - n), 0) AS c1 FROM flow),
        middle AS (SELECT *, (CASE WHEN c0 > 0 THEN went + c0 / 2 ELSE went + n + c1 / 2 END) / greatest(target, 1.0) AS x FROM copies),
        slopes AS (SELECT *, 1.5 - class / 2.0 AS a, 0.5 * class + 0.5 AS z FROM middle),
        bent AS (SELECT *, (a + 1) / 4 AS half FROM slopes)
        SELECT doc_id, size, n AS source_size, target, c0 + c1 AS taken, ((c0 > 0)::INT + (c1 > 0)::INT)::BIGINT AS n_copies,
               CASE WHEN c0 + c1 > 0 THEN round(CASE WHEN class = 1 THEN x
                    WHEN x < half THEN (sqrt(a * a + 4 * (1 - a) * x) - a) / (2 * (1 - a))
                    ELSE 0.5 + (sqrt(greatest(1 + 4 * (z - 1) * (x - half), 0)) - 1) / (2 * (z - 1)) END, 6) END AS first_position
        FROM bent
    """,
    "op5_ngram_jaccard_join": f"""
        WITH RECURSIVE {SHINGLES},
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM shingles a JOIN shingles b
                   ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
                  WHERE 100 * m >= 75 * (x.n + y.n - m)),
        ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
        reach AS (SELECT a AS x, a AS y FROM ways UNION SELECT x, b FROM reach JOIN ways ON y = a)
        SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, doc_id) AS component_id
        FROM docs LEFT JOIN sizes USING (doc_id)
        LEFT JOIN (SELECT x AS doc_id, min(y) AS c FROM reach GROUP BY x) USING (doc_id)
    """,
    "op8_line_dedup": r"""
        WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
        lines AS (SELECT doc_id, unnest(range(len(parts))) AS line, unnest(parts) AS raw FROM split),
        judged AS (SELECT doc_id, line, trim(raw, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS t FROM lines),
        firsts AS (SELECT t, min((doc_id, line)) AS f, length(t) AS n FROM judged WHERE length(t) >= 20 GROUP BY t),
        sides AS (SELECT t, f, unnest([(base, 'p', left(t, (base // 2)::INT)), (base, 's', right(t, (base - base // 2)::INT))]) AS k
                  FROM (SELECT *, unnest([n, n - 1]) AS base FROM firsts)),
        near AS (SELECT DISTINCT a.t FROM sides a JOIN sides b ON a.k = b.k AND b.f < a.f AND levenshtein(a.t, b.t) = 1),
        gone AS (SELECT doc_id, line FROM judged JOIN firsts USING (t) LEFT JOIN near USING (t)
                 WHERE near.t IS NOT NULL OR (doc_id, line) > f),
        kept AS (SELECT doc_id, string_agg(raw, chr(10) ORDER BY line) AS t
                 FROM lines ANTI JOIN gone USING (doc_id, line) GROUP BY doc_id)
        SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(string_split(text, chr(10))) END::BIGINT AS n_lines,
               coalesce(n, 0)::BIGINT AS n_dropped, sha256(coalesce(t, '')) AS kept_sha256
        FROM documents LEFT JOIN kept USING (doc_id)
        LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) USING (doc_id)
    """,
    "op9_substring_dedup": rf"""
        WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
        starts AS (SELECT r, unnest(range(1, greatest(len(w) - 33, 1))) AS p FROM docs),
        wins AS (SELECT r, p, hash(list_slice(w, p, p + 34)) AS h, sha256(array_to_string(list_slice(w, p, p + 34), ' ')) AS s
                 FROM starts JOIN docs USING (r)),
        again AS (SELECT r, p FROM wins WHERE s IN (SELECT s FROM wins GROUP BY s HAVING count(*) > 1)),
        gone AS (SELECT DISTINCT r, unnest(range(p, p + 35)) AS q FROM again),
        words AS (SELECT r, unnest(range(1, len(w) + 1)) AS q, unnest(w) AS word FROM docs),
        kept AS (SELECT words.r, q, word FROM words ANTI JOIN gone USING (r, q)),
        told AS (SELECT r, count(*) AS n_kept, string_agg(word, ' ' ORDER BY q) AS t FROM kept GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n_kept, 0))::BIGINT AS n_removed,
               sha256(coalesce(t, '')) AS kept_sha256
        FROM docs LEFT JOIN told USING (r)
    """,
    "op11_ranked_search": rf"""
        WITH words AS (SELECT doc_id, unnest({TERMS}) AS term FROM documents),
        tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
        sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
        sums AS (SELECT count(*) AS docs, sum(n)::BIGINT AS l FROM sizes),
        weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
                    FROM tf, sums GROUP BY term, docs),
        asked AS (SELECT DISTINCT item_id, unnest({TERMS}) AS term FROM benchmark),
        scored AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // l))))::BIGINT AS score
                   FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN sizes USING (doc_id), sums GROUP BY ALL)
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
        FROM scored WHERE score > 0 QUALIFY rank <= 10
    """,
}
