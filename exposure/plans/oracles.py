"""The same results in DuckDB SQL, written the direct way: re-scored per cause, all pairs
compared, recursion in place of splitting.  Used to check the Spark jobs, never to run them.
"""

from __future__ import annotations

import re

from exposure import dims
from exposure.operators import conversations, evidence, payloads, pii, reviews
from exposure.plans import derive

NOW = f"TIMESTAMP '{derive.NOW}'"
ORACLES: dict[str, str] = {}


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    """A Java pattern as a quoted RE2 one."""
    return q(pattern.replace("(?iU)", "(?i)").replace("(?U)", ""))


def values(rows) -> str:
    cell = lambda v: q(v) if isinstance(v, str) else ("NULL" if v is None else repr(v))
    return ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)


def in_list(words) -> str:
    return "(" + ", ".join(q(w) for w in words) + ")"


def array(words) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]"


# ---------------------------------------------------------------------------
# Device risk
# ---------------------------------------------------------------------------


def curve(p: str) -> str:
    return f"(CASE WHEN {p} <= 1e-9 THEN 100 ELSE CAST(floor(1e2 * (1.5e2 / (1.5e2 + {p})) + 5e-1) AS BIGINT) END)"


def overall(p: str, b: str, i: str) -> str:
    two = f"round({p} * 5e-1, 1) + round({b} * 5e-1, 1)"
    three = f"round({p} * 4e-1, 1) + round({b} * 4e-1, 1) + round({i} * 2e-1, 1)"
    return f"CAST(floor((CASE WHEN {i} IS NULL THEN {two} ELSE {three} END) + 5e-1) AS BIGINT)"


def age(t: str, now: str = NOW) -> str:
    return f"greatest(0e0, (epoch_us({now}) - epoch_us({t})) / 8.64e10)"


BAND = "CASE WHEN {0} >= 100000 THEN 1e2 WHEN {0} >= 1000 THEN 85e0 WHEN {0} >= 10 THEN 65e0 WHEN {0} >= 1 THEN 45e0 ELSE 0e0 END"
LEVEL = "CASE WHEN {0} >= 1000 THEN 'critical' WHEN {0} >= 1 THEN 'high' ELSE 'low' END"
PII_W = (
    "(CASE risk_level WHEN 'critical' THEN 1e2 WHEN 'high' THEN 6e1 WHEN 'medium' THEN 25e0 WHEN 'low' THEN 1e1 ELSE 25e0 END)"
    " * (CASE action_taken WHEN 'masked' THEN 25e-2 WHEN 'allowlisted' THEN 2e-1 ELSE 1e0 END) * confidence"
)
SITE_W = "(CASE verdict WHEN 'dangerous' THEN 1e2 WHEN 'suspicious' THEN 3e1 WHEN 'unknown' THEN 5e0 ELSE 0e0 END)"

DEVICE = f"""
WITH pii AS (SELECT {derive.PII_EVENTS} FROM events),
sc AS (SELECT {derive.SITE_CHECKS}, event_id FROM events),
ic0 AS (SELECT {derive.IDENTITY_CHECKS} FROM events WHERE event_type = 'signup'),
ic AS (SELECT *, {BAND.format('breach_count')} AS penalty, {LEVEL.format('breach_count')} AS level,
    CASE WHEN coalesce(label, '') <> '' THEN 'label:' || trim(lower(label)) ELSE 'prefix:' || hash_prefix END AS key FROM ic0),
ev AS (SELECT *, {PII_W} * pow(5e-1, {age('occurred_at')} / 7e0) AS p,
    CASE WHEN action_taken IN ('masked', 'allowlisted') THEN 'resolved' WHEN risk_level IN ('high', 'critical') THEN 'severe' ELSE 'minor' END AS cause,
    risk_level IN ('high', 'critical') AND action_taken IN ('none', 'ignored') AS is_open
    FROM pii WHERE occurred_at >= {NOW} - INTERVAL 30 DAY),
sw AS (SELECT *, {SITE_W} AS base FROM sc WHERE occurred_at >= {NOW} - INTERVAL 30 DAY),
dom AS (SELECT device_id, domain, base, t, base * pow(5e-1, {age('t')} / 7e0) AS p FROM (
    SELECT device_id, domain, base, max(occurred_at) AS t,
        row_number() OVER (PARTITION BY device_id, domain ORDER BY base DESC) AS rn FROM sw GROUP BY device_id, domain, base) WHERE rn = 1),
live AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY device_id, key ORDER BY occurred_at DESC, id DESC) AS rn,
    min(occurred_at) OVER (PARTITION BY device_id, key) AS first_at,
    first_value(id) OVER (PARTITION BY device_id, key ORDER BY occurred_at, id) AS first_id FROM ic) WHERE rn = 1),
dev AS (SELECT DISTINCT device_id FROM (SELECT device_id FROM pii UNION ALL SELECT device_id FROM sc UNION ALL SELECT device_id FROM ic)),
e AS (SELECT device_id, sum(p) AS ep, count(*) AS n, count(*) FILTER (action_taken = 'masked') AS masked,
    count(*) FILTER (action_taken = 'allowlisted') AS muted, count(*) FILTER (is_open) AS n_open,
    coalesce(sum(p) FILTER (cause <> 'severe'), 0) AS wo_severe, coalesce(sum(p) FILTER (cause <> 'minor'), 0) AS wo_minor,
    coalesce(sum(p) FILTER (cause <> 'resolved'), 0) AS wo_resolved, count(*) FILTER (cause = 'severe') AS n_severe,
    count(*) FILTER (cause = 'minor') AS n_minor, count(*) FILTER (cause = 'resolved') AS n_resolved FROM ev GROUP BY 1),
s AS (SELECT device_id, sum(p) AS sp, count(*) FILTER (base = 100) AS n_d, count(*) FILTER (base = 30) AS n_s, count(*) FILTER (base = 5) AS n_u,
    coalesce(sum(p) FILTER (base <> 100), 0) AS wo_d, coalesce(sum(p) FILTER (base <> 30), 0) AS wo_s,
    coalesce(sum(p) FILTER (base <> 5), 0) AS wo_u FROM dom GROUP BY 1),
visits AS (SELECT device_id, count(*) AS nv FROM sw GROUP BY 1),
i AS (SELECT device_id, sum(penalty) AS ip, count(*) AS nc, count(*) FILTER (breach_count > 0) AS nb FROM live GROUP BY 1),
t AS (SELECT device_id, coalesce(ep, 0) AS ep, coalesce(n, 0) AS n, coalesce(masked, 0) AS masked, coalesce(muted, 0) AS muted,
    coalesce(n_open, 0) AS n_open, wo_severe, wo_minor, wo_resolved, coalesce(n_severe, 0) AS n_severe, coalesce(n_minor, 0) AS n_minor,
    coalesce(n_resolved, 0) AS n_resolved, coalesce(sp, 0) AS sp, coalesce(n_d, 0) AS n_d, coalesce(n_s, 0) AS n_s, coalesce(n_u, 0) AS n_u,
    wo_d, wo_s, wo_u, coalesce(nv, 0) AS nv, ip, nc, nb
    FROM dev LEFT JOIN e USING (device_id) LEFT JOIN s USING (device_id) LEFT JOIN visits USING (device_id) LEFT JOIN i USING (device_id)),
c AS (SELECT *, {curve('ep')} AS privacy, {curve('sp')} AS browsing, CASE WHEN nc IS NOT NULL THEN {curve('ip')} END AS identity FROM t),
r AS (SELECT *, {overall('privacy', 'browsing', 'identity')} AS overall FROM c)
"""
RISK_LEVEL = "CASE WHEN overall >= 80 THEN 'low' WHEN overall >= 60 THEN 'medium' WHEN overall >= 35 THEN 'high' ELSE 'critical' END"

ORACLES["risk_overall"] = f"""{DEVICE}
SELECT device_id, overall, privacy, browsing, identity, {RISK_LEVEL} AS risk_level,
    CASE WHEN identity IS NULL THEN 0.8::DOUBLE ELSE 1e0 END AS confidence,
    n AS pii_events, masked AS masked_events, n_d + n_s AS flagged_domains,
    CASE WHEN n = 0 AND nv = 0 THEN 'Nothing has been seen yet.' WHEN overall >= 80 THEN 'All good: nothing needs attention.'
         WHEN overall >= 60 THEN 'Mostly fine; a couple of things deserve a look.'
         WHEN overall >= 35 THEN 'Some things need attention, the first advice first.' ELSE 'Serious issues need attention today.' END AS headline FROM r"""

ORACLES["risk_contributions"] = f"""{DEVICE}
SELECT device_id, 'privacy' AS component, privacy AS score, 0.4::DOUBLE AS weight,
    CASE WHEN identity IS NULL THEN 0.5::DOUBLE ELSE 0.4::DOUBLE END AS weight_applied,
    round(privacy * CASE WHEN identity IS NULL THEN 5e-1 ELSE 4e-1 END, 1) AS points, n AS event_count FROM r
UNION ALL SELECT device_id, 'browsing', browsing, 0.4::DOUBLE, CASE WHEN identity IS NULL THEN 0.5::DOUBLE ELSE 0.4::DOUBLE END,
    round(browsing * CASE WHEN identity IS NULL THEN 5e-1 ELSE 4e-1 END, 1), nv FROM r
UNION ALL SELECT device_id, 'identity', identity, 0.2::DOUBLE, CASE WHEN identity IS NULL THEN 0e0 ELSE 0.2::DOUBLE END,
    coalesce(round(identity * 2e-1, 1), 0e0), coalesce(nc, 0) FROM r"""

ADVICE_ROWS = """
adv AS (SELECT device_id, 1 AS o, 'high' AS priority, 'change_password' AS action, nb AS subjects FROM r WHERE coalesce(nb, 0) > 0
UNION ALL SELECT device_id, 2, 'high', 'review_pii', n_open FROM r WHERE n_open > 0
UNION ALL SELECT device_id, 3, 'high', 'review_sites', n_d FROM r WHERE n_d > 0
UNION ALL SELECT device_id, 4, 'medium', 'review_sites', n_s FROM r WHERE n_s > 0 AND n_d = 0
UNION ALL SELECT device_id, 5, 'low', 'review_allowlist', muted FROM r WHERE muted >= 3
UNION ALL SELECT device_id, 6, 'low', 'setup_identity', 0 FROM r WHERE nc IS NULL),
ranked AS (SELECT device_id, row_number() OVER (PARTITION BY device_id ORDER BY o) - 1 AS rank, priority, action, CAST(subjects AS BIGINT) AS subjects FROM adv)
"""
ORACLES["risk_recommendations"] = f"{DEVICE}, {ADVICE_ROWS} SELECT * FROM ranked WHERE rank < 4"

CAUSES = f"""
cause AS (
SELECT device_id, overall, 'pii_sent_unprotected' AS code, 'high' AS severity, 0 AS sev, n_severe AS subjects, 'review_pii' AS action,
    {overall(curve('wo_severe'), 'browsing', 'identity')} AS without, false AS must, 0 AS ord FROM r WHERE n_severe > 0
UNION ALL SELECT device_id, overall, 'pii_minor_unprotected', 'medium', 1, n_minor, 'review_pii', {overall(curve('wo_minor'), 'browsing', 'identity')}, false, 1 FROM r WHERE n_minor > 0
UNION ALL SELECT device_id, overall, 'pii_protected', 'low', 2, n_resolved, NULL, {overall(curve('wo_resolved'), 'browsing', 'identity')}, false, 2 FROM r WHERE n_resolved > 0
UNION ALL SELECT device_id, overall, 'site_dangerous', 'high', 0, n_d, 'review_sites', {overall('privacy', curve('wo_d'), 'identity')}, false, 3 FROM r WHERE n_d > 0
UNION ALL SELECT device_id, overall, 'site_suspicious', 'medium', 1, n_s, 'review_sites', {overall('privacy', curve('wo_s'), 'identity')}, false, 4 FROM r WHERE n_s > 0
UNION ALL SELECT device_id, overall, 'site_unchecked', 'low', 2, n_u, NULL, {overall('privacy', curve('wo_u'), 'identity')}, false, 5 FROM r WHERE n_u > 0
UNION ALL SELECT device_id, overall, 'identity_unmeasured', 'info', 3, 0, NULL, overall, true, 6 FROM r WHERE nc IS NULL
UNION ALL SELECT device_id, overall, 'identity_breached', 'high', 0, 1, 'change_password', {overall('privacy', 'browsing', curve('rest'))}, false,
    10 + row_number() OVER (PARTITION BY device_id ORDER BY first_at, first_id, key)
    FROM (SELECT r.*, l.key, l.first_at, l.first_id, (SELECT coalesce(sum(penalty), 0) FROM live m WHERE m.device_id = l.device_id AND m.key <> l.key) AS rest
        FROM live l JOIN r USING (device_id) WHERE l.breach_count > 0)),
priced AS (SELECT *, greatest(0, without - overall) AS points FROM cause),
shown AS (SELECT *, row_number() OVER (PARTITION BY device_id, must ORDER BY points DESC, sev, code, ord) AS k,
    count(*) FILTER (must) OVER (PARTITION BY device_id) AS n_must FROM priced WHERE must OR points >= 1),
driver AS (SELECT device_id, row_number() OVER (PARTITION BY device_id ORDER BY points DESC, sev, code, ord) - 1 AS rank, code, points, severity, CAST(subjects AS BIGINT) AS subjects
    FROM shown WHERE must OR k <= 4 - n_must),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY points DESC, sev, code, ord) AS bk FROM priced
    WHERE action IS NOT NULL AND points >= 1) WHERE bk = 1)
"""
ORACLES["risk_drivers"] = f"{DEVICE}, {CAUSES} SELECT * FROM driver"


def counted(n: str, one: str, many: str) -> str:
    return f"{n} || CASE WHEN {n} = 1 THEN '{one}' ELSE '{many}' END"


ORACLES["risk_contribution_details"] = f"""{DEVICE}
SELECT device_id, 'privacy' AS component, CASE WHEN n = 0 THEN 'Nothing sensitive was typed.'
    WHEN privacy >= 80 THEN {counted('n', ' finding', ' findings')} || ', minor or masked.'
    ELSE {counted('n', ' sensitive detail', ' sensitive details')} || ' typed.' END AS detail FROM r
UNION ALL SELECT device_id, 'browsing', CASE WHEN nv = 0 THEN 'No risky site was visited.'
    WHEN n_d + n_s = 0 THEN 'Some sites could not be checked in full.' ELSE {counted('(n_d + n_s)', ' site', ' sites')} || ' flagged.' END FROM r
UNION ALL SELECT device_id, 'identity', CASE WHEN nc IS NULL THEN 'No password has been checked, so this part is missing.'
    WHEN nb = 0 THEN {counted('nc', ' password', ' passwords')} || ' checked, none breached.'
    ELSE nb || ' of ' || {counted('nc', ' password', ' passwords')} || ' found in breaches.' END FROM r"""
ORACLES["risk_recommendation_texts"] = f"""{DEVICE}, {ADVICE_ROWS},
named AS (SELECT device_id, string_agg(coalesce(label, 'One of your passwords'), ', ' ORDER BY k) AS names FROM (
    SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY first_at, first_id, key) AS k FROM live WHERE breach_count > 0) WHERE k <= 2 GROUP BY 1),
opened AS (SELECT device_id, min(site_origin) AS origin, count(DISTINCT site_origin) AS origins FROM ev WHERE is_open GROUP BY 1),
bad AS (SELECT device_id, min(domain) FILTER (base = 100) AS scam, min(domain) FILTER (base = 30) AS odd FROM dom GROUP BY 1)
SELECT device_id, rank, CASE action
    WHEN 'change_password' THEN {counted('subjects', ' password is', ' passwords are')} || ' in breaches'
    WHEN 'review_pii' THEN {counted('subjects', ' sensitive detail', ' sensitive details')} || ' sent unmasked'
    WHEN 'review_sites' THEN CASE priority WHEN 'high' THEN {counted('subjects', ' likely scam site', ' likely scam sites')} ELSE {counted('subjects', ' odd site', ' odd sites')} END || ' visited'
    WHEN 'review_allowlist' THEN 'Several warnings are muted' ELSE 'No password checked yet' END AS title, CASE action
    WHEN 'change_password' THEN 'Change now: ' || names || CASE WHEN subjects > 2 THEN ' and ' || (subjects - 2) || ' more' ELSE '' END || '.'
    WHEN 'review_pii' THEN 'Typed on ' || replace(replace(origin, 'https://', ''), 'http://', '')
        || CASE WHEN origins > 1 THEN ' and ' || {counted('(origins - 1)', ' other', ' others')} ELSE '' END || '.'
    WHEN 'review_sites' THEN 'Among them ' || CASE priority WHEN 'high' THEN scam ELSE odd END || '.'
    WHEN 'review_allowlist' THEN subjects || ' muted findings are worth a second look.'
    ELSE 'One of three parts of the score is missing.' END AS detail
FROM ranked LEFT JOIN named USING (device_id) LEFT JOIN opened USING (device_id) LEFT JOIN bad USING (device_id) WHERE rank < 4"""
ORACLES["risk_stories"] = f"""{DEVICE}, {CAUSES},
p AS (SELECT device_id, count(*) AS n_all, count(*) FILTER (points > 0) AS c, max(points) AS top, sum(points) AS total FROM driver GROUP BY 1)
SELECT r.device_id, 'Score ' || overall || ' of 100' || CASE WHEN coalesce(c, 0) = 0 AND n_all > 0 THEN ' and only missing parts keep it open.'
    WHEN coalesce(c, 0) = 0 THEN ' and nothing pulls it down.' WHEN c = 1 THEN '; one thing pulls it down.'
    WHEN top >= total - top THEN '; mostly one thing pulls it down.' ELSE '; ' || c || ' things pull it down together.' END AS story
FROM r LEFT JOIN p ON p.device_id = r.device_id"""
KEYED = CAUSES.replace("SELECT device_id, overall, 'pii_sent", "SELECT device_id, NULL AS key, overall, 'pii_sent").replace(
    "UNION ALL SELECT device_id, overall, 'identity_breached'", "UNION ALL SELECT device_id, key, overall, 'identity_breached'").replace(
    "UNION ALL SELECT device_id, overall,", "UNION ALL SELECT device_id, NULL, overall,")
ORACLES["risk_causes"] = f"""{DEVICE}, {KEYED}
SELECT device_id, key, code, points, severity, CAST(subjects AS BIGINT) AS subjects, action FROM priced"""
ORACLES["risk_lever"] = f"""{DEVICE}, {CAUSES}
SELECT r.device_id, b.code, r.overall AS current_score, r.overall + b.points AS projected_score, b.points AS delta, b.action,
    CASE WHEN identity IS NULL THEN 'The score covers 80% of what is measured; the rest is unknown, not safe.' ELSE 'The score covers typing, sites and passwords.' END
    || CASE WHEN n_u > 0 THEN ' ' || n_u || CASE WHEN n_u = 1 THEN ' site' ELSE ' sites' END || ' stay unknown.' ELSE '' END AS coverage
FROM r LEFT JOIN best b ON r.device_id = b.device_id"""

REPLAY = f"""
day AS (SELECT d, {NOW} - to_days(CAST(d AS INTEGER)) AS as_of FROM range(0, 31) x(d)),
rp AS (SELECT device_id, d, sum({PII_W} * pow(5e-1, {age('occurred_at', 'as_of')} / 7e0)) AS ep
    FROM pii JOIN day ON occurred_at <= as_of AND occurred_at >= as_of - INTERVAL 30 DAY GROUP BY ALL),
rs0 AS (SELECT device_id, d, as_of, domain, {SITE_W} AS base, max(occurred_at) AS t
    FROM sc JOIN day ON occurred_at <= as_of AND occurred_at >= as_of - INTERVAL 30 DAY GROUP BY ALL),
rs AS (SELECT device_id, d, sum(base * pow(5e-1, {age('t', 'as_of')} / 7e0)) AS sp FROM (
    SELECT *, row_number() OVER (PARTITION BY device_id, d, domain ORDER BY base DESC) AS rn FROM rs0) WHERE rn = 1 GROUP BY ALL),
replay AS (SELECT device_id, epoch_us(as_of) AS captured_at, {curve('coalesce(ep, 0)')} AS privacy, {curve('coalesce(sp, 0)')} AS browsing
    FROM (SELECT DISTINCT device_id FROM (SELECT device_id FROM pii UNION ALL SELECT device_id FROM sc)) CROSS JOIN day
    LEFT JOIN rp USING (device_id, d) LEFT JOIN rs USING (device_id, d))
"""
ORACLES["risk_replay_daily"] = f"{DEVICE}, {REPLAY} SELECT *, {overall('privacy', 'browsing', 'NULL')} AS overall FROM replay"
ORACLES["score_trend"] = f"""{DEVICE}, {REPLAY} SELECT device_id, captured_at, {overall('privacy', 'browsing', 'NULL')} AS overall
FROM replay WHERE captured_at >= epoch_us({NOW} - INTERVAL 30 DAY)"""

BARE = "replace(replace(site_origin, 'https://', ''), 'http://', '')"
TIMELINE = f"""
lines AS (SELECT device_id, occurred_at, 0 AS ord, id, 'pii' AS kind, risk_level AS severity, masked_preview, {BARE} AS site FROM ev
UNION ALL SELECT device_id, occurred_at, 1, id, 'site', CASE verdict WHEN 'dangerous' THEN 'critical' WHEN 'suspicious' THEN 'medium' ELSE 'low' END, NULL, domain FROM sw
UNION ALL SELECT device_id, occurred_at, 2, id, 'identity', level, NULL, NULL FROM ic),
line AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY occurred_at DESC, ord, id DESC) AS rank FROM lines QUALIFY rank <= 25)
"""
ORACLES["timeline_top25"] = f"""{DEVICE}, {TIMELINE}
SELECT device_id, epoch_us(occurred_at) AS occurred_at, kind, severity, masked_preview, site, rank FROM line"""

FLAGGED = """
fl0 AS (SELECT device_id, domain, max(CASE verdict WHEN 'dangerous' THEN 3 WHEN 'suspicious' THEN 2 ELSE 1 END) AS vr,
    min(trust_score) AS trust_score, max(occurred_at) AS last_seen, count(*) AS visits,
    arg_max(CASE WHEN event_id % 2 = 0 THEN concat('note ', event_id % 11) ELSE '' END, (occurred_at, id)) FILTER (event_id % 5 <> 0) AS reasons
    FROM sw WHERE verdict <> 'safe' GROUP BY ALL),
fl AS (SELECT device_id, row_number() OVER (PARTITION BY device_id ORDER BY vr DESC, trust_score, visits DESC, last_seen DESC, domain) AS rank, domain,
    ['unknown', 'suspicious', 'dangerous'][vr] AS verdict, CAST(trust_score AS BIGINT) AS trust_score, epoch_us(last_seen) AS last_seen, visits,
    coalesce(reasons, '') AS reasons FROM fl0 QUALIFY rank <= 10)
"""
ORACLES["flagged_sites"] = f"{DEVICE}, {FLAGGED} SELECT * FROM fl"
SEEN = """seen AS (SELECT device_id, epoch_us(min(occurred_at)) AS created_at, epoch_us(max(occurred_at)) AS last_seen_at FROM (
    SELECT device_id, occurred_at FROM pii UNION ALL SELECT device_id, occurred_at FROM sc UNION ALL SELECT device_id, occurred_at FROM ic) GROUP BY 1)"""
ORACLES["device_table"] = f"{DEVICE}, {SEEN} SELECT * FROM seen"
ORACLES["latest_device"] = f"{DEVICE}, {SEEN} SELECT * FROM seen ORDER BY last_seen_at DESC, device_id LIMIT 1"
THINNED = """
WITH RECURSIVE snap AS (SELECT concat('dev-', user_id % 10) AS device_id, ts FROM events),
kept AS (SELECT device_id, min(ts) AS ts FROM snap GROUP BY 1
    UNION ALL SELECT k.device_id, (SELECT min(s.ts) FROM snap s WHERE s.device_id = k.device_id AND s.ts >= k.ts + INTERVAL 60 MINUTE) AS ts
    FROM kept k WHERE k.ts IS NOT NULL)
SELECT device_id, epoch_us(ts) AS captured_at FROM kept WHERE ts IS NOT NULL"""
ORACLES["snapshots_thinned"] = THINNED
ORACLES["stream_thinned"] = THINNED
ORACLES["stream_fresh_alerts"] = """
WITH RECURSIVE seen AS (SELECT concat('k', event_id % 97) AS key, ts FROM events),
given AS (SELECT key, min(ts) AS ts FROM seen GROUP BY 1
    UNION ALL SELECT g.key, (SELECT min(s.ts) FROM seen s WHERE s.key = g.key AND s.ts >= g.ts + INTERVAL 6 HOUR) AS ts
    FROM given g WHERE g.ts IS NOT NULL)
SELECT key, epoch_us(ts) AS ts FROM given WHERE ts IS NOT NULL"""
ORACLES["dashboard_summary"] = f"""{DEVICE}, {CAUSES}, {ADVICE_ROWS}, {TIMELINE}, {FLAGGED}
SELECT r.device_id, overall, {RISK_LEVEL} AS risk_level, CASE WHEN identity IS NULL THEN 0.8::DOUBLE ELSE 1e0 END AS confidence, privacy, browsing, identity,
    coalesce((SELECT string_agg(code, '|' ORDER BY rank) FROM driver d WHERE d.device_id = r.device_id), '') AS drivers,
    (SELECT code FROM best b WHERE b.device_id = r.device_id) AS lever,
    coalesce((SELECT string_agg(action, '|' ORDER BY rank) FROM ranked a WHERE a.device_id = r.device_id AND rank < 4), '') AS actions,
    (SELECT string_agg(kind, '|' ORDER BY rank) FROM line l WHERE l.device_id = r.device_id) AS timeline,
    (SELECT string_agg(domain, '|' ORDER BY rank) FROM fl WHERE fl.device_id = r.device_id) AS flagged,
    n AS total_pii_events, masked AS total_masked, n_d + n_s AS total_sites_flagged FROM r"""
ORACLES["sessions_as_json"] = f"""{DEVICE} SELECT device_id,
    concat('{{"device_id":"', device_id, '","overall":', overall, ',"risk_level":"', {RISK_LEVEL}, '"}}') AS json FROM r"""

# ---------------------------------------------------------------------------
# Identity
# ---------------------------------------------------------------------------

ORACLES["identity_live"] = f"""{DEVICE} SELECT device_id, key, epoch_us(occurred_at) AS occurred_at, breach_count, label, penalty, level AS risk_level FROM live"""
ORACLES["identity_scores"] = f"""{DEVICE},
named AS (SELECT device_id, coalesce(label, 'One of your passwords') AS label, row_number() OVER (PARTITION BY device_id ORDER BY first_at, first_id, key) AS k
    FROM live WHERE breach_count > 0)
SELECT device_id, {curve('ip')} AS identity, nc AS i_checked, nb AS i_breached,
    (SELECT string_agg(label, '|' ORDER BY k) FROM named WHERE named.device_id = i.device_id) AS first_breached,
    CASE WHEN nb = 0 THEN nc || CASE WHEN nc = 1 THEN ' password' ELSE ' passwords' END || ' checked, none breached.'
         ELSE nb || ' of ' || nc || CASE WHEN nc = 1 THEN ' password' ELSE ' passwords' END || ' found in breaches.' END AS sentence FROM i"""
CORPUS = f"""
WITH ks AS (SELECT DISTINCT event_id % 4000 AS k FROM events),
raw AS (SELECT {derive.CORPUS} FROM ks),
corpus AS (SELECT prefix, split_part(line, ':', 1) AS suffix, CAST(split_part(line, ':', 2) AS BIGINT) AS count FROM raw
    WHERE length(split_part(line, ':', 1)) = 35 AND CAST(split_part(line, ':', 2) AS BIGINT) > 0),
sec AS (SELECT id, device_id, upper(sha1(secret)) AS h FROM (SELECT {derive.SECRETS} FROM events))
"""
ORACLES["breach_corpus"] = f"{CORPUS} SELECT * FROM corpus"
ORACLES["breach_range"] = f"{CORPUS} SELECT * FROM corpus WHERE prefix IN (SELECT substr(h, 1, 5) FROM sec)"
ORACLES["breach_match"] = f"""{CORPUS} SELECT id, device_id, substr(h, 1, 5) AS prefix,
    CASE WHEN substr(h, 1, 5) IN (SELECT prefix FROM corpus) THEN coalesce((SELECT count FROM corpus c WHERE c.prefix || c.suffix = h), 0) END AS breach_count FROM sec"""
ORACLES["breach_plausible"] = f"""{CORPUS}, chk AS (SELECT id, substr(h, 1, 5) AS hash_prefix, (id % 6) * 37 AS breach_count FROM sec),
v AS (SELECT *, CASE WHEN breach_count > 0 AND hash_prefix IN (SELECT prefix FROM corpus)
    THEN EXISTS (SELECT 1 FROM corpus c WHERE c.prefix = hash_prefix AND c.count = breach_count) END AS verified FROM chk)
SELECT *, {BAND.format('breach_count')} AS penalty, {LEVEL.format('breach_count')} AS risk_level,
    CASE WHEN breach_count > 0 AND verified = false THEN 0.75::DOUBLE ELSE 0.95::DOUBLE END AS confidence FROM v"""
ALL_CORPUS = CORPUS.replace("event_id % 4000", "event_id").replace(derive.SECRETS, derive.ALL_SECRETS)
ORACLES["breach_match_bucketed"] = f"""{ALL_CORPUS}, known AS (SELECT DISTINCT prefix FROM corpus)
SELECT id, device_id, substr(h, 1, 5) AS prefix, CASE WHEN known.prefix IS NOT NULL THEN coalesce(count, 0) END AS breach_count
FROM sec LEFT JOIN corpus c ON c.prefix || c.suffix = h LEFT JOIN known ON known.prefix = substr(h, 1, 5)"""
ORACLES["breach_plausible_bucketed"] = f"""{ALL_CORPUS}, chk AS (SELECT id, substr(h, 1, 5) AS hash_prefix, (id % 6) * 37 AS breach_count FROM sec)
SELECT *, CASE WHEN breach_count > 0 AND hash_prefix IN (SELECT prefix FROM corpus)
    THEN (hash_prefix, breach_count) IN (SELECT (prefix, count) FROM corpus) END AS verified FROM chk"""
ORACLES["prefix_k_anonymity"] = f"""{CORPUS} SELECT substr(prefix, 1, 2) || '000' AS prefix, count(*) AS suffixes, max(count) AS max_count FROM corpus GROUP BY 1"""
ORACLES["identity_stored"] = f"""{DEVICE} SELECT device_id, upper(hash_prefix) AS hash_prefix, count(*) AS n, max(breach_count) AS worst FROM ic GROUP BY ALL"""

# ---------------------------------------------------------------------------
# Text scan
# ---------------------------------------------------------------------------


def span_rows(source: str, pattern: str, key: str, text: str = "text", ordinal: str = "i", value: str | None = None) -> str:
    """Rows ``key, text, i, s, e, v`` of all matches, offsets by summed lengths."""
    p = re2(pattern)
    return f"""(SELECT {key}, {text} AS text, {ordinal}, m[{ordinal}] AS v,
        CAST(coalesce(list_sum(list_transform(g[1:{ordinal}], lambda x: length(x))), 0)
            + coalesce(list_sum(list_transform(m[1:{ordinal} - 1], lambda x: length(x))), 0) AS BIGINT) AS s
        FROM (SELECT {key}, {text}, m, g, unnest(range(1, len(m) + 1)) AS {ordinal}
            FROM (SELECT {key}, {text}, regexp_extract_all({text}, {p}) AS m, string_split_regex({text}, {p}) AS g
                FROM {source} WHERE regexp_matches({text}, {p}))))"""


DIGITS = "regexp_replace({0}, '[^0-9]', '', 'g')"


def luhn(v: str) -> str:
    d = DIGITS.format(v)
    return f"""(length({d}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length({d}) + 1), lambda j:
        CASE WHEN j % 2 = 1 THEN CAST(substr(reverse({d}), j, 1) AS INT)
             WHEN CAST(substr(reverse({d}), j, 1) AS INT) > 4 THEN CAST(substr(reverse({d}), j, 1) AS INT) * 2 - 9
             ELSE CAST(substr(reverse({d}), j, 1) AS INT) * 2 END)) % 10 = 0)"""


def verhoeff(v: str) -> str:
    d = DIGITS.format(v)
    acc = "0"
    for k in range(12):
        digit = f"CAST(substr({d}, {12 - k}, 1) AS INT)"
        acc = f"CAST(substr('{dims.VERHOEFF_D}', ({acc}) * 10 + CAST(substr('{dims.VERHOEFF_P}', {k % 8 * 10} + {digit} + 1, 1) AS INT) + 1, 1) AS INT)"
    return f"(CASE WHEN regexp_full_match({d}, '[2-9][0-9]{{11}}') THEN {acc} = 0 ELSE false END)"


VALID = {
    "aadhaar": verhoeff("v"),
    "credit_card": luhn("v"),
    "ifsc": "true",
    "phone": f"regexp_matches({DIGITS.format('v')}, '[6-9][0-9]{{9}}$')",
}
#: letters beyond ASCII count as word characters at a word border; RE2 needs them folded
FOLD = "regexp_replace(text, '[À-ÖØ-öø-ſ]', '_', 'g')"


def candidates(source: str, key: str = "doc_id") -> str:
    parts = []
    for n, d in enumerate(pii.DETECTORS):
        found = span_rows(source, d.pattern, key, "raw" if d.name in ("email", "password") else "folded")
        test = VALID.get(d.name, "true")
        conf = d.confidence
        value, start = "v", "s"
        if d.name == "password":
            value = f"regexp_extract(v, {re2(d.pattern)}, 1)"
            start = f"s + length(v) - length({value})"
        if d.context:
            conf = round(min(0.99, conf + 0.1), 2)
            around = "lower(substr(text, CAST(greatest(s - 40, 0) + 1 AS BIGINT), CAST(s + length(v) + 40 - greatest(s - 40, 0) AS BIGINT)))"
            test = "(" + " OR ".join(f"contains({around}, {q(w)})" for w in d.context) + ")"
        parts.append(
            f"SELECT {key}, {n} AS det, {q(d.name)} AS pii_type, {q(d.risk)} AS risk_level, {conf}::DOUBLE AS confidence, "
            f"{start} AS s, s + length(v) AS e, {value} AS v FROM {found} WHERE {test}"
        )
    return "\nUNION ALL ".join(parts)


GREEDY = """list_reduce(list_transform(list(c ORDER BY {order}), lambda x: [x]), lambda acc, x:
    CASE WHEN len(list_filter(acc, lambda k: x[1].s < k.e AND k.s < x[1].e)) > 0 THEN acc ELSE list_concat(acc, x) END)"""

MASK = """CASE WHEN pii_type IN ('email', 'upi_id') THEN CASE WHEN length(split_part(v, '@', 1)) <= 1 THEN repeat('•', length(split_part(v, '@', 1))) ELSE substr(v, 1, 1) || repeat('•', length(split_part(v, '@', 1)) - 1) END || '@' || substr(v, length(split_part(v, '@', 1)) + 2)
    WHEN pii_type IN ('api_key', 'jwt', 'password') THEN CASE WHEN length(v) <= 8 THEN repeat('•', length(v)) ELSE substr(v, 1, 4) || repeat('•', 12) END
    ELSE array_to_string(list_transform(range(1, length(v) + 1), lambda j: CASE WHEN regexp_matches(substr(v, j, 1), '[A-Za-z0-9]')
        AND length(regexp_replace(substr(v, 1, j), '[^A-Za-z0-9]', '', 'g')) <= n_alnum - least(4, n_alnum // 2) THEN 'X' ELSE substr(v, j, 1) END), '') END"""


def findings(source_sql: str, key: str = "doc_id", drop: str = "false", extra: str = "") -> str:
    """CTEs from texts to ``finding``: candidates, greedy choice, masks."""
    return f"""
txt AS (SELECT {key}{extra}, text AS raw, {FOLD} AS folded FROM ({source_sql})),
cand0 AS ({candidates('txt', key)}),
cand AS (SELECT c.* FROM cand0 c JOIN txt USING ({key}) WHERE NOT ({drop})),
kept AS (SELECT {key}, {GREEDY.format(order='c.confidence DESC, c.e - c.s DESC, c.s, c.det')} AS k
    FROM (SELECT {key}, {{'s': s, 'e': e, 'det': det, 'pii_type': pii_type, 'risk_level': risk_level, 'confidence': confidence, 'v': v}} AS c FROM cand) GROUP BY {key}),
finding0 AS (SELECT {key}, unnest(k, recursive := true) FROM (SELECT {key}, unnest(k) AS k FROM kept)),
finding AS (SELECT {key}, pii_type, risk_level, confidence, s AS start, e AS "end", {MASK} AS masked_preview, 'regex' AS detection_tier, v, det
    FROM (SELECT *, length(regexp_replace(v, '[^A-Za-z0-9]', '', 'g')) AS n_alnum FROM finding0))
"""


TEXTS = f"SELECT {derive.TEXTS} FROM documents"
OUT = 'doc_id, pii_type, risk_level, confidence, start, "end", masked_preview, detection_tier'
SEEDED = findings(f"SELECT * FROM ({TEXTS})", extra=", site_origin")
ORACLES["pii_findings"] = f"WITH {findings('SELECT doc_id, text FROM documents')} SELECT {OUT} FROM finding"
ORACLES["pii_findings_seeded"] = f"WITH {SEEDED} SELECT {OUT} FROM finding"
ORACLES["pii_candidates_card"] = f"""WITH t AS ({TEXTS}), f AS (SELECT doc_id, {FOLD} AS text FROM t)
SELECT doc_id, s AS start, s + length(v) AS "end", {luhn('v')} AS luhn,
    CASE WHEN d LIKE '4%' THEN 'Visa' WHEN d[1:2] IN ('51', '52', '53', '54', '55') THEN 'Mastercard' WHEN d[1:2] IN ('34', '37') THEN 'American Express'
        WHEN d LIKE '6011%' OR d LIKE '65%' THEN 'Discover' WHEN d[1:2] IN ('60', '81', '82') THEN 'RuPay' END AS brand
FROM (SELECT *, {DIGITS.format('v')} AS d FROM {span_rows('f', pii.DETECTORS[4].pattern, 'doc_id')})"""
LEVELS = "CASE risk_level WHEN 'critical' THEN 100 WHEN 'high' THEN 80 WHEN 'medium' THEN 50 ELSE 25 END"
ORACLES["pii_message_scores"] = f"""WITH {SEEDED},
w AS (SELECT doc_id, count(*) AS n, max(({LEVELS}, confidence)) AS w FROM finding GROUP BY 1),
sc AS (SELECT doc_id, coalesce(n, 0) AS n_findings, CASE WHEN n IS NULL THEN 0 ELSE least(100, CAST(round_even(w[1] * w[2] + least(18, (n - 1) * 6), 0) AS BIGINT)) END AS risk_score
    FROM txt LEFT JOIN w USING (doc_id))
SELECT *, CASE WHEN risk_score >= 85 THEN 'critical' WHEN risk_score >= 60 THEN 'high' WHEN risk_score >= 30 THEN 'medium' ELSE 'low' END AS risk_level FROM sc"""
ORACLES["pii_redacted"] = f"""WITH {SEEDED},
o AS (SELECT doc_id, start, "end", masked_preview, lag("end", 1, 0) OVER (PARTITION BY doc_id ORDER BY start) AS prev FROM finding),
b AS (SELECT doc_id, string_agg(substr(raw, CAST(prev + 1 AS BIGINT), CAST(start - prev AS BIGINT)) || masked_preview, '' ORDER BY start) AS head, max("end") AS last FROM o JOIN txt USING (doc_id) GROUP BY 1),
r AS (SELECT doc_id, CASE WHEN head IS NULL THEN raw ELSE head || substr(raw, CAST(last + 1 AS BIGINT)) END AS redacted FROM txt LEFT JOIN b USING (doc_id))
SELECT doc_id, length(redacted) AS n, md5(redacted) AS digest FROM r"""
ORIGIN = "split_part(site_origin, '/', 1) || '//' || split_part(site_origin, '/', 3)"
ORACLES["pii_muted"] = f"""WITH {findings(f'SELECT * FROM ({TEXTS})', extra=', site_origin', drop=f"CASE WHEN length({ORIGIN}) % 2 = 0 THEN c.pii_type IN ('credit_card', 'email') ELSE c.pii_type = 'upi_id' END")}
SELECT {OUT} FROM finding"""
ORACLES["pii_semantic_gate"] = f"""WITH {SEEDED},
g AS (SELECT doc_id, NOT EXISTS (SELECT 1 FROM finding f WHERE f.doc_id = txt.doc_id AND risk_level IN ('high', 'critical'))
    AND length(regexp_replace(raw, '^\\s+|\\s+$', '', 'g')) >= 40
    AND len(string_split_regex(regexp_replace(raw, '^\\s+|\\s+$', '', 'g'), '\\s+')) >= 6 AS worth_reading FROM txt)
SELECT *, CASE WHEN NOT worth_reading THEN 'skipped' WHEN doc_id % 3 = 0 THEN 'ran' ELSE 'unavailable' END AS status FROM g"""
ORACLES["exposure_crosstab"] = ""
ORACLES["destination_fit"] = ""
PLACE = f"""
place(host, kind, name) AS (VALUES {values((h, k, n) for k, sites in dims.DESTINATIONS.items() for h, n in sites.items())}),
fam(pii_type, family) AS (VALUES {values(dims.PII_FAMILIES.items())}),
fits(family, kind, fit) AS (VALUES {values((f, k, g) for f, row in dims.FIT_MATRIX.items() for k, g in row.items())}),
hosts AS (SELECT doc_id, split_part(split_part(site_origin, '/', 3), ':', 1) AS host FROM txt),
best AS (SELECT doc_id, host, (SELECT arg_max({{'kind': kind, 'name': name}}, length(p.host)) FROM place p
    WHERE h.host = p.host OR (contains(p.host, '.') AND ends_with(h.host, '.' || p.host))) AS b FROM hosts h),
graded AS (SELECT f.doc_id, f.pii_type, f.start, fam.family, coalesce(b.kind, 'unknown') AS destination_kind, coalesce(b.name, host) AS destination_name,
    coalesce(fits.fit, 'unknown') AS destination_fit
    FROM finding f JOIN best USING (doc_id) LEFT JOIN fam USING (pii_type) LEFT JOIN fits ON fits.family = fam.family AND fits.kind = b.kind)
"""
ORACLES["destination_fit"] = f"""WITH {SEEDED}, {PLACE} SELECT doc_id, pii_type, start, destination_kind, destination_name, destination_fit,
    CASE destination_fit WHEN 'never' THEN upper(left(said, 1)) || substr(said, 2) || ' does not belong on ' || destination_name || '.'
        WHEN 'rarely' THEN destination_name || ' seldom needs ' || said || '.' WHEN 'expected' THEN destination_name || ' normally takes ' || said || '.'
        ELSE CASE WHEN destination_kind <> 'unknown' THEN 'Whether ' || said || ' belongs on ' || destination_name || ' is not known.'
             ELSE destination_name || ' is not a known site; nothing says ' || said || ' is safe there.' END END AS destination_note
    FROM graded JOIN (VALUES {values(dims.PII_PHRASES.items())}) AS phrases(pii_type, said) USING (pii_type)"""
ORACLES["exposure_crosstab"] = f"""WITH {SEEDED}, {PLACE} SELECT coalesce(family, 'other') AS family, destination_kind, destination_fit, count(*) AS findings FROM graded GROUP BY ALL"""

#: RE2 has no lookaround: the token is matched with its borders, which the separators allow
ORACLES["credential_prefilter"] = f"""WITH t AS ({TEXTS}), shape(o, prefix, p) AS (VALUES {values((i, a, b) for i, (a, b) in enumerate(pii.CREDENTIAL_SHAPES))}),
m AS (SELECT doc_id, text, prefix, p, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS k FROM t JOIN shape ON contains(text, prefix) AND regexp_matches(text, p) QUALIFY k = 1),
h AS (SELECT doc_id, prefix, length(text) AS n, CAST(length(string_split_regex(text, p)[1]) AS BIGINT) AS s, regexp_extract(text, p) AS v FROM m)
SELECT doc_id, prefix, s, substr(v, 1, 4) || repeat('•', 16) AS masked,
    CASE WHEN n <= 20000 THEN n ELSE least(20000, n - greatest(0, s - greatest(0, (20000 - length(v)) // 2))) END AS excerpt_chars FROM h"""
MESSAGES = f"SELECT {derive.MESSAGES} FROM conversations WHERE role <> 'system'"
ORACLES["text_hygiene"] = f"""WITH m AS ({MESSAGES}) SELECT conv_id, turn, length(c) AS n, md5(c) AS clean, md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS unstamped
FROM (SELECT *, replace(text, '.', ' ') || ' 12:04 PM' AS c FROM m)"""
STAMPED = f"{SEEDED}, st AS (SELECT f.*, concat('dev-', doc_id % 50) AS device_id, {NOW} - to_days(CAST(doc_id % 60 AS INTEGER)) AS occurred_at FROM finding f)"
ORACLES["findings_stored"] = f"""WITH {STAMPED} SELECT device_id, pii_type, count(*) AS n, epoch_us(min(occurred_at)) AS first_at, max(masked_preview) AS last_mask
FROM st WHERE occurred_at >= {NOW} - INTERVAL 30 DAY GROUP BY ALL"""
ORACLES["stream_findings"] = f"WITH {STAMPED} SELECT device_id, pii_type, count(*) AS n FROM st GROUP BY ALL"
OCR_TXT = f"SELECT {derive.OCR_TEXTS} FROM documents"
CORE = "0-9OoQDIilL|!ZzASsGTBgq"
OCR_TOKEN = f"[{CORE}](?:[ \\-]?[{CORE}]){{11,}}"
OCR_DIGITS = f"translate(regexp_replace(v, '[ \\-]', '', 'g'), {q(dims.OCR_FROM)}, {q(dims.OCR_TO)})"
ORACLES["pii_ocr_recovered"] = f"""WITH {findings(OCR_TXT)},
tok AS (SELECT doc_id, s, s + length(v) AS e, length(regexp_replace(v, '[ \\-0-9]', '', 'g')) AS swaps, {OCR_DIGITS} AS v FROM {span_rows('txt', OCR_TOKEN, 'doc_id', 'raw')}
    WHERE NOT regexp_matches(substr(text, s, 1), '[A-Za-z0-9]') AND NOT regexp_matches(substr(text, s + length(v) + 1, 1), '[A-Za-z0-9]')),
ok AS (SELECT *, CASE WHEN {verhoeff('v')} THEN 'aadhaar' WHEN {luhn('v')} THEN 'credit_card' END AS pii_type FROM tok WHERE swaps BETWEEN 1 AND 3)
SELECT doc_id, pii_type, CASE pii_type WHEN 'aadhaar' THEN 'high' ELSE 'critical' END AS risk_level, round(0.8::DOUBLE - 0.05::DOUBLE * (swaps - 1), 2) AS confidence,
    s AS start, e AS "end", repeat('X', length(v) - 4) || right(v, 4) AS masked_preview, 'ocr' AS detection_tier
FROM ok WHERE pii_type IS NOT NULL AND NOT EXISTS (SELECT 1 FROM finding f WHERE f.doc_id = ok.doc_id AND f.start < ok.e AND ok.s < f."end")"""
ORACLES["pii_semantic_import"] = f"""WITH {SEEDED},
offer AS (SELECT doc_id, raw, 0 AS o, ['postal_address', 'security_answer', 'family_detail', 'nonsense'][doc_id % 4 + 1] AS pii_type, regexp_extract(raw, '([A-Za-z]{{4,}})[^A-Za-z]*$', 1) AS v, 0.85::DOUBLE AS confidence FROM txt WHERE doc_id % 3 = 0
    UNION ALL SELECT doc_id, raw, 2, 'health_detail', regexp_replace(substr(raw, 1, 12), '^\\s+|\\s+$', '', 'g'), 0.6::DOUBLE FROM txt WHERE doc_id % 3 = 0),
loc AS (SELECT doc_id, {{'s': instr(raw, v) - 1, 'e': instr(raw, v) - 1 + length(v), 'o': o, 'pii_type': pii_type, 'confidence': confidence}} AS c FROM offer
    WHERE pii_type <> 'nonsense' AND length(v) >= 3 AND instr(raw, v) > 0),
free AS (SELECT * FROM loc WHERE NOT EXISTS (SELECT 1 FROM finding f WHERE f.doc_id = loc.doc_id AND f.start < c.e AND c.s < f."end")),
k AS (SELECT doc_id, unnest(k, recursive := true) FROM (SELECT doc_id, unnest({GREEDY.format(order='c.confidence DESC, c.e - c.s DESC, c.s, c.o')}) AS k FROM free GROUP BY doc_id))
SELECT doc_id, pii_type, CASE pii_type WHEN 'security_answer' THEN 'critical' WHEN 'family_detail' THEN 'medium' ELSE 'high' END AS risk_level, confidence,
    s AS start, e AS "end", repeat('•', least(12, e - s)) AS masked_preview, 'llm' AS detection_tier FROM k"""

# ---------------------------------------------------------------------------
# Sites
# ---------------------------------------------------------------------------


def labels(x: str) -> str:
    return f"list_filter(string_split({x}, '.'), lambda lb: lb <> '')"


def registrable(x: str) -> str:
    ls = labels(x)
    return f"""(CASE WHEN len({ls}) <= 2 THEN array_to_string({ls}, '.')
        WHEN array_to_string({ls}[-2:], '.') IN {in_list(dims.MULTI_LABEL_SUFFIXES)} THEN array_to_string({ls}[-3:], '.') ELSE array_to_string({ls}[-2:], '.') END)"""


def netloc(u: str) -> str:
    return f"regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?//([^/?#]*)', 1)"


def host_of(u: str) -> str:
    return f"split_part(regexp_replace(lower({netloc(u)}), '^.*@', ''), ':', 1)"


FOLDED = "replace(replace(translate({0}, '013457', 'oleast'), 'rn', 'm'), 'vv', 'w')"


def brands(hosts_sql: str) -> str:
    """CTE ``brand_of(host, kind, brand, lure)`` of the hosts of a query."""
    return f"""
bd(brand, domain) AS (VALUES {values((b, d) for b, ds in dims.BRAND_DOMAINS.items() for d in ds)}),
bh AS (SELECT host, {registrable('host')} AS domain, list_filter(string_split_regex(host, '[^a-z0-9]+'), lambda t: t <> '') AS toks FROM (SELECT DISTINCT host FROM ({hosts_sql}) WHERE host <> '')),
bt AS (SELECT host, domain, unnest(toks) AS t, generate_subscripts(toks, 1) AS o, list_has_any(toks, {array(dims.LURE_TOKENS)}) AS lured FROM bh),
bdec AS (SELECT host, o, t, {FOLDED.format('t')} AS f, CASE
    WHEN t IN (SELECT brand FROM bd) THEN CASE WHEN EXISTS (SELECT 1 FROM bd WHERE bd.brand = t AND bd.domain = bt.domain) THEN 'own' WHEN t = 'apple' AND NOT lured THEN NULL ELSE 'named' END
    WHEN {FOLDED.format('t')} IN (SELECT brand FROM bd) AND NOT EXISTS (SELECT 1 FROM bd WHERE bd.brand = {FOLDED.format('t')} AND bd.domain = bt.domain) THEN 'lookalike' END AS kind FROM bt),
bfirst AS (SELECT host, arg_min(kind, o) AS kind, arg_min(CASE WHEN kind = 'lookalike' THEN f ELSE t END, o) AS brand FROM bdec WHERE kind IS NOT NULL GROUP BY 1),
brand_of AS (SELECT bh.host, kind, brand, list_has_any(toks, {array(dims.LURE_TOKENS)}) AS lured FROM bh LEFT JOIN bfirst USING (host))
"""


URL_PARTS = f"""
u0 AS (SELECT page_id, url, CASE WHEN contains(url, '//') THEN url ELSE 'https://' || url END AS f FROM (SELECT {derive.URLS} FROM pages)),
u1 AS (SELECT *, {host_of('f')} AS host, regexp_extract(f, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?//[^/?#]*([^?#]*)', 1) AS path, lower(regexp_extract(f, '^([A-Za-z]+):', 1)) AS scheme FROM u0),
u AS (SELECT *, {registrable('host')} AS domain, scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END AS url_key, scheme || '://' || {netloc('f')} || path AS list_key FROM u1)
"""
ORACLES["url_parts"] = f"""WITH {URL_PARTS} SELECT page_id, host, domain, url_key, list_key,
    CASE WHEN contains(url, '//') THEN split_part(url, '/', 1) || '//' || split_part(url, '/', 3) ELSE url END AS origin,
    regexp_matches(url, '^https?://') AS checkable, array_to_string(list_filter(string_split_regex(host, '[^a-z0-9]+'), lambda t: t <> ''), '|') AS tokens FROM u"""
SITE_SCORE = """
b AS (SELECT u.*, kind IN ('named', 'lookalike') AND kind IS NOT NULL AS bad, kind, brand, lured,
    CASE WHEN kind = 'lookalike' THEN 1e0 WHEN kind = 'named' AND lured THEN 9e-1 WHEN kind = 'named' THEN 55e-2 ELSE 0e0 END AS bp FROM {src} u LEFT JOIN brand_of USING (host)),
m AS (SELECT *, 3e-1 + CASE WHEN age IS NULL THEN 0e0 ELSE 25e-2 END + CASE WHEN listed = false THEN 45e-2 * CASE WHEN age > 30 THEN 1e0 ELSE 5e-1 END ELSE 0e0 END AS avail,
    3e-1 * bp + CASE WHEN age IS NULL THEN 0e0 WHEN age <= 7 THEN 25e-2 * 1e0 WHEN age <= 30 THEN 25e-2 * 8e-1 WHEN age <= 180 THEN 25e-2 * 4e-1 WHEN age <= 365 THEN 25e-2 * 15e-2 ELSE 0e0 END AS pen FROM b),
n AS (SELECT *, CASE WHEN bad AND (kind = 'lookalike' OR lured) THEN least(25, greatest(0, round_even(1e2 * (1e0 - pen / avail), 0))) ELSE greatest(0, least(100, round_even(1e2 * (1e0 - pen / avail), 0))) END AS sc FROM m),
site AS (SELECT *, CASE WHEN listed THEN 'dangerous' WHEN sc < 40 THEN 'dangerous' WHEN avail < 31e-2 THEN 'unknown' WHEN sc < 75 OR bad OR (age <= 180 AND age IS NOT NULL) THEN 'suspicious' ELSE 'safe' END AS verdict FROM n),
scored AS (SELECT *, CAST(CASE WHEN listed THEN 2 WHEN verdict = 'unknown' THEN least(sc, 50) ELSE sc END AS BIGINT) AS trust_score,
    CASE WHEN listed THEN 99e-2 ELSE round(avail, 2) END AS confidence FROM site)
"""
BRANDS = brands("SELECT host FROM u")
PLAIN = f"WITH {URL_PARTS}, {BRANDS}, ux AS (SELECT *, CAST(NULL AS INT) AS age, CAST(NULL AS BOOLEAN) AS listed FROM u), {SITE_SCORE.format(src='ux')}"
ORACLES["url_brand"] = f"""{PLAIN} SELECT page_id, CASE WHEN bad THEN brand END AS brand, coalesce(kind = 'lookalike', false) AS lookalike, bp AS penalty, trust_score, verdict FROM scored"""
REGISTRY = f"""
reg AS (SELECT DISTINCT domain, CAST((length(domain) * 37) % 500 AS INT) AS age FROM u WHERE length(domain) % 3 <> 0),
thr AS (SELECT DISTINCT list_key FROM u WHERE page_id % 11 = 0)
"""
FULL = f"""WITH {URL_PARTS}, {BRANDS}, {REGISTRY}, ux AS (SELECT u.*, reg.age, CASE WHEN page_id % 5 <> 0 THEN list_key IN (SELECT list_key FROM thr) END AS listed
    FROM u LEFT JOIN reg USING (domain)), {SITE_SCORE.format(src='ux')}"""
ORACLES["url_trust"] = f"""{FULL} SELECT page_id, domain, trust_score, verdict, confidence, CASE WHEN listed THEN NULL ELSE age END AS domain_age_days, listed AS safe_browsing_hit,
    bad AND NOT coalesce(listed, false) AS brand_mismatch,
    CASE WHEN listed THEN 'safe_browsing:bad' ELSE CASE WHEN listed IS NULL THEN 'safe_browsing:unknown' ELSE 'safe_browsing:good' END
        || CASE WHEN bad THEN '|brand:bad' ELSE '' END || CASE WHEN bad AND lured THEN '|brand:bad' ELSE '' END
        || CASE WHEN age IS NULL THEN '|domain_age:unknown' WHEN age <= 180 THEN '|domain_age:bad' ELSE '|domain_age:good' END END AS reasons FROM scored"""
ORACLES["url_trust_distinct"] = f"""WITH {URL_PARTS}, {BRANDS}, {REGISTRY}, keyed AS (SELECT url_key, min(url) AS url FROM u GROUP BY 1),
    ux AS (SELECT u.*, reg.age, list_key IN (SELECT list_key FROM thr) AS listed FROM (SELECT DISTINCT ON (u.url_key) u.* FROM u JOIN keyed USING (url_key, url)) u LEFT JOIN reg USING (domain)), {SITE_SCORE.format(src='ux')}
SELECT u.page_id, u.url_key, trust_score, verdict, listed AS safe_browsing_hit FROM u JOIN scored USING (url_key)"""
ORACLES["url_trust_reused"] = f"""SELECT run, t.*, reused FROM ({ORACLES["url_trust_distinct"]}) t,
    (VALUES (CAST(1 AS BIGINT), false), (CAST(2 AS BIGINT), true), (CAST(3 AS BIGINT), false)) r(run, reused)"""
ORACLES["registration_dates"] = f"""SELECT page_id, CASE WHEN page_id % 3 < 2 THEN epoch_us(TIMESTAMP '2020-02-01 10:00:00' + to_days(CAST(page_id % 9 AS INTEGER))) END AS registered_at FROM pages"""

# ---------------------------------------------------------------------------
# Links, wording and senders
# ---------------------------------------------------------------------------


def excerpt(x: str) -> str:
    flat = f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
    return f"(CASE WHEN length({flat}) <= 120 THEN {flat} ELSE rtrim(substr({flat}, 1, 119)) || '…' END)"


def near(right: str, window: int) -> str:
    """Condition on a span row: a whole ``right`` match lies within the window."""
    bare = re2(right)[1:-1]
    return f"""(CASE WHEN s - {window} <= 0 THEN regexp_matches(substr(text, 1, CAST(s + length(v) + {window} AS BIGINT)), '{bare}')
        ELSE regexp_matches(substr(text, CAST(s - {window} AS BIGINT), CAST(length(v) + {2 * window + 1} AS BIGINT)), '(?s)^.(?:.*?)(?:{bare})') END)"""


def link_ctes(source: str, key: str, body: str) -> str:
    """``link(key, o, url, host, display, domain)`` and ``link_hit(key, o, k, name, penalty)``."""
    anchor, url, dom = re2(evidence.ANCHOR), re2(evidence.URL), re2(evidence.DOMAINISH)
    return f"""
la AS (SELECT {key}, unnest(regexp_extract_all({body}, {anchor}, 1)) AS url, unnest(regexp_extract_all({body}, {anchor}, 2)) AS inner_text,
    generate_subscripts(regexp_extract_all({body}, {anchor}, 1), 1) AS o FROM {source}),
lb AS (SELECT {key}, unnest(x) AS url, generate_subscripts(x, 1) AS o FROM (SELECT {key}, regexp_extract_all(regexp_replace({body}, {anchor}, ' ', 'g'), {url}) AS x FROM {source})),
link0 AS (SELECT {key}, o, url, {excerpt("regexp_replace(inner_text, '<[^>]+>', ' ', 'g')")} AS display FROM la
    UNION ALL SELECT {key}, 1000000 + min(o), url, url FROM lb WHERE NOT EXISTS (SELECT 1 FROM la WHERE la.{key} = lb.{key} AND la.url = lb.url) GROUP BY {key}, url),
link1 AS (SELECT *, {host_of('url')} AS host FROM link0),
link AS (SELECT *, {registrable('host')} AS domain FROM link1 WHERE host <> ''),
{brands('SELECT host FROM link')},
shown AS (SELECT {key}, o, list_filter(list_transform(list_concat(list_transform(regexp_extract_all(display, {url}), lambda x: {host_of('x')}), regexp_extract_all(display, {dom}, 1)),
    lambda c: {registrable('lower(c)')}), lambda z: z <> '' AND z <> domain AND NOT ends_with(host, '.' || z)) AS other FROM link),
lfirst AS (SELECT {key}, host, min(o) AS o, any_value(domain) AS domain FROM link GROUP BY {key}, host),
lflag AS (SELECT {key}, o, 1 AS k, CASE WHEN kind IN ('named', 'lookalike') THEN 'link_brand_mismatch' WHEN contains(host, 'xn--') THEN 'link_punycode'
    WHEN regexp_full_match(host, '[0-9]+(\\.[0-9]+){{3}}') THEN 'link_raw_ip' WHEN domain IN {in_list(dims.SHORTENERS)} THEN 'link_shortener' END AS name, kind FROM lfirst LEFT JOIN brand_of USING (host)),
link_hit AS (SELECT {key}, o, k, name, CASE name WHEN 'link_brand_mismatch' THEN CASE WHEN kind = 'lookalike' THEN 95 ELSE 85 END WHEN 'link_punycode' THEN 85 WHEN 'link_raw_ip' THEN 80 ELSE 45 END AS penalty
    FROM lflag WHERE name IS NOT NULL UNION ALL SELECT {key}, o, 0, 'link_display_mismatch', 100 FROM shown WHERE len(other) > 0)
"""


def first_of(source: str, key: str, text: str, pattern: str, condition: str = "true") -> str:
    return f"(SELECT {key}, text, arg_min(s, i) AS s, arg_min(v, i) AS v FROM {span_rows(source, pattern, key, text)} WHERE {condition} GROUP BY {key}, text)"


def content_ctes(source: str, key: str, text: str) -> str:
    """``content_hit(key, o, name, penalty, ev)`` over visible text."""
    ev = evidence
    specs = [
        (ev.CREDENTIAL_NOUNS, near(ev.REQUEST_VERBS, 80)), (ev.CONSEQUENCES, near(ev.ACCOUNT_NOUNS, 80)),
        (ev.URGENCY, "true"), (ev.PAYMENT, "true"), (ev.REWARD, "true"), (ev.DANGEROUS_FILE, "true"), (ev.GREETING, "true"),
    ]
    parts = []
    for n, ((pattern, cond), (name, penalty, _)) in enumerate(zip(specs, ev.CONTENT)):
        parts.append(f"SELECT {key}, {n} AS o, {q(name)} AS name, {penalty} AS penalty, text, s, v FROM {first_of(source, key, text, pattern, cond)}")
    prose = f"SELECT {key}, 5, 'attachment_lure', 50, text, s, v FROM {first_of(source, key, text, ev.ATTACHMENT_PROSE)} WHERE {key} NOT IN (SELECT {key} FROM ch0 WHERE o = 5)"
    around = "substr(text, CAST(greatest(0, s - 40) + 1 AS BIGINT), CAST(s + length(v) + 40 - greatest(0, s - 40) AS BIGINT))"
    union = "\nUNION ALL ".join(parts)
    return f"""ch0 AS ({union}), ch1 AS (SELECT * FROM ch0 UNION ALL {prose}),
content_hit AS (SELECT {key}, o, name, penalty, {excerpt(around)} AS ev FROM ch1)"""


EMAILS = f"SELECT {derive.EMAILS} FROM documents"


def visible(expr: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace({expr}, {re2(evidence.ANCHOR)}, ' \\2 ', 'g'), '<[^>]+>', ' ', 'g'), {re2(evidence.URL)}, ' ', 'g')"


MAIL = f"mail AS ({EMAILS}), vis AS (SELECT msg_id, {visible('concat(subject, chr(10), body)')} AS visible FROM mail)"
ADDRESS = "'^\\s*(?:\"?([^\"<]*?)\"?\\s*)?<?([^<>\\s@]+@[^<>\\s@]+?)>?\\s*$'"
SENDER = f"""
s0 AS (SELECT msg_id, sender, subject, reply_to, CASE WHEN regexp_matches(sender, {ADDRESS}) THEN regexp_extract(sender, {ADDRESS}, 1) END AS display,
    CASE WHEN regexp_matches(sender, {ADDRESS}) THEN lower(regexp_extract(sender, {ADDRESS}, 2)) END AS address,
    CASE WHEN regexp_matches(reply_to, {ADDRESS}) THEN split_part(lower(regexp_extract(reply_to, {ADDRESS}, 2)), '@', 2) END AS reply_host FROM mail),
snd AS (SELECT *, split_part(address, '@', 2) AS host, {registrable("split_part(address, '@', 2)")} AS sender_domain, {registrable('reply_host')} AS reply_domain FROM s0),
bx(brand, domain) AS (VALUES {values((b, d) for b, ds in dims.BRAND_DOMAINS.items() for d in ds)}),
claim AS (SELECT msg_id, arg_min(t, o) AS t FROM (SELECT msg_id, sender_domain, unnest(x) AS t, generate_subscripts(x, 1) AS o
    FROM (SELECT *, string_split_regex(lower(concat(display, ' ', split_part(address, '@', 1))), '[^a-z0-9]+') AS x FROM snd)) y
    WHERE t IN (SELECT brand FROM bx) AND NOT EXISTS (SELECT 1 FROM bx WHERE bx.brand = y.t AND bx.domain = y.sender_domain) GROUP BY 1)
"""
SENDER_HITS = f"""
sender_hit AS (
SELECT msg_id, 0 AS o, 'sender_lookalike_domain' AS name, CASE WHEN kind = 'lookalike' THEN 95 ELSE 85 END AS penalty FROM snd JOIN sbrand USING (host) WHERE kind IN ('named', 'lookalike')
UNION ALL SELECT msg_id, 0, 'sender_brand_mismatch', 90 FROM snd JOIN claim USING (msg_id) LEFT JOIN sbrand USING (host) WHERE coalesce(kind, '') NOT IN ('named', 'lookalike')
UNION ALL SELECT msg_id, 1, 'sender_freemail_authority', 75 FROM snd WHERE sender_domain IN {in_list(dims.FREEMAIL)}
    AND list_has_any(string_split_regex(lower(concat(display, ' ', subject)), '[^a-z0-9]+'), {array(dims.BRAND_DOMAINS)})
UNION ALL SELECT msg_id, 2, 'sender_reply_to_mismatch', 70 FROM snd WHERE address IS NOT NULL AND reply_host IS NOT NULL AND reply_domain <> sender_domain)
"""
SBRAND = brands("SELECT host FROM snd WHERE address IS NOT NULL").replace("brand_of AS", "sbrand AS")
MAIL_LINKS = link_ctes("mail", "msg_id", "body")


def joined_hits(table: str, key: str, what: str = "name || ':' || penalty", order: str = "o") -> str:
    return f"(SELECT string_agg({what}, '|' ORDER BY {order}) FROM {table} h WHERE h.{key} = x.{key})"


ORACLES["email_links"] = f"""WITH {MAIL}, {MAIL_LINKS} SELECT msg_id, coalesce({joined_hits('link', 'msg_id', 'host')}, '') AS hosts,
    coalesce({joined_hits('link_hit', 'msg_id', order='o, k')}, '') AS hits FROM mail x"""
ORACLES["email_sender"] = f"""WITH {MAIL}, {SENDER}, {SBRAND}, {SENDER_HITS} SELECT msg_id, CASE WHEN address IS NOT NULL THEN sender_domain END AS sender_domain,
    CASE WHEN address IS NOT NULL THEN coalesce({joined_hits('sender_hit', 'msg_id')}, '') END AS hits FROM snd x"""
CONTENT = content_ctes("vis", "msg_id", "visible")
ORACLES["email_content"] = f"""WITH {MAIL}, {CONTENT} SELECT msg_id, length(visible) AS visible_chars, coalesce({joined_hits('content_hit', 'msg_id', 'name')}, '') AS hits,
    coalesce({joined_hits('content_hit', 'msg_id', 'ev')}, '') AS evidence FROM vis x"""


def penalty(table: str, key: str, bump: int) -> str:
    return f"coalesce((SELECT CASE WHEN count(*) > 0 THEN least(100, max(penalty) + {bump} * (count(*) - 1)) END FROM {table} h WHERE h.{key} = x.{key}), 0)"


#: the second brand table of a statement gets its own names
SBRAND2 = re.sub(r"\b(bd|bh|bt|bdec|bfirst)\b", r"s_\1", SBRAND)
VERDICT = "CASE WHEN risk_score >= 65 THEN 'dangerous' WHEN risk_score >= 30 THEN 'suspicious' ELSE 'safe' END"
ORACLES["email_verdict"] = f"""WITH {MAIL}, {MAIL_LINKS}, {CONTENT}, {SENDER}, {SBRAND2}, {SENDER_HITS},
x AS (SELECT msg_id, address IS NOT NULL AS known, visible, CASE WHEN msg_id % 4 = 0 THEN [{', '.join(q(x) for x in ('credential_theft', 'benign', 'unheard_of', 'extortion'))}][(msg_id // 4) % 4 + 1] END AS label FROM snd JOIN vis USING (msg_id)),
p AS (SELECT msg_id, known, visible, CASE WHEN label <> 'unheard_of' THEN label END AS intent, {penalty('link_hit', 'msg_id', 5)} AS link_penalty, {penalty('content_hit', 'msg_id', 8)} AS content_penalty,
    CASE WHEN known THEN {penalty('sender_hit', 'msg_id', 6)} END AS sender_penalty,
    (SELECT count(*) FROM link_hit h WHERE h.msg_id = x.msg_id) AS nl, (SELECT count(*) FROM content_hit h WHERE h.msg_id = x.msg_id) AS nc,
    (SELECT count(*) FROM sender_hit h WHERE h.msg_id = x.msg_id) AS ns,
    coalesce({joined_hits('link_hit', 'msg_id', "name || ':bad|'", 'o, k')}, '') AS sl, coalesce({joined_hits('content_hit', 'msg_id', "name || ':bad|'")}, '') AS sc,
    coalesce({joined_hits('sender_hit', 'msg_id', "name || ':bad|'")}, '') AS ss FROM x),
w AS (SELECT *, (35e-2 * link_penalty + 3e-1 * content_penalty + CASE WHEN known THEN 15e-2 * sender_penalty ELSE 0e0 END) / (35e-2 + 3e-1 + CASE WHEN known THEN 15e-2 ELSE 0e0 END) AS t1,
    CASE intent WHEN 'credential_theft' THEN 95 WHEN 'extortion' THEN 85 WHEN 'benign' THEN 0 END AS ip, length(trim(visible, ' ' || chr(10))) >= 40 AS enough FROM p),
r AS (SELECT *, CASE WHEN enough THEN CAST(least(100, floor(CASE WHEN ip IS NULL THEN t1 ELSE greatest(t1, t1 * 8e-1 + ip * 2e-1) END + 5e-1)) AS BIGINT) ELSE 0 END AS risk_score FROM w),
v AS (SELECT *, CASE WHEN NOT enough THEN 'unknown' ELSE {VERDICT} END AS verdict, nl + nc + ns AS hits FROM r)
SELECT msg_id, link_penalty, content_penalty, sender_penalty, intent, risk_score, verdict, CASE WHEN enough THEN hits ELSE 0 END AS n_hits,
    CASE WHEN NOT enough THEN 0e0 ELSE round(least(CASE WHEN verdict = 'safe' THEN 8e-1 ELSE 1e0 END, 95e-2, 55e-2 + CASE WHEN known THEN 15e-2 ELSE 0e0 END + CASE WHEN intent IS NULL THEN 0e0 ELSE 1e-1 END + CASE WHEN hits >= 3 THEN 1e-1 WHEN hits = 2 THEN 5e-2 ELSE 0e0 END), 2) END AS confidence,
    CASE WHEN NOT enough THEN 'insufficient_text:unknown' ELSE rtrim(replace(replace(sl, '||', '|'), '||', '|') || replace(sc, '||', '|') || replace(ss, '||', '|')
        || CASE WHEN intent IS NOT NULL AND intent <> 'benign' THEN 'intent_' || intent || ':bad|' ELSE '' END
        || CASE WHEN NOT known THEN 'sender_missing:unknown|' ELSE '' END || CASE WHEN intent IS NULL THEN 'intent_missing:unknown|' ELSE '' END
        || CASE WHEN nl = 0 THEN 'links_clean:good|' ELSE '' END || CASE WHEN nc = 0 THEN 'wording_clean:good|' ELSE '' END || CASE WHEN known AND ns = 0 THEN 'sender_clean:good|' ELSE '' END
        || CASE WHEN intent = 'benign' THEN 'intent_benign:good|' ELSE '' END, '|') END AS signals FROM v"""

# ---------------------------------------------------------------------------
# Conversations
# ---------------------------------------------------------------------------

TALK = f"""msg AS ({MESSAGES}),
conv AS (SELECT conv_id, count(*) FILTER (incoming) AS incoming_messages, coalesce(string_agg(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10) ORDER BY turn)
    FILTER (incoming AND regexp_matches(text, '\\S')), '') AS incoming_text FROM msg GROUP BY 1)"""
ORACLES["conv_assembled"] = f"WITH {TALK} SELECT conv_id, incoming_messages, length(incoming_text) AS chars, incoming_text FROM conv"

_C = conversations
_SPECS = (
    (_C.OTP_NOUNS, near(_C.ASK_VERBS, 220)), (_C.OFFER, near(_C.LARGE_SUM, 220)), (_C.AUTHORITY, near(_C.COERCE, 220)),
    (_C.JOB, near(_C.EARNINGS, 220)), (_C.UPI_VPA, near(_C.PAY_VERBS, 220)), (_C.SECRECY, "true"), (_C.OFF_PLATFORM, "true"),
)
TALK_HITS = ",\n".join(
    f"th{n} AS (SELECT conv_id, {n} AS o, {q(name)} AS name, {pen} AS penalty, text, s, v FROM {first_of('conv', 'conv_id', 'incoming_text', pattern, cond)})"
    for n, ((pattern, cond), (name, pen, _)) in enumerate(zip(_SPECS, _C.SIGNALS))
) + f""",
talk0 AS ({" UNION ALL ".join(f"SELECT * FROM th{n}" for n in range(7) if n != 1)}
    UNION ALL SELECT * FROM th1 WHERE conv_id IN (SELECT conv_id FROM th0) OR regexp_matches(text, {re2(_C.SMALL_ACTION)})),
tq AS (SELECT *, greatest(0, s - 60) AS l, least(length(text), s + length(v) + 60) AS r FROM talk0),
tw AS (SELECT *, regexp_replace(CASE WHEN l > 0 THEN regexp_replace(substr(text, CAST(l + 1 AS BIGINT), CAST(s - l AS BIGINT)), '^[^ \\n]*[ \\n]', '') ELSE substr(text, 1, CAST(s AS BIGINT)) END || v
    || CASE WHEN r < length(text) THEN regexp_replace(substr(text, CAST(s + length(v) + 1 AS BIGINT), CAST(r - s - length(v) AS BIGINT)), '[ \\n][^ \\n]*$', '') ELSE substr(text, CAST(s + length(v) + 1 AS BIGINT)) END,
    '^\\s+|\\s+$', '', 'g') AS w FROM tq),
talk_hit AS (SELECT *, CASE WHEN length(w) <= 140 THEN w ELSE rtrim(CASE WHEN contains(substr(w, 1, 140), ' ') AND length(regexp_replace(substr(w, 1, 140), '(?s) [^ ]*$', '')) > 70
    THEN regexp_replace(substr(w, 1, 140), '(?s) [^ ]*$', '') ELSE substr(w, 1, 140) END) END AS quote FROM tw)"""
ORACLES["conv_signals"] = f"""WITH {TALK}, {TALK_HITS} SELECT conv_id, coalesce({joined_hits('talk_hit', 'conv_id', 'name')}, '') AS hits,
    coalesce({joined_hits('talk_hit', 'conv_id', 'quote')}, '') AS quotes, true AS all_literal FROM conv x"""
CHAT_LINKS = link_ctes("conv", "conv_id", "incoming_text")
CHAT_VIS = f"cv AS (SELECT conv_id, {visible('concat(chr(10), incoming_text)')} AS words FROM conv)"
CHAT_CONTENT = content_ctes("cv", "conv_id", "words")


def chat_verdict(keys: str) -> str:
    return f"""x AS (SELECT conv_id, incoming_text, {keys} FROM conv),
p AS (SELECT *, {penalty('talk_hit', 'conv_id', 10)} AS talk_penalty, {penalty('link_hit', 'conv_id', 5)} AS link_penalty, {penalty('content_hit', 'conv_id', 8)} AS content_penalty,
    (SELECT count(*) FROM talk_hit h WHERE h.conv_id = x.conv_id) + (SELECT count(*) FROM link_hit h WHERE h.conv_id = x.conv_id) + (SELECT count(*) FROM content_hit h WHERE h.conv_id = x.conv_id) AS hits FROM x),
w AS (SELECT *, greatest(5e-1 * talk_penalty + 25e-2 * link_penalty + 25e-2 * content_penalty, CASE WHEN talk_penalty >= 85 THEN talk_penalty ELSE 0 END,
    CASE WHEN link_penalty >= 85 THEN link_penalty ELSE 0 END, CASE WHEN content_penalty >= 85 THEN content_penalty ELSE 0 END) AS t1,
    CASE intent WHEN 'otp_fraud' THEN 95 WHEN 'romance_fraud' THEN 75 WHEN 'benign' THEN 0 END AS ip, length(incoming_text) >= 12 AS enough FROM p),
r AS (SELECT *, CASE WHEN enough THEN CAST(least(100, floor(CASE WHEN ip IS NULL THEN t1 ELSE greatest(t1, t1 * 8e-1 + ip * 2e-1) END + 5e-1)) AS BIGINT) ELSE 0 END AS risk_score FROM w),
cvd AS (SELECT *, CASE WHEN NOT enough THEN 'unknown' ELSE {VERDICT} END AS verdict FROM r)"""


_LABEL = "CASE WHEN conv_id % 4 = 0 AND (conv_id // 4) % 4 <> 2 THEN ['otp_fraud', 'benign', '', 'romance_fraud'][(conv_id // 4) % 4 + 1] END AS intent"
CHAT = f"WITH {TALK}, {TALK_HITS}, {CHAT_LINKS}, {CHAT_VIS}, {CHAT_CONTENT}"
ORACLES["conv_verdict"] = f"""{CHAT}, {chat_verdict(_LABEL)}
SELECT conv_id, talk_penalty, link_penalty, content_penalty, intent, risk_score, verdict, CASE WHEN enough THEN hits ELSE 0 END AS n_hits,
    CASE WHEN NOT enough THEN 0e0 ELSE round(least(CASE WHEN verdict = 'safe' THEN 75e-2 ELSE 1e0 END, 95e-2, 7e-1 + CASE WHEN intent IS NULL THEN 0e0 ELSE 1e-1 END + CASE WHEN hits >= 3 THEN 1e-1 WHEN hits = 2 THEN 5e-2 ELSE 0e0 END), 2) END AS confidence FROM cvd"""
#: each conversation's turns are a second apart, so each is one burst; the last one is still open
ORACLES["stream_settled_chats"] = f"""{CHAT}, {chat_verdict("CAST(NULL AS VARCHAR) AS intent")},
ends AS (SELECT conv_id, (1700000000 + conv_id * 1000 + max(turn)) * 1000000 + 2500000 AS settled_at FROM msg GROUP BY 1)
SELECT conv_id, settled_at, risk_score, verdict FROM cvd JOIN ends USING (conv_id) WHERE settled_at <= (SELECT max(settled_at) - 2500000 - 60000000 FROM ends)"""

# ---------------------------------------------------------------------------
# Payloads
# ---------------------------------------------------------------------------

#: written per kind of generated payload: the fields each one carries are known
PAY = f"""pl AS (SELECT event_id AS n, event_id % 16 AS k, payload FROM (SELECT event_id, {derive.PAYLOADS} FROM events)),
pp AS (SELECT n AS payload_id, n, k, payload,
    CASE WHEN k IN (0, 1, 2, 3, 12, 13, 15) THEN 'upi' WHEN k IN (4, 5, 14) THEN 'url' WHEN k IN (7, 8) THEN 'wifi' WHEN k = 9 THEN 'crypto' WHEN k = 10 THEN 'vcard' ELSE 'text' END AS kind,
    CASE WHEN k IN (0, 1, 2, 3, 12, 13, 15) THEN 'upi' WHEN k IN (4, 14) THEN 'https' WHEN k = 5 THEN 'http' WHEN k = 6 THEN 'javascript' WHEN k IN (7, 8) THEN 'wifi' WHEN k = 9 THEN 'bitcoin' WHEN k = 10 THEN 'begin' END AS scheme,
    CASE k WHEN 0 THEN 'amazon-refund@ybl' WHEN 1 THEN concat('shop', n, '@okaxis') WHEN 2 THEN '' WHEN 3 THEN concat('bob', n, '@zzz') WHEN 12 THEN concat('x', n, '@ybl') WHEN 13 THEN 'plainname' WHEN 15 THEN concat('ravi', n, '@oksbi') END AS payee_vpa,
    CASE k WHEN 0 THEN 'Amazon Refund' WHEN 1 THEN 'Corner Shop' WHEN 2 THEN 'Nobody' WHEN 15 THEN 'SBI Help' END AS payee_name,
    CASE k WHEN 0 THEN CAST(n % 5000 AS DOUBLE) WHEN 1 THEN n % 300 + 5e-1 WHEN 13 THEN CASE WHEN n % 9 <= 7 THEN pow(1e1, n % 9) END WHEN 15 THEN CAST(n % 4000 AS DOUBLE) END AS amount,
    CASE WHEN k IN (0, 1, 2, 12, 15) THEN false WHEN k = 3 THEN true WHEN k = 13 THEN n % 9 = 8 END AS amount_unreadable FROM pl)"""
ORACLES["payload_parsed"] = f"""WITH {PAY} SELECT payload_id, kind, scheme, payee_vpa, CASE WHEN kind = 'upi' THEN split_part(payee_vpa, '@', 2) END AS handle, payee_name, amount, amount_unreadable,
    CASE WHEN k = 0 THEN 'urgent claim your prize' END AS note, CASE WHEN k = 1 THEN '5411' END AS merchant_code, CASE WHEN k = 12 THEN 'https://a.example' END AS embedded_url,
    CASE k WHEN 7 THEN concat('Cafe', n) WHEN 8 THEN concat('Home', n) END AS wifi_ssid, CASE k WHEN 7 THEN true WHEN 8 THEN false END AS wifi_open,
    CASE WHEN k = 10 THEN concat('https://arnazon.com/', n) ELSE '' END AS embedded_urls FROM pp"""
ORACLES["payload_verdict"] = f"""WITH {PAY},
am AS (SELECT *, CASE WHEN coalesce(amount, 0) <= 0 THEN 0 WHEN k = 1 THEN 20 WHEN amount >= 2000 THEN 85 ELSE 50 END AS ap FROM pp),
sig AS (SELECT payload_id, kind, k,
    CASE k WHEN 0 THEN [80, ap, 55] WHEN 1 THEN [ap] WHEN 2 THEN [0] WHEN 3 THEN [50, 55] WHEN 12 THEN [60] WHEN 13 THEN [70, CASE WHEN amount_unreadable THEN 55 ELSE ap END] WHEN 15 THEN [ap] END AS pens0,
    ap, amount_unreadable FROM am),
hit AS (SELECT *, list_filter(pens0, lambda x: x > 0) AS pens FROM sig),
us AS (SELECT *, CASE WHEN len(pens) > 0 THEN least(100, list_max(pens) + 6 * (len(pens) - 1)) ELSE 0 END AS up FROM hit),
sc AS (SELECT payload_id, kind, k, ap, amount_unreadable, CAST(CASE WHEN kind = 'upi' THEN up WHEN k = 4 THEN 55 WHEN k = 5 THEN 70 WHEN k = 6 THEN 90 WHEN k = 7 THEN 45 WHEN k = 9 THEN 55 WHEN k = 10 THEN 100 ELSE 0 END AS BIGINT) AS risk_score FROM us),
vd AS (SELECT *, CASE WHEN k = 2 THEN 'unknown' WHEN kind = 'upi' THEN {VERDICT} WHEN k = 5 THEN 'dangerous' WHEN k = 6 THEN 'dangerous' WHEN k = 7 THEN 'suspicious' WHEN k = 9 THEN 'suspicious' WHEN k = 10 THEN 'dangerous' ELSE 'unknown' END AS verdict FROM sc)
SELECT payload_id, kind, risk_score, verdict, CAST(CASE WHEN k = 2 THEN 0.4 WHEN kind = 'upi' THEN CASE WHEN verdict = 'safe' THEN CASE WHEN risk_score > 0 THEN 0.8 ELSE 0.75 END WHEN risk_score > 0 THEN 0.9 ELSE 0.75 END
    WHEN kind = 'url' THEN 0.35 WHEN k = 6 THEN 0.95 WHEN kind = 'wifi' THEN 0.7 WHEN k = 9 THEN 0.75 WHEN k = 10 THEN 0.3 ELSE 0.4 END AS DOUBLE) AS confidence,
    CASE k WHEN 0 THEN 'payee_brand_mismatch:bad|' || CASE WHEN ap > 0 THEN 'amount_on_receive_qr:bad|' ELSE '' END || 'urgent_note:bad|payee_name_unverified:unknown|known_psp_handle:good'
        WHEN 1 THEN 'amount_on_receive_qr:bad|payee_name_unverified:unknown|known_psp_handle:good|no_note:good'
        WHEN 2 THEN 'missing_vpa:unknown|payee_name_unverified:unknown|no_prefilled_amount:good|no_note:good'
        WHEN 3 THEN 'unknown_psp_handle:bad|unreadable_amount:bad|payee_name_unverified:unknown|no_note:good'
        WHEN 4 THEN 'shortened_link:bad|safe_browsing:unknown|domain_age:unknown' WHEN 5 THEN 'raw_ip_link:bad|safe_browsing:unknown|domain_age:unknown'
        WHEN 6 THEN 'dangerous_scheme:bad' WHEN 7 THEN 'open_wifi:bad|wifi_name_unverified:unknown' WHEN 8 THEN 'wifi_name_unverified:unknown|encrypted_wifi:good' WHEN 9 THEN 'crypto_payment:bad'
        WHEN 10 THEN 'link_in_payload:bad|brand:bad|safe_browsing:unknown|domain_age:unknown|not_a_destination:unknown' WHEN 11 THEN 'not_a_destination:unknown'
        WHEN 12 THEN 'link_inside_payment:bad|payee_name_unverified:unknown|known_psp_handle:good|no_prefilled_amount:good|no_note:good'
        WHEN 13 THEN 'malformed_vpa:bad|' || CASE WHEN amount_unreadable THEN 'unreadable_amount:bad' ELSE 'amount_on_receive_qr:bad' END || '|payee_name_unverified:unknown|no_note:good'
        WHEN 14 THEN 'safe_browsing:unknown|domain_age:unknown'
        ELSE CASE WHEN ap > 0 THEN 'amount_on_receive_qr:bad|' ELSE '' END || 'payee_name_unverified:unknown|known_psp_handle:good|no_note:good' END AS signals FROM vd"""
ORACLES["site_checks_stored"] = f"""{FULL}, {PAY}
SELECT concat('dev-', page_id) AS device_id, domain, trust_score, verdict, listed AS safe_browsing_hit, bad AND NOT coalesce(listed, false) AS brand_mismatch FROM scored WHERE verdict <> 'safe' AND domain <> ''
UNION ALL SELECT concat('pay-', payload_id), CASE k WHEN 4 THEN 'bit.ly' WHEN 5 THEN concat('0.', n % 256) WHEN 10 THEN 'arnazon.com' ELSE 'example.org' END, CASE WHEN k = 10 THEN 0 ELSE 50 END,
    CASE WHEN k = 10 THEN 'dangerous' ELSE 'unknown' END, NULL, k = 10 FROM pp WHERE k IN (4, 5, 10, 14)"""

ORACLES["site_checks_read"] = f"""{FULL}, kept AS (SELECT *, {NOW} - to_days(CAST(page_id % 60 AS INTEGER)) AS seen_at FROM scored WHERE verdict <> 'safe' AND domain <> '')
SELECT concat('dev-', page_id % 50) AS device_id, verdict, count(*) AS n, epoch_us(min(seen_at)) AS first_at, CAST(sum(trust_score) AS BIGINT) AS trust,
    count(*) FILTER (listed) AS listed, count(*) FILTER (bad AND NOT coalesce(listed, false)) AS imitations
FROM kept WHERE seen_at >= {NOW} - INTERVAL 30 DAY GROUP BY ALL"""

# ---------------------------------------------------------------------------
# Reviews
# ---------------------------------------------------------------------------

ORACLES["review_split"] = """WITH p AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\\n\\s*\\n'), lambda r: regexp_replace(r, '^\\s+|\\s+$', '', 'g')), lambda r: length(r) > 5) AS x FROM documents)
SELECT doc_id, pos - 1 AS pos, length(x[pos]) AS n, md5(x[pos]) AS digest FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS pos FROM p)"""
REVIEWS = f"rv AS (SELECT {derive.REVIEWS} FROM documents d LEFT JOIN labels q ON d.doc_id = q.doc_id)"


def tokens(x: str) -> str:
    """A token ends where no letter of any alphabet follows, as in the Spark pattern."""
    folded = f"regexp_replace(lower({x}), '[^\\x00-\\x7F]', '_', 'g')"
    return f"list_distinct(regexp_extract_all({folded}, '\\b[a-z0-9]{{3,}}\\b'))"


def count_of(x: str, phrases) -> str:
    return "(" + " + ".join(f"CAST(regexp_matches({x}, {q(p)}) AS INT)" for p in phrases) + ")"


LANG = f"""{REVIEWS}, rt AS (SELECT *, lower(trim(concat(coalesce(title, ''), ' ', body))) AS x, {tokens('product_title')} AS want, {tokens('body')} AS toks FROM rv),
lang AS (SELECT set_id, review_id, rating, verified_purchase, toks,
    list_filter([CASE WHEN {count_of('x', reviews.INCENTIVE)} > 0 THEN 'language_incentive_disclosure' END, CASE WHEN {count_of('x', reviews.SUPERLATIVE)} >= 2 THEN 'language_superlative_stacking' END,
        CASE WHEN {count_of('x', reviews.MARKETING)} >= 2 THEN 'language_marketing_register' END,
        CASE WHEN length(product_title) > 5 AND len(want) >= 2 AND length(body) < 300 AND list_has_all(toks, want) THEN 'language_title_stuffing' END], lambda h: h IS NOT NULL) AS hits FROM rt)"""
ORACLES["review_language"] = f"WITH {LANG} SELECT review_id, array_to_string(hits, '|') AS hits FROM lang"
#: all pairs, each compared
PAIRS = f"""tk AS (SELECT set_id, review_id, toks FROM lang WHERE len(toks) >= 5),
pr AS (SELECT a.set_id, a.review_id AS r1, b.review_id AS r2 FROM tk a JOIN tk b ON a.set_id = b.set_id AND a.review_id < b.review_id
    WHERE len(list_intersect(a.toks, b.toks)) * 10 >= (len(a.toks) + len(b.toks) - len(list_intersect(a.toks, b.toks))) * 7),
nd AS (SELECT set_id, review_id, count(*) AS partners FROM (SELECT set_id, r1 AS review_id FROM pr UNION ALL SELECT set_id, r2 FROM pr) GROUP BY ALL)"""
ORACLES["review_near_dups"] = f"WITH {LANG}, {PAIRS} SELECT * FROM nd"


def set_score(model: str) -> str:
    pen = "list_transform(hits, lambda h: CASE h WHEN 'language_incentive_disclosure' THEN 80 WHEN 'language_superlative_stacking' THEN 45 WHEN 'language_marketing_register' THEN 35 ELSE 40 END)"
    return f"""st AS (SELECT set_id, count(*) AS n, max(list_max({pen})) AS lw, sum(len(hits)) AS lh, count(rating) AS rated, count(*) FILTER (rating = 5) AS f5, count(*) FILTER (rating = 1) AS f1,
    count(verified_purchase) AS known, count(*) FILTER (NOT verified_purchase) AS unv FROM lang GROUP BY 1),
s1 AS (SELECT *, (SELECT count(*) FROM pr WHERE pr.set_id = st.set_id) AS dup_pairs, rated >= 5 AND f5 + f1 = rated AND f1 > 0 AND f5 > 0 AS polarised, known >= 3 AND unv / known >= 75e-2 AS doubtful FROM st),
s2 AS (SELECT *, CASE WHEN lh = 0 THEN 0 ELSE least(100, lw + 5 * (lh - 1)) END AS lp,
    CASE WHEN n < 2 THEN NULL WHEN dup_pairs > 0 AND polarised THEN 95 WHEN dup_pairs > 0 THEN 85 WHEN polarised THEN 60 ELSE 0 END AS pp,
    CASE WHEN known = 0 THEN NULL WHEN doubtful THEN 50 ELSE 0 END AS rp FROM s1),
s3 AS (SELECT *, (35e-2 * lp + coalesce(4e-1 * pp, 0) + coalesce(25e-2 * rp, 0)) / (35e-2 + CASE WHEN pp IS NULL THEN 0e0 ELSE 4e-1 END + CASE WHEN rp IS NULL THEN 0e0 ELSE 25e-2 END) AS wt,
    greatest(lp, coalesce(pp, 0), coalesce(rp, 0)) AS worst FROM s2),
s4 AS (SELECT *, greatest({model}, CAST(least(100, round_even(CASE WHEN worst >= 80 THEN greatest(wt, worst) ELSE wt END, 0)) AS BIGINT)) AS risk_score FROM s3)"""


BANDS = "CASE WHEN {0} >= 70 THEN 'manipulated' WHEN {0} >= 40 THEN 'suspicious' ELSE 'organic' END"
ORACLES["review_set_score"] = f"""WITH {LANG}, {PAIRS}, {set_score("CASE WHEN length(set_id) = 4 THEN 55 ELSE 0 END")}
SELECT set_id, n, dup_pairs, CAST(lp AS BIGINT) AS language_penalty, pp AS pattern_penalty, rp AS reviewer_penalty, risk_score, {BANDS.format('risk_score')} AS verdict,
    CAST(CASE WHEN n >= 3 OR length(set_id) = 4 THEN 0.85 ELSE 0.7 END AS DOUBLE) AS confidence FROM s4"""
ORACLES["review_item_score"] = f"""WITH {LANG}, {PAIRS}, {set_score('0')},
it AS (SELECT l.set_id, l.review_id, risk_score AS sscore, list_concat(list_transform(hits, lambda h: CASE h WHEN 'language_incentive_disclosure' THEN 85 WHEN 'language_superlative_stacking' THEN 60 ELSE 35 END),
    list_filter([CASE WHEN nd.partners > 0 THEN 85 END, CASE WHEN polarised AND rating IS NOT NULL THEN 60 END, CASE WHEN doubtful AND verified_purchase = false THEN 60 END], lambda x: x IS NOT NULL)) AS own
    FROM lang l JOIN s4 USING (set_id) LEFT JOIN nd ON nd.set_id = l.set_id AND nd.review_id = l.review_id),
io AS (SELECT set_id, review_id, len(own) AS signals, CASE WHEN len(own) > 0 THEN least(100, greatest(sscore, list_max(own))) WHEN sscore < 40 THEN 15 ELSE least(40, sscore) END AS risk_score FROM it)
SELECT *, {BANDS.format('risk_score')} AS verdict FROM io"""

# ---------------------------------------------------------------------------
# Retrieval
# ---------------------------------------------------------------------------


def terms(x: str) -> str:
    folded = f"regexp_replace(lower({x}), '[^\\x00-\\x7F]', '_', 'g')"
    words = f"list_filter(regexp_extract_all({folded}, '\\b[a-z0-9]{{3,}}\\b'), lambda w: NOT list_contains({array(dims.STOP_WORDS)}, w))"
    cases = " ".join(f"WHEN {q(w)} THEN {array(e)}" for w, e in dims.SYNONYMS.items())
    return f"list_concat({words}, flatten(list_transform({words}, lambda w: CASE w {cases} ELSE [] END)))"


BM25 = f"""
dt AS (SELECT id, ord, {terms("concat_ws(' ', title, summary, body, summary)")} AS t FROM (SELECT {derive.CARDS} FROM documents)),
size AS (SELECT count(*) AS n, avg(len(t)) AS al FROM dt),
tf AS (SELECT id, ord, len(t) AS dl, unnest(t) AS w FROM dt),
tfc AS (SELECT id, ord, dl, w, count(*) AS tf FROM tf GROUP BY ALL),
dfc AS (SELECT w, count(*) AS df FROM tfc GROUP BY 1),
qt AS (SELECT qid, unnest({terms('question')}) AS w FROM (SELECT {derive.QUESTIONS} FROM benchmark)),
bm AS (SELECT qid, id, ord, sum(ln((n - df + 5e-1) / (df + 5e-1) + 1e0) * (tf * 25e-1 / (tf + 15e-1 * (25e-2 + 75e-2 * (dl / al))))) AS score
    FROM qt JOIN tfc USING (w) JOIN dfc USING (w) CROSS JOIN size GROUP BY ALL)"""
ORACLES["bm25_top3"] = f"""WITH {BM25} SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, ord) AS rank, id, round(score, 6) AS score FROM bm WHERE score >= 1 QUALIFY rank <= 3"""
ORACLES["bm25_top3_indexed"] = ORACLES["bm25_top3"]

# ---------------------------------------------------------------------------
# Cards and streams
# ---------------------------------------------------------------------------

ORACLES["cards_read"] = """SELECT 'item-' || item_id AS id, 'a|b' AS tags, md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS digest FROM benchmark"""
ORACLES["cards_parsed"] = """SELECT CASE WHEN doc_id % 4 = 0 THEN 'file_' || doc_id ELSE 'card-' || doc_id END AS id, CASE WHEN doc_id % 4 = 0 THEN 'File ' || doc_id ELSE 'Topic ' || source END AS title,
    CASE WHEN doc_id % 4 = 0 THEN '' ELSE lang || '|' || source END AS tags, CASE WHEN doc_id % 4 = 0 THEN 'File ' || doc_id ELSE 'Topic ' || source END AS summary,
    length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS n, md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS digest FROM documents"""
#: windows whose end the watermark (latest event less one hour) has passed
ORACLES["stream_live_counts"] = f"""WITH p AS (SELECT *, time_bucket(INTERVAL 6 HOUR, occurred_at, TIMESTAMP '2000-01-01') AS w FROM (SELECT {derive.PII_EVENTS} FROM events))
SELECT device_id, pii_type, epoch_us(w) AS "from", epoch_us(w + INTERVAL 6 HOUR) AS until, count(*) AS events, count(*) FILTER (action_taken = 'masked') AS masked
FROM p WHERE w + INTERVAL 6 HOUR <= (SELECT max(occurred_at) - INTERVAL 1 HOUR FROM p) GROUP BY ALL"""
ORACLES["stream_debounced"] = """WITH e AS (SELECT CAST(user_id % 5 AS VARCHAR) AS device_id, ts, concat('text ', event_id) AS text FROM events),
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY device_id ORDER BY ts) < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS b FROM e),
s AS (SELECT *, sum(b) OVER (PARTITION BY device_id ORDER BY ts) AS grp FROM g)
SELECT device_id, 'f' AS field_id, epoch_us(max(ts)) AS ts, count(*) AS states, arg_max(text, ts) AS text FROM s GROUP BY device_id, grp
HAVING max(ts) + INTERVAL 10 MINUTE <= (SELECT max(ts) - INTERVAL 1 MINUTE FROM e)"""
#: 2^(-age/7) summed over whole days up to 6 February
ORACLES["stream_incremental_score"] = f"""WITH p AS (SELECT * FROM (SELECT {derive.PII_EVENTS} FROM events) WHERE occurred_at >= TIMESTAMP '2024-01-06' ),
s AS (SELECT device_id, sum({PII_W} * pow(5e-1, {age('occurred_at', "TIMESTAMP '2024-02-06'")} / 7e0)) AS p FROM p GROUP BY 1)
SELECT device_id, {curve('p')} AS privacy FROM s"""
ORACLES["stream_score_from_state"] = ORACLES["stream_incremental_score"]
#: a burst is left out if the field's burst before it held the same text, less than a week before
ORACLES["stream_typed_findings"] = f"""WITH e AS (SELECT * FROM (SELECT {derive.TYPED} FROM events) WHERE field_type <> 'password'),
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY device_id, field_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM e),
s AS (SELECT *, sum(b) OVER (PARTITION BY device_id, field_id ORDER BY ts) AS grp FROM g),
burst AS (SELECT device_id, field_id, max(ts) AS ts, arg_max(text, ts) AS text, any_value(site_origin) AS site_origin FROM s GROUP BY device_id, field_id, grp),
told AS (SELECT *, row_number() OVER (ORDER BY device_id, field_id, ts) AS doc_id FROM burst
    WINDOW w AS (PARTITION BY device_id, field_id ORDER BY ts) QUALIFY (lag(text) OVER w = text AND ts - lag(ts) OVER w < INTERVAL 7 DAY) IS NOT TRUE),
{findings("SELECT * FROM told WHERE length(trim(text)) >= 6")}
SELECT device_id, site_origin, epoch_us(ts) AS occurred_at, pii_type, masked_preview FROM finding JOIN told USING (doc_id)"""
ORACLES["scores_from_day_sums"] = f"""WITH r AS ({ORACLES["risk_overall"]}), x AS ({DEVICE} SELECT device_id FROM pii UNION SELECT device_id FROM sc)
SELECT device_id, privacy, browsing FROM r WHERE device_id IN (SELECT device_id FROM x)"""

ORACLES["stored_dashboard"] = f"""WITH d AS ({ORACLES["dashboard_summary"]})
SELECT device_id, overall, risk_level, privacy, browsing, identity, lever, total_pii_events, total_sites_flagged FROM d"""
ORACLES["scores_stored"] = f"""WITH d AS ({ORACLES["dashboard_summary"]})
SELECT device_id, epoch_us(TIMESTAMP '{derive.NOW}') AS captured_at, overall, privacy, identity, browsing FROM d"""
