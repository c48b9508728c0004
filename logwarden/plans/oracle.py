"""DuckDB statements equivalent to the registered queries, written independently from the raw tables."""

from __future__ import annotations

import datetime as dt

from logwarden.config import SUSPICIOUS_MARKERS
from logwarden.operators.review import INSTRUCTIONS
from logwarden.plans.queries import BASE_DAYS, DAY_END, RANGE, SOME_USER, SPLIT, TRUST_AS_OF


def _r(x: str, digits: int) -> str:
    """Correctly rounded decimal of a double, ties to even, by its exact binary value."""
    return f"CAST(printf('%.{digits}f', {x}) AS DOUBLE)"


def _iso(x: str) -> str:
    return f"strftime(make_timestamp(({x}) * 1000000), '%Y-%m-%dT%H:%M:%SZ')"


def _set(c: str) -> str:
    return f"coalesce(array_to_string(list_sort(list(DISTINCT {c}) FILTER ({c} IS NOT NULL)), ','), '')"


LOGS = f"""
e AS (
 SELECT event_id, user_id AS uid, event_type, value, CAST(json_extract_string(props, '$.k') AS INT) AS k,
        CAST(floor(epoch(ts)) AS BIGINT) AS ep FROM events),
logs AS (
 SELECT event_id AS log_id, ep AS receive_epoch, {_iso('ep')} AS "timestamp",
  CASE event_type WHEN 'purchase' THEN 'POST' WHEN 'signup' THEN 'PUT' ELSE 'GET' END AS method,
  CASE event_type WHEN 'click' THEN concat('/api/products?p=', CAST(k % 20 AS STRING))
   WHEN 'view' THEN concat('/api/users/', CAST(CASE WHEN k < 25 THEN uid ELSE (uid + k) % 150 END AS STRING))
   WHEN 'purchase' THEN concat('/api/orders/', CAST(140000000 + k AS STRING))
   WHEN 'signup' THEN concat('/api/addresses/', CAST(k AS STRING))
   ELSE CASE WHEN k < 2 THEN concat('/admin/', CAST(k AS STRING)) ELSE concat('/api/x/', CAST(k % 7 AS STRING)) END
  END AS uri,
  CAST(CASE WHEN event_type = 'error' THEN CASE WHEN k < 50 THEN 500 ELSE 404 END
   WHEN event_type = 'signup' AND k < 10 THEN 302 ELSE 200 END AS BIGINT) AS status,
  CASE WHEN event_id % 131 = 0 THEN 0.0::DOUBLE ELSE value / 100 END AS response_time,
  CAST(floor(value * 100) AS BIGINT) AS bytes_sent, concat('ua-', CAST(k % 4 AS STRING)) AS user_agent,
  CASE WHEN k < 10 THEN '203.0.113.50' WHEN k < 70 THEN concat('118.235.82.', CAST(k % 6 AS STRING))
   ELSE concat('13.124.0.', CAST(k % 10 AS STRING)) END AS client_ip,
  concat('10.0.1.', CAST(k % 3 AS STRING)) AS alb_ip,
  CASE WHEN k < 10 THEN 'unknown' WHEN k < 70 THEN 'cgnat_kr' ELSE 'cloud' END AS ip_class,
  CASE WHEN k < 10 THEN 'AS64500' WHEN k < 70 THEN 'AS4766' ELSE 'AS16509' END AS ip_asn,
  CASE WHEN k >= 70 THEN 'cloud host' WHEN k >= 10 THEN 'carrier' END AS ip_org,
  CASE WHEN k >= 10 AND k < 70 THEN 'KR' ELSE 'US' END AS ip_country,
  k >= 10 AND k < 70 AS is_nat_whitelisted,
  CASE WHEN event_id % 89 = 0 THEN 'replayed' END AS seed_scenario,
  event_id % 89 <> 0 AS baseline_eligible,
  CASE WHEN event_id % 97 <> 0 THEN CAST(uid AS STRING) END AS user_id,
  CASE WHEN event_id % 97 <> 0 AND event_id % 53 <> 0
   THEN concat('jti-', CAST(uid AS STRING), '-', CAST(ep // 86400 AS STRING)) END AS jwt_id,
  CASE WHEN event_id % 97 <> 0 THEN concat('lsid-', CAST(uid AS STRING)) END AS session_id,
  CASE WHEN event_id % 97 <> 0 THEN CASE WHEN event_type = 'click' THEN 'web' ELSE 'app' END END AS client_id,
  CASE WHEN event_id % 97 <> 0 THEN 'ES256' END AS alg,
  CASE WHEN event_id % 97 <> 0 THEN CASE WHEN k < 95 THEN 'key-1' ELSE 'key-2' END END AS kid,
  CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 211 = 0 THEN ep + 4000 ELSE ep - (k % 9) * 60
   END AS jwt_issued_at,
  CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 211 = 0 THEN ep + 4600 WHEN event_id % 107 = 0 THEN ep - 1
   WHEN event_id % 103 = 0 THEN ep + 7200 WHEN event_id % 101 = 0 THEN ep - (k % 9) * 60 + 2400
   ELSE ep - (k % 9) * 60 + 600 END AS jwt_expires_at,
  CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 109 = 0 THEN ep - 90000
   WHEN event_id % 113 = 0 THEN ep - 2700000 ELSE ep - (k % 9) * 60 END AS auth_time,
  CASE WHEN event_id % 97 <> 0 THEN 'aal1' END AS acr,
  CASE WHEN event_id % 97 <> 0 THEN 'pwd' ELSE '' END AS amr,
  CASE WHEN event_id % 97 <> 0 THEN 'openid,core' ELSE '' END AS scopes,
  CASE WHEN event_id % 97 = 0 THEN '' WHEN event_id % 127 = 0 THEN 'https://other.example'
   ELSE 'https://api.example' END AS audiences,
  CASE WHEN event_id % 97 <> 0 THEN 'https://auth.example/' END AS issuer
 FROM e)"""

DERIVED = """
 CASE WHEN receive_epoch - jwt_issued_at < 60 THEN 'fresh' WHEN receive_epoch - jwt_issued_at < 3600 THEN 'active'
  WHEN receive_epoch - jwt_issued_at < 86400 THEN 'aging' WHEN jwt_issued_at IS NOT NULL THEN 'stale'
  END AS token_lifecycle,
 CASE WHEN jwt_expires_at - receive_epoch < 0 THEN 'expired' WHEN jwt_expires_at - receive_epoch < 60
  THEN 'expiring_soon' WHEN jwt_expires_at IS NOT NULL THEN 'valid' END AS token_status,
 receive_epoch - jwt_issued_at AS token_age_seconds, jwt_expires_at - receive_epoch AS token_ttl_seconds"""


def _rule(no: int, name: str, score: int, where: str, reason: str) -> str:
    return (f"SELECT log_id, user_id, receive_epoch, jwt_id, uri, {no} AS rule_no, '{name}' AS rule, {score} AS score,"
            f" {reason} AS reason FROM logs WHERE {where}")


VIOL = "viol AS (" + " UNION ALL ".join([
    _rule(0, "T001", 80, "jwt_expires_at < receive_epoch",
          "printf('expired token (%d s after expiry)', receive_epoch - jwt_expires_at)"),
    _rule(1, "T002", 70, "jwt_expires_at - jwt_issued_at > 1800",
          "printf('long-lived token (TTL %d s, normal 600 s)', jwt_expires_at - jwt_issued_at)"),
    _rule(2, "T003", 80, "jwt_issued_at > receive_epoch + 60",
          "printf('token issued in the future (%d s ahead)', jwt_issued_at - receive_epoch)"),
    _rule(3, "T004", 30, "receive_epoch - auth_time > 86400",
          "printf('stale authentication (%d days ago)', (receive_epoch - auth_time) // 86400)"),
    _rule(4, "T005", 70, "audiences <> '' AND audiences <> 'https://api.example'",
          """'wrong audience: ["' || audiences || '"]'"""),
    _rule(5, "T006", 20, "user_id IS NOT NULL AND jwt_id IS NULL", "'jti claim missing'"),
    _rule(6, "T007", 80, "jwt_expires_at - jwt_issued_at > 3600",
          "printf('abnormal TTL (%d s, over 6 times the normal 600 s)', jwt_expires_at - jwt_issued_at)"),
]) + ")"


def _alert(name: str, severity: str, rfc: str, mitre: str, where: str, reason: str, evidence: str) -> str:
    return (f"SELECT *, '{name}' AS rule, '{severity}' AS severity, '{rfc}' AS rfc, {mitre} AS mitre, {reason} AS reason,"
            f" {evidence} AS evidence FROM logs WHERE {where}")


def _hits(now: str = "receive_epoch") -> str:
    return "hits AS (" + " UNION ALL ".join([
        _alert("T001", "high", "RFC 7519 §4.1.4", "'T1550.001'", f"jwt_expires_at <> 0 AND jwt_expires_at < {now}",
               f"printf('expired token used (%d s after expiry)', {now} - jwt_expires_at)",
               f"""printf('{{"jwt_expires_at":%d,"now":%d,"expired_seconds_ago":%d}}', jwt_expires_at, {now}::BIGINT,
                   {now} - jwt_expires_at)"""),
        _alert("T002", "high", "RFC 9068 §3", "'T1550.001'", "jwt_expires_at - jwt_issued_at > 86400",
               "printf('abnormally long-lived token (%d hours)', (jwt_expires_at - jwt_issued_at) // 3600)",
               """printf('{"lifetime_seconds":%d,"lifetime_hours":%d}', jwt_expires_at - jwt_issued_at,
                   (jwt_expires_at - jwt_issued_at) // 3600)"""),
        _alert("T003", "high", "RFC 8725 §2.7", "'T1550.001'", f"jwt_issued_at > {now} + 60",
               f"printf('token issued in the future (%d s ahead)', jwt_issued_at - {now})",
               f"""printf('{{"jwt_issued_at":%d,"now":%d,"future_seconds":%d}}', jwt_issued_at, {now}::BIGINT,
                   jwt_issued_at - {now})"""),
        _alert("T004", "medium", "RFC 9068 §1", "'T1078'", "jwt_issued_at - auth_time > 2592000",
               "printf('token issued on stale authentication (%d days)', (jwt_issued_at - auth_time) // 86400)",
               """printf('{"auth_time_age_days":%d,"iat_minus_auth_time":%d}', (jwt_issued_at - auth_time) // 86400,
                   jwt_issued_at - auth_time)"""),
        _alert("T005", "high", "RFC 7519 §4.1.3", "'T1550.001'",
               "audiences <> '' AND audiences <> 'https://api.example'",
               """'wrong audience: ["' || audiences || '"]'""",
               """'{"expected":"https://api.example","got":["' || audiences || '"]}'"""),
        _alert("T006", "medium", "RFC 7519 §4.1.7", "NULL", "user_id IS NOT NULL AND jwt_id IS NULL",
               "'jti claim missing from the token'", """'{"has_jwt":true,"has_jti":false}'"""),
    ]) + ")"


HITS = _hits()
RESIDUAL = "residual AS (SELECT * FROM logs WHERE log_id NOT IN (SELECT log_id FROM hits))"

REJECTED = ("(CASE WHEN log_id % 59 = 0 THEN 'empty' WHEN log_id % 61 = 0 THEN 'not json' WHEN log_id % 71 = 0 THEN 'not an object' "
            "WHEN log_id % 73 = 0 AND jwt_issued_at IS NOT NULL THEN 'unreadable: jwt.iat' END)")

CLUSTERS = """
clusters AS (
 SELECT subnet, count(DISTINCT client_ip) AS ip_count, max(receive_epoch) AS last_epoch,
  list_sort(list(DISTINCT client_ip))[1:10] AS sample_ips
 FROM (SELECT *, regexp_replace(client_ip, '\\.[^.]*$', '.0/24') AS subnet FROM logs) GROUP BY subnet
 HAVING count(DISTINCT client_ip) >= 5)"""

def _global(win: str, closed: str = "true") -> str:
    """Alerts of the four global rules, networks by ``win``."""
    return f"""
gl AS (SELECT *, regexp_replace(client_ip, '\\.[^.]*$', '.0/24') AS subnet, receive_epoch - receive_epoch % 86400 AS today FROM logs),
nets AS (
 SELECT subnet, {win} AS win, count(DISTINCT client_ip) AS n, count(*) AS reqs, count(*) FILTER (status >= 400) AS errs,
  count(*) FILTER (regexp_matches(uri, '/(addresses|orders)/[0-9]+')) AS sens, max(receive_epoch) AS receive_epoch,
  list_sort(list(DISTINCT client_ip))[1:10] AS sample FROM gl GROUP BY ALL HAVING count(DISTINCT client_ip) >= 5),
sess AS (
 SELECT session_id, today AS win, count(DISTINCT subnet) AS n, max(receive_epoch) AS receive_epoch,
  list_sort(list(DISTINCT subnet))[1:10] AS sample FROM gl WHERE session_id IS NOT NULL GROUP BY ALL HAVING count(DISTINCT subnet) >= 3),
globals AS (
 SELECT receive_epoch, win, 'C001' AS rule, 'high' AS severity, 'T1071' AS mitre,
  printf('%d addresses active in one /24 network (%s)', n, subnet) AS reason,
  printf('{{"subnet":"%s","ip_count":%d', subnet, n) AS head, 'sample_ips' AS sampled, sample, '' AS tail FROM nets
 UNION ALL SELECT receive_epoch, win, 'C002', 'medium', 'T1595',
  printf('%d of %d requests failed over %d addresses of one /24 network (%s)', errs, reqs, n, subnet),
  printf('{{"subnet":"%s","ip_count":%d,"error_count":%d,"request_count":%d', subnet, n, errs, reqs), NULL, NULL, '' FROM nets
  WHERE errs >= 20 AND errs * 100 >= reqs * 10
 UNION ALL SELECT receive_epoch, win, 'C003', 'high', 'T1119',
  printf('%d sensitive records read from %d addresses of one /24 network (%s)', sens, n, subnet),
  printf('{{"subnet":"%s","ip_count":%d,"sensitive_count":%d', subnet, n, sens), NULL, NULL, '' FROM nets WHERE sens >= 20
 UNION ALL SELECT receive_epoch, win, 'S001', 'high', 'T1539', printf('session %s used from %d networks in a day', session_id, n),
  printf('{{"session_id":"%s","networks":%d', session_id, n), 'sample_networks', sample, printf(',"win":%d', win) FROM sess),
found AS (SELECT * FROM globals WHERE {closed})"""


SAMPLED = """head || CASE WHEN sampled IS NULL THEN '' ELSE printf(',"%s":["%s"]', sampled, array_to_string(sample, '","')) END || tail || '}'"""

USERW = f"""
ul AS (SELECT *, receive_epoch - receive_epoch % 300 AS win FROM logs WHERE user_id IS NOT NULL),
tok AS (
 SELECT user_id, win, jwt_id AS jti, count(DISTINCT ip_class) > 1 AS cc, count(DISTINCT ip_country) > 1 AS co,
  {_set('client_ip')} AS ip_set, {_set('ip_class')} AS ip_class_set, {_set('ip_country')} AS ip_country_set
 FROM ul WHERE jwt_id IS NOT NULL GROUP BY ALL),
tokw AS (SELECT user_id, win, count(*) FILTER (cc) AS class_crossings, count(*) FILTER (co) AS country_crossings,
  string_agg(jti, ',' ORDER BY jti) FILTER (cc OR co) AS replay_jtis FROM tok GROUP BY ALL),
vio AS (SELECT *, receive_epoch - receive_epoch % 300 AS win, row_number() OVER (
  PARTITION BY user_id, receive_epoch - receive_epoch % 300 ORDER BY receive_epoch, log_id, rule_no) AS rn
 FROM viol WHERE user_id IS NOT NULL),
viow AS (SELECT user_id, win, least(80, max(score)) AS violation_score, {_set('rule')} AS triggered_rules,
  count(*) FILTER (rn <= 10) AS n_samples,
  string_agg(concat_ws('|', rule, CAST(score AS STRING), reason, coalesce(jwt_id, '-'), uri), ';' ORDER BY rn)
   FILTER (rn <= 10) AS samples FROM vio GROUP BY ALL),
uw0 AS (
 SELECT user_id, win, count(*) AS request_count, count(*) FILTER (status BETWEEN 200 AND 299) AS success_count,
  count(*) FILTER (status >= 400) AS error_count,
  count(*) FILTER (regexp_matches(uri, '/(addresses|orders)/[0-9]+')) AS suspicious_uri_count,
  count(DISTINCT uri) AS unique_uris_count, count(DISTINCT client_ip) AS ip_count, count(DISTINCT jwt_id) AS jti_count,
  {_set('client_ip')} AS ip_set, {_set('jwt_id')} AS jti_set, {_set('alg')} AS alg_set, {_set('kid')} AS kid_set,
  CAST(sum(bytes_sent) AS BIGINT) AS response_bytes_total, max(bytes_sent) AS response_bytes_max,
  bool_and(baseline_eligible) AS is_baseline_eligible
 FROM ul GROUP BY user_id, win),
uw AS (
 SELECT uw0.user_id AS target_id, uw0.*, {_iso('uw0.win')} AS window_start, '5min' AS window_size,
  coalesce(class_crossings, 0) AS class_crossings, coalesce(country_crossings, 0) AS country_crossings,
  coalesce(replay_jtis, '') AS replay_jtis, coalesce(violation_score, 0) AS violation_score,
  coalesce(triggered_rules, '') AS triggered_rules, coalesce(n_samples, 0) AS violation_samples,
  coalesce(samples, '') AS samples
 FROM uw0 LEFT JOIN tokw USING (user_id, win) LEFT JOIN viow USING (user_id, win))"""

IPW = f"""
lens AS (SELECT * FROM (VALUES ('5min', 300), ('1h', 3600), ('24h', 86400)) t(window_size, secs)),
il AS (SELECT logs.*, window_size, receive_epoch - receive_epoch % secs AS win FROM logs, lens),
ipw AS (
 SELECT client_ip AS target_id, win, {_iso('win')} AS window_start, window_size, count(*) AS request_count,
  count(*) FILTER (status >= 400) AS error_count,
  count(*) FILTER (regexp_matches(uri, '/(addresses|orders)/[0-9]+')) AS suspicious_uri_count,
  count(DISTINCT user_id) AS unique_subs_count, {_set('user_id')} AS sub_set,
  CAST(sum(bytes_sent) AS BIGINT) AS response_bytes_total, {_set('method')} AS request_methods,
  {_set('user_agent')} AS ua_set,
  arg_min_null(ip_class, (receive_epoch, log_id)) AS ip_class, arg_min_null(ip_asn, (receive_epoch, log_id)) AS ip_asn,
  arg_min_null(ip_org, (receive_epoch, log_id)) AS ip_org,
  arg_min_null(ip_country, (receive_epoch, log_id)) AS ip_country,
  arg_min_null(is_nat_whitelisted, (receive_epoch, log_id)) AS is_nat_whitelisted,
  bool_and(baseline_eligible) AS is_baseline_eligible
 FROM il GROUP BY client_ip, win, window_size)"""


def _base(name: str = "base", excluded: str | None = None, days: tuple[dt.date, dt.date] | None = None) -> str:
    keep = "is_baseline_eligible" + (f" AND target_id NOT IN (SELECT target_id FROM {excluded})" if excluded else "")
    if days:
        keep += f" AND CAST(make_timestamp(win * 1000000) AS DATE) BETWEEN DATE '{days[0]}' AND DATE '{days[1]}'"
    return f"""
{name}_vals AS (
 SELECT 'request_burst' AS metric, request_count AS v FROM uw WHERE {keep} UNION ALL
 SELECT 'response_size_burst', response_bytes_total FROM uw WHERE {keep} UNION ALL
 SELECT 'cumulative_exfil', response_bytes_total FROM ipw WHERE window_size = '24h' AND {keep} UNION ALL
 SELECT concat('ip_user_diversity_', window_size), unique_subs_count FROM ipw WHERE {keep}),
{name}_dist AS (
 SELECT metric, count(*) AS n, avg(v) AS mean, stddev_pop(v) AS std, list_sort(list(v)) AS s
 FROM {name}_vals GROUP BY metric),
{name} AS (
 SELECT m.metric, coalesce(n, 0) AS sample_count, coalesce({_r('mean', 3)}, 0) AS mean, coalesce({_r('std', 3)}, 0) AS std,
  coalesce(CAST(s[1 + least(n - 1, CAST(floor(0.50::DOUBLE * n) AS BIGINT))] AS DOUBLE), 0) AS p50,
  coalesce(CAST(s[1 + least(n - 1, CAST(floor(0.95::DOUBLE * n) AS BIGINT))] AS DOUBLE), 0) AS p95,
  coalesce(CAST(s[1 + least(n - 1, CAST(floor(0.99::DOUBLE * n) AS BIGINT))] AS DOUBLE), 0) AS p99,
  coalesce(n, 0) < 100 AS cold_start
 FROM (VALUES ('request_burst'), ('response_size_burst'), ('cumulative_exfil'), ('ip_user_diversity_5min'),
  ('ip_user_diversity_1h'), ('ip_user_diversity_24h')) m(metric) LEFT JOIN {name}_dist USING (metric))"""


PII = """
pii AS (
 SELECT CAST(user_id AS STRING) AS user_id, count(*) FILTER (event_type = 'purchase' AND k < 50) AS email,
  count(*) FILTER (event_type = 'signup' AND k < 30) AS phone,
  bool_or(event_type = 'error' AND k = 0) AS doorlock_with_address
 FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events) GROUP BY 1)"""

SENSITIVITY = ("CASE WHEN doorlock_with_address OR email >= 10 OR phone >= 10 THEN 70 WHEN phone >= 5 THEN 50 "
               "ELSE 0 END")


def _burst(value: str, metric: str, weight: int, cap: int, base: str) -> str:
    z = f"(({value} - b.mean) / b.std)"
    return (f"(SELECT CASE WHEN b.cold_start OR b.std = 0 THEN 0 ELSE CAST(least({cap}, "
            f"round_even(greatest(0::DOUBLE, {z} - 2) * {weight}, 0)) AS INT) END FROM {base} b WHERE b.metric = '{metric}')")


def _risk(name: str = "risk", base: str = "base", pii: bool = True) -> str:
    sens = f"coalesce((SELECT {SENSITIVITY} FROM pii WHERE pii.user_id = uw.target_id), 0)" if pii else "0"
    return f"""
{name}_div AS (
 SELECT ipw.*, b.mean AS baseline_mean, b.std AS baseline_std, b.sample_count AS baseline_sample_count,
  CASE WHEN NOT b.cold_start AND b.std <> 0 THEN (unique_subs_count - b.mean) / b.std END AS z
 FROM ipw LEFT JOIN {base} b ON b.metric = concat('ip_user_diversity_', window_size)),
{name}_raw AS (
 SELECT *, CASE WHEN z IS NULL THEN CASE WHEN unique_subs_count >= 10 THEN 70 WHEN unique_subs_count >= 5 THEN 30 ELSE 0 END
   WHEN z < 3 THEN 0 WHEN z < 6 THEN 70 ELSE 100 END AS raw_score FROM {name}_div),
{name}_fac AS (
 SELECT 'user' AS target_type, target_id, win, window_start, window_size, violation_score AS token_violation,
  {_burst('request_count', 'request_burst', 5, 25, base)} AS request_burst,
  CASE WHEN class_crossings > 0 OR country_crossings > 0 THEN 80 ELSE 0 END AS token_replay,
  {_burst('response_bytes_total', 'response_size_burst', 6, 30, base)} AS response_size_burst,
  0 AS ip_user_diversity, {sens} AS response_sensitivity, 0 AS cumulative_exfil, triggered_rules, class_crossings,
  NULL AS ip_class, NULL AS ip_asn, NULL AS ip_org, NULL AS ip_country, NULL::BOOLEAN AS is_nat_whitelisted FROM uw
 UNION ALL
 SELECT 'ip', target_id, win, window_start, window_size, 0, 0, 0, 0,
  CASE WHEN ip_class = 'cgnat_kr' AND raw_score > 30 THEN 30 ELSE raw_score END, 0,
  CASE WHEN window_size = '24h' THEN {_burst('response_bytes_total', 'cumulative_exfil', 10, 50, base)} ELSE 0 END,
  NULL, NULL, ip_class, ip_asn, ip_org, ip_country, is_nat_whitelisted FROM {name}_raw),
{name}_sum AS (
 SELECT *, greatest(ip_user_diversity, response_sensitivity) AS over,
  (token_violation + token_replay) + 0.3::DOUBLE * (request_burst + response_size_burst + cumulative_exfil) AS addv,
  0.3::DOUBLE * request_burst AS w_rb, 0.3::DOUBLE * response_size_burst AS w_rsb, 0.3::DOUBLE * cumulative_exfil AS w_ce
 FROM {name}_fac),
{name}_tot AS (
 SELECT *, CAST(least(100, round_even(greatest(over, addv), 0)) AS INT) AS total_score,
  greatest(token_violation, token_replay, w_rb, w_rsb, w_ce) AS top,
  greatest(token_violation, request_burst, token_replay, response_size_burst, ip_user_diversity, cumulative_exfil) AS top2
 FROM {name}_sum),
{name}_dom AS (
 SELECT *, CASE WHEN total_score = 0 THEN NULL
   WHEN over >= addv THEN CASE WHEN ip_user_diversity >= response_sensitivity THEN 'ip_user_diversity'
    ELSE 'response_sensitivity' END
   WHEN token_violation = top THEN 'token_violation' WHEN token_replay = top THEN 'token_replay'
   WHEN w_rb = top THEN 'request_burst' WHEN w_rsb = top THEN 'response_size_burst' ELSE 'cumulative_exfil'
   END AS dominant_factor,
  CASE WHEN top2 = 0 THEN NULL WHEN token_violation = top2 THEN 'token_violation'
   WHEN request_burst = top2 THEN 'request_burst' WHEN token_replay = top2 THEN 'token_replay'
   WHEN response_size_burst = top2 THEN 'response_size_burst' WHEN ip_user_diversity = top2 THEN 'ip_user_diversity'
   ELSE 'cumulative_exfil' END AS second FROM {name}_tot),
{name}_led AS (SELECT *, CASE WHEN dominant_factor = 'response_sensitivity' THEN second ELSE dominant_factor END AS led
 FROM {name}_dom),
{name} AS (
 SELECT *, CASE WHEN dominant_factor IS NULL THEN 'L0' WHEN led IS NULL THEN 'L4'
   WHEN led = 'ip_user_diversity' THEN CASE WHEN window_size = '24h' THEN 'L4(Slow & Low)' ELSE 'L4' END
   WHEN led = 'cumulative_exfil' THEN 'L4(Slow & Low)' ELSE 'L2' END AS attacker_level,
  response_sensitivity >= 70 AS data_exfiltration_detected,
  response_sensitivity >= 50 AND response_sensitivity < 70 AS suspected_exfiltration
 FROM {name}_led)"""


_MARKED = " OR ".join(f"contains(uri, '{m}')" for m in SUSPICIOUS_MARKERS)

CANDIDATES = f"""
rl AS (SELECT *, receive_epoch - receive_epoch % 86400 AS review_win,
  nullif(regexp_extract(uri, '/api/users/([0-9]+)', 1), '') AS acc FROM residual WHERE user_id IS NOT NULL),
rf AS (
 SELECT user_id, review_win, count(*) AS request_count, count(*) FILTER (status >= 400) AS error_count,
  bool_or({_MARKED}) AS marked, count(DISTINCT split_part(uri, '?', 1)) AS path_count,
  count(DISTINCT acc) FILTER (acc <> user_id) AS foreign_count FROM rl GROUP BY ALL),
cand AS (
 SELECT * FROM (SELECT user_id, review_win, request_count, error_count, path_count,
  CASE WHEN marked THEN 'suspicious_path' WHEN request_count < 3 THEN NULL WHEN request_count > 200 THEN 'volume'
   WHEN error_count / request_count > 0.3 THEN 'error_rate' WHEN path_count > 15 THEN 'path_variety'
   WHEN path_count = 1 AND request_count >= 20 THEN 'single_path' WHEN foreign_count >= 2 THEN 'foreign_ids'
   END AS reason FROM rf) WHERE reason IS NOT NULL)"""

REQUESTS = f"""
rk AS (SELECT *, row_number() OVER (PARTITION BY user_id, review_win ORDER BY receive_epoch, log_id) AS rn FROM rl),
lines AS (
 SELECT user_id, review_win, string_agg(printf('  %d. [%s] %s %s → %s (IP: %s)', rn, substr("timestamp", 1, 19), method,
   substr(uri, 1, 80), CAST(status AS STRING), client_ip), chr(10) ORDER BY rn) AS txt FROM rk WHERE rn <= 20 GROUP BY ALL),
req AS (
 SELECT user_id, review_win, request_count, c.reason, txt || CASE WHEN request_count > 20
   THEN chr(10) || printf('  ... (the first 20 of %d are shown)', request_count) ELSE '' END AS log_lines,
  rk.log_id, rk.receive_epoch, rk."timestamp", rk.client_ip, rk.method, rk.uri, rk.status, rk.jwt_id, rk.session_id
 FROM cand c JOIN lines USING (user_id, review_win) JOIN rk USING (user_id, review_win) WHERE rk.rn = 1)"""

VERDICTS = """
verdicts AS (
 SELECT req.* EXCLUDE (reason), CASE reason WHEN 'suspicious_path' THEN 'U-LLM-PRIV-ESC' ELSE 'U-LLM' END AS rule,
  CASE reason WHEN 'suspicious_path' THEN 'high' ELSE 'medium' END AS severity,
  CASE reason WHEN 'suspicious_path' THEN concat(request_count, ' requests') ELSE 'errors' END AS reason,
  NULL AS rfc, CASE reason WHEN 'suspicious_path' THEN 'T1190' END AS mitre, NULL AS cve,
  printf('{"user_id":"%s","log_count":%d,"llm_evidence":[%s],"model":"external-reviewer"}', user_id, request_count,
   CASE reason WHEN 'suspicious_path' THEN '"' || uri || '"' ELSE '' END) AS evidence
 FROM req WHERE reason = 'suspicious_path' OR (reason = 'error_rate' AND request_count % 2 = 0))"""

RULE_DOCS = f"""
docs AS (
 SELECT {_iso('receive_epoch')} AS "@timestamp", receive_epoch AS alert_epoch, 'rule_engine' AS alert_type, 1 AS layer,
  rule, severity, user_id, session_id, jwt_id, client_ip AS ip, method, uri, status, "timestamp" AS log_timestamp,
  evidence, reason, rfc, mitre, NULL AS cve FROM hits
 UNION ALL
 SELECT {_iso('last_epoch')}, last_epoch, 'global', 1, 'C001', 'high', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
  printf('{{"subnet":"%s","ip_count":%d,"sample_ips":["%s"]}}', subnet, ip_count, array_to_string(sample_ips, '","')),
  printf('%d addresses active in one /24 network (%s)', ip_count, subnet), NULL, 'T1071', NULL FROM clusters)"""

PROFILE = f"""
pl AS (SELECT *, receive_epoch - receive_epoch % 300 AS win FROM logs WHERE user_id IS NOT NULL),
pw AS (
 SELECT user_id, win, count(*) AS n, min(auth_time) AS amin, max(auth_time) AS amax FROM pl GROUP BY ALL),
pt AS (
 SELECT user_id, min(receive_epoch) AS first_seen, max(receive_epoch) AS last_seen, count(*) AS requests_total,
  count(*) FILTER (status BETWEEN 200 AND 299) AS success_total, count(*) FILTER (status >= 400) AS error_total,
  CAST(sum(bytes_sent) AS BIGINT) AS response_bytes_total, max(bytes_sent) AS response_bytes_max,
  count(*) FILTER (status // 100 = 2) AS s2xx, count(*) FILTER (status // 100 = 3) AS s3xx,
  count(*) FILTER (status // 100 = 4) AS s4xx, count(*) FILTER (status // 100 = 5) AS s5xx,
  list_sort(list(DISTINCT (receive_epoch % 86400) // 3600)) AS hours FROM pl GROUP BY user_id),
pb AS (
 SELECT user_id, count(*) AS data_points_count, max(n) AS requests_per_window_max, arg_min(amin, win) AS first_auth,
  arg_max(amax, win) AS last_auth FROM pw GROUP BY user_id),
prof AS (
 SELECT *, greatest((last_seen - first_seen) // 86400 + 1, 1) AS total_active_days,
  {_r('error_total / requests_total', 4)} AS error_ratio,
  {_r('response_bytes_total / requests_total', 1)} AS response_bytes_avg,
  {_r('requests_total / data_points_count', 3)} AS requests_per_window_mean FROM pt JOIN pb USING (user_id)),
pe AS (
 SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY "count" DESC, path) AS rank FROM (
  SELECT user_id, split_part(uri, '?', 1) AS path, count(*) AS "count", max(receive_epoch) AS last_seen
  FROM pl GROUP BY 1, 2)),
pi AS (
 SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY "count" DESC, client_ip) AS rank FROM (
  SELECT user_id, client_ip, count(*) AS "count", min(receive_epoch) AS first_seen, max(receive_epoch) AS last_seen,
   arg_min(ip_class, (receive_epoch, log_id)) AS ip_class, arg_min(ip_asn, (receive_epoch, log_id)) AS ip_asn,
   arg_min(ip_country, (receive_epoch, log_id)) AS ip_country FROM pl GROUP BY 1, 2)),
pk AS (
 SELECT *, row_number() OVER (PARTITION BY user_id, kind ORDER BY last_win DESC, v DESC) AS rn FROM (
  SELECT user_id, 'jti' AS kind, jwt_id AS v, max(win) AS last_win FROM pl WHERE jwt_id IS NOT NULL GROUP BY ALL UNION ALL
  SELECT user_id, 'kid', kid, max(win) FROM pl WHERE kid IS NOT NULL GROUP BY ALL UNION ALL
  SELECT user_id, 'session', session_id, max(win) FROM pl WHERE session_id IS NOT NULL GROUP BY ALL)),
ptok AS (
 SELECT user_id,
  coalesce(string_agg(v, ',' ORDER BY last_win, v) FILTER (kind = 'jti' AND rn <= 50), '') AS known_jtis,
  coalesce(string_agg(v, ',' ORDER BY last_win, v) FILTER (kind = 'session' AND rn <= 20), '') AS known_lsids,
  count(*) FILTER (kind = 'session') AS known_lsid_count,
  coalesce(string_agg(v, ',' ORDER BY last_win, v) FILTER (kind = 'kid' AND rn <= 5), '') AS known_kids
 FROM pk GROUP BY user_id),
pheads AS (
 SELECT *, row_number() OVER (PARTITION BY user_id, win ORDER BY receive_epoch, log_id) AS rn,
  jwt_expires_at - jwt_issued_at AS token_lifetime FROM pl),
pclaims AS (
 SELECT user_id, arg_max(audiences, win) FILTER (audiences <> '') AS audiences, arg_max(issuer, win) AS issuer,
  arg_max(client_id, win) AS client_id, arg_max(acr, win) AS acr, arg_max(amr, win) FILTER (amr <> '') AS amr,
  arg_max(scopes, win) FILTER (scopes <> '') AS scopes,
  arg_max(token_lifetime, win) FILTER (token_lifetime <> 0) AS token_lifetime FROM pheads WHERE rn = 1 GROUP BY user_id)"""

HISTORY = f"""
hist AS (
 SELECT target_id AS user_id, count(*) AS total_alerts, max(win) AS last_alert_epoch,
  arg_max(dominant_factor, win) AS last_alert_dominant_factor,
  arg_max(split_part(triggered_rules, ',', 1), win) FILTER (triggered_rules <> '') AS last_alert_rule,
  max(total_score) AS max_score_seen,
  max(CASE attacker_level WHEN 'L4' THEN 4 WHEN 'L4(Slow & Low)' THEN 3 WHEN 'L2' THEN 2 ELSE 1 END) AS lv,
  bool_or(data_exfiltration_detected) AS data_exfiltration_ever,
  count(*) FILTER (win BETWEEN {DAY_END} - 86400 AND {DAY_END}) AS alerts_last_24h,
  count(*) FILTER (win BETWEEN {DAY_END} - 7 * 86400 AND {DAY_END}) AS alerts_last_7d,
  count(*) FILTER (win BETWEEN {DAY_END} - 30 * 86400 AND {DAY_END}) AS alerts_last_30d
 FROM risk WHERE target_type = 'user' AND total_score >= 50 GROUP BY target_id)"""

# A stream closes a window once the watermark (newest log minus one minute) reaches its end.
CLOSED = "(SELECT max(receive_epoch) - 60 FROM logs)"


def _with(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " "


ALL_RISK = (LOGS, VIOL, USERW, IPW, PII, _base(), _risk())
BARE_RISK = (LOGS, VIOL, USERW, IPW, _base(), _risk(pii=False))
REVIEW = (LOGS, HITS, RESIDUAL, CANDIDATES)
BASE_COLUMNS = "metric, sample_count, mean, std, p50, p95, p99, cold_start"
SPREAD = """
 CASE WHEN r < 1e-9 THEN 0.0 ELSE CASE WHEN a < 0 THEN (a + 24) % 24 ELSE a END END AS hour,
 CASE WHEN r >= 1 THEN 0.0 WHEN r < 1e-9 THEN 12.0 ELSE sqrt(-2 * ln(r)) * 24 / (2 * pi()) END AS spread"""


PROFILE_COLUMNS = """prof.user_id, prof.first_seen, prof.last_seen, requests_total, error_ratio,
 (SELECT count(*) FROM pe WHERE pe.user_id = prof.user_id AND rank <= 30) AS unique_uri_count, known_jtis, client_id,
 (SELECT count(*) FROM pi WHERE pi.user_id = prof.user_id AND rank <= 20) AS known_ip_count,
 (SELECT client_ip FROM pi WHERE pi.user_id = prof.user_id AND rank = 1) AS primary_ip, data_points_count"""
PROFILE_TABLES = "prof JOIN ptok USING (user_id) JOIN pclaims USING (user_id)"
LATE = f"(log_id % 100 = 7 AND receive_epoch < {SPLIT})"


def oracle_statements() -> dict[str, str]:
    instructions = INSTRUCTIONS.replace("'", "''")
    return {
        "normalize_logs": _with(LOGS) + f"SELECT *, {DERIVED} FROM logs",
        "token_derivation": _with(LOGS) + f"SELECT log_id, {DERIVED} FROM logs",
        "time_range_scan": _with(LOGS) + 'SELECT log_id, "timestamp", user_id, uri, status FROM logs '
            f"WHERE receive_epoch BETWEEN {RANGE[0]} AND {RANGE[1]}",
        "time_range_first": _with(LOGS) + 'SELECT log_id, "timestamp", user_id, uri FROM logs '
            f"WHERE receive_epoch BETWEEN {RANGE[0]} AND {RANGE[1]} ORDER BY receive_epoch, log_id LIMIT 500",
        "recent_logs": _with(LOGS) + 'SELECT log_id, "timestamp", method, uri FROM logs '
            f"WHERE receive_epoch BETWEEN {DAY_END} - 1440 * 60 AND {DAY_END}",
        "user_logs": _with(LOGS) + 'SELECT log_id, "timestamp", method, uri, status FROM logs '
            f"WHERE user_id = '{SOME_USER}'",
        "stored_user_logs": _with(LOGS) + 'SELECT log_id, "timestamp", method, uri, status FROM logs '
            f"WHERE user_id = '{SOME_USER}' AND receive_epoch BETWEEN {RANGE[0]} AND {DAY_END}",
        "sensitive_uri": _with(LOGS) + "SELECT log_id, method, uri, client_ip FROM logs "
            "WHERE regexp_matches(uri, '/(addresses|orders)/[0-9]+')",
        "derived_fields": _with(LOGS) + f"""
            SELECT log_id, split_part(uri, '?', 1) AS path,
             nullif(regexp_extract(uri, '/api/users/([0-9]+)', 1), '') AS accessed_user, ({_MARKED}) AS suspicious,
             regexp_replace(client_ip, '\\.[^.]*$', '.0/24') AS subnet, CAST((receive_epoch % 86400) // 3600 AS INT) AS hour,
             CASE WHEN status // 100 BETWEEN 2 AND 5 THEN concat('s', status // 100, 'xx') END AS status_class,
             {_iso('receive_epoch - receive_epoch % 300')} AS window_start, {_r('bytes_sent / 32', 1)} AS units
            FROM logs""",
        "ingested_logs": _with(LOGS) + f"""SELECT log_id, "timestamp", receive_epoch, method, uri, status, bytes_sent, client_ip, user_id,
             jwt_id, jwt_issued_at, jwt_expires_at, auth_time, audiences, baseline_eligible,
             is_nat_whitelisted FROM logs WHERE {REJECTED} IS NULL""",
        "rejected_lines": _with(LOGS) + f"""SELECT {REJECTED} AS reason, count(*) AS lines,
             CASE {REJECTED} WHEN 'empty' THEN ' ' WHEN 'not an object' THEN '[{{"log_id":' || left(CAST(min(CAST(log_id AS STRING)) AS STRING), 1)
              ELSE '{{"log_id":' || left(min(CAST(log_id AS STRING) || ','), 2) END AS starts
            FROM logs WHERE {REJECTED} IS NOT NULL GROUP BY {REJECTED}""",
        "token_rules_per_log": _with(LOGS, VIOL) + "SELECT * FROM viol",
        "token_violation_window": _with(LOGS, VIOL, USERW) + "SELECT target_id, window_start, violation_score, "
            "triggered_rules, samples FROM uw",
        "legacy_rule_alerts": _with(LOGS, HITS) + "SELECT log_id, rule, severity, rfc, mitre, reason, evidence FROM hits",
        "legacy_rule_alerts_as_of": _with(LOGS, _hits(str(TRUST_AS_OF))) + "SELECT rule, severity, count(*) AS alerts "
            "FROM hits GROUP BY ALL",
        "rule_residual": _with(LOGS, HITS, RESIDUAL) + "SELECT log_id, user_id, uri, status FROM residual",
        "rule_summary": _with(LOGS, HITS, RESIDUAL, CLUSTERS) + """SELECT (SELECT count(*) FROM logs) AS total_logs,
            (SELECT count(DISTINCT log_id) FROM hits) AS rule_matched,
            (SELECT count(*) FROM residual) AS passed_to_review, (SELECT count(*) FROM clusters) AS global_alerts""",
        "subnet_cluster": _with(LOGS, CLUSTERS) + "SELECT subnet, ip_count, last_epoch, "
            "array_to_string(sample_ips, ',') AS sample_ips FROM clusters",
        "global_rule_alerts": _with(LOGS, _global("CAST(NULL AS BIGINT)")) + f"""SELECT receive_epoch, win, rule, severity, reason,
            CAST(NULL AS STRING) AS rfc, mitre, CAST(NULL AS STRING) AS cve, {SAMPLED} AS evidence FROM found""",
        "global_rule_summary": _with(LOGS, HITS, RESIDUAL, _global("CAST(NULL AS BIGINT)")) + """SELECT (SELECT count(*) FROM logs) AS total_logs,
            (SELECT count(DISTINCT log_id) FROM hits) AS rule_matched,
            (SELECT count(*) FROM residual) AS passed_to_review, (SELECT count(*) FROM found) AS global_alerts""",
        "streaming_global_alerts": _with(LOGS, _global("today", f"win + 86400 <= {CLOSED}")) + """SELECT win, receive_epoch, rule, severity, reason,
            head || tail || '}' AS evidence FROM found""",
        "alert_documents": _with(*REVIEW, REQUESTS, VERDICTS, CLUSTERS, RULE_DOCS) + f"""
            SELECT * FROM docs UNION ALL
            SELECT {_iso('receive_epoch')}, receive_epoch, 'llm', 2, rule, severity, user_id, session_id, jwt_id, client_ip,
             method, uri, status, "timestamp", evidence, reason, rfc, mitre, cve FROM verdicts""",
        "recent_alerts": _with(LOGS, HITS, CLUSTERS, RULE_DOCS) + f"""
            SELECT "@timestamp", alert_type, rule, severity, user_id, ip, uri FROM docs
            WHERE alert_epoch >= {DAY_END} - 72 * 3600 AND severity = 'high'
            ORDER BY alert_epoch DESC, rule, user_id NULLS LAST, ip NULLS LAST, uri NULLS LAST, evidence LIMIT 100""",
        "user_events_5min": _with(LOGS, VIOL, USERW) + f"""
            SELECT window_start AS "@timestamp", 'user' AS target_type, target_id, win, window_start, window_size,
             request_count, success_count, error_count, {_r('error_count / request_count', 4)} AS error_rate,
             unique_uris_count, suspicious_uri_count, ip_count, jti_count, response_bytes_total, {_r('response_bytes_total / request_count', 1)} AS response_bytes_avg,
             response_bytes_max, class_crossings, country_crossings, violation_score, triggered_rules,
             violation_samples, is_baseline_eligible FROM uw""",
        "user_windows": _with(LOGS, VIOL, USERW) + """
            SELECT target_id, win, window_start, window_size, request_count, success_count, error_count,
             suspicious_uri_count, response_bytes_total, response_bytes_max, is_baseline_eligible, jti_count,
             class_crossings, country_crossings, violation_score, triggered_rules FROM uw""",
        "token_replay": _with(LOGS, VIOL, USERW) + """
            SELECT DISTINCT user_id, win, jti, CASE WHEN cc THEN 'ip_class' ELSE 'ip_country' END AS crossing_type, kind, member
            FROM tok JOIN (
             SELECT user_id, win, jwt_id AS jti, 'ip_set' AS kind, client_ip AS member FROM ul UNION ALL
             SELECT user_id, win, jwt_id, 'ip_class_set', ip_class FROM ul UNION ALL
             SELECT user_id, win, jwt_id, 'ip_country_set', ip_country FROM ul) USING (user_id, win, jti)
            WHERE (cc OR co) AND member IS NOT NULL""",
        "ip_events_multi": _with(LOGS, IPW) + """
            SELECT window_start AS "@timestamp", 'ip' AS target_type, * EXCLUDE (sub_set, request_methods, ua_set) FROM ipw""",
        "user_windows_without_log_id": _with(LOGS, VIOL, USERW) + """
            SELECT target_id, win, request_count, success_count, error_count, suspicious_uri_count, response_bytes_total,
             jti_count, class_crossings, country_crossings, violation_score, triggered_rules FROM uw""",
        "ip_windows": _with(LOGS, IPW) + "SELECT * EXCLUDE (sub_set, request_methods, ua_set) FROM ipw",
        "user_event_members": _with(LOGS) + """, l AS (
            SELECT *, receive_epoch - receive_epoch % 300 AS win FROM logs WHERE user_id IS NOT NULL)
            SELECT DISTINCT user_id, win, kind, member FROM (
             SELECT user_id, win, 'ip_set' AS kind, client_ip AS member FROM l UNION ALL
             SELECT user_id, win, 'jti_set', jwt_id FROM l UNION ALL SELECT user_id, win, 'alg_set', alg FROM l UNION ALL
             SELECT user_id, win, 'kid_set', kid FROM l) WHERE member IS NOT NULL""",
        "ip_event_members": _with(LOGS, IPW) + """
            SELECT DISTINCT client_ip, window_size, win, kind, member FROM (
             SELECT client_ip, window_size, win, 'sub_set' AS kind, user_id AS member FROM il UNION ALL
             SELECT client_ip, window_size, win, 'request_methods', method FROM il UNION ALL
             SELECT client_ip, window_size, win, 'ua_set', user_agent FROM il) WHERE member IS NOT NULL""",
        "baseline_distributions": _with(LOGS, VIOL, USERW, IPW, _base()) + f"SELECT {BASE_COLUMNS} FROM base",
        "baseline_excluding_high_risk": _with(
            *BARE_RISK, "hot AS (SELECT DISTINCT target_id FROM risk WHERE total_score >= 70)",
            _base("base2", "hot")) + f"SELECT {BASE_COLUMNS} FROM base2",
        "baseline_of_days": _with(LOGS, VIOL, USERW, IPW, _base(days=BASE_DAYS)) + f"SELECT {BASE_COLUMNS} FROM base",
        "baseline_of_days_excluding": _with(
            *BARE_RISK, "hot AS (SELECT DISTINCT target_id FROM risk WHERE total_score >= 70)",
            _base("base2", "hot", BASE_DAYS)) + f"SELECT {BASE_COLUMNS} FROM base2",
        "factor_scores": _with(*ALL_RISK) + """SELECT target_type, target_id, window_start, window_size, token_violation,
            request_burst, token_replay, response_size_burst, ip_user_diversity, response_sensitivity, cumulative_exfil
            FROM risk""",
        "ip_diversity_meta": _with(*BARE_RISK) + f"""
            SELECT target_id, window_start, window_size, raw_score, ip_class = 'cgnat_kr' AND raw_score > 30 AS capped,
             CASE WHEN ip_class = 'cgnat_kr' AND raw_score > 30 THEN 'ip_class=cgnat_kr whitelist soft cap' END AS cap_reason,
             unique_subs_count AS unique_subs_raw, {_r('z', 3)} AS zscore, baseline_mean, baseline_std,
             baseline_sample_count, z IS NULL AS cold_start_fallback_applied FROM risk_raw""",
        "risk_scores": _with(*ALL_RISK) + """
            SELECT window_start AS "@timestamp", target_type, target_id, window_start, window_size, total_score,
             dominant_factor, token_violation, request_burst, token_replay, response_size_burst, ip_user_diversity,
             response_sensitivity, cumulative_exfil, attacker_level, data_exfiltration_detected, suspected_exfiltration,
             triggered_rules, class_crossings, ip_class, ip_asn, ip_org, ip_country, is_nat_whitelisted FROM risk""",
        "risk_scores_with_feedback": _with(
            *BARE_RISK, "hot AS (SELECT DISTINCT target_id FROM risk WHERE total_score >= 70)",
            _base("base2", "hot"), _risk("risk2", "base2", pii=False)) + """
            SELECT target_type, target_id, window_start, window_size, total_score, dominant_factor, attacker_level
            FROM risk2""",
        "attacker_levels": _with(*ALL_RISK) + """SELECT target_type, window_size, attacker_level, count(*) AS windows,
            max(total_score) AS max_score, count(*) FILTER (suspected_exfiltration) AS suspected FROM risk GROUP BY ALL""",
        "risk_summary": _with(*ALL_RISK) + """SELECT count(*) AS total_docs, count(*) FILTER (total_score >= 50) AS alert_count,
            max(total_score) AS max_score, count(*) FILTER (data_exfiltration_detected) AS exfil_flagged FROM risk""",
        "dominant_histogram": _with(*ALL_RISK) + """SELECT coalesce(dominant_factor, 'none') AS dominant_factor,
            count(*) AS alerts, CASE dominant_factor WHEN 'token_violation' THEN '토큰규격위반'
             WHEN 'request_burst' THEN '요청수급증' WHEN 'token_replay' THEN '토큰재현(Replay)'
             WHEN 'response_size_burst' THEN '응답크기급증' WHEN 'ip_user_diversity' THEN 'IP-사용자다양성'
             WHEN 'response_sensitivity' THEN '응답민감도' WHEN 'cumulative_exfil' THEN '누적유출량' END AS label
            FROM risk WHERE total_score >= 50 GROUP BY ALL""",
        "alerts_above_p99": _with(*BARE_RISK) + """, p AS (SELECT list_sort(list(total_score)) AS s, count(*) AS n FROM risk)
            SELECT target_type, target_id, window_start, window_size, total_score FROM risk, p
            WHERE total_score >= greatest(50, s[1 + least(n - 1, CAST(floor(0.99::DOUBLE * n) AS BIGINT))])""",
        "pii_sensitivity": _with(PII) + f"SELECT *, {SENSITIVITY} AS response_sensitivity FROM pii",
        "review_candidates": _with(*REVIEW) + "SELECT * FROM cand",
        "review_requests": _with(*REVIEW, REQUESTS) + f"""
            SELECT user_id, review_win, request_count, reason, log_lines, log_id AS first_log,
             'Access log of user ' || user_id || ', ' || request_count || ' requests:' || chr(10) || chr(10) || log_lines
             || chr(10) || chr(10) || '{instructions}' AS prompt FROM req""",
        "review_verdicts": _with(*REVIEW, REQUESTS, VERDICTS) + "SELECT user_id, review_win, log_id, uri, rule, severity, "
            "reason, rfc, mitre, cve, evidence FROM verdicts",
        "profile_totals": _with(LOGS, PROFILE) + """
            SELECT user_id, first_seen, last_seen, total_active_days, requests_total, success_total, error_total,
             error_ratio, response_bytes_total, response_bytes_max, response_bytes_avg, s2xx, s3xx, s4xx, s5xx,
             data_points_count, requests_per_window_mean, requests_per_window_max, first_auth, last_auth FROM prof""",
        "profile_hours": _with(LOGS, PROFILE) + f""", h AS (
            SELECT user_id, hours, len(hours) AS n,
             list_sum(list_transform(hours, lambda x: sin(x::DOUBLE * 2 * pi() / 24))) / len(hours) AS s,
             list_sum(list_transform(hours, lambda x: cos(x::DOUBLE * 2 * pi() / 24))) / len(hours) AS c FROM pt),
            q AS (SELECT *, sqrt(s * s + c * c) AS r, atan2(s, c) * 24 / (2 * pi()) AS a FROM h),
            z AS (SELECT *, {SPREAD} FROM q)
            SELECT user_id, array_to_string(hours, ',') AS active_hours, n AS active_hour_count,
             {_r('hour', 3)} AS circular_mean_hour, {_r('spread', 3)} AS circular_stdev_hour FROM z""",
        "profile_endpoints": _with(LOGS, PROFILE) + "SELECT * FROM pe WHERE rank <= 30",
        "profile_ips": _with(LOGS, PROFILE) + "SELECT * FROM pi WHERE rank <= 20",
        "profile_location": _with(LOGS, PROFILE) + f"""
            SELECT user_id, least(count(*), 20) AS known_ip_count, {_set('ip_country')} AS known_countries,
             {_set('ip_asn')} AS known_asns, {_set('ip_class')} AS known_ip_classes,
             arg_min(client_ip, rank) AS primary_ip FROM pi GROUP BY user_id""",
        "profile_tokens": _with(LOGS, PROFILE) + "SELECT * FROM ptok",
        "profile_claims": _with(LOGS, PROFILE) + "SELECT * FROM pclaims",
        "profile_alerts": _with(*ALL_RISK, HISTORY) + """
            SELECT * EXCLUDE (lv), CASE lv WHEN 4 THEN 'L4' WHEN 3 THEN 'L4(Slow & Low)' WHEN 2 THEN 'L2' ELSE 'L0'
              END AS max_attacker_level_seen,
             CASE WHEN max_score_seen >= 80 THEN 'critical' ELSE 'high' END AS max_severity_seen FROM hist""",
        "alert_recording": _with(*ALL_RISK) + """
            SELECT count(*) FILTER (target_type = 'user' AND total_score >= 50) AS recorded,
             count(*) FILTER (target_type <> 'user' OR total_score < 50) AS skipped FROM risk""",
        "trust_levels": _with(*BARE_RISK, HISTORY) + f""", seen AS (
            SELECT user_id, min(receive_epoch) AS first_seen FROM logs WHERE user_id IS NOT NULL GROUP BY ALL)
            SELECT user_id, first_seen, coalesce(total_alerts, 0) AS total_alerts,
             CASE WHEN total_alerts > 0 THEN 'suspicious' WHEN first_seen IS NULL THEN 'new'
              WHEN {TRUST_AS_OF} - first_seen < 7 * 86400 THEN 'new'
              WHEN {TRUST_AS_OF} - first_seen < 14 * 86400 THEN 'learning' ELSE 'established' END AS trust_level
            FROM seen FULL JOIN hist USING (user_id)""",
        "profile_merge": _with(LOGS, PROFILE) + f"""
            SELECT user_id, prof.first_seen, prof.last_seen, total_active_days, requests_total, error_ratio,
             response_bytes_avg, requests_per_window_max, array_to_string(hours, ',') AS active_hours,
             (SELECT count(*) FROM pe WHERE pe.user_id = prof.user_id AND rank <= 30) AS unique_uri_count,
             (SELECT path FROM pe WHERE pe.user_id = prof.user_id AND rank = 1) AS top_path, known_jtis, client_id,
             (SELECT count(*) FROM pi WHERE pi.user_id = prof.user_id AND rank <= 20) AS known_ip_count,
             (SELECT client_ip FROM pi WHERE pi.user_id = prof.user_id AND rank = 1) AS primary_ip,
             CASE WHEN {DAY_END} - prof.first_seen < 7 * 86400 THEN 'new'
              WHEN {DAY_END} - prof.first_seen < 14 * 86400 THEN 'learning' ELSE 'established' END AS trust_level,
             data_points_count FROM prof JOIN ptok USING (user_id) JOIN pclaims USING (user_id)""",
        "profile_upsert_counts": _with(LOGS) + f""", a AS (
            SELECT DISTINCT user_id FROM logs WHERE user_id <> '' AND receive_epoch < {SPLIT}),
            b AS (SELECT DISTINCT user_id, receive_epoch // 300 AS w FROM logs WHERE user_id <> '' AND receive_epoch >= {SPLIT})
            SELECT count(DISTINCT user_id) FILTER (user_id NOT IN (SELECT user_id FROM a)) AS created, count(*) AS updated,
             (SELECT count(DISTINCT receive_epoch // 300) FROM logs WHERE user_id = '' AND receive_epoch >= {SPLIT}) AS failed
            FROM b""",
        "streaming_user_events": _with(LOGS, VIOL, USERW) + f"""
            SELECT target_id, win, window_start, window_size, request_count, success_count, error_count,
             suspicious_uri_count, response_bytes_total, response_bytes_max, is_baseline_eligible, jti_count,
             class_crossings, country_crossings, violation_score, triggered_rules FROM uw
            WHERE win + 300 <= {CLOSED}""",
        "streaming_ip_events": _with(LOGS, IPW) + f"""
            SELECT target_id, win, window_start, window_size, request_count, error_count, suspicious_uri_count,
             unique_subs_count, response_bytes_total, ip_class, ip_asn, ip_org, ip_country, is_nat_whitelisted,
             is_baseline_eligible FROM ipw WHERE window_size = '1h' AND win + 3600 <= {CLOSED}""",
        "streaming_risk_scores": _with(*BARE_RISK) + f"""
            SELECT target_type, target_id, win, window_size, total_score, dominant_factor, attacker_level FROM risk
            WHERE win + CASE window_size WHEN '5min' THEN 300 WHEN '1h' THEN 3600 ELSE 86400 END <= {CLOSED}""",
        "streaming_dedup": _with(LOGS) + "SELECT log_id, user_id, uri, receive_epoch FROM logs",
        "streaming_rule_alerts": _with(LOGS, HITS) + "SELECT log_id, rule, severity, reason FROM hits",
        "streaming_subnet_clusters": _with(LOGS) + f""", s AS (
            SELECT receive_epoch - receive_epoch % 86400 AS win, regexp_replace(client_ip, '\\.[^.]*$', '.0/24') AS subnet,
             count(DISTINCT client_ip) AS ip_count FROM logs GROUP BY ALL)
            SELECT * FROM s WHERE ip_count >= 5 AND win + 86400 <= {CLOSED}""",
        "filed_events": _with(LOGS, VIOL, USERW, IPW) + """
            SELECT 'user-run' AS run, '2024-02-02' AS ingest_date, window_size, count(*) AS windows, count(DISTINCT target_id) AS targets,
             CAST(sum(request_count) AS BIGINT) AS requests FROM uw GROUP BY window_size UNION ALL
            SELECT 'ip-run', '2024-02-02', window_size, count(*), count(DISTINCT target_id), CAST(sum(request_count) AS BIGINT)
            FROM ipw GROUP BY window_size""",
        "filed_risk": _with(*ALL_RISK) + """SELECT target_type, target_id, win, window_size, total_score, dominant_factor, attacker_level,
            target_id IN (SELECT target_id FROM risk WHERE total_score >= 70) AS excluded_next FROM risk""",
        "filed_alerts": _with(*REVIEW, REQUESTS, VERDICTS, CLUSTERS, RULE_DOCS) + """
            SELECT 'rules' AS run, alert_type, layer, rule, severity, user_id, ip, uri, alert_epoch, evidence, reason FROM docs UNION ALL
            SELECT 'verdicts', 'llm', 2, rule, severity, user_id, client_ip, uri, receive_epoch, evidence, reason FROM verdicts""",
        "profile_store": _with(LOGS, PROFILE) + f"SELECT {PROFILE_COLUMNS} FROM {PROFILE_TABLES}",
        "profile_lookup": _with(LOGS, PROFILE) + f"""SELECT {PROFILE_COLUMNS}, true AS known, false AS stranger FROM {PROFILE_TABLES}
            WHERE prof.user_id = '{SOME_USER}'""",
        "streamed_risk": _with(*ALL_RISK) + """SELECT target_type, target_id, win, window_size, total_score, dominant_factor, attacker_level,
            data_exfiltration_detected, triggered_rules, ip_class, ip_country FROM risk""",
        "streamed_profiles": _with(*ALL_RISK, HISTORY, PROFILE) + f"""SELECT {PROFILE_COLUMNS}, coalesce(total_alerts, 0) AS total_alerts,
            last_alert_epoch, last_alert_dominant_factor, last_alert_rule, max_score_seen,
            CASE lv WHEN 4 THEN 'L4' WHEN 3 THEN 'L4(Slow & Low)' WHEN 2 THEN 'L2' WHEN 1 THEN 'L0' END AS max_attacker_level_seen,
            coalesce(data_exfiltration_ever, false) AS data_exfiltration_ever, coalesce(alerts_last_7d, 0) AS alerts_last_7d,
            CASE WHEN total_alerts > 0 THEN 'suspicious' WHEN {DAY_END} - prof.first_seen < 7 * 86400 THEN 'new'
             WHEN {DAY_END} - prof.first_seen < 14 * 86400 THEN 'learning' ELSE 'established' END AS trust_level
            FROM {PROFILE_TABLES} LEFT JOIN hist USING (user_id)""",
        "streamed_late": _with(LOGS) + f"""
            SELECT strftime(make_timestamp(receive_epoch * 1000000), '%Y-%m-%d') AS day, count(*) AS logs, count(DISTINCT user_id) AS users,
             max((SELECT max(receive_epoch) - 60 FROM logs WHERE NOT {LATE}) - receive_epoch) AS most_seconds_late
            FROM logs WHERE {LATE} GROUP BY 1""",
    }
