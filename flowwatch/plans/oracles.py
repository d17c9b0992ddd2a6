"""The registered queries as plain SQL over the same tables, for checking results."""

from __future__ import annotations

from flowwatch.operators.signatures import PORT_SCAN, SENSITIVE_PORT
from flowwatch.schemas import FEATURES
from flowwatch.sources.fixtures import FIXED_OFFSET

AS_OF = "TIMESTAMP '2024-01-31 12:34:56'"

_EV = """ev AS (
  SELECT event_id, ts, date_trunc('second', ts) AS sec, user_id, event_type, value, props,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         CASE WHEN user_id % 8 < 3 THEN '10.0.0.' || (user_id % 8 + 2) ELSE '203.0.113.' || (user_id % 8) END AS src_ip,
         CASE WHEN user_id % 8 < 3 THEN '203.0.113.' || (event_id % 5) ELSE '10.0.0.' || (event_id % 3 + 2) END AS dest_ip,
         CASE CAST(json_extract_string(props, '$.k') AS INTEGER) WHEN 0 THEN 22 WHEN 1 THEN 23 WHEN 2 THEN 2323
              WHEN 3 THEN 3389 WHEN 4 THEN 5900 ELSE 1000 + CAST(json_extract_string(props, '$.k') AS INTEGER) END AS dport
  FROM events)"""

_PACKETS = (
    _EV
    + """, packets AS (
  SELECT event_id AS seq, 'cap0' AS sensor_id, (epoch_us(ts) - 1704067200000000) // 1000 AS ts_us,
         src_ip, dest_ip, CASE WHEN event_id % 3 = 0 THEN 17 ELSE 6 END AS protocol,
         CAST(60 + floor(value * 4) AS INTEGER) AS packet_size,
         CAST(40000 + (event_id * 7919) % 25536 AS INTEGER) AS sport, dport
  FROM ev)"""
)

_FEATURES = (
    _PACKETS
    + """, feat AS (
  SELECT *, coalesce((ts_us - lag(ts_us) OVER (ORDER BY ts_us, seq)) / 1e6, 0.0) AS time_diff,
         ln(1.0 + packet_size) AS packet_size_log,
         CASE WHEN sport >= 49152 THEN 1.0::DOUBLE ELSE 0.0 END AS is_ephemeral_sport,
         CASE WHEN src_ip IN ('10.0.0.2', '10.0.0.3', '10.0.0.4') THEN 1.0::DOUBLE ELSE 0.0 END AS direction,
         CAST(count(DISTINCT dport) OVER (PARTITION BY src_ip ORDER BY ts_us
              RANGE BETWEEN 15000000 PRECEDING AND CURRENT ROW) AS DOUBLE) AS unique_dports_15s
  FROM packets)"""
)

_HITS = (
    _FEATURES
    + f""", hits AS (
  SELECT *, '{PORT_SCAN[0]}' AS rule, '{PORT_SCAN[1]}' AS rule_severity, '{PORT_SCAN[2]}' AS description
  FROM feat WHERE unique_dports_15s >= 10
  UNION ALL
  SELECT *, '{SENSITIVE_PORT[0]}', '{SENSITIVE_PORT[1]}', '{SENSITIVE_PORT[2]}'
  FROM feat WHERE direction = 0 AND dport IN (22, 23, 2323, 3389, 5900))"""
)

_ALERTS = """alerts AS (
  SELECT 'a' || event_id AS id, sec AS ts, src_ip,
         CASE WHEN event_type = 'error' THEN dest_ip || ':' || dport || printf(' score=%.3f', -k / 500.0)
              ELSE CASE WHEN k < 5 THEN 'inbound-sensitive-port' ELSE 'port-scan-suspected' END
                   || ' ' || dest_ip || ':' || dport END AS label,
         CASE WHEN event_type = 'error' THEN CASE WHEN k >= 50 THEN 'HIGH' WHEN k >= 25 THEN 'MEDIUM' ELSE 'LOW' END
              WHEN k < 5 THEN 'MEDIUM' ELSE 'HIGH' END AS severity,
         CASE WHEN event_type = 'error' THEN 'ANOMALY' ELSE 'SIGNATURE' END AS kind
  FROM ev WHERE event_type IN ('error', 'view'))"""

_BLOCKS = """blocks AS (
  SELECT 'b' || event_id AS id, sec AS ts, src_ip AS ip,
         CASE WHEN event_type = 'purchase' THEN 'block' ELSE 'unblock' END AS action,
         CASE WHEN event_type = 'purchase' AND k % 2 = 0 THEN 'auto-high' ELSE 'manual' END AS reason,
         CASE WHEN event_type = 'purchase' AND k % 2 = 1 THEN sec + to_minutes(k) END AS expires_at
  FROM ev WHERE event_type IN ('purchase', 'signup'))"""

_USER_BLOCKS = _BLOCKS.replace("src_ip AS ip", "'198.18.' || (user_id // 256) || '.' || (user_id % 256) AS ip")

_TRUSTED = """trusted AS (
  SELECT src_ip AS ip, CASE WHEN src_ip = '10.0.0.2' THEN 'gateway' ELSE 'partner' END AS note, min(sec) AS created_ts
  FROM ev WHERE src_ip IN ('10.0.0.2', '203.0.113.3') GROUP BY src_ip)"""

_LOGS = (
    f"{_EV}, {_ALERTS}, {_BLOCKS}"
    + """, logs AS (
  SELECT id, ts, src_ip AS ip, 'alert' AS type, label, severity, kind FROM alerts
  UNION ALL
  SELECT id, ts, ip, 'block', action, NULL, 'block' FROM blocks)"""
)

_COMMANDS = """commands AS (
  SELECT event_id AS seq, sec AS ts,
         trim(CASE WHEN event_id % 97 = 0 THEN ' ' WHEN event_id % 89 = 0 THEN src_ip || '.9' ELSE src_ip END) AS ip,
         CASE event_type WHEN 'purchase' THEN 'block' WHEN 'signup' THEN 'unblock' WHEN 'view' THEN 'trust'
              ELSE 'untrust' END AS command,
         CASE WHEN k % 2 = 1 THEN k * 10 END AS minutes,
         CASE WHEN k % 3 = 0 THEN '' ELSE 'r' || k END AS reason
  FROM ev WHERE event_type <> 'click')"""

_NAMES = """names AS (
  SELECT src_ip AS ip, max_by('host-' || k, event_id) AS name
  FROM ev WHERE event_type = 'signup' AND k % 2 = 0 GROUP BY src_ip)"""


def _inventory(name: str, where: str = "true", named: bool = True) -> str:
    seen = f"""(SELECT src_ip AS ip, ts_us FROM packets WHERE {where}
      UNION ALL SELECT dest_ip, ts_us FROM packets WHERE {where})"""
    label = "coalesce(n.name, '')" if named else "''"
    join = "LEFT JOIN names n USING (ip)" if named else ""
    return f"""{name} AS (
  SELECT d.ip, d.first_seen, d.last_seen, {label} AS name
  FROM (SELECT ip, min(ts_us) AS first_seen, max(ts_us) AS last_seen FROM {seen} GROUP BY ip) d {join})"""


def _iso(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%dT%H:%M:%SZ')"


def _path(n: int) -> str:
    """Depth credit of a leaf holding n rows."""
    if n <= 1:
        return "0.0"
    if n == 2:
        return "1.0"
    return f"(2.0 * (ln({n} - 1.0) + 0.5772156649015329) - 2.0 * ({n} - 1.0) / {n})"


_SCORED = (
    _FEATURES
    + f""", paths AS (
  SELECT *,
    CASE WHEN unique_dports_15s <= 8.5 THEN CASE WHEN packet_size_log <= 5.0 THEN 2 + {_path(150)} ELSE 2 + {_path(86)} END
         ELSE 1 + {_path(2)} END
    + CASE WHEN dport <= 1000.5 THEN 1 + {_path(1)}
           WHEN time_diff <= 0.5 THEN 2 + {_path(200)} ELSE 2 + {_path(55)} END
    + CASE WHEN packet_size_log <= 6.0 THEN CASE WHEN direction <= 0.5 THEN 2 + {_path(120)} ELSE 2 + {_path(100)} END
           ELSE 1 + {_path(36)} END AS total
  FROM feat), scored AS (
  SELECT *, -pow(2.0, -total / 3 / {_path(256)}) - ({FIXED_OFFSET}) AS score FROM paths), anomalies AS (
  SELECT *, CASE WHEN score <= -0.10 THEN 'high' WHEN score <= -0.05 THEN 'medium' ELSE 'low' END AS severity
  FROM scored WHERE score < 0)"""
)

_ANOMALY_LINE = """printf('ANOMALY: ts=%.6f %s -> %s proto=%d size=%d dport=%d eph_sport=%d unique_dports_15s=%d direction=%s score=%.3f severity=%s',
  ts_us / 1e6, src_ip, dest_ip, protocol, packet_size, dport, CAST(is_ephemeral_sport AS INTEGER),
  CAST(unique_dports_15s AS INTEGER), CASE WHEN direction = 1 THEN 'out' ELSE 'in' END, score, severity)"""
_SIGNATURE_LINE = """printf('SIGNATURE: %s severity=%s | %s -> %s dport=%d desc="%s"',
  rule, rule_severity, src_ip, dest_ip, dport, description)"""

_RAW = f"""{_PACKETS}, raw AS (
  SELECT p.*, e.event_type, e.event_type IN ('error', 'purchase') AS tcp, e.event_type = 'click' AS udp
  FROM packets p JOIN ev e ON p.seq = e.event_id)"""

_TEXTS = f"""{_EV}, texts AS (
  SELECT event_id AS seq, k, event_id % 10 AS d, value,
    CASE k % 9 WHEN 0 THEN 'nan' WHEN 1 THEN 'not-a-number' WHEN 2 THEN ' ' || k || '.' || (event_id % 10) || ' '
         WHEN 3 THEN '-' || k || '.' || (event_id % 10) WHEN 4 THEN k || 'e2' WHEN 5 THEN ''
         ELSE k || '.' || (event_id % 10) END AS text
  FROM ev)"""

_FEED = """
  SELECT id, ts, src_ip AS ip, 'alert' AS type,
         CASE WHEN kind = 'ANOMALY' THEN regexp_extract(label, '^(.*) score=', 1) ELSE label END AS detail, severity,
         CASE WHEN kind = 'ANOMALY' THEN CAST(regexp_extract(label, 'score=(.*)$', 1) AS DOUBLE) END AS score
  FROM alerts
  UNION ALL
  SELECT id, ts, ip, action, action, '', NULL FROM blocks"""

_ADDR = f"""{_EV}, addr AS (
  SELECT event_id AS seq, k * 3 AS a, user_id % 300 AS b, event_id % 256 AS c, k AS d,
         (k * 3) || '.' || (user_id % 300) || '.' || (event_id % 256) || '.' || k AS ip FROM ev)"""

_LOGINS = """attempts AS (
  SELECT CAST(user_id AS VARCHAR) AS username, event_id AS seq, epoch(sec)::BIGINT AS t, event_type = 'signup' AS ok,
         row_number() OVER (PARTITION BY user_id ORDER BY sec, event_id) AS rn
  FROM ev WHERE event_type IN ('error', 'signup')), fold AS (
  SELECT username, 0::BIGINT AS rn, 0::BIGINT AS seq, false AS ok, 0 AS before, 0 AS fails, 0::BIGINT AS until, '' AS verdict
  FROM (SELECT DISTINCT username FROM attempts)
  UNION ALL
  SELECT a.username, a.rn, a.seq, a.ok, f.fails,
    CASE WHEN f.until > a.t THEN f.fails WHEN a.ok THEN 0 WHEN f.fails + 1 >= 5 THEN 0 ELSE f.fails + 1 END,
    CASE WHEN f.until > a.t THEN f.until WHEN a.ok THEN 0 WHEN f.fails + 1 >= 5 THEN a.t + 259200 ELSE f.until END,
    CASE WHEN f.until > a.t THEN 'locked' WHEN a.ok THEN 'ok' ELSE 'invalid' END
  FROM fold f JOIN attempts a ON a.username = f.username AND a.rn = f.rn + 1)"""

_CONTAIN = """valid AS (
  SELECT *, row_number() OVER (PARTITION BY ip ORDER BY ts, seq) AS rn FROM commands
  WHERE ip <> '' AND NOT (command = 'trust' AND len(string_split(ip, '.')) <> 4)), fold AS (
  SELECT ip, 0::BIGINT AS rn, 0::BIGINT AS seq, '' AS command, 'none' AS state, NULL::TIMESTAMP AS until, '' AS verdict
  FROM (SELECT DISTINCT ip FROM valid)
  UNION ALL
  SELECT ip, rn, seq, command,
    CASE command WHEN 'block' THEN CASE WHEN st = 'trusted' THEN st ELSE 'blocked' END
                 WHEN 'unblock' THEN CASE WHEN st = 'blocked' THEN 'none' ELSE st END
                 WHEN 'trust' THEN CASE WHEN st = 'blocked' THEN st ELSE 'trusted' END
                 ELSE CASE WHEN st = 'trusted' THEN 'none' ELSE st END END,
    CASE WHEN command = 'block' AND st <> 'trusted' THEN ts + to_minutes(minutes)
         WHEN st = 'blocked' AND command <> 'unblock' THEN until END,
    CASE WHEN command = 'block' AND st = 'trusted' THEN 'trusted_ip'
         WHEN command = 'trust' AND st = 'blocked' THEN 'ip_blocked' ELSE 'ok' END
  FROM (SELECT v.ip, v.rn, v.seq, v.command, v.ts, v.minutes, f.until,
               CASE WHEN f.state = 'blocked' AND f.until < v.ts THEN 'none' ELSE f.state END AS st
        FROM fold f JOIN valid v ON v.ip = f.ip AND v.rn = f.rn + 1))"""

_DEDUP = """per_second AS (
  SELECT rule, src_ip, dest_ip, ts_us // 1000000 AS second, min_by(seq, (ts_us, seq)) AS seq
  FROM hits GROUP BY ALL), linked AS (
  SELECT p.*, (SELECT min(q.second) FROM per_second q
               WHERE q.rule = p.rule AND q.src_ip = p.src_ip AND q.dest_ip = p.dest_ip AND q.second >= p.second + 5) AS following,
         row_number() OVER (PARTITION BY rule, src_ip, dest_ip ORDER BY second) AS rn
  FROM per_second p), chain AS (
  SELECT rule, src_ip, dest_ip, second, seq, following FROM linked WHERE rn = 1
  UNION ALL
  SELECT l.rule, l.src_ip, l.dest_ip, l.second, l.seq, l.following
  FROM chain c JOIN linked l ON l.rule = c.rule AND l.src_ip = c.src_ip AND l.dest_ip = c.dest_ip
       AND l.second = c.following)"""

_FEATURE_LIST = ", ".join(f"round(CAST({n} AS DOUBLE), 9) AS {n}" for n in FEATURES)
_VECTOR = " || ',' || ".join(f"printf('%.6f', CAST({n} AS DOUBLE))" for n in FEATURES)
_SCALER = " UNION ALL ".join(
    f"SELECT {i} AS feature_idx, '{n}' AS name, round(avg({n}), 6) AS mean, "
    f"round(CASE WHEN stddev_pop({n}) = 0 THEN 1.0 ELSE stddev_pop({n}) END, 6) AS scale FROM feat"
    for i, n in enumerate(FEATURES)
)
_SCALED = ", ".join(
    f"round(({n} - avg({n}) OVER ()) / CASE WHEN stddev_pop({n}) OVER () = 0 THEN 1.0 "
    f"ELSE stddev_pop({n}) OVER () END, 6) AS {n}"
    for n in FEATURES
)

SQL: dict[str, str] = {
    "packets_view": f"WITH {_PACKETS} SELECT * FROM packets",
    "normalize_packets": f"""WITH {_RAW}
SELECT seq, sensor_id, ts_us, src_ip, dest_ip, protocol,
  CASE WHEN seq % 11 = 0 OR seq % 13 = 0 THEN 0 ELSE packet_size END AS packet_size,
  CASE WHEN tcp THEN sport WHEN udp THEN sport + 1 ELSE 0 END AS sport,
  CASE WHEN tcp THEN dport WHEN udp THEN dport + 1 ELSE 0 END AS dport
FROM raw WHERE event_type <> 'view'""",
    "rejected_packets": f"""WITH {_RAW}
SELECT seq, src_ip, dest_ip, CASE WHEN tcp THEN sport WHEN udp THEN sport + 1 ELSE 0 END AS sport,
  CASE WHEN tcp THEN dport WHEN udp THEN dport + 1 ELSE 0 END AS dport
FROM raw WHERE event_type <> 'view' AND seq % 13 = 0 AND seq % 11 <> 0""",
    "rolling_rows": f"""WITH {_FEATURES} SELECT seq, ts_us, round(time_diff, 6) AS time_diff, unique_dports_15s,
  strftime(make_timestamp(ts_us), '%Y-%m-%d') AS event_date FROM feat""",
    "alert_upsert": f"""WITH {_EV}, {_ALERTS}
SELECT id, {_iso("ts")} AS ts, src_ip, label || CASE WHEN severity = 'LOW' THEN '' WHEN kind = 'ANOMALY' THEN ' v2'
  ELSE ' v1' END AS label, severity, kind FROM alerts""",
    "block_upsert": f"""WITH {_EV}, {_BLOCKS}
SELECT id, {_iso("ts")} AS ts, ip, action, reason || CASE WHEN action <> 'block' THEN '' WHEN expires_at IS NULL
  THEN ' v2' ELSE ' v1' END AS reason, {_iso("expires_at")} AS expires_at FROM blocks""",
    "export_csv_rows": f"WITH {_LOGS} SELECT id, {_iso('ts')} AS ts, ip, type, label, severity, kind FROM logs",
    "export_json_rows": f"WITH {_LOGS} SELECT id, {_iso('ts')} AS ts, ip, type, label, severity, kind FROM logs",
    "anomaly_lines": f"WITH {_SCORED} SELECT seq, {_ANOMALY_LINE} AS line FROM anomalies",
    "signature_lines": f"WITH {_HITS} SELECT seq, {_SIGNATURE_LINE} AS line FROM hits",
    "log_levels": f"""WITH {_SCORED}, hits AS (
  SELECT 'high' AS severity, 0 AS a FROM feat WHERE unique_dports_15s >= 10
  UNION ALL SELECT 'medium', 0 FROM feat WHERE direction = 0 AND dport IN (22, 23, 2323, 3389, 5900)
  UNION ALL SELECT severity, 1 FROM anomalies)
SELECT CASE severity WHEN 'high' THEN 'ERROR' WHEN 'medium' THEN 'WARNING' ELSE 'INFO' END AS level,
  count(*) AS n_lines, CAST(sum(a) AS BIGINT) AS n_anomaly FROM hits GROUP BY 1""",
    "feat_size_log": f"WITH {_PACKETS} SELECT seq, round(ln(1.0 + packet_size), 9) AS packet_size_log FROM packets",
    "feat_ephemeral": f"WITH {_FEATURES} SELECT seq, is_ephemeral_sport FROM feat",
    "feat_direction": f"WITH {_FEATURES} SELECT seq, direction FROM feat",
    "feat_direction_by_sensor": f"""WITH {_PACKETS}, own AS (
  SELECT DISTINCT seq % 2 AS s, src_ip FROM packets WHERE protocol = 17 AND src_ip LIKE '10.0.0.%')
SELECT seq, 'cap' || (seq % 2) AS sensor_id, CASE WHEN own.s IS NULL THEN 0.0::DOUBLE ELSE 1.0 END AS direction
FROM packets p LEFT JOIN own ON own.s = p.seq % 2 AND own.src_ip = p.src_ip""",
    "retention_job": f"""WITH {_EV}, {_ALERTS}
SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS event_date, count(*) AS n_rows,
       CAST(ts AS DATE) < CAST({AS_OF} AS DATE) - 7 AS dropped FROM alerts GROUP BY ALL""",
    "feature_vector": f"WITH {_FEATURES} SELECT seq, {_VECTOR} AS features FROM feat",
    "features_per_event": f"WITH {_FEATURES} SELECT seq, {_FEATURE_LIST} FROM feat",
    "features_empty": f"WITH {_FEATURES} SELECT seq, {_FEATURE_LIST} FROM feat WHERE protocol = 1",
    "features_batch_reference": f"""WITH {_FEATURES}, counts AS (
  SELECT src_ip, count(DISTINCT dport) AS n FROM packets
  WHERE ts_us >= (SELECT max(ts_us) - 15000000 FROM packets) GROUP BY src_ip), batch AS (
  SELECT f.* EXCLUDE (unique_dports_15s), coalesce(n, 0) AS unique_dports_15s FROM feat f LEFT JOIN counts USING (src_ip))
SELECT seq, {_FEATURE_LIST} FROM batch""",
    "coerce_int": f"""WITH {_TEXTS}
SELECT seq,
  CASE WHEN k % 9 IN (0, 1, 5) THEN 99 ELSE CAST(trunc(CAST(trim(text) AS DOUBLE)) AS BIGINT) END AS from_text,
  CASE WHEN k % 9 = 0 THEN -3 ELSE CAST(trunc(value - 20) AS BIGINT) END AS from_number,
  CASE WHEN k % 2 = 0 THEN 1::BIGINT ELSE 0 END AS from_flag FROM texts""",
    "coerce_float": f"""WITH {_TEXTS}
SELECT seq, k % 9 = 0 AS is_nan, CASE WHEN k % 9 = 0 THEN 0.0::DOUBLE WHEN k % 9 IN (1, 5) THEN -1.5
  ELSE CAST(trim(text) AS DOUBLE) END AS value FROM texts""",
    "severity_map": f"""WITH {_EV}
SELECT event_id AS seq, CASE WHEN k % 10 IN (7, 8) THEN 'unknown' WHEN (k - 60) / 400.0::DOUBLE <= -0.1::DOUBLE THEN 'high'
  WHEN (k - 60) / 400.0::DOUBLE <= -0.05::DOUBLE THEN 'medium' ELSE 'low' END AS severity FROM ev""",
    "alert_labels": f"""WITH {_PACKETS}
SELECT seq, dest_ip || ':' || dport || printf(' score=%.3f', -(dport % 500) / 500.0) AS anomaly,
  '{PORT_SCAN[0]} ' || dest_ip || ':' || dport AS signature FROM packets""",
    "alert_rows": f"""WITH {_EV}
SELECT md5(event_id || ':' || upper(event_type)) AS id, {_iso("ts")} AS ts, src_ip,
  CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE props END AS label, 'LOW' AS severity, upper(event_type) AS kind
FROM ev""",
    "label_parse": f"""WITH {_EV}, {_ALERTS}
SELECT id, CASE WHEN kind = 'ANOMALY' THEN regexp_extract(label, '^(.*) score=', 1) ELSE label END AS label_text,
  CASE WHEN kind = 'ANOMALY' THEN CAST(regexp_extract(label, 'score=(.*)$', 1) AS DOUBLE) END AS label_score FROM alerts""",
    "normalize_events": f"""WITH {_EV}, {_ALERTS}, {_BLOCKS}, feed AS ({_FEED})
SELECT id, {_iso("ts")} AS ts, ip, type, detail, severity, score FROM feed""",
    "iso_parts": f"""WITH {_EV} SELECT event_id AS seq, {_iso("ts")} AS iso, strftime(ts, '%Y-%m-%d') AS date,
  strftime(ts, '%H:%M') AS hhmm FROM ev""",
    "ban_expiry": f"""WITH {_EV} SELECT event_id AS seq,
  CASE WHEN k % 5 = 4 AND k > 0 THEN {_iso("ts + to_minutes(k)")} END AS expires FROM ev""",
    "port_risk": f"""WITH {_EV}
SELECT user_id, CASE WHEN bool_or(dport IN (23, 445, 3389, 5900, 21)) THEN 'High' ELSE 'Medium' END AS risk
FROM ev GROUP BY user_id""",
    "ip_valid": f"WITH {_ADDR} SELECT seq, ip, a <= 255 AND b <= 255 AS valid FROM addr",
    "ip_class": f"""WITH {_ADDR}
SELECT seq, CASE WHEN a > 255 OR b > 255 THEN 'invalid' WHEN a = 127 THEN 'loopback'
  WHEN a IN (0, 10) OR a >= 240 OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168)
    OR (a = 192 AND b = 0 AND c IN (0, 2) AND NOT (c = 0 AND d IN (9, 10))) OR (a = 198 AND b IN (18, 19))
    OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113) THEN 'private'
  ELSE 'public' END AS ip_class FROM addr""",
    "cidr_hosts": f"""WITH {_EV}, nets AS (
  SELECT DISTINCT dest_ip, 22 + k % 11 AS len FROM ev), num AS (
  SELECT dest_ip || '/' || len AS cidr, len, 1::BIGINT << (32 - len) AS span,
    CAST(split_part(dest_ip, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(dest_ip, '.', 2) AS BIGINT) * 65536
    + CAST(split_part(dest_ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(dest_ip, '.', 4) AS BIGINT) AS n FROM nets
  UNION ALL SELECT DISTINCT '0.0.0.0/0', 0, 1::BIGINT << 32, 0::BIGINT FROM ev WHERE k = 0), lim AS (
  SELECT cidr, n - n % span + CASE WHEN len <= 30 THEN 1 ELSE 0 END AS lo,
    n - n % span + span - 1 - CASE WHEN len <= 30 THEN 1 ELSE 0 END AS hi FROM num), hosts AS (
  SELECT cidr, unnest(generate_series(lo, least(hi, lo + 255))) AS h FROM lim)
SELECT cidr, (h >> 24) || '.' || ((h >> 16) & 255) || '.' || ((h >> 8) & 255) || '.' || (h & 255) AS host FROM hosts
UNION ALL
SELECT '2001:db8::' || lower(to_hex(k)) || '/' || len, '2001:db8::' || CASE WHEN h = 0 THEN '' ELSE lower(to_hex(h)) END FROM (
  SELECT k, len, unnest(generate_series(lo, least(hi, lo + 255))) AS h FROM (
    SELECT k, len, k - k % span + CASE WHEN len < 127 THEN 1 ELSE 0 END AS lo, k - k % span + span - 1 AS hi FROM (
      SELECT DISTINCT k::BIGINT AS k, 118 + k % 11 AS len, 1::BIGINT << (10 - k % 11) AS span FROM ev)))
UNION ALL
SELECT DISTINCT '2001:db8:1::' || lower(to_hex(k)), '2001:db8:1::' || lower(to_hex(k)) FROM ev WHERE k % 5 = 3
UNION ALL
SELECT '::/0', '::' || lower(to_hex(h)) FROM (SELECT unnest(generate_series(1, 256)) AS h) WHERE EXISTS (SELECT 1 FROM ev WHERE k = 1)""",
    "ports_csv": f"""WITH {_PACKETS}, sets AS (
  SELECT src_ip, list_sort(list(DISTINCT dport)) AS p FROM packets GROUP BY src_ip)
SELECT src_ip, array_to_string(p, ',') AS csv, CAST(len(p[1:64]) AS INTEGER) AS n_first,
  array_to_string(p[1:64], ',') AS first FROM sets""",
    "feature_checksum": f"""WITH {_EV}
SELECT event_id AS seq, sha256(event_type || ',' || src_ip || ',' || k) AS checksum FROM ev""",
    "logs_filtered": f"""WITH {_LOGS}
SELECT id, {_iso("ts")} AS ts, ip, type, label, severity, kind FROM (
  SELECT * FROM logs WHERE ip = '203.0.113.5' AND lower(coalesce(severity, '')) = 'high' AND type = 'alert'
    AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-25' ORDER BY ts DESC, id DESC LIMIT 200)""",
    "logs_by_kind": f"""WITH {_LOGS} SELECT id, {_iso("ts")} AS ts, ip, type, label, severity, kind FROM logs
WHERE lower(kind) = 'signature'""",
    "normalized_filtered": f"""WITH {_EV}, {_ALERTS}, {_BLOCKS}, feed AS ({_FEED})
SELECT id, {_iso("ts")} AS ts, ip, type, detail, severity, score FROM feed
WHERE ip = '10.0.0.3' AND type = 'unblock' AND ts >= TIMESTAMP '2024-01-10'""",
    "alerts_page": f"""WITH {_EV}, {_ALERTS} SELECT id, {_iso("ts")} AS ts, src_ip, label, severity, kind FROM (
  SELECT * FROM alerts WHERE ts < TIMESTAMP '2024-01-20' OR (ts = TIMESTAMP '2024-01-20' AND id < 'a5000')
  ORDER BY ts DESC, id DESC LIMIT 50)""",
    "alerts_page_by_time": f"""WITH {_EV}, {_ALERTS} SELECT id, {_iso("ts")} AS ts, src_ip, label, severity, kind FROM (
  SELECT * FROM alerts WHERE ts < TIMESTAMP '2024-01-20' ORDER BY ts DESC, id DESC LIMIT 50)""",
    "rule_port_scan": f"""WITH {_FEATURES}
SELECT seq, '{PORT_SCAN[0]}' AS rule, unique_dports_15s FROM feat WHERE unique_dports_15s >= 10""",
    "rule_sensitive_port": f"""WITH {_FEATURES}
SELECT seq, '{SENSITIVE_PORT[0]}' AS rule, dport FROM feat
WHERE direction = 0 AND dport IN (22, 23, 2323, 3389, 5900)""",
    "signature_hits": f"""WITH {_HITS} SELECT seq, src_ip, dest_ip, dport, rule, rule_severity, description FROM hits
UNION ALL
SELECT seq, src_ip, dest_ip, dport, 'size-by-port', 'low', 'Large for its port.' FROM packets
WHERE packet_size::DOUBLE / nullif(dport % 7, 0) > 50
UNION ALL
SELECT seq, src_ip, dest_ip, dport, 'high-even-port', 'low', 'Even port from 1040 on.' FROM packets WHERE dport % 2 = 0 AND dport >= 1040""",
    "dports_per_src_approx": f"""WITH {_PACKETS}
SELECT src_ip, count(DISTINCT dport) AS unique_dports, true AS within_bound FROM packets GROUP BY src_ip""",
    "device_ensure": f"""WITH {_PACKETS}, {_inventory("known", "protocol = 6", False)}, asked AS (
  SELECT CASE WHEN event_id % 4 = 3 THEN '192.0.2.' || (event_id % 50) ELSE dest_ip END AS ip, event_id % 4 = 1 AS named FROM ev), touched AS (
  SELECT DISTINCT ip FROM asked WHERE NOT named), names AS (SELECT DISTINCT ip, 'host ' || ip AS name FROM asked WHERE named), merged AS (
  SELECT coalesce(k.ip, t.ip) AS ip, least(first_seen, CASE WHEN t.ip IS NOT NULL THEN epoch_us({AS_OF}) END) AS first_seen,
    greatest(last_seen, CASE WHEN t.ip IS NOT NULL THEN epoch_us({AS_OF}) END) AS last_seen, coalesce(name, '') AS name
  FROM known k FULL JOIN touched t ON k.ip = t.ip)
SELECT m.ip, first_seen, last_seen, coalesce(n.name, m.name) AS name FROM merged m LEFT JOIN names n ON m.ip = n.ip""",
    "function_rule": f"""WITH {_FEATURES}
SELECT seq, 'large-inbound' AS rule, packet_size FROM feat
WHERE packet_size > 300 AND direction = 0 AND sport % 499 <> 0""",
    "context_rule": f"""WITH {_PACKETS}, counted AS (
  SELECT seq, sum(CASE WHEN packet_size >= 300 THEN 1 ELSE 0 END) OVER (
    PARTITION BY src_ip ORDER BY ts_us, seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS n FROM packets)
SELECT seq, 'burst-of-large' AS rule, CAST(n AS BIGINT) AS large_of_ten FROM counted WHERE n >= 5""",
    "rules_toggled": f"""WITH {_FEATURES}
SELECT seq, '{PORT_SCAN[0]}' AS rule, 'on' AS setting FROM feat WHERE unique_dports_15s >= 5
UNION ALL SELECT seq, '{SENSITIVE_PORT[0]}', 'on' FROM feat WHERE direction = 0 AND dport IN (23, 1001)""",
    "threshold_texts": f"""WITH {_EV}, s AS (SELECT event_id AS seq, (k - 60) / 400.0::DOUBLE AS s FROM ev)
SELECT seq, CASE WHEN s <= -0.08::DOUBLE THEN 'high' WHEN s <= -0.01::DOUBLE THEN 'medium' ELSE 'low' END AS wide,
  CASE WHEN s <= -0.12::DOUBLE THEN 'high' WHEN s <= -0.02::DOUBLE THEN 'medium' ELSE 'low' END AS spaced,
  CASE WHEN s <= -0.1::DOUBLE THEN 'high' WHEN s <= -0.05::DOUBLE THEN 'medium' ELSE 'low' END AS unreadable FROM s""",
    "conformed_blocks": f"""WITH {_EV}, {_BLOCKS}
SELECT id, {_iso("ts")} AS ts, ip, action, '' AS reason, CAST(NULL AS VARCHAR) AS expires_at FROM blocks""",
    "signature_dedup": f"""WITH RECURSIVE {_HITS}, {_DEDUP}
SELECT rule, src_ip, dest_ip, second, seq FROM chain""",
    "signature_alerts": f"""WITH {_HITS}
SELECT md5('cap0:' || seq || ':' || rule) AS id, {_iso("make_timestamp(ts_us)")} AS ts, src_ip,
  rule || ' ' || dest_ip || ':' || dport AS label, upper(rule_severity) AS severity, 'SIGNATURE' AS kind FROM hits""",
    "expired_bans": f"""WITH {_EV}, {_USER_BLOCKS}
SELECT md5(id || ':auto-expired') AS id, ip, 'unblock' AS action, 'auto-expired' AS reason
FROM (SELECT *, max(ts) OVER (PARTITION BY ip) AS newest FROM blocks)
WHERE action = 'block' AND expires_at < {AS_OF} AND ts = newest""",
    "blocks_with_trust": f"""WITH {_EV}, {_BLOCKS}, {_TRUSTED}
SELECT id, ip, action, ip IN (SELECT ip FROM trusted) AS trusted FROM blocks""",
    "block_candidates": f"""WITH {_EV}, {_BLOCKS}, {_TRUSTED}
SELECT id, ip, reason FROM blocks WHERE action = 'block' AND ip NOT IN (SELECT ip FROM trusted)""",
    "trust_rejected": f"""WITH {_EV}, {_BLOCKS}, last AS (
  SELECT ip, action FROM blocks QUALIFY row_number() OVER (PARTITION BY ip ORDER BY ts DESC, id DESC) = 1)
SELECT event_id AS seq, src_ip AS ip FROM ev
WHERE event_type = 'click' AND src_ip IN (SELECT ip FROM last WHERE action = 'block')""",
    "latest_action": f"""WITH {_EV}, {_USER_BLOCKS}
SELECT ip, id, action, reason FROM blocks
QUALIFY row_number() OVER (PARTITION BY ip ORDER BY ts DESC, id DESC) = 1""",
    "block_state": f"""WITH {_EV}, {_TRUSTED}, {_COMMANDS}
SELECT ip, {_iso("ts")} AS ts, command AS action,
  CASE WHEN command = 'unblock' AND reason = '' THEN 'manual' ELSE reason END AS reason,
  CASE WHEN command = 'block' THEN {_iso("ts + to_minutes(minutes)")} END AS expires_at
FROM commands WHERE command IN ('block', 'unblock') AND ip <> ''
  AND (command = 'unblock' OR ip NOT IN (SELECT ip FROM trusted))
QUALIFY row_number() OVER (PARTITION BY ip ORDER BY ts DESC, seq DESC) = 1""",
    "containment_fold": f"""WITH RECURSIVE {_EV}, {_COMMANDS}, {_CONTAIN}
SELECT seq, ip, command, verdict FROM fold WHERE rn > 0
UNION ALL
SELECT seq, ip, command, CASE WHEN ip = '' THEN 'ip_required' ELSE 'bad_ip' END FROM commands
WHERE ip = '' OR (command = 'trust' AND len(string_split(ip, '.')) <> 4)""",
    "lockout_verdicts": f"""WITH RECURSIVE {_EV}, {_LOGINS}
SELECT username, seq, ok, before AS failures_before, verdict FROM fold WHERE rn > 0""",
    "lockout_states": f"""WITH RECURSIVE {_EV}, {_LOGINS}
SELECT username, count(*) AS attempts, count_if(verdict = 'ok')::BIGINT AS accepted,
  count_if(verdict = 'invalid')::BIGINT AS failed, count_if(verdict = 'locked')::BIGINT AS refused
FROM fold WHERE rn > 0 GROUP BY username""",
    "trusted_list": f"WITH {_EV}, {_TRUSTED} SELECT ip, note, {_iso('created_ts')} AS created_ts FROM trusted",
    "trusted_merge": f"""WITH {_EV}, {_BLOCKS}, {_TRUSTED}, added AS (
  SELECT src_ip AS ip, props AS note, sec AS created_ts FROM ev WHERE event_type = 'signup'
  QUALIFY row_number() OVER (PARTITION BY src_ip ORDER BY sec DESC, props DESC) = 1), merged AS (
  SELECT * FROM added UNION ALL SELECT * FROM trusted WHERE ip NOT IN (SELECT ip FROM added)), gone AS (
  SELECT ip FROM blocks WHERE action = 'block' GROUP BY ip HAVING epoch(max(expires_at))::BIGINT % 2 = 0)
SELECT ip, note, {_iso("created_ts")} AS created_ts FROM merged WHERE ip NOT IN (SELECT ip FROM gone)""",
    "dports_per_src": f"WITH {_PACKETS} SELECT src_ip, count(DISTINCT dport) AS unique_dports FROM packets GROUP BY src_ip",
    "port_entropy": f"""WITH {_PACKETS}, c AS (SELECT src_ip, dport, count(*) AS n FROM packets GROUP BY ALL), p AS (
  SELECT src_ip, n / sum(n) OVER (PARTITION BY src_ip) AS p FROM c)
SELECT src_ip, round(-sum(p * log2(p)), 6) AS entropy FROM p GROUP BY src_ip""",
    "stats_snapshot": f"""WITH {_EV}, {_ALERTS}, {_BLOCKS}, n AS (
  SELECT (SELECT count(*) FROM alerts) AS alerts, (SELECT count(*) FROM blocks) AS blocks)
SELECT least(alerts, 200) AS alerts_200, least(blocks, 200) AS blocks_200, alerts, blocks FROM n""",
    "dashboard_counts": f"""WITH {_PACKETS}, {_ALERTS}, {_BLOCKS}, {_NAMES}, {_inventory("devices")}
SELECT (SELECT count(*) FROM devices) AS devices, (SELECT count(*) FROM devices WHERE name = '') AS unnamed_devices,
  (SELECT count(*) FROM alerts WHERE ts BETWEEN TIMESTAMP '2024-01-29 12:00:00' AND TIMESTAMP '2024-01-30 12:00:00') AS alerts_24h,
  (SELECT count(*) FROM blocks WHERE ts BETWEEN TIMESTAMP '2024-01-29 12:00:00' AND TIMESTAMP '2024-01-30 12:00:00') AS blocks_24h""",
    "device_inventory": f"WITH {_PACKETS}, {_NAMES}, {_inventory('devices')} SELECT * FROM devices",
    "device_services": f"""WITH {_PACKETS}
SELECT dest_ip AS ip, array_to_string(list_sort(list(DISTINCT dport)), ',') AS open_ports,
  CASE WHEN bool_or(dport IN (23, 445, 3389, 5900, 21)) THEN 'High' ELSE 'Medium' END AS risk
FROM packets WHERE dport IN (22, 23, 53, 80, 110, 139, 143, 443, 445, 3306, 3389, 5900) GROUP BY dest_ip""",
    "devices_top": f"""WITH {_PACKETS}, {_NAMES}, {_inventory("devices")}
SELECT * FROM devices ORDER BY last_seen DESC, ip LIMIT 5""",
    "scan_targets": f"""WITH {_PACKETS}, {_NAMES}, {_inventory("devices")}
SELECT ip FROM devices WHERE ip LIKE '10.%' OR ip LIKE '203.0.113.%'""",
    "device_merge": f"""WITH {_PACKETS}, {_NAMES}, {_inventory("known", "protocol = 6", False)}, {_inventory("seen", "protocol = 17")}
SELECT coalesce(k.ip, s.ip) AS ip, least(k.first_seen, s.first_seen) AS first_seen,
  greatest(k.last_seen, s.last_seen) AS last_seen, coalesce(nullif(s.name, ''), k.name, '') AS name
FROM known k FULL JOIN seen s ON k.ip = s.ip""",
    "device_rename": f"""WITH {_PACKETS}, {_TRUSTED}, {_inventory("known", "protocol = 6", False)}
SELECT k.ip, first_seen, last_seen, coalesce(note, name) AS name FROM known k LEFT JOIN trusted t ON k.ip = t.ip""",
    "device_scan_merge": f"""WITH {_PACKETS}, known AS (
  SELECT src_ip AS ip, min(ts_us) AS first_seen, max(ts_us) AS last_seen FROM packets WHERE protocol = 17 GROUP BY src_ip), scan AS (
  SELECT dest_ip AS ip, array_to_string(list_sort(list(DISTINCT dport)), ',') AS open_ports,
    CASE WHEN bool_or(dport IN (23, 3389, 5900)) THEN 'High' ELSE 'Medium' END AS risk
  FROM packets WHERE dport IN (22, 23, 3389, 5900) GROUP BY dest_ip)
SELECT coalesce(k.ip, s.ip) AS ip, coalesce(first_seen, epoch_us({AS_OF})) AS first_seen,
  CASE WHEN s.ip IS NOT NULL THEN epoch_us({AS_OF}) ELSE last_seen END AS last_seen, '' AS name,
  coalesce(open_ports, '') AS open_ports, coalesce(risk, '') AS risk
FROM known k FULL JOIN scan s ON k.ip = s.ip""",
    "alert_rates": f"""WITH {_EV}, {_ALERTS}
SELECT {_iso("date_trunc('hour', ts)")} AS bucket, severity, kind, count(*) AS n_alerts FROM alerts GROUP BY ALL""",
    "alerts_top": f"""WITH {_EV}, {_ALERTS} SELECT id, {_iso("ts")} AS ts, src_ip, label, severity, kind
FROM (SELECT * FROM alerts ORDER BY ts DESC, id DESC LIMIT 100)""",
    "blocks_top": f"""WITH {_EV}, {_BLOCKS} SELECT id, {_iso("ts")} AS ts, ip, action, reason, {_iso("expires_at")} AS expires_at
FROM (SELECT * FROM blocks ORDER BY ts DESC, id DESC LIMIT 100)""",
    "log_events": f"WITH {_LOGS} SELECT id, {_iso('ts')} AS ts, ip, type, label, severity, kind FROM logs",
    "retention_kept": f"""WITH {_EV}, {_ALERTS} SELECT id, severity, {_iso("ts")} AS ts FROM alerts
WHERE CAST(ts AS DATE) >= CAST({AS_OF} - INTERVAL 7 DAY AS DATE)""",
    "retention_counts": f"""WITH {_EV}, {_ALERTS}, {_BLOCKS}
SELECT (SELECT count(*) FROM alerts WHERE CAST(ts AS DATE) < CAST({AS_OF} - INTERVAL 7 DAY AS DATE)) AS alerts,
  (SELECT count(*) FROM blocks WHERE CAST(ts AS DATE) < CAST({AS_OF} - INTERVAL 14 DAY AS DATE)) AS blocks""",
    "latest_feed": f"""WITH {_LOGS}, sent AS (
  SELECT *, CAST(substr(id, 2) AS BIGINT) AS arrival FROM logs
  UNION ALL SELECT id, ts, ip, type, label, 'MEDIUM', kind, CAST(substr(id, 2) AS BIGINT) + 100 FROM logs WHERE severity = 'HIGH')
SELECT id, {_iso("ts")} AS ts, ip, type, label, severity, kind, arrival FROM (
  SELECT * FROM (SELECT * FROM sent QUALIFY row_number() OVER (PARTITION BY id, type ORDER BY arrival DESC) = 1)
  ORDER BY arrival DESC LIMIT 200)""",
    "feat_time_diff": f"WITH {_FEATURES} SELECT seq, round(time_diff, 6) AS time_diff FROM feat",
    "feat_unique_dports": f"WITH {_FEATURES} SELECT seq, unique_dports_15s FROM feat",
    "feat_unique_dports_capped": f"""WITH {_PACKETS}, idx AS (
  SELECT *, row_number() OVER (ORDER BY ts_us, seq) AS i FROM packets)
SELECT a.seq, CAST(count(DISTINCT b.dport) AS DOUBLE) AS unique_dports_15s
FROM idx a JOIN idx b ON a.src_ip = b.src_ip AND b.i BETWEEN a.i - 39 AND a.i AND b.ts_us >= a.ts_us - 15000000
GROUP BY a.seq""",
    "arrival_index": f"WITH {_PACKETS} SELECT seq, row_number() OVER (ORDER BY ts_us, seq) AS arrival_index FROM packets",
    "retrain_points": f"""WITH {_PACKETS}, idx AS (
  SELECT seq, row_number() OVER (ORDER BY ts_us, seq) AS arrival_index FROM packets)
SELECT seq, arrival_index, least(arrival_index, 500) AS window_rows FROM idx
WHERE arrival_index % 100 = 0 AND least(arrival_index, 500) >= 50""",
    "scan_windows": f"""WITH {_PACKETS}, slid AS (
  SELECT (ts_us // 5000000 - o) * 5000000 AS window_start, src_ip, dport FROM packets, (VALUES (0), (1), (2)) v(o))
SELECT window_start, window_start + 15000000 AS window_end, src_ip, count(DISTINCT dport) AS unique_dports,
  count(*) AS packets FROM slid GROUP BY window_start, src_ip""",
    "scaler_stats": f"WITH {_FEATURES} {_SCALER}",
    "scaled_features": f"WITH {_FEATURES} SELECT seq, {_SCALED} FROM feat",
    "iforest_sample": f"""WITH {_PACKETS}, hashed AS (
  SELECT seq, substr(md5('42:' || sensor_id || ':' || seq), 1, 15) AS h FROM packets), pool AS (
  SELECT seq, CAST('0x' || substr(h, 1, 7) AS BIGINT) AS hi, CAST('0x' || substr(h, 8, 7) AS BIGINT) AS lo FROM hashed), trees AS (
  SELECT t AS tree_id, 1 + CAST('0x' || substr(md5('42:' || t), 1, 15) AS BIGINT) % 2147483646 AS a,
    1 + CAST('0x' || substr(md5('42:' || t), 16, 15) AS BIGINT) % 2147483646 AS b
  FROM (SELECT CAST(unnest(range(8)) AS INTEGER) AS t)), dealt AS (
  SELECT tree_id, seq, row_number() OVER (PARTITION BY tree_id ORDER BY (hi * a + lo * b) % 2147483647, seq) AS rank
  FROM pool, trees)
SELECT tree_id, CAST(rank AS INTEGER) AS rank, seq FROM dealt WHERE rank <= 256""",
    "score_fixed_forest": f"WITH {_SCORED} SELECT seq, round(score, 9) AS score FROM scored",
    "contamination_offset": """SELECT round(quantile_cont(-1.0::DOUBLE / (1.0::DOUBLE + value), 0.05), 12) AS score_offset
FROM events""",
    "predict_labels": f"WITH {_SCORED} SELECT seq, CASE WHEN score < 0 THEN 'Anomaly' ELSE 'Normal' END AS label FROM scored",
    "anomaly_alerts": f"""WITH {_SCORED}
SELECT md5('cap0:' || seq || ':anomaly') AS id, {_iso("make_timestamp(ts_us)")} AS ts, src_ip,
  dest_ip || ':' || dport || printf(' score=%.3f', score) AS label, upper(severity) AS severity, 'ANOMALY' AS kind
FROM anomalies""",
    "autoblock_decisions": f"""WITH {_SCORED}, {_TRUSTED}, first AS (
  SELECT src_ip AS ip, min_by(seq, (ts_us, seq)) AS seq, min(ts_us) AS ts_us FROM anomalies
  WHERE severity = 'high' AND src_ip NOT IN ('10.0.0.2', '10.0.0.3', '10.0.0.4') GROUP BY src_ip)
SELECT md5('cap0:' || seq || ':autoblock') AS id, {_iso("make_timestamp(ts_us)")} AS ts, ip, 'block' AS action,
  'auto-high' AS reason, CAST(NULL AS VARCHAR) AS expires_at
FROM first WHERE ip NOT IN (SELECT ip FROM trusted)""",
}

_CHECKSUM = f"sha256('{','.join(FEATURES)}')"
_TREES = "(SELECT CAST(unnest(range(100)) AS INTEGER) AS tree_id)"

# What holds for a trained forest whatever its random cuts.
SQL |= {
    "iforest_shape": f"""WITH n AS (SELECT CAST(least(256, count(*)) AS INTEGER) AS n FROM events)
SELECT tree_id, n AS root_rows, CAST(n AS BIGINT) AS leaf_rows, 1::BIGINT AS extra_leaves, true AS depth_ok FROM n, {_TREES}""",
    "model_metadata": f"""SELECT '1.0.0' AS version, '{", ".join(FEATURES)}' AS feature_names, {len(FEATURES)} AS feature_count,
  {_CHECKSUM} AS feature_checksum, 0.05::DOUBLE AS contamination, 100 AS n_estimators, 42 AS random_state,
  CAST(least(256, count(*)) AS INTEGER) AS subsample FROM events""",
    "train_job": f"""SELECT 100 AS n_estimators, CAST(least(256, count(*)) AS INTEGER) AS subsample,
  {_CHECKSUM} AS feature_checksum, true AS usable FROM events""",
    "model_roundtrip": "SELECT event_id AS seq, true AS same FROM events",
    "predict_shuffled_columns": "SELECT event_id AS seq, true AS same FROM events",
}

# Streams must give what their batch twins give.
SQL |= {
    "live_features": SQL["features_per_event"],
    "live_alerts": SQL["anomaly_alerts"]
    + f"""
UNION ALL
SELECT * FROM ({SQL["signature_alerts"]})""",
    "live_devices": f"WITH {_PACKETS}, {_inventory('devices', named=False)} SELECT * FROM devices",
    "live_blocks": SQL["autoblock_decisions"],
    "live_limited_hits": SQL["signature_dedup"],
    "live_retrain": f"""WITH ends AS (SELECT min(epoch_us(ts)) AS first, max(epoch_us(ts)) AS last FROM events), cut AS (
  SELECT (epoch_us(ts) - first) * 4 // (last - first + 1) AS micro_batch, count(*) AS n FROM events, ends GROUP BY 1), seen AS (
  SELECT micro_batch, n, CAST(sum(n) OVER (ORDER BY micro_batch) AS BIGINT) AS total FROM cut)
SELECT micro_batch, 20 AS n_estimators, CAST(least(256, total) AS INTEGER) AS subsample, {_CHECKSUM} AS feature_checksum
FROM seen WHERE total // 700 > (total - n) // 700 AND total >= 50""",
    "live_lockout": f"""WITH RECURSIVE {_EV}, {_LOGINS} SELECT username, seq, verdict FROM fold WHERE rn > 0""",
    "live_ban_expiry": f"""WITH {_EV}, {_USER_BLOCKS}
SELECT ip, {_iso("expires_at")} AS ts, 'unblock' AS action, 'auto-expired' AS reason
FROM (SELECT *, lead(ts) OVER (PARTITION BY ip ORDER BY ts, id) AS replaced, max(ts) OVER () AS now FROM blocks)
WHERE action = 'block' AND expires_at < coalesce(replaced, now)""",
    "live_feed": f"""WITH {_EV}, {_ALERTS}, {_BLOCKS}
SELECT 'alert' AS event, id, {_iso("ts")} AS ts FROM alerts UNION ALL SELECT 'block', id, {_iso("ts")} FROM blocks""",
    "live_view": f"""WITH {_LOGS} SELECT id, {_iso("ts")} AS ts, ip, type, label, severity, kind, arrival FROM (
  SELECT *, CAST(substr(id, 2) AS BIGINT) AS arrival FROM logs ORDER BY arrival DESC LIMIT 200)""",
    # Windows that the watermark, 30 seconds behind the newest packet, has passed.
    "live_scan_summary": f"""WITH {_PACKETS}, slid AS (
  SELECT (ts_us // 5000000 - o) * 5000000 AS window_start, src_ip, dport FROM packets, (VALUES (0), (1), (2)) v(o))
SELECT window_start, src_ip, count(DISTINCT dport) AS unique_dports, count(*) AS packets FROM slid
WHERE window_start + 15000000 <= (SELECT max(ts_us) // 1000 * 1000 - 30000000 FROM packets) GROUP BY window_start, src_ip""",
}
