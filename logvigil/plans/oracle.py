"""The checked queries as plain SQL over the driver tables.

Each result is stated here a second time, from the rules themselves and with
other means (window frames over whole sources, recursive reachability), so that
agreement says something.
"""

from __future__ import annotations

from logvigil.constants import (
    BANKING_TERMS, CYBER_FLAGS, GOVERNMENT_TERMS, LEVELS, MOBILE_MONEY_TERMS,
    MUNICIPAL_TERMS, ONBOARDING_TERMS, PATTERN_FLAGS, PATTERN_TECHNIQUES, PERSONAL_TERMS,
    POPIA_FLAGS, RANSOMWARE_TERMS, SERVICE_ACCOUNT_TERMS, UTILITY_TERMS,
)
from logvigil.operators.regulatory import OBLIGATIONS

INVESTIGATIONS = 8


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def has_any(column: str, terms) -> str:
    pattern = "|".join(t.replace(".", "[.]") for t in terms)
    return f"coalesce(regexp_matches({column}, '{pattern}'), false)"


def chain(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(p.strip() for p in parts)


LOGS = f"""
logs AS (
  SELECT 'inv-' || (g % {INVESTIGATIONS}) AS investigation_id, event_id,
         1704067200000000 + elapsed // 30 AS ts_us,
         make_timestamp(1704067200000000 + elapsed // 30) AS ts,
         CASE WHEN event_id % 97 = 0
              THEN '41.' || ((event_id // 65536) % 256) || '.' || ((event_id // 256) % 256) || '.' || (event_id % 256)
              ELSE '196.25.' || (g // 256) || '.' || (g % 256) END AS src_ip,
         CASE event_id % 11 WHEN 0 THEN '8.8.4.' || (user_id % 200)
              WHEN 1 THEN 'portal' || g || '.gov.za'
              ELSE '10.' || (g % 200) || '.' || (user_id % 7) || '.' || (event_id % 29) END AS dst_ip,
         CASE event_type WHEN 'error' THEN 'login_failed'
              WHEN 'purchase' THEN 'payment_transfer'
              WHEN 'signup' THEN CASE WHEN event_id % 7 = 0 THEN 'ussd_ewallet' ELSE 'fica_onboarding' END
              WHEN 'click' THEN CASE WHEN event_id % 17 = 0 THEN 'prepaid_meter_update' ELSE 'connection' END
              ELSE CASE WHEN event_id % 13 = 0 THEN 'tor_proxy'
                        WHEN event_id % 19 = 0 THEN 'municipal_ransomware' ELSE 'file_access' END
         END AS event_type,
         CASE WHEN g % 3 = 0 THEN 1000 + CAST(json_extract_string(props, '$.k') AS INTEGER)
              ELSE CASE event_id % 4 WHEN 0 THEN 443 WHEN 1 THEN 80 WHEN 2 THEN 22 ELSE 53 END
         END AS dst_port,
         CASE event_id % 5 WHEN 0 THEN 'HTTPS' WHEN 1 THEN 'HTTP' WHEN 2 THEN 'SSH' WHEN 3 THEN ' dns ' END AS protocol,
         floor(value) * CASE WHEN event_type = 'purchase' THEN 300000.0::DOUBLE ELSE 100.0::DOUBLE END AS bytes_transferred,
         CASE WHEN user_id % 9 = 0 THEN 'svc_batch_' || user_id ELSE 'user' || user_id END AS user_account,
         'PC-' || (user_id % 50) AS device_id
  FROM (SELECT *, user_id // 10 AS g, epoch_us(ts) - 1704067200000000 AS elapsed FROM events)
)"""

PROFILE = """
profile AS (
  SELECT investigation_id, src_ip, count(*) AS source_events,
         avg(bytes_transferred) AS source_mean_bytes, count(DISTINCT dst_port) AS source_ports
  FROM logs GROUP BY ALL
)"""


def _burst(name: str, source: str, events: int, seconds: int) -> str:
    before = events - 1
    return f"""
{name} AS (
  SELECT event_id, coalesce(bool_or(starts) OVER (PARTITION BY investigation_id, src_ip
           ORDER BY ts_us, event_id ROWS BETWEEN {before} PRECEDING AND CURRENT ROW), false) AS member
  FROM (SELECT *, lead(ts_us, {before}) OVER (PARTITION BY investigation_id, src_ip
                  ORDER BY ts_us, event_id) - ts_us <= {seconds * 1_000_000} AS starts
        FROM {source})
)"""


FAILED = "failed AS (SELECT * FROM logs WHERE regexp_matches(lower(event_type), 'fail|denied|invalid'))"

# special-purpose IPv4 ranges as octet tests
ABROAD = r"""(regexp_matches({c}, '^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])([.](25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){{3}}$')
  AND NOT regexp_matches({c}, '^(0|10|127|169[.]254|172[.](1[6-9]|2[0-9]|3[01])|192[.]0[.]2|192[.]168|198[.]1[89]|198[.]51[.]100|203[.]0[.]113|22[4-9]|2[345][0-9])[.]')
  AND ({c} IN ('192.0.0.9', '192.0.0.10') OR NOT regexp_matches({c}, '^192[.]0[.]0[.]'))
  AND NOT regexp_matches({c}, '^(196|197|105|41)[.]'))"""

CONTEXT = ",\n".join(p.strip() for p in (
    LOGS, PROFILE, FAILED, _burst("rapid", "logs", 3, 60), _burst("brute", "failed", 5, 600),
    f"""
rules AS (
  SELECT l.*, p.source_events, p.source_mean_bytes, p.source_ports,
         p.source_events >= 3 AND bytes_transferred > 3 * source_mean_bytes AS "AMOUNT_SPIKE",
         r.member AS "RAPID_SUCCESSION",
         hour(ts) < 5 AS "OFF_HOURS",
         bytes_transferred > 0 AND bytes_transferred % 1000 = 0 AS "ROUND_BYTES",
         p.source_events = 1 AS "NEW_SOURCE",
         p.source_ports >= 10 AS "PORT_SCAN",
         {ABROAD.format(c='dst_ip')} AS "CROSS_BORDER",
         coalesce(b.member, false) AS "BRUTE_FORCE"
  FROM logs l JOIN profile p USING (investigation_id, src_ip)
       JOIN rapid r USING (event_id) LEFT JOIN brute b USING (event_id)
)""",
))

_EXPECTED = """WHEN 80 THEN upper(trim(protocol)) <> 'HTTP'
  WHEN 443 THEN upper(trim(protocol)) NOT IN ('HTTPS', 'TLS', 'SSL')
  WHEN 22 THEN upper(trim(protocol)) <> 'SSH' WHEN 25 THEN upper(trim(protocol)) <> 'SMTP'
  WHEN 53 THEN upper(trim(protocol)) <> 'DNS'"""
# written out a second time, so that a wrong constant in the engine shows
_RULES = ("AMOUNT_SPIKE", "RAPID_SUCCESSION", "OFF_HOURS", "ROUND_BYTES", "NEW_SOURCE", "PORT_SCAN",
          "CROSS_BORDER", "BRUTE_FORCE")
_SIGNALS = [
    ('"AMOUNT_SPIKE"', 25, "Unusual data volume"),
    ('"RAPID_SUCCESSION"', 30, "High-frequency event pattern"),
    ('"OFF_HOURS"', 10, "Off-hours activity"),
    ('"ROUND_BYTES"', 15, "Structured data transfer"),
    ('"NEW_SOURCE"', 20, "Unknown source"),
    ('"PORT_SCAN"', 25, "Port scanning detected"),
    ('"CROSS_BORDER"', 20, "Cross-border network activity"),
    ('"BRUTE_FORCE"', 30, "Brute force authentication attempt"),
    ("mismatch", 20, "Protocol anomaly"),
    ("regexp_matches(lower(event_type), 'crypto|tor|proxy|casino|darknet')", 20, "High-risk service category"),
    ("bytes_transferred > 50000000", 25, "Large data transfer (exfiltration risk)"),
]
MISMATCH = f"(protocol IS NOT NULL AND trim(protocol) <> '' AND CASE dst_port {_EXPECTED} ELSE false END)"
REASONS = "concat_ws('|', " + ", ".join(
    f"CASE WHEN \"{r}\" THEN '{r}' END" for r in _RULES) + ")"


def labels(behind_mismatch: str = "NULL") -> str:
    """The labels that hold; the outlier signal stands behind the protocol."""
    held = [f"CASE WHEN {test} THEN {quoted(label)} END" for test, _, label in _SIGNALS]
    return "concat_ws('|', " + ", ".join([*held[:-2], behind_mismatch, *held[-2:]]) + ")"


POINTS = " + ".join(f"CASE WHEN {test} THEN {points} ELSE 0 END" for test, points, _ in _SIGNALS)

SCORED = CONTEXT + f""",
marked AS (SELECT *, {MISMATCH} AS mismatch FROM rules),
added AS (
  SELECT *, {REASONS} AS reasons, {labels()} AS signals,
         CAST(greatest(0, least(100, {POINTS})) AS INTEGER) AS threat_score
  FROM marked
),
scored AS (
  SELECT *, reasons <> '' AS is_anomaly,
         CASE WHEN threat_score = 0 THEN 'None' WHEN threat_score <= 24 THEN 'Low'
              WHEN threat_score <= 49 THEN 'Medium' WHEN threat_score <= 74 THEN 'High'
              ELSE 'Critical' END AS threat_level
  FROM added
)"""

GRAPH = SCORED + """,
mentions AS (
  SELECT investigation_id, event_id, 'src_ip' AS role, 'ip:' || trim(src_ip) AS node_id, threat_score, threat_level FROM scored
  UNION ALL SELECT investigation_id, event_id, 'dst_ip', 'ip:' || trim(dst_ip), threat_score, threat_level FROM scored
  UNION ALL SELECT investigation_id, event_id, 'user_account', 'user_account:' || trim(user_account), threat_score, threat_level FROM scored
  UNION ALL SELECT investigation_id, event_id, 'device_id', 'device_id:' || trim(device_id), threat_score, threat_level FROM scored
),
nodes AS (
  SELECT investigation_id, node_id,
         CASE WHEN bool_or(role = 'src_ip') THEN 'src_ip' ELSE min(role) END AS type,
         bool_or(threat_level IN ('High', 'Critical')) AS is_suspicious,
         max(threat_score) AS max_threat_score,
         list_extract(['None', 'Low', 'Medium', 'High', 'Critical'],
           max(list_position(['None', 'Low', 'Medium', 'High', 'Critical'], threat_level))) AS max_threat_level,
         count(*) AS event_count
  FROM mentions GROUP BY investigation_id, node_id
),
traffic AS (
  SELECT investigation_id, 'ip:' || trim(src_ip) AS source, 'ip:' || trim(dst_ip) AS target,
         trim(event_type) AS event_type, count(*) AS events, sum(bytes_transferred) AS bytes,
         max(threat_score) AS score
  FROM scored GROUP BY ALL
),
edges AS (
  SELECT investigation_id, source, target, CAST(sum(events) AS BIGINT) AS event_count,
         sum(bytes) AS total_bytes, max(score) AS max_threat_score,
         list_extract(list(event_type ORDER BY events DESC, event_type), 1) AS dominant_event_type
  FROM traffic GROUP BY investigation_id, source, target
)"""

CLUSTERS = GRAPH + """,
links AS (
  SELECT investigation_id, source AS a, target AS b FROM edges
  UNION SELECT investigation_id, target, source FROM edges
),
reach AS (
  SELECT DISTINCT investigation_id, a AS node_id, a AS other FROM links
  UNION
  SELECT r.investigation_id, r.node_id, l.b FROM reach r
  JOIN links l ON l.investigation_id = r.investigation_id AND l.a = r.other
),
components AS (
  SELECT investigation_id, node_id, min(other) AS component FROM reach GROUP BY ALL
),
found AS (
  SELECT investigation_id, component, count(*) AS node_count,
         count(*) FILTER (is_suspicious) AS suspicious_nodes, max(max_threat_score) AS max_threat_score,
         list_extract(['None', 'Low', 'Medium', 'High', 'Critical'],
           max(list_position(['None', 'Low', 'Medium', 'High', 'Critical'], max_threat_level))) AS dominant_threat_level
  FROM components JOIN nodes USING (investigation_id, node_id)
  GROUP BY ALL HAVING count(*) FILTER (is_suspicious) >= 3
),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY investigation_id
              ORDER BY max_threat_score DESC, suspicious_nodes DESC, component) AS position
  FROM found
),
named AS (SELECT *, 'CLUSTER-' || lpad(CAST(position AS VARCHAR), 3, '0') AS cluster_id FROM numbered),
cluster_members AS (
  SELECT n.investigation_id, n.cluster_id, c.node_id
  FROM named n JOIN components c USING (investigation_id, component)
),
inside AS (
  SELECT t.*, m.cluster_id FROM traffic t
  JOIN cluster_members m ON m.investigation_id = t.investigation_id AND m.node_id = t.source
),
clusters AS (
  SELECT n.investigation_id, n.cluster_id, n.position, n.component AS first_node, n.node_count,
         n.suspicious_nodes, i.edge_count, i.total_bytes, n.max_threat_score, n.dominant_threat_level
  FROM named n JOIN (
    SELECT investigation_id, cluster_id, count(DISTINCT source || '>' || target) AS edge_count,
           sum(bytes) AS total_bytes
    FROM inside GROUP BY ALL) i USING (investigation_id, cluster_id)
),
graph_summary AS (
  SELECT investigation_id, n.total_nodes, e.total_edges, n.suspicious_nodes,
         coalesce(c.attack_clusters_detected, 0) AS attack_clusters_detected,
         n.max_threat_score_in_graph
  FROM (SELECT investigation_id, count(*) AS total_nodes, count(*) FILTER (is_suspicious) AS suspicious_nodes,
               max(max_threat_score) AS max_threat_score_in_graph FROM nodes GROUP BY ALL) n
  LEFT JOIN (SELECT investigation_id, count(*) AS total_edges FROM edges GROUP BY ALL) e USING (investigation_id)
  LEFT JOIN (SELECT investigation_id, count(*) AS attack_clusters_detected FROM clusters GROUP BY ALL) c USING (investigation_id)
)"""

_COMBINED = "(lower(event_type) || ' ' || lower(replace(signals, '|', ' ')))"
_ROW_FLAGS = {
    "personal": has_any(_COMBINED, PERSONAL_TERMS),
    "serious": "threat_score >= 50",
    "abroad": has_any(_COMBINED, PERSONAL_TERMS) + ' AND "CROSS_BORDER"',
    "operator": "threat_level IN ('High', 'Critical') AND "
                + has_any("lower(user_account)", SERVICE_ACCOUNT_TERMS),
    "reportable": "threat_level = 'Critical' OR \"BRUTE_FORCE\" OR \"PORT_SCAN\"",
    "banking": "threat_level = 'Critical' AND " + has_any("lower(event_type)", BANKING_TERMS),
    "utility": has_any(_COMBINED, UTILITY_TERMS),
    "portal": '"BRUTE_FORCE" AND (' + has_any("lower(dst_ip)", GOVERNMENT_TERMS) + " OR "
              + has_any("lower(event_type)", GOVERNMENT_TERMS) + ")",
    "mobile": has_any("lower(event_type)", MOBILE_MONEY_TERMS),
    "ransom": has_any("lower(event_type)", RANSOMWARE_TERMS) + " AND ("
              + has_any("lower(dst_ip)", MUNICIPAL_TERMS) + " OR "
              + has_any("lower(event_type)", MUNICIPAL_TERMS) + ")",
    "onboarding": "threat_score >= 50 AND " + has_any("lower(event_type)", ONBOARDING_TERMS),
}


def flags(clusters: str = "0") -> str:
    """CTEs ``seen``, ``flags`` (booleans) and ``listed`` (joined names)."""
    tests = ", ".join(f"bool_or({test}) AS {name}" for name, test in _ROW_FLAGS.items())
    names = [*POPIA_FLAGS, *CYBER_FLAGS, *PATTERN_FLAGS]
    values = ["personal", "personal AND serious", "abroad", "operator", "reportable",
              "reportable AND clusters > 0", "banking", "utility", "portal", "mobile", "ransom",
              "onboarding"]
    columns = ", ".join(f'{v} AS "{n}"' for v, n in zip(values, names, strict=True))

    def joined(group, sep="|"):
        return f"concat_ws('{sep}', " + ", ".join(
            f"CASE WHEN \"{n}\" THEN '{n}' END" for n in group) + ")"

    sentences = "concat_ws(' ', " + ", ".join(
        f'CASE WHEN "{n}" THEN {quoted(t[0])} END' for n, t in OBLIGATIONS.items()) + ")"
    duties = "concat_ws('|', " + ", ".join(
        f'CASE WHEN "{n}" THEN {quoted(t[1])} END' for n, t in OBLIGATIONS.items()) + ")"
    return f"""
seen AS (SELECT investigation_id, {clusters} AS clusters, {tests} FROM scored GROUP BY investigation_id),
flags AS (SELECT investigation_id, {columns} FROM seen),
listed AS (
  SELECT investigation_id, {joined(POPIA_FLAGS)} AS popia_flags, {joined(CYBER_FLAGS)} AS cybercrimes_flags,
         {joined(PATTERN_FLAGS)} AS sa_patterns_matched,
         coalesce(nullif({sentences}, ''), 'No immediate compliance obligations identified.') AS compliance_summary,
         {duties} AS reporting_obligations
  FROM flags
)"""


CLUSTER_COUNT = "any_value((SELECT count(*) FROM clusters c WHERE c.investigation_id = scored.investigation_id))"

SUMMARY = """
summary AS (
  SELECT investigation_id, count(*) AS event_count, count(*) FILTER (is_anomaly) AS anomaly_count,
         count(*) FILTER (threat_level IN ('High', 'Critical')) AS high_threat_count,
         max(threat_score) AS max_threat_score,
         count(*) FILTER (threat_level = 'Critical') AS critical, count(*) FILTER (threat_level = 'High') AS high,
         count(*) FILTER (threat_level = 'Medium') AS medium, count(*) FILTER (threat_level = 'Low') AS low,
         count(*) FILTER (threat_level = 'None') AS "none"
  FROM scored GROUP BY investigation_id
)"""

TOP = """
top_events AS (
  SELECT * FROM (
    SELECT investigation_id, event_id, event_type, src_ip, dst_ip, threat_score, threat_level,
           signals, reasons, ts,
           row_number() OVER (PARTITION BY investigation_id ORDER BY threat_score DESC, event_id) AS position
    FROM scored) WHERE position <= 10
)"""

# terms in the order they are first met: event by event, then the flag lists
QUERY_TEXT = """
terms AS (
  SELECT investigation_id, position * 1000 + p AS place, term FROM (
    SELECT investigation_id, position,
           unnest(string_split(concat_ws('|', nullif(signals, ''), nullif(reasons, ''), event_type), '|')) AS term,
           generate_subscripts(string_split(concat_ws('|', nullif(signals, ''), nullif(reasons, ''), event_type), '|'), 1) AS p
    FROM top_events)
  UNION ALL
  SELECT investigation_id, 1000000 + p, term FROM (
    SELECT investigation_id,
           unnest(string_split(concat_ws('|', nullif(sa_patterns_matched, ''), nullif(popia_flags, ''), nullif(cybercrimes_flags, '')), '|')) AS term,
           generate_subscripts(string_split(concat_ws('|', nullif(sa_patterns_matched, ''), nullif(popia_flags, ''), nullif(cybercrimes_flags, '')), '|'), 1) AS p
    FROM listed)
),
asked AS (
  SELECT investigation_id, string_agg(term, ', ' ORDER BY place) AS query_used
  FROM (SELECT investigation_id, min(place) AS place, arg_min(term, place) AS term
        FROM terms WHERE trim(term) <> '' GROUP BY investigation_id, lower(term))
  GROUP BY investigation_id
)"""

TECHNIQUES = "techniques AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{p}', '{t}')" for p, ids in PATTERN_TECHNIQUES.items() for t in ids
) + ") AS t(pattern, technique_id))"

EVIDENCE = """
evidence AS (
  SELECT s.*, l.popia_flags, l.cybercrimes_flags, l.sa_patterns_matched, 0 AS attack_clusters
  FROM summary s JOIN listed l USING (investigation_id)
),
drafted AS (
  SELECT investigation_id,
         event_count || ' events were analysed; ' || anomaly_count || ' were anomalous and '
         || high_threat_count || ' rated High or Critical. The highest score was ' || max_threat_score
         || ' and ' || attack_clusters || ' attack clusters were found.' || chr(10) || chr(10)
         || CASE WHEN concat_ws('|', popia_flags, cybercrimes_flags, sa_patterns_matched) = '||'
                 THEN 'No regulatory or regional flag was raised.'
                 ELSE 'Flags raised: ' || replace(concat_ws('|', nullif(popia_flags, ''),
                      nullif(cybercrimes_flags, ''), nullif(sa_patterns_matched, '')), '|', ', ') || '.' END
         AS incident_summary,
         CASE WHEN max_threat_score >= 75 THEN 'High' WHEN max_threat_score >= 50 THEN 'Medium' ELSE 'Low' END
         AS confidence_level,
         array_to_string(list_slice(string_split(concat_ws('|',
           CASE WHEN high_threat_count > 0 THEN 'Review every event rated High or Critical.' END,
           CASE WHEN attack_clusters > 0 THEN 'Contain the hosts of the attack clusters.' END,
           CASE WHEN popia_flags <> '' THEN 'Assess which personal data may be affected.' END,
           CASE WHEN cybercrimes_flags <> '' THEN 'Preserve evidence and check reporting duties.' END,
           'No further action identified.', 'No further action identified.',
           'No further action identified.', 'No further action identified.'), '|'), 1, 4), '|')
         AS incident_next_steps
  FROM evidence
)"""

LEVEL_LIST = "[" + ", ".join(quoted(x) for x in LEVELS) + "]"
