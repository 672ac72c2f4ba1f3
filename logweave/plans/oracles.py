"""The registered queries as plain SQL for the checking engine.

Written on their own, from the meaning of each operator: nothing here is
generated from the Spark plans. Only the derived inputs share a text.
"""

from __future__ import annotations

from logweave.plans import fixtures as X

T = "'%Y-%m-%d %H:%M:%S'"
SQL: dict[str, str] = {}

RAW = (f"raw AS (SELECT event_id AS seq, ts AS arrival_ts, "
       f"{X.raw_sql('VARCHAR', chr(115) + 'trftime(ts, ' + chr(39) + '%b' + chr(39) + ')', 'strftime(ts, ' + chr(39) + '%H:%M:%S' + chr(39) + ')')} "
       f"AS line FROM events)")

# The derived lines have one layout, so fixed positions do.
RECORDS = RAW + """,
split AS (SELECT seq, CAST(regexp_extract(line, '^<([0-9]+)>', 1) AS INTEGER) AS p,
  regexp_replace(line, '^<[0-9]+>', '') AS rest FROM raw),
records AS (SELECT seq,
  strptime('2024 ' || replace(substr(rest, 1, 15), '  ', ' '), '%Y %b %d %H:%M:%S') AS ts,
  CASE WHEN p < 8 THEN p + 8 ELSE p END AS pri,
  CAST(CASE WHEN p < 8 THEN 1 ELSE p // 8 END AS INTEGER) AS fac, CAST(p % 8 AS INTEGER) AS sev,
  split_part(split_part(substr(rest, 17), ' ', 1), '.', 1) AS host,
  regexp_extract(substr(rest, 17), '^[^ ]+ ([0-9A-Za-z]*)', 1) AS prog,
  regexp_replace(substr(rest, 17), '^[^ ]+ ', '') AS msg FROM split)"""

FAC_NAMES = """fac_names AS (SELECT * FROM (VALUES (0,'kern'),(1,'user'),(2,'mail'),(3,'daemon'),
(4,'auth'),(5,'syslog'),(6,'lpr'),(7,'news'),(8,'uucp'),(9,'cron'),(10,'authpriv'),(11,'ftp'),
(16,'local0'),(17,'local1'),(18,'local2'),(19,'local3'),(20,'local4'),(21,'local5'),
(22,'local6'),(23,'local7'),(24,'mark')) t(fac, facility))"""
SEV_NAMES = """sev_names AS (SELECT * FROM (VALUES (0,'emerg'),(1,'alert'),(2,'crit'),(3,'err'),
(4,'warn'),(5,'notice'),(6,'info'),(7,'debug')) t(sev, priority))"""


def compile_sql(source: str) -> str:
    """CTEs ``terms``, ``bad`` and ``masks`` for a rules relation (rule_id, selector)."""
    return f"""{FAC_NAMES},
fac_codes AS (SELECT facility AS name, fac AS code FROM fac_names
  UNION ALL SELECT 'security', 4
  UNION ALL SELECT CAST(i * 8 AS VARCHAR), CAST(i AS INTEGER) FROM range(0, 24) r(i)),
sev_codes AS (SELECT * FROM (VALUES ('emerg',0),('panic',0),('alert',1),('crit',2),('err',3),
  ('error',3),('warn',4),('warning',4),('notice',5),('info',6),('debug',7),
  ('0',0),('1',1),('2',2),('3',3),('4',4),('5',5),('6',6),('7',7)) t(name, code)),
pieces AS (SELECT rule_id, unnest(regexp_extract_all(selector, '[^.;]+\\.[^,;]+')) AS piece,
  generate_subscripts(regexp_extract_all(selector, '[^.;]+\\.[^,;]+'), 1) AS pos FROM {source}),
terms AS (SELECT rule_id, pos, string_split(ltrim(split_part(piece, '.', 1), ',;'), ',') AS facs,
  lower(regexp_replace(split_part(piece, '.', 2), '^!?=?', '')) AS lvl,
  split_part(piece, '.', 2) LIKE '!%' AS neg,
  regexp_matches(split_part(piece, '.', 2), '^!?=') AS single FROM pieces),
coded AS (SELECT t.*, s.code AS sev,
  CASE WHEN lvl = 'none' OR (lvl = '*' AND NOT single) THEN 255
       WHEN single THEN 1 << s.code ELSE (1 << (s.code + 1)) - 1 END AS bits,
  (lvl = 'none') <> neg AS clr
  FROM terms t LEFT JOIN sev_codes s ON s.name = t.lvl),
named AS (SELECT c.rule_id, c.pos, c.bits, c.clr, lower(u.f) AS f, fc.code AS code
  FROM coded c, unnest(c.facs) u(f) LEFT JOIN fac_codes fc ON fc.name = lower(u.f)),
bad AS (SELECT DISTINCT rule_id FROM named WHERE bits IS NULL OR (code IS NULL AND f <> '*')),
applied AS (SELECT n.rule_id, f.i AS fac, n.pos, n.bits, n.clr FROM named n
  JOIN range(0, 25) f(i) ON n.code = f.i OR (n.f = '*' AND f.i < 24)
  WHERE n.rule_id NOT IN (SELECT rule_id FROM bad)),
masks AS (SELECT rule_id, CAST(fac AS INTEGER) AS fac, CAST(list_reduce(
    list(CASE WHEN clr THEN 256 + bits ELSE bits END ORDER BY pos),
    lambda m, t: CASE WHEN t >= 256 THEN m & (511 - t) ELSE m | t END, CAST(0 AS BIGINT)) AS INTEGER) AS mask
  FROM applied GROUP BY rule_id, fac)"""


RULES = f"""rules AS (SELECT * FROM (VALUES {X.rule_values()})
  t(rule_id, selector, program, message_re, host_re, date_re, time_re, inverse, dest, sink))"""

ROUTED = f"""{RECORDS}, {RULES}, {compile_sql('rules')},
routed AS (SELECT r.*, u.rule_id, u.dest, u.sink FROM records r
  JOIN masks m ON m.fac = r.fac AND m.mask <> 16 AND (m.mask & (1 << r.sev)) <> 0
  JOIN rules u ON u.rule_id = m.rule_id AND (u.program IS NULL OR u.program = r.prog))"""

HEADER = "strftime({0}, '%b') || ' ' || lpad(CAST(day({0}) AS VARCHAR), 2, ' ') || strftime({0}, ' %H:%M:%S')"


def stamp(col: str) -> str:
    return f"strftime({col}, {T})"


SQL["route_host_counts"] = f"WITH {ROUTED} SELECT rule_id, host, count(*) AS n FROM routed GROUP BY 1, 2"
SQL["parse_records"] = f"""WITH {RECORDS} SELECT seq, {stamp('ts')} AS ts, fac, sev, pri, host, prog, msg,
  true AS has_header_ts FROM records"""

SQL["parse_pri_edge"] = f"""WITH lines AS (SELECT event_id, ts, event_type, user_id % 3 = 0 AS is_kernel,
  CASE event_id % 6 WHEN 0 THEN 13 WHEN 1 THEN 0 WHEN 2 THEN user_id WHEN 3 THEN user_id * 40
    WHEN 4 THEN 99999 ELSE user_id % 192 END AS given FROM events),
ok AS (SELECT *, CASE WHEN given > 1023 THEN 13 ELSE given END AS p FROM lines),
guarded AS (SELECT *, CASE WHEN p < 8 AND NOT is_kernel THEN p + 8 ELSE p END AS pri FROM ok)
SELECT event_id AS seq, {stamp('ts')} AS ts, CAST(pri // 8 AS INTEGER) AS fac,
  CAST(pri % 8 AS INTEGER) AS sev, CAST(pri AS INTEGER) AS pri, '{X.LOCAL_HOST}' AS host,
  event_type AS prog, event_type AS msg, false AS has_header_ts FROM guarded"""

SQL["header_times"] = f"""WITH o AS (SELECT o_orderkey AS k, o_orderdate AS d, o_orderpriority AS p,
  o_orderkey % 4 AS kind FROM orders),
dated AS (SELECT *, CASE WHEN kind = 1 THEN year(d) WHEN kind = 3 THEN NULL
    WHEN month(d) < 6 OR month(d) = 6 AND day(d) = 1 THEN 2024 ELSE 2023 END AS y,
  strftime(d, '%b') || ' ' || lpad(CAST(day(d) AS VARCHAR), 2, ' ') AS md FROM o),
placed AS (SELECT *, CASE WHEN kind = 3 THEN NULL WHEN month(d) = 2 AND day(d) = 29 AND kind <> 1
    THEN TIMESTAMP '2024-02-29 10:20:30'
  ELSE make_timestamp(y, month(d), day(d), 10, 20, 30.0) END AS t FROM dated)
SELECT k AS seq, strftime(coalesce(t, TIMESTAMP '2024-05-05 05:05:05'), {T}) AS ts,
  CASE kind WHEN 0 THEN p WHEN 1 THEN p WHEN 2 THEN '10.0.0.1 ' || p ELSE md || ' 10:20 ' || p END AS msg,
  kind <> 3 AS has_header_ts FROM placed"""

SQL["host_short"] = """SELECT event_id AS seq, 'h' || CAST(user_id % 20 AS VARCHAR) || '.example.com' AS msg_host,
  'h' || CAST(user_id % 20 AS VARCHAR) AS host FROM events"""

SQL["code_names"] = f"""WITH {FAC_NAMES}, {SEV_NAMES},
c AS (SELECT CAST(l_partkey % 26 AS INTEGER) AS fac, CAST(l_suppkey % 9 AS INTEGER) AS sev,
  count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT c.fac, c.sev, coalesce(f.facility, CAST(c.fac * 8 AS VARCHAR)) AS facility,
  coalesce(s.priority, CAST(c.sev AS VARCHAR)) AS priority, n
FROM c LEFT JOIN fac_names f ON f.fac = c.fac LEFT JOIN sev_names s ON s.sev = c.sev"""

SQL["escape_controls"] = """SELECT doc_id, replace(replace(replace(replace(replace(replace(text,
  chr(10), ' '), 'e', '^A'), 'a', '^['), 'i', '\\177'), 'o', '\\205'), 'u', '^I') AS shown FROM documents"""

SQL["mask_nonprint"] = """SELECT doc_id, array_to_string(list_transform(string_split(text, ''),
  lambda c: CASE WHEN c = chr(10) OR (unicode(c) BETWEEN 32 AND 126) THEN c
    ELSE repeat('X', strlen(c)) END), '') AS masked FROM documents"""

SQL["peer_names"] = """SELECT '10.0.0.' || l_suppkey AS peer,
  CASE WHEN l_suppkey % 2 = 0 THEN s_name || '.example.com' ELSE '10.0.0.' || l_suppkey END AS peer_host,
  CASE WHEN l_suppkey % 2 = 0 THEN s_name ELSE '10' END AS host, count(*) AS n
FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2, 3"""

SQL["translate_symbols"] = """WITH sym AS (SELECT p_partkey + 4096 AS a,
  ' [<' || printf('%x', p_partkey + 4096) || '> ' || p_brand || '.' || replace(p_name, ' ', '_') || ' ]' AS shown
  FROM part WHERE p_partkey % 3 <> 0),
o AS (SELECT o.*, o_custkey + 4096 AS a1, o_orderkey % 2000 + 4096 AS a2 FROM orders o),
j AS (SELECT o.*, s1.shown AS x1, s2.shown AS x2 FROM o LEFT JOIN sym s1 ON s1.a = a1
  LEFT JOIN sym s2 ON s2.a = a2)
SELECT o_orderkey AS seq, CASE WHEN o_orderstatus = 'F' THEN 'disk full on ' || o_orderpriority
  WHEN x1 IS NULL THEN 'oops at [<' || printf('%X', a1) || '>] from [<' || printf('%x', a2) || '>] end'
  WHEN x2 IS NULL THEN 'oops at ' || x1 || ' from [<' || printf('%x', a2) || '>] end'
  ELSE 'oops at ' || x1 || ' from ' || x2 || ' end' END AS line FROM j"""

SQL["file_input"] = f"""WITH d AS (SELECT *, unnest(string_split(text, chr(10))) AS first,
  generate_subscripts(string_split(text, chr(10)), 1) - 1 AS nr,
  CASE WHEN doc_id % 3 <> 0 OR doc_id % 1100 > 1023 THEN 2 ELSE doc_id % 1100 END AS p FROM documents)
SELECT doc_id * 1000000 + nr AS seq, '2024-03-01 00:00:00' AS ts, CAST(p AS INTEGER) AS pri, '{X.LOCAL_HOST}' AS host,
  regexp_extract(source || ':', '^[0-9A-Za-z]*') AS prog, source || ':' || first AS msg FROM d"""

SQL["custom_time"] = f"""SELECT o_orderkey AS seq,
  CASE WHEN o_orderstatus = 'F' THEN '2024-03-01 00:00:00'
    WHEN month(o_orderdate) = 2 AND day(o_orderdate) = 29 THEN '2024-02-29 ' || strftime(o_orderdate, '%H:%M:%S')
    WHEN month(o_orderdate) < 6 OR (month(o_orderdate) = 6 AND (day(o_orderdate) = 1 OR day(o_orderdate) = 2
      AND strftime(o_orderdate, '%H:%M:%S') = '00:00:00')) THEN '2024' || strftime(o_orderdate, '-%m-%d %H:%M:%S')
    ELSE '2023' || strftime(o_orderdate, '-%m-%d %H:%M:%S') END AS ts,
  2 AS pri, CASE WHEN o_orderstatus = 'F' THEN 'app:[not a time, no no no] ' ELSE 'app:[] ' END
    || o_orderpriority AS msg, o_orderstatus <> 'F' AS has_header_ts FROM orders"""

SQL["reassemble_lines"] = """WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
e AS (SELECT doc_id AS conn_id, unnest(parts) AS line, generate_subscripts(parts, 1) - 1 AS line_no FROM d)
SELECT conn_id, CAST(line_no AS BIGINT) AS line_no, line FROM e WHERE line <> ''"""

SQL["kernel_lines"] = f"""SELECT event_id AS seq, {stamp('ts')} AS ts, 0 AS fac,
  CAST(CASE WHEN event_id % 3 = 1 THEN user_id % 8 WHEN event_id % 3 = 2 AND user_id < 10 THEN user_id
    ELSE 4 END & 7 AS INTEGER) AS sev, 'kernel' AS prog,
  'kernel: ' || CASE WHEN event_id % 3 = 2 AND user_id >= 10 THEN '<' || user_id || '>' ELSE '' END
    || event_type || ' at ' || props AS msg, true AS is_kernel
FROM events WHERE NOT (event_id % 3 = 2 AND user_id IN (8, 9))
UNION ALL SELECT event_id, {stamp('ts')}, 1, CAST(user_id % 8 AS INTEGER), 'kernel',
  'kernel: ' || event_type || ' at ' || props, true FROM events WHERE event_id % 3 = 2 AND user_id IN (8, 9)"""

SQL["kernel_lines_bsd"] = f"""WITH k AS (SELECT *, CASE event_id % 3 WHEN 0 THEN 2 WHEN 1 THEN user_id % 8
  ELSE CASE WHEN user_id > 1023 THEN 2 ELSE user_id END END AS p FROM events)
SELECT event_id AS seq, {stamp('ts')} AS ts, CAST(p // 8 AS INTEGER) AS fac, CAST(p % 8 AS INTEGER) AS sev,
  '' AS prog, '/bsd: ' || event_type || ' at ' || props AS msg, true AS is_kernel FROM k"""

SQL["device_lines"] = """SELECT event_id AS seq,
  CAST(CASE WHEN user_id < 8 THEN user_id + 8 ELSE user_id END AS INTEGER) AS pri,
  CAST(CASE WHEN user_id < 8 THEN 1 ELSE user_id // 8 END AS INTEGER) AS fac,
  CAST(user_id % 8 AS INTEGER) AS sev, event_type AS msg FROM events"""

SQL["datagrams"] = f"""WITH c AS (SELECT *, turn * 9 AS p FROM conversations),
m AS (SELECT *, role || ': ' || array_to_string(list_transform(string_split(text, ''),
  lambda c: CASE WHEN c = chr(10) THEN ' ' WHEN unicode(c) BETWEEN 32 AND 126 THEN c
    ELSE repeat('X', strlen(c)) END), '') AS msg FROM c)
SELECT conv_id * 1000 + turn AS seq, CAST(CASE WHEN p > 1023 THEN 13 WHEN p < 8 THEN p + 8 ELSE p END AS INTEGER) AS pri,
  coalesce(s_name, '10') AS host, role AS prog, msg
FROM m LEFT JOIN supplier ON s_suppkey = conv_id AND s_suppkey % 2 = 0"""

_PLACE = "(conv_id * 1000 + turn) * 64 + conv_id % 7 AS seq"
SQL["recorded_datagrams"] = f"""SELECT *, CAST(1 AS BIGINT) AS n FROM ({SQL["datagrams"].replace(
    "conv_id * 1000 + turn AS seq", _PLACE)})
UNION ALL SELECT NULL, NULL, '', '', '{{' || s_name, CAST(2 AS BIGINT) FROM supplier"""

SQL["merge_sources"] = f"""SELECT event_id * 3 AS seq, 'app.log' AS source, 2 AS pri, '{X.LOCAL_HOST}' AS host,
  'app' AS prog, 'app.log:' || event_type AS msg, false AS is_kernel FROM events WHERE event_type = 'view'
UNION ALL SELECT event_id * 3 + 1, 'kernel', 4, '{X.LOCAL_HOST}', 'kernel', 'kernel: ' || event_type, true
  FROM events WHERE event_type = 'error'
UNION ALL SELECT event_id * 3 + 2, 'net', CAST(CASE WHEN user_id > 1023 THEN 13 WHEN user_id < 8 THEN user_id + 8
  ELSE user_id END AS INTEGER), 'p' || user_id, event_type, event_type, false
  FROM events WHERE event_type NOT IN ('view', 'error')"""

TENANTS = f"""tenants AS (SELECT CAST(c_custkey AS VARCHAR) AS rule_id,
  {X.tenant_selector('INTEGER')} AS selector FROM customer)"""
SQL["compile_masks"] = f"""WITH {TENANTS}, {compile_sql('tenants')}
SELECT rule_id, fac, mask FROM masks WHERE mask <> 0"""
SQL["rules_rejected"] = f"""WITH {TENANTS}, {compile_sql('tenants')}
SELECT rule_id, selector FROM tenants WHERE rule_id IN (SELECT rule_id FROM bad)"""

SQL["program_blocks"] = f"""WITH c AS (SELECT o_custkey AS config_id, o_orderkey AS line_no,
  {X.config_text('VARCHAR')} AS text FROM orders),
m AS (SELECT *, CASE WHEN regexp_matches(trim(text), '^#?!')
  THEN regexp_extract(trim(text), '^#?!\\s*([0-9A-Za-z]*)', 1) END AS mark FROM c),
f AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY config_id ORDER BY line_no
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prog FROM m)
SELECT config_id, line_no, text, nullif(prog, '') AS program FROM f
WHERE mark IS NULL AND trim(text) <> '' AND text NOT LIKE '#%'"""

SQL["route_counts"] = f"""WITH {ROUTED} SELECT rule_id, dest, sink, count(*) AS n,
  CAST(sum(seq) AS BIGINT) AS seq_sum FROM routed GROUP BY 1, 2, 3"""
SQL["route_tenants"] = f"""WITH {RECORDS}, {TENANTS}, {compile_sql('tenants')},
kinds AS (SELECT fac, sev, count(*) AS c FROM records GROUP BY 1, 2)
SELECT m.rule_id, CAST(sum(c) AS BIGINT) AS n FROM kinds k JOIN masks m ON m.fac = k.fac AND m.mask <> 16
  AND (m.mask & (1 << k.sev)) <> 0 GROUP BY 1"""
SQL["route_programs"] = f"""WITH {RECORDS}, owners AS (SELECT CAST(s_suppkey AS VARCHAR) AS rule_id,
  {X.program_rule('VARCHAR')} FROM supplier), {compile_sql('owners')}
SELECT o.rule_id, count(*) AS n, CAST(sum(r.seq) AS BIGINT) AS seq_sum FROM records r
JOIN masks m ON m.fac = r.fac AND m.mask <> 16 AND (m.mask & (1 << r.sev)) <> 0
JOIN owners o ON o.rule_id = m.rule_id AND (o.program IS NULL OR o.program = r.prog) GROUP BY 1"""
SQL["route_programs_shuffled"] = SQL["route_programs"]
SQL["default_rules"] = f"""WITH {RECORDS} SELECT rule_id, dest, count(*) AS n FROM records
JOIN (VALUES ('default-1', 'console', 3), ('default-2', '*', 0)) d(rule_id, dest, worst) ON sev <= worst
GROUP BY 1, 2"""
SQL["unrouted"] = f"""WITH {ROUTED} SELECT seq, fac, sev, prog FROM records WHERE seq NOT IN (
  SELECT seq FROM routed WHERE rule_id IN ('whole', 'groups', 'sales', 'ledger', 'exact'))"""
SQL["regex_message"] = f"""WITH {RECORDS} SELECT seq, host, msg FROM records
WHERE regexp_matches(msg, '[[:digit:]]{{3}}.*9')"""
SQL["regex_time_inverse"] = f"""WITH {RECORDS} SELECT seq, host, {stamp('ts')} AS ts FROM records
WHERE host NOT LIKE '%h1%' AND hour(ts) NOT BETWEEN 10 AND 19"""
SQL["regex_chain"] = f"""WITH {ROUTED}, kept AS (SELECT r.*, u.* EXCLUDE (rule_id, dest, sink) FROM routed r
  JOIN rules u ON u.rule_id = r.rule_id)
SELECT rule_id, count(*) AS n, CAST(sum(seq) AS BIGINT) AS seq_sum FROM kept
WHERE (message_re IS NULL OR regexp_matches(msg, message_re) <> inverse)
  AND (host_re IS NULL OR regexp_matches(host, host_re) <> inverse)
  AND (time_re IS NULL OR regexp_matches(strftime(ts, '%H:%M:%S'), time_re) <> inverse)
  AND (date_re IS NULL OR regexp_matches(strftime(ts, '%b ') || lpad(CAST(day(ts) AS VARCHAR), 2, ' '), date_re) <> inverse)
  AND (rule_id NOT IN ('loud', 'louder') OR (msg LIKE '%error%' AND regexp_matches(host, '[13579]$') AND second(ts) % 2 = 0))
  AND (rule_id <> 'louder' OR (msg NOT LIKE '%k: 1%' AND host NOT LIKE 'h1%'))
GROUP BY 1"""
SQL["drop_empty"] = "SELECT event_type AS msg, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY 1"

REPEATS = """lines AS (SELECT rule_id, date_trunc('second', ts) AS ts, event_id AS seq, 1 AS fac,
  CASE event_type WHEN 'error' THEN 3 WHEN 'click' THEN 4 WHEN 'signup' THEN 5 WHEN 'purchase' THEN 6 ELSE 7 END AS sev,
  'h' AS host, event_type AS msg FROM events JOIN (VALUES ('all', 'error'), ('all', 'click'), ('all', 'signup'),
  ('all', 'purchase'), ('all', 'view'), ('errors', 'error'), ('mixed', 'error'), ('mixed', 'click')) r(rule_id, kind)
  ON kind = event_type),
flagged AS (SELECT *, CASE WHEN lag(msg) OVER w = msg AND lag(host) OVER w = host THEN 0 ELSE 1 END AS fresh
  FROM lines WINDOW w AS (PARTITION BY rule_id ORDER BY ts, seq)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY rule_id ORDER BY ts, seq) AS run FROM flagged)"""
_RUNS = f"""WITH {REPEATS} SELECT rule_id, min(seq) AS first_seq, min(host) AS host, min(msg) AS msg, min(fac) AS fac,
  arg_min(sev, seq) AS sev, count(*) AS n, strftime(min(ts), {T}) AS first_ts, strftime(max(ts), {T}) AS last_ts
FROM numbered GROUP BY rule_id, run"""
SQL["collapse_runs"] = _RUNS
SQL["collapse_runs_bucketed"] = _RUNS

# State of the repeat timer as a list element: w = last write, s = step,
# p = pending, t = time of this or the last line, o = written so far.
_GAP = "CASE {0} WHEN 0 THEN 30 WHEN 1 THEN 120 ELSE 600 END"
SQL["collapse_emit"] = f"""WITH {REPEATS},
runs AS (SELECT rule_id, run, min(seq) AS first_seq, arg_min(sev, seq) AS sev, min(msg) AS msg,
  min(epoch(ts)::BIGINT) AS t0, list(epoch(ts)::BIGINT ORDER BY ts, seq) AS times FROM numbered GROUP BY 1, 2),
placed AS (SELECT *, lead(t0) OVER (PARTITION BY rule_id ORDER BY run) AS nxt FROM runs),
folded AS (SELECT *, list_reduce(list_transform(times[2:], lambda x:
    {{'w': 0::BIGINT, 's': 0, 'p': 0::BIGINT, 't': x, 'o': []::STRUCT(a BIGINT, b BIGINT, n BIGINT)[]}}),
  lambda z, e: list_transform([CASE WHEN z.p > 0 AND z.w + {_GAP.format('z.s')} <= e.t
      THEN {{'w': z.w + {_GAP.format('z.s')}, 's': least(z.s + 1, 2), 'p': 1::BIGINT, 't': e.t,
        'o': list_append(z.o, {{'a': z.w + {_GAP.format('z.s')}, 'b': z.t, 'n': z.p}})}}
      ELSE {{'w': z.w, 's': z.s, 'p': z.p + 1, 't': e.t, 'o': z.o}} END],
    lambda u: CASE WHEN u.t > u.w + {_GAP.format('u.s')}
      THEN {{'w': u.t, 's': least(u.s + 1, 2), 'p': 0::BIGINT, 't': u.t,
        'o': list_append(u.o, {{'a': u.t, 'b': u.t, 'n': u.p}})}} ELSE u END)[1],
  {{'w': t0, 's': 0, 'p': 0::BIGINT, 't': t0, 'o': [{{'a': t0, 'b': t0, 'n': 0::BIGINT}}]}}) AS z FROM placed),
closed AS (SELECT *, CASE WHEN z.p > 0 THEN list_append(z.o, {{'a': least(coalesce(nxt, 9999999999),
    z.w + {_GAP.format('z.s')}), 'b': z.t, 'n': z.p}}) ELSE z.o END AS o FROM folded),
written AS (SELECT *, unnest(o) AS x FROM closed)
SELECT rule_id, first_seq AS run, strftime(make_timestamp(x.a * 1000000), {T}) AS at,
  strftime(make_timestamp(x.b * 1000000), {T}) AS ts, 1 AS fac, sev, 'h' AS host,
  CASE WHEN x.n > 1 THEN 'last message repeated ' || x.n || ' times' ELSE msg END AS msg, x.n AS n FROM written"""
SQL["collapse_stream"] = SQL["collapse_emit"]
SQL["collapse_off"] = f"""WITH {REPEATS} SELECT rule_id, msg, count(*) AS n, CAST(sum(seq) AS BIGINT) AS s
FROM lines GROUP BY 1, 2"""
SQL["output_gaps"] = f"""WITH {REPEATS}, g AS (SELECT rule_id, ts, lag(ts) OVER (PARTITION BY rule_id ORDER BY ts, seq) AS p FROM lines)
SELECT rule_id, strftime(p, {T}) AS silent_from, strftime(ts, {T}) AS silent_to,
  date_diff('second', p, ts) AS seconds FROM g WHERE date_diff('second', p, ts) >= 3600"""
SQL["marks_due"] = f"""WITH {ROUTED}, ticks AS (SELECT m.rule_id, u.dest, t.tick FROM masks m JOIN rules u ON u.rule_id = m.rule_id,
  range(TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-31 00:00:01', INTERVAL 20 MINUTE) t(tick)
  WHERE m.fac = 24 AND (m.mask & 64) <> 0)
SELECT rule_id, dest, strftime(tick, {T}) AS ts, 24 AS fac, 6 AS sev, '{X.LOCAL_HOST}' AS host, '-- MARK --' AS msg
FROM ticks k WHERE NOT EXISTS (SELECT 1 FROM routed r WHERE r.rule_id = k.rule_id AND r.ts <= k.tick
  AND r.ts > k.tick - INTERVAL 10 MINUTE)"""
SQL["marks_odd"] = f"""WITH {ROUTED}, ticks AS (SELECT m.rule_id, u.dest, t.tick FROM masks m JOIN rules u ON u.rule_id = m.rule_id,
  range(TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-31 00:00:01', INTERVAL 1201 SECOND) t(tick)
  WHERE m.fac = 24 AND (m.mask & 64) <> 0)
SELECT rule_id, dest, strftime(tick, {T}) AS ts FROM ticks k WHERE NOT EXISTS (SELECT 1 FROM routed r
  WHERE r.rule_id = k.rule_id AND r.ts <= k.tick AND r.ts >= k.tick - INTERVAL 600 SECOND)"""
SQL["diagnostics_records"] = f"""WITH {TENANTS}, {compile_sql('tenants')}, {RAW}
SELECT CAST(rule_id AS BIGINT) AS seq, '2024-06-01 00:00:00' AS ts, 43 AS pri, '{X.LOCAL_HOST}' AS host,
  'syslogd' AS prog, 'syslogd: unknown name in selector "' || selector || '" of rule ' || rule_id AS msg
FROM tenants WHERE rule_id IN (SELECT rule_id FROM bad)
UNION ALL SELECT seq, '2024-06-01 00:00:00', 43, '{X.LOCAL_HOST}', 'syslogd',
  'syslogd: no text after the host in "' || split_part(line, ' signup', 1) || '"' FROM raw WHERE line LIKE '% signup[%'"""

SQL["file_lines"] = f"""WITH {ROUTED} SELECT dest, seq, {HEADER.format('ts')} || ' ' || host || ' ' || msg AS value
FROM routed"""
SQL["forward_lines"] = f"""WITH {ROUTED} SELECT dest, '<' || pri || '>' || {HEADER.format('ts')} || ' ' || host || ' ' || msg
  || chr(10) AS value, count(*) AS n FROM routed WHERE sink = 'forward' GROUP BY 1, 2"""
SQL["log_table"] = f"""WITH {ROUTED}, {SEV_NAMES}
SELECT f.facility, s.priority, strftime(ts, '%Y-%m-%d') AS date, host, count(*) AS n,
  min(strftime(ts, '%H:%M:%S')) AS first_time, max(msg) AS last_message
FROM routed r LEFT JOIN fac_names f ON f.fac = r.fac LEFT JOIN sev_names s ON s.sev = r.sev
WHERE sink = 'table' GROUP BY 1, 2, 3, 4"""
# facilities 12 to 15 have no name and are shown as numbers
SQL["log_table"] = SQL["log_table"].replace("SELECT f.facility,", "SELECT coalesce(f.facility, CAST(r.fac * 8 AS VARCHAR)) AS facility,")
SQL["log_table_plain"] = f"""WITH {ROUTED} SELECT strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H:%M:%S') AS time, host,
  msg AS message FROM routed"""
SQL["log_table_ts"] = f"""WITH {ROUTED}, {SEV_NAMES},
k AS (SELECT ts, host, msg, arg_min(fac, seq) AS fac, arg_min(sev, seq) AS sev FROM routed WHERE sink = 'table' GROUP BY 1, 2, 3)
SELECT coalesce(f.facility, CAST(k.fac * 8 AS VARCHAR)) AS facility, s.priority, {stamp('ts')} AS timestamp, host, msg AS message
FROM k LEFT JOIN fac_names f ON f.fac = k.fac LEFT JOIN sev_names s ON s.sev = k.sev"""
SQL["log_table_seq"] = f"""WITH {RECORDS} SELECT row_number() OVER (ORDER BY ts, seq) AS seq, strftime(ts, '%Y-%m-%d') AS date,
  strftime(ts, '%H:%M:%S') AS time, host, msg AS message FROM records"""
SQL["sql_export"] = """SELECT 'INSERT INTO syslog (host, message) VALUES(' || CASE WHEN page_id % 5 = 0 THEN 'NULL' ELSE '''' || replace(replace(replace(replace(replace(url,
  '\\', '\\\\'), '''', '\\'''), '"', '\\"'), chr(10), '\\' || chr(10)), chr(13), '\\' || chr(13)) || '''' END || ', ''' ||
  replace(replace(replace(replace(replace(html, '\\', '\\\\'), '''', '\\'''), '"', '\\"'), chr(10), '\\' || chr(10)),
  chr(13), '\\' || chr(13)) || ''')' AS value FROM pages"""
SQL["lookup"] = f"""WITH {RECORDS}, {FAC_NAMES}, {SEV_NAMES}
SELECT coalesce(f.facility, CAST(r.fac * 8 AS VARCHAR)) AS facility, s.priority, strftime(ts, '%Y-%m-%d') AS date,
  strftime(ts, '%H:%M:%S') AS time, host, msg AS message
FROM records r LEFT JOIN fac_names f ON f.fac = r.fac LEFT JOIN sev_names s ON s.sev = r.sev
WHERE ts >= TIMESTAMP '2024-01-10 06:00:00' AND ts < TIMESTAMP '2024-01-10 18:00:00' AND msg LIKE 'view%'"""
SQL["lookup_indexed"] = f"""WITH {RECORDS}, {FAC_NAMES}, {SEV_NAMES}, asked AS (
  SELECT 'host' AS ask, * FROM records WHERE host = 'h7'
  UNION ALL SELECT 'start' AS ask, * FROM records WHERE starts_with(msg, 'purchase[1')
  UNION ALL SELECT 'all' AS ask, * FROM records WHERE ts >= TIMESTAMP '2024-01-10 06:00:00'
    AND ts < TIMESTAMP '2024-01-10 18:00:00' AND host = 'h3' AND starts_with(msg, 'view'))
SELECT ask, coalesce(f.facility, CAST(r.fac * 8 AS VARCHAR)) AS facility, s.priority, strftime(ts, '%Y-%m-%d') AS date,
  strftime(ts, '%H:%M:%S') AS time, host, msg AS message
FROM asked r LEFT JOIN fac_names f ON f.fac = r.fac LEFT JOIN sev_names s ON s.sev = r.sev"""
SQL["lost_report"] = f"""WITH {ROUTED} SELECT '2024-06-01 00:00:00' AS ts, 5 AS fac, 3 AS sev, 43 AS pri,
  '{X.LOCAL_HOST}' AS host, 'syslogd' AS prog,
  'syslogd: ' || count(*) || ' records not delivered to ' || sink AS msg FROM routed GROUP BY sink"""
SQL["volume_20min"] = f"""WITH {ROUTED} SELECT strftime(time_bucket(INTERVAL 20 MINUTE, ts), {T}) AS slot, dest, count(*) AS n
FROM routed GROUP BY 1, 2"""
SQL["header_text"] = f"""SELECT {HEADER.format('o_orderdate')} AS header, strftime(o_orderdate, '%Y-%m-%d') AS date,
  strftime(o_orderdate, '%H:%M:%S') AS time, count(*) AS n FROM orders GROUP BY 1, 2, 3"""
SQL["text_helpers"] = """SELECT page_id, replace(url, '/', '.') AS chain, lower(hex(url)) AS hex, url AS back,
  regexp_replace(url, '(http)s?://', '\\1:', 'g') AS changed FROM pages"""
SQL["notify_fanout"] = """WITH alerts AS (SELECT event_id AS seq, value > 95 AS everyone,
  'Customer#' || lpad(CAST(user_id AS VARCHAR), 9, '0') AS u1,
  'Customer#' || lpad(CAST(user_id * 7 % 150 AS VARCHAR), 9, '0') AS u2 FROM events WHERE event_type = 'error'),
sessions AS (SELECT c_name AS "user", 'tty' || c_custkey AS terminal FROM customer WHERE c_custkey % 5 > 1),
told AS (SELECT s."user", s.terminal, a.seq FROM alerts a JOIN sessions s ON NOT a.everyone AND s."user" = a.u1
  UNION ALL SELECT s."user", s.terminal, a.seq FROM alerts a JOIN sessions s ON NOT a.everyone AND s."user" = a.u2 AND a.u1 <> a.u2
  UNION ALL SELECT s."user", s.terminal, a.seq FROM alerts a JOIN sessions s ON a.everyone)
SELECT "user", terminal, count(*) AS n, CAST(sum(seq) AS BIGINT) AS seq_sum FROM told GROUP BY 1, 2"""
# Which line is bad follows from what was done to the logs: a changed line is
# found itself, a missing one by the line after it.
TAMPERED = """c AS (SELECT conv_id, turn, conv_id % 7 = 2 AND turn = 1 AS gone,
  conv_id % 3 = 1 AND turn = conv_id % 4 AS changed FROM conversations),
v AS (SELECT conv_id, min(CASE WHEN NOT gone AND (changed OR (turn > 1 AND conv_id % 7 = 2)) THEN turn END) AS bad_line,
  max(gone OR changed) AS touched, count(*) FILTER (NOT gone) AS lines FROM c GROUP BY conv_id)"""
SQL["verify"] = f"""WITH {TAMPERED} SELECT CAST(conv_id AS VARCHAR) AS log_id, CAST(touched AS INTEGER) AS status,
  bad_line, lines FROM v"""
SQL["verify_without_macs"] = f"""WITH {TAMPERED} SELECT CAST(conv_id AS VARCHAR) AS log_id,
  CAST(touched AS INTEGER) AS status, lines FROM v"""
SQL["first_corrupt_line"] = f"""WITH {TAMPERED} SELECT CAST(conv_id AS VARCHAR) AS log_id, bad_line
FROM v WHERE bad_line IS NOT NULL"""
SQL["protect_chain"] = """WITH RECURSIVE lines AS (SELECT conv_id, turn, hex(text) AS h, strlen(text) AS n FROM conversations),
chain AS (SELECT DISTINCT conv_id, CAST(-1 AS BIGINT) AS turn, CASE conv_id % 2 WHEN 0 THEN sha1('seed-' || conv_id)
    ELSE md5('seed-' || conv_id) END AS k FROM conversations
  UNION ALL SELECT conv_id, turn, CASE conv_id % 2 WHEN 0 THEN sha1(unhex(x)) ELSE md5(unhex(x)) END FROM (
    SELECT c.conv_id, l.turn, array_to_string(list_transform(
      range(0, CASE WHEN n = 0 THEN strlen(k) // 2 WHEN n > strlen(k) // 2
        THEN (n + strlen(k) // 2 - 1) // (strlen(k) // 2) * (strlen(k) // 2)
        ELSE (strlen(k) // 2 + n - 1) // n * n END),
      lambda i: printf('%02x', xor(('0x' || substr(k, 2 * (i % (strlen(k) // 2)) + 1, 2))::INT,
        CASE WHEN n = 0 THEN 0 ELSE ('0x' || substr(h, 2 * (i % n) + 1, 2))::INT END))), '') AS x
    FROM chain c JOIN lines l ON l.conv_id = c.conv_id AND l.turn = c.turn + 1))
SELECT CAST(conv_id AS VARCHAR) AS log_id, turn AS line_no, k AS key FROM chain WHERE turn >= 0"""

# the keyed XOR of the chain once more, with the key before each line
SQL["protect"] = SQL["protect_chain"].rsplit("SELECT CAST(conv_id", 1)[0] + """,
inner_x AS (SELECT c.conv_id, l.turn, array_to_string(list_transform(
      range(0, CASE WHEN n = 0 THEN strlen(k) // 2 WHEN n > strlen(k) // 2
        THEN (n + strlen(k) // 2 - 1) // (strlen(k) // 2) * (strlen(k) // 2)
        ELSE (strlen(k) // 2 + n - 1) // n * n END),
      lambda i: printf('%02x', xor(('0x' || substr(k, 2 * (i % (strlen(k) // 2)) + 1, 2))::INT,
        CASE WHEN n = 0 THEN 0 ELSE ('0x' || substr(h, 2 * (i % n) + 1, 2))::INT END))), '') AS x
  FROM chain c JOIN lines l ON l.conv_id = c.conv_id AND l.turn = c.turn + 1)
SELECT CAST(c.conv_id AS VARCHAR) AS log_id, c.turn AS line_no, sha1(unhex(x)) AS "inner", 20 AS mac_bytes, k AS key
FROM chain c JOIN inner_x i ON i.conv_id = c.conv_id AND i.turn = c.turn"""

SQL["protect_segments"] = f"""WITH RECURSIVE {RECORDS},
lines AS (SELECT seq // 500 AS part, row_number() OVER (PARTITION BY seq // 500 ORDER BY seq) - 1 AS turn,
  hex(t) AS h, strlen(t) AS n FROM (SELECT seq, {HEADER.format('ts')} || ' ' || host || ' ' || msg AS t FROM records)),
chain AS (SELECT DISTINCT part, CAST(-1 AS BIGINT) AS turn, sha1('seed-hot|' || part) AS k FROM lines
  UNION ALL SELECT part, turn, sha1(unhex(x)) FROM (SELECT c.part, l.turn, array_to_string(list_transform(
      range(0, CASE WHEN n = 0 THEN strlen(k) // 2 WHEN n > strlen(k) // 2
        THEN (n + strlen(k) // 2 - 1) // (strlen(k) // 2) * (strlen(k) // 2)
        ELSE (strlen(k) // 2 + n - 1) // n * n END),
      lambda i: printf('%02x', xor(('0x' || substr(k, 2 * (i % (strlen(k) // 2)) + 1, 2))::INT,
        CASE WHEN n = 0 THEN 0 ELSE ('0x' || substr(h, 2 * (i % n) + 1, 2))::INT END))), '') AS x
    FROM chain c JOIN lines l ON l.part = c.part AND l.turn = c.turn + 1))
SELECT 'hot|' || part AS log_id, max_by(k, turn) AS last_key FROM chain GROUP BY part"""

SQL["regex_rejected"] = f"""SELECT s_suppkey AS seq, 43 AS pri, '{X.LOCAL_HOST}' AS host,
  'syslogd: no valid pattern "' || {X.BAD_PATTERNS} || '" in rule ' || s_suppkey AS msg FROM supplier WHERE s_suppkey % 9 < 5"""

# the patterns look for one number before a brace; the last four kinds of the others as they are meant
SQL["regex_many"] = f"""WITH {RECORDS}, hits AS (SELECT r.seq, r.msg, 1 + r.seq % 100 AS rule_id,
  s.s_suppkey IS NULL AS free, s.s_suppkey % 7 = 3 AS odd, s.s_suppkey % 9 AS kind, s.s_suppkey % 2 = 0 AS inverse,
  r.msg LIKE '%k": ' || CAST(s.s_suppkey % 90 AS VARCHAR) || '}}%' AS plain
  FROM records r LEFT JOIN supplier s ON s.s_suppkey = 1 + r.seq % 100),
tested AS (SELECT *, CASE WHEN NOT odd THEN plain WHEN kind = 5 THEN contains(msg, '[') WHEN kind = 6 THEN contains(msg, 'k {{x')
  WHEN kind = 7 THEN contains(msg, ']') OR contains(msg, '&') OR contains(msg, 'a') ELSE regexp_matches(msg, '[^0-9]{{2,3}}') END AS hit FROM hits)
SELECT CAST(rule_id AS VARCHAR) AS rule_id, count(*) AS n, CAST(sum(seq) AS BIGINT) AS seq_sum FROM tested
WHERE free OR (NOT (odd AND kind < 5) AND hit <> inverse) GROUP BY 1"""

SQL["lookup_table"] = SQL["lookup"]
SQL["followed_lines"] = f"""WITH {RAW} SELECT line, count(*) AS n, count(*) AS places FROM raw GROUP BY 1"""
SQL["regex_grammar"] = f"""WITH {RECORDS}, asks AS (SELECT CAST(c_custkey AS VARCHAR) AS rule_id, c_custkey % 3 AS g,
  c_custkey % 4 = 0 AS by_host, c_custkey % 5 = 0 AS inverse, {X.grammar(False, 'VARCHAR')} AS p FROM customer),
kinds AS (SELECT DISTINCT p FROM asks), msgs AS (SELECT DISTINCT msg FROM records),
hits AS (SELECT p, msg, regexp_matches(msg, p) AS hit FROM kinds, msgs)
SELECT rule_id, count(*) AS n, CAST(sum(seq) AS BIGINT) AS seq_sum FROM records r
JOIN asks a ON r.sev <= 6 AND (r.fac = 4 OR r.fac = 16 + a.g) JOIN hits h ON h.p = a.p AND h.msg = r.msg
WHERE h.hit <> a.inverse AND (NOT by_host OR regexp_matches(r.host, '^h[0-9]$') <> a.inverse) GROUP BY 1"""
SQL["committed_batches"] = f"""WITH {ROUTED} SELECT rule_id, dest, count(*) AS n, CAST(sum(seq) AS BIGINT) AS seq_sum
FROM routed WHERE sink = 'forward' GROUP BY 1, 2"""
SQL["saved_and_replayed"] = f"""WITH {ROUTED}, places AS (SELECT seq,
  row_number() OVER (PARTITION BY seq % 2 ORDER BY ts, seq) AS place FROM routed WHERE sink = 'forward')
SELECT seq, count(*) AS n, min(place) AS first, max(place) AS last FROM places GROUP BY 1"""
SQL["log_table_ts_batches"] = SQL["log_table_ts"]
SQL["actions_fanout"] = f"""WITH {RECORDS}, owners AS (SELECT CAST(s_suppkey AS VARCHAR) AS rule_id, s_suppkey AS k,
  {X.program_rule('VARCHAR')} FROM supplier), {compile_sql('owners')},
acts AS (SELECT rule_id, program, unnest(CASE WHEN k % 3 = 0 THEN [{{sink: 'file', dest: 'all'}},
  {{sink: 'forward', dest: 'relay' || CAST(k % 5 AS VARCHAR)}}] ELSE [{{sink: 'table', dest: 'log'}}] END) AS a FROM owners)
SELECT o.rule_id, a.sink AS sink, a.dest AS dest, count(*) AS n, CAST(sum(r.seq) AS BIGINT) AS seq_sum FROM records r
JOIN masks m ON m.fac = r.fac AND m.mask <> 16 AND (m.mask & (1 << r.sev)) <> 0
JOIN acts o ON o.rule_id = m.rule_id AND (o.program IS NULL OR o.program = r.prog) GROUP BY 1, 2, 3"""
SQL["registered_parts"] = f"""WITH {RECORDS} SELECT host, count(*) AS n, CAST(sum(seq) AS BIGINT) AS seq_sum FROM records
WHERE NOT contains(msg, 'view') AND regexp_matches(host, '[02468]$') GROUP BY 1"""
SQL["verify_parts"] = SQL["verify"]
