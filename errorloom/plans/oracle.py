"""For every registered query the same result in plain SQL, for DuckDB."""

from errorloom import fixtures as fx
from errorloom.golden_agents import AOL_AGENT, AOL_VERSION, GOLDEN_AGENTS
from errorloom.operators.beacons import SCREENED_KEYWORDS
from errorloom.plans.registered import FILE


def _literal(value):
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return str(value).lower()


def _values(rows):
    return "values " + ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)


K = "cast(json_extract_string(props, '$.k') as int)"

REPORTS = f"""
reports as (
    select event_id + 1 as id,
           concat('http://cdn.example.com/js/', event_type, '.js') as file,
           {K} as line,
           concat('Uncaught ', event_type, ' failure ', cast(user_id % 4 as varchar)) as message,
           user_id % 7 + 1 as browser,
           cast(case when event_id % 11 = 0 then 1 else 0 end as int) as status,
           ts as date,
           {fx.FIRST_IP} + user_id as ip,
           case user_id % 3 when 0 then 'Windows' when 1 then 'Linux' else 'Apple' end as platform
    from events)"""

BROWSERS = f"""
browsers(id, type, version) as (
    {_values(fx.KNOWN_BROWSERS)})"""


def _dotted(ip):
    return " || '.' || ".join(f"(({ip} >> {shift}) & 255)" for shift in (24, 16, 8, 0))


# Open reports with their browser.
FEED = f"""{REPORTS}, {BROWSERS},
feed as (
    select r.id, r.file, r.line, r.message, r.date, r.status, r.platform, r.browser as browser_id,
           coalesce(b.type, 'unknown') as type, coalesce(b.version, 'unknown') as version,
           {_dotted('r.ip')} as ip,
           md5(concat(r.message, cast(r.line as varchar))) as hash
    from reports r left join browsers b on r.browser = b.id
    where r.status = 0)"""

# The raw requests before their address is read. The query string is plain enough to be read
# with split_part and replace.
BEACONS = """
beacons as (
    select event_id + 1 as id, ts as received_at, event_id, event_type, user_id,
           event_id % {agents} as ua_id,
           concat('message=Uncaught%20', event_type, '%20failure%20', cast(user_id % 4 as varchar),
                  '&url=http%3A%2F%2Fcdn.example.com%2Fjs%2F', event_type, '.js&line=',
                  cast(event_id % 120 as varchar)) as query_string,
           case event_id % 10
               when 0 then concat('10.1.', cast(user_id % 250 as varchar), '.9, 203.0.113.7')
               when 1 then 'unknown'
               when 2 then 'fe80::1'
               when 3 then concat('10.2.0.', cast(user_id % 250 as varchar)) end as xff,
           concat('192.0.2.', cast(user_id % 250 as varchar)) as remote_addr
    from events)""".format(agents=len(GOLDEN_AGENTS))

DECODED = f"""{BEACONS},
decoded as (
    select *, url_decode(split_part(split_part(query_string, '&', 1), '=', 2)) as message,
           url_decode(split_part(split_part(query_string, '&', 2), '=', 2)) as file,
           cast(split_part(split_part(query_string, '&', 3), '=', 2) as int) as line
    from beacons)"""

QUAD = "([0-9]+[.][0-9]+[.][0-9]+[.][0-9]+)"
OCTET = "cast(split_part(quads[1], '.', {}) as bigint)"
ADDRESSED = f"""{DECODED},
addressed as (
    select *, list_distinct(quads) as distinct_quads,
           array_to_string(quads, '') as ip_text,
           {OCTET.format(1)} * 16777216 + {OCTET.format(2)} * 65536
               + {OCTET.format(3)} * 256 + {OCTET.format(4)} as ip
    from (select *, regexp_extract_all(
              case when xff is not null and lower(xff) not in ('', '0', 'unknown') then xff
                   else remote_addr end, '{QUAD}', 1) as quads
          from decoded))"""

GOLDEN = f"""
golden(ua_id, type, version, platform, is_mobile, is_robot) as (
    {_values((number, *row[1:]) for number, row in enumerate(GOLDEN_AGENTS))})"""

# Accepted events with their browser, and the dimension after they came in.
INGESTED = f"""{ADDRESSED}, {GOLDEN}, {{known}},
arrived as (
    select a.*, g.type, g.version, g.platform
    from addressed a join golden g using (ua_id) where a.ip is not null),
pairs as (
    select lower(type) as type_key, lower(version) as version_key,
           arg_min(type, id) as type, arg_min(version, id) as version,
           min(id) as first_id, min(received_at) as date
    from arrived group by all),
fresh as (
    select (select coalesce(max(id), 0) from browsers) + first_id as id, p.type, p.version, p.date,
           type_key, version_key
    from pairs p
    where not exists (select 1 from browsers b
                      where lower(b.type) = type_key and lower(b.version) = version_key)),
every as (
    select id, type_key, version_key from fresh
    union all
    select min(id), lower(type), lower(version) from browsers group by all),
stored as (
    select a.id, a.file, a.line, a.message, e.id as browser, cast(0 as int) as status,
           a.received_at as date, a.ip, a.platform, a.type, a.version
    from arrived a join every e
      on lower(a.type) = e.type_key and lower(a.version) = e.version_key)"""

FROM_EMPTY = INGESTED.format(
    known="browsers as (select 0 as id, '' as type, '' as version where false)"
)
FROM_KNOWN = INGESTED.format(known=BROWSERS)

MESSAGE_SUMMARY = """
    select hash, arg_max(message, id) as message, arg_max(file, id) as file,
           arg_max(line, id) as line, arg_max(type, id) as type, arg_max(version, id) as version,
           arg_max(platform, id) as platform, count(*) as times,
           case when count(*) >= 3 then 'danger' else 'warning' end as severity,
           min(id) as first_id, min(date) as first_report, max(date) as last_report,
           date_trunc('hour', min(date)) as first_hour, date_trunc('hour', max(date)) as last_hour
    from {source} group by hash"""

BROWSER_SUMMARY = """
    select type, count(*) as times, count(distinct version) as versions, min(id) as first_id,
           min(date) as first_report, max(date) as last_report
    from {source} group by type"""

VERSIONS = """
    select type, version, count(*) as times, min(id) as first_id,
           min(date) as first_report, max(date) as last_report
    from {source} group by type, version"""

SCRIPT_SUMMARY = """
    select file, count(*) as times, min(id) as first_id,
           min(date) as first_report, max(date) as last_report
    from {source} group by file"""

HASHED_STORED = f"""{FROM_EMPTY},
hashed as (
    select *, md5(concat(message, cast(line as varchar))) as hash from stored)"""

UNTRUSTED = f"""
untrusted as (
    select event_id + 1 as id, event_id, user_id, {K} as k,
           case event_id % 5 when 0 then event_type when 1 then 'x;y' when 2 then 'Union'
                when 3 then 'reunion' else '　' end as a,
           case event_id % 4 when 1 then concat('x', {K}) when 2 then cast({K} as varchar)
                when 3 then concat({K}, '.5') end as n
    from events)"""

# Each digit of a signed key and its mask.
MASKED = "p || t || f"
for _digit, _mask in (("1", "Dp"), ("2", "eF"), ("3", "jw"), ("4", "Kn"), ("5", "iq"), ("6", "oz")):
    MASKED = f"replace({MASKED}, '{_digit}', '{_mask}')"


def _coded(text):
    code = f"base64(encode({text}))"
    return f"reverse(left({code}, length({code}) - 2))"


SIGNED = f"""
signed as (
    select event_id + 1 as id, event_id, cast(event_id as varchar) as p,
           cast(user_id as varchar) as t, event_type as f,
           cast(user_id + case when event_id % 6 = 1 then 1 else 0 end as varchar) as sent_t,
           {_coded("translate(cast(event_id + 1700000000 as varchar), '0123456789', 'FiReNdLSyu')")} as k
    from events),
timed as (
    select *, translate(decode(from_base64(reverse(k) || '==')), 'FiReNdLSyu', '0123456789') as time
    from signed),
codes as (
    select id, event_id,
           {_coded(MASKED + ' || time')} as cr,
           {_coded(MASKED.replace('p || t || f', 'p || sent_t || f') + ' || time')} as expected
    from timed)"""


def _with(ctes, body):
    return f"with {ctes.strip()} {body.strip()}"


def _keyword_tests(column):
    return " or ".join(f"contains({column}, {_literal(word)})" for word in SCREENED_KEYWORDS)


CLIENTS = """
    select ip, count(*) as times, min(date) as first_report, max(date) as last_report
    from feed where {where} group by ip"""

FIXED = """message = 'Uncaught click failure 0' and line < 50"""
FIXED_HASHES = f"""{REPORTS},
marked as (select *, md5(concat(message, cast(line as varchar))) as hash from reports),
fixed as (select distinct hash from marked where {FIXED})"""

# Half of the events came in before some errors were fixed; others were deleted after all came in.
RESOLVED = f"""{HASHED_STORED},
marked as (
    select *, id - 1 <= (select min(event_id) + (max(event_id) - min(event_id)) // 2 from events) as early from hashed),
fixed as (select distinct hash from marked where early and {FIXED}),
dropped as (select distinct hash from marked where message = 'Uncaught click failure 1' and line >= 100),
left_over as (
    select *, early and hash in (select hash from fixed) as is_fixed
    from marked where hash not in (select hash from dropped))"""

# Masks and the tree of templates, written out: two leading words, a fifth of a leaf's reports.
SHAPED = f"""
varied as (
    select event_id + 1 as id, ts as date,
           case event_id % 4
               when 0 then concat('Cannot read property "p', user_id, '" of null at line ', event_id % 50)
               when 1 then concat('Uncaught ', event_type, ' failure ', user_id % 4)
               when 2 then concat('user name ', translate(cast(user_id as varchar), '0123456789', 'abcdefghij'),
                                  ' was not found in ', event_type)
               else concat('Timeout of ', {K}, ' ms while loading http://cdn.example.com/', event_type, '.js') end as message
    from events where event_id % 11 <> 0),
shaped as (
    select *, row_number() over () as row, len(words) as n, array_to_string(words[1:2], ' ') as head
    from (select *, list_filter(string_split_regex(
              regexp_replace(regexp_replace(regexp_replace(message, '"[^"]*"', '<text>', 'g'),
                  '[a-z]+://[^ ]+', '<url>', 'g'), '[0-9]+', '<n>', 'g'), ' +'), lambda w: w <> '') as words
          from varied)),
placed as (select row, n, head, unnest(range(1, len(words) + 1)) as place, unnest(words) as word from shaped),
frequent as (
    select n, head, place, word, count(*) as times,
           (select count(*) from shaped s where s.n = placed.n and s.head = placed.head) as total
    from placed group by n, head, place, word),
filled as (
    select p.row, string_agg(case when p.place <= 2 or f.times >= 0.2 * f.total then p.word else '<*>' end, ' ' order by p.place) as template
    from placed p join frequent f on p.n = f.n and p.head = f.head and p.place = f.place and p.word = f.word
    group by p.row)"""

ORACLE = {
    "open_reports": _with(
        FEED,
        "select id, file, line, message, date, type, version, status, ip, platform, hash from feed",
    ),
    "feed_json": _with(
        FEED,
        """select id, cast(json_object('id', cast(id as varchar), 'file', file,
                  'line', cast(line as varchar), 'message', message,
                  'date', strftime(date, '%Y-%m-%d %H:%M:%S'),
                  'browser', json_object('type', type, 'version', version),
                  'status', cast(status as varchar), 'ip', ip, 'platform', platform,
                  'hash', hash) as varchar) as json from feed""",
    ),
    "display_labels": _with(
        FEED,
        """select id, case when lower(type) = 'internet explorer' then 'ie' else lower(type) end
                  as icon_key, file || ':' || line as location,
                  type || ' ' || version as browser_label from feed""",
    ),
    "report_count": _with(REPORTS, "select count(*) as n from reports where status = 0"),
    "epoch_times": _with(REPORTS, "select id, epoch_us(date) // 1000 as millis from reports"),
    "message_counts": _with(
        FEED,
        """select hash, count(*) as times, min(id) as first_id, min(date) as first_report,
                  max(date) as last_report from feed group by hash""",
    ),
    "message_summary": _with(FEED, MESSAGE_SUMMARY.format(source="feed")),
    "message_age": _with(
        FEED,
        f"""select hash,
                   date_diff('hour', date_trunc('hour', min(date)), timestamp '{fx.AS_OF}') as age_hours,
                   date_diff('hour', date_trunc('hour', max(date)), timestamp '{fx.AS_OF}')
                       as last_age_hours,
                   date_sub('hour', min(date), max(date)) as active_hours
            from feed group by hash""",
    ),
    "browser_summary": _with(FEED, BROWSER_SUMMARY.format(source="feed")),
    "browser_display": _with(
        FEED,
        """select min(id) as first_id,
                  case when lower(type) = 'internet explorer' then 'ie' else lower(type) end as icon_key,
                  count(*) || ' (' || count(distinct version) || ' vers)' as submissions
           from feed group by type""",
    ),
    "browser_summary_since_newest": _with(
        f"""{FEED},
        starts as (select type, version, min(id) as start from feed group by all),
        cuts as (select type, max(start) as cut from starts group by type)""",
        """select type, count(*) as times, count(distinct version) as versions, min(id) as first_id,
                  min(date) filter (where id >= cut) as first_report,
                  max(date) filter (where id >= cut) as last_report
           from feed join cuts using (type) group by type""",
    ),
    "browser_versions": _with(FEED, VERSIONS.format(source="feed")),
    "browser_versions_one": _with(
        FEED, VERSIONS.format(source="feed").replace("group by", "where type = 'Chrome' group by")
    ),
    "browser_by_name": _with(
        FEED, "select id, type, hash from feed where lower(type) = 'internet explorer'"
    ),
    "script_summary": _with(FEED, SCRIPT_SUMMARY.format(source="feed")),
    "script_details": _with(
        FEED,
        f"""select id, type || ' ' || version as browser_label, line, message, platform
            from feed where file = {_literal(FILE)}""",
    ),
    "decoded_beacons": _with(DECODED, "select id, message, file, line from decoded"),
    "encoded_beacons": _with(
        REPORTS, "select id, url_encode(message) as message, url_encode(file) as url from reports"
    ),
    "client_ip": _with(ADDRESSED, "select id, ip_text, ip from addressed"),
    "client_ip_strict": _with(
        ADDRESSED,
        "select id, case when len(distinct_quads) = 1 then ip end as ip from addressed",
    ),
    "ingest_rejects": _with(
        ADDRESSED,
        """select id, received_at as date, ip, 'ip' as reject_reason
           from addressed where ip is null""",
    ),
    "screen_keywords": _with(
        UNTRUSTED,
        f"""select id, case when {_keyword_tests('a')} then 'keyword' else 'ok' end as verdict
            from untrusted""",
    ),
    "range_check": _with(
        UNTRUSTED,
        """select id, case when try_cast(n as double) between 10 and 60 then n else '0' end as verdict
           from untrusted""",
    ),
    "verify_signed": _with(
        SIGNED,
        """select id, case when event_id % 6 <> 0 and cr = expected then 'valid' else 'invalid' end
                  as verdict from codes""",
    ),
    "ua_type": _with(
        f"{BEACONS}, {GOLDEN}",
        "select event_id, type, version from beacons join golden using (ua_id)",
    ),
    "ua_platform": _with(
        f"{BEACONS}, {GOLDEN}", "select event_id, platform from beacons join golden using (ua_id)"
    ),
    "ua_flags": _with(
        f"{BEACONS}, {GOLDEN}",
        f"""select event_id, is_mobile, is_robot, ua_id = {AOL_AGENT} as is_aol,
                   case when ua_id = {AOL_AGENT} then '{AOL_VERSION}' else 'unknown' end as aol_version,
                   false as is_chromeframe
            from beacons join golden using (ua_id)""",
    ),
    "ua_rules_by_row": _with(
        f"{BEACONS}, {GOLDEN}",
        "select event_id, type, version, platform from beacons join golden using (ua_id)",
    ),
    "new_browsers": _with(FROM_KNOWN, "select id, type, version, date from fresh"),
    "facts_with_browser_id": _with(FROM_KNOWN, "select id, browser from stored"),
    "geo_enriched": _with(
        f"""{REPORTS},
        ranges as (
            select {fx.FIRST_IP} + c_custkey * 8 as ip_start, {fx.FIRST_IP} + c_custkey * 8 + 5 as ip_end,
                   'nation ' || c_nationkey as location
            from customer)""",
        """select r.id, g.location from reports r
           left join ranges g on r.ip between g.ip_start and g.ip_end""",
    ),
    "geo_enriched_nested": _with(
        f"""{REPORTS},
        ranges as (
            select {fx.FIRST_IP} + (l_orderkey * 7 + l_linenumber) % 30000 as ip_start,
                   {fx.FIRST_IP} + 65535 - (l_orderkey * 7 + l_linenumber) % 30000 as ip_end,
                   max('order ' || l_orderkey) as location
            from lineitem group by all),
        best as (
            select ip, max(ip_start) as ip_start
            from (select distinct ip from reports) join ranges on ip between ip_start and ip_end group by ip)""",
        """select r.id, g.location from reports r
           left join best b on r.ip = b.ip left join ranges g on b.ip_start = g.ip_start""",
    ),
    "ua_chromeframe": _with(BEACONS, "select event_id, id % 5 = 0 as is_chromeframe from beacons"),
    "message_templates": _with(
        SHAPED,
        """select template, count(*) as times, min(id) as first_id, max(id) as last_id, min(date) as first_report,
                  max(date) as last_report, count(distinct message) as messages
           from shaped join filled using (row) group by template""",
    ),
    "ingested_reports": _with(
        FROM_EMPTY, "select id, file, line, message, browser, status, date, ip, platform from stored"
    ),
    "ingested_browsers": _with(FROM_EMPTY, "select id, type, version, date from fresh"),
    "written_reports": _with(FROM_EMPTY, VERSIONS.format(source="stored")),
    "stream_equals_batch": _with(HASHED_STORED, MESSAGE_SUMMARY.format(source="hashed")),
    "compacted_summary": _with(HASHED_STORED, MESSAGE_SUMMARY.format(source="hashed")),
    "compacted_reports": _with(
        FROM_EMPTY, "select id, file, line, message, browser, status, date, ip, platform from stored"
    ),
    "load_then_stream": _with(HASHED_STORED, MESSAGE_SUMMARY.format(source="hashed")),
    "ingest_outcomes": _with(
        f"{ADDRESSED}, {SIGNED}",
        """select a.id, case when len(distinct_quads) <> 1 then 'ip' when a.id % 7 = 0 then 'keyword'
                            when c.event_id % 6 = 0 or cr <> expected then 'signature' else 'accepted' end as outcome
           from addressed a join codes c on a.id = c.id""",
    ),
    "feed_after_resolve": _with(
        RESOLVED, "select id, cast(case when is_fixed then 1 else 0 end as int) as status from left_over"
    ),
    "running_after_resolve": _with(
        f"{RESOLVED}, open as (select * from left_over where not is_fixed)", MESSAGE_SUMMARY.format(source="open")
    ),
    "compacted_after_resolve": _with(
        f"{RESOLVED}, open as (select * from left_over where not is_fixed)", SCRIPT_SUMMARY.format(source="open")
    ),
    "live_messages": _with(
        HASHED_STORED,
        f"select * exclude (first_hour, last_hour) from ({MESSAGE_SUMMARY.format(source='hashed')})",
    ),
    "live_browsers": _with(HASHED_STORED, BROWSER_SUMMARY.format(source="hashed")),
    "live_scripts": _with(HASHED_STORED, SCRIPT_SUMMARY.format(source="hashed")),
    "resolve": _with(
        FIXED_HASHES,
        """select id, cast(case when f.hash is not null then 1 else status end as int) as status
           from marked m left join fixed f on m.hash = f.hash""",
    ),
    "delete": _with(
        FIXED_HASHES, "select id, status from marked where hash not in (select hash from fixed)"
    ),
    "affected": _with(FEED, CLIENTS.format(where=f"type = 'Firefox' and file = {_literal(FILE)}")),
    "affected_by_line": _with(FEED, CLIENTS.format(where="line = 42")),
    "affected_by_ip": _with(FEED, CLIENTS.format(where="ip = '10.0.0.7'")),
    "daily_digest": _with(
        FEED,
        """select cast(date as date) as day, hash, arg_max(message, id) as message, count(*) as times,
                  min(date) as first_report, max(date) as last_report
           from feed group by 1, 2""",
    ),
    "message_browsers": _with(
        FEED,
        """select hash, count(*) as times,
                  array_to_string(list_sort(list(distinct browser_id)), ',') as browsers
           from feed group by hash""",
    ),
    "message_browser_counts": _with(
        FEED, "select hash, count(distinct browser_id) as browsers, count(*) as times from feed group by hash"
    ),
    "strict_fingerprint": _with(
        FEED,
        """select md5(file || chr(1) || line || chr(1) || message) as hash, file, line, message,
                  count(*) as times, min(date) as first_report, max(date) as last_report
           from feed group by all""",
    ),
}

ORACLE["exported_feed"] = ORACLE["feed_json"]
