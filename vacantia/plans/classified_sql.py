"""SQL for what ingest, searches and audits make of the synthetic postings, written from their rules.

What titles mention is said by hand for the synthetic titles; places go through the SQL of the facets.
"""

from __future__ import annotations

from vacantia.functions import places, titles
from vacantia.functions.text import sql_has
from vacantia.plans.synthetic import POSTINGS_SQL

ISO = "strftime(posted_at, '%Y-%m-%dT%H:%M:%S.%gZ')"
_TRIMMED = r"regexp_replace(regexp_replace({}, '\s{{2,}}', ' ', 'g'), '^[\s,;/|–-]+|[\s,;/|–-]+$', '', 'g')"


def _no_parens(text: str) -> str:
    for _ in range(3):
        text = rf"regexp_replace({text}, '\(\s*\)', ' ', 'g')"
    return rf"trim(regexp_replace({text}, '\s{{2,}}', ' ', 'g'))"


_CUT = _TRIMMED.format("regexp_replace(raw, '(?i)\\b' || company || '\\b', ' ', 'g')")
_BARE = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '(?i)\b(?:remote|anywhere)\b', '', 'g'),
    '(?i)^\s*(?:or|and|&)\s+|\s+(?:or|and|&)\s*$', '', 'g'), '(?i)(?:^|,)\s*(?:or|and|&)\s*,', ',', 'g'), '(?i)\b(in|on)-(office|site)\b', '\1‑\2', 'g')""".format(_no_parens("geo"))
_SAME = "CASE lower(x) WHEN 'uk' THEN 'united kingdom' WHEN 'us' THEN 'united states' WHEN 'usa' THEN 'united states' WHEN 'uae' THEN 'united arab emirates' WHEN 'czech republic' THEN 'czechia' WHEN 'republic of korea' THEN 'south korea' ELSE lower(x) END"
_LIST = "CASE WHEN {0} = '' THEN [] ELSE string_split({0}, ',') END"
_FOUND = places.sql_facets("(SELECT DISTINCT place FROM placed)", "place")
#: What the synthetic titles mention.
_MENTIONED = """CASE title WHEN 'Data Analyst (Portugal)' THEN ['portugal'] WHEN 'US Remote Software Engineer' THEN ['united states'] WHEN 'Software Engineer, Remote - Germany' THEN ['germany']
    WHEN 'Backend Engineer - Chicago, IL, USA' THEN ['united states'] ELSE [] END"""
_ROLE = titles.sql_role_of("title")
_EVERY = titles.sql_stack_lists("lower(coalesce(title, ''))")


def _stack(role: str) -> str:
    of = lambda group: "[" + ", ".join(f"'{s}'" for s in group) + "]"
    cases = " ".join(f"WHEN {role} = '{r}' THEN list_intersect({_EVERY}, {of(g)})" for r, g in titles.ROLE_STACKS.items())
    return f"CASE WHEN {role} IN ({', '.join(repr(r) for r in titles.STACKLESS_ROLES)}) THEN [] {cases} ELSE {_EVERY} END"


def jobs_sql(hinted: bool = False) -> str:
    """CTEs that end in `jobs`, with arrays as lists; `hinted` gives every other posting hints of a board's own."""
    hints = "CAST(external_id AS BIGINT) % 2 = 0" if hinted else "false"
    return rf"""
WITH raws AS (SELECT *, {places.sql_formatted('location_raw')} AS raw FROM {POSTINGS_SQL}),
geos AS (SELECT *, CASE WHEN lower(raw) = lower(company) THEN 'Unknown' WHEN {_CUT} = '' THEN raw ELSE {_no_parens(_CUT)} END AS geo FROM raws),
placed AS (SELECT *, CASE WHEN lower(geo) = 'unknown' THEN '' ELSE geo END AS place FROM geos),
found AS (SELECT place, {_LIST.format('tokens')} AS t, {_LIST.format('countries')} AS c, {_LIST.format('regions')} AS r FROM ({_FOUND})),
parted AS (SELECT placed.*, t, c, r, list_filter(list_transform(regexp_split_to_array({_BARE}, '\s*[-/|,]+\s*'), lambda x: regexp_replace(trim(x), '\s{{2,}}', ' ', 'g')), lambda x: x <> '') AS parts
  FROM placed JOIN found USING (place)),
keyed AS (SELECT *, list_transform(parts, lambda x: {_SAME}) AS keys, lower(trim(geo)) IN ('', 'unknown') AS blank FROM parted),
shown AS (SELECT *, CASE WHEN len(c) + len(r) = 0 AND (regexp_matches(geo, '(?i)\b(?:remote|anywhere|distributed)\b') OR (is_flagged_remote AND blank)) THEN 'Remote' WHEN blank THEN 'Unknown'
    ELSE coalesce(nullif(replace({_no_parens("array_to_string(list_transform(list_filter(range(1, len(keys) + 1), lambda i: list_position(keys, keys[i]) = i), lambda i: coalesce(list_filter(parts, lambda x: lower(x) = keys[i])[1], parts[i])), ', ')")}, '‑', '-'), ''), 'Unknown') END AS location FROM keyed),
owned AS (SELECT * REPLACE (CASE WHEN location = 'Remote' THEN ['remote'] ELSE t END AS t, CASE WHEN location = 'Remote' THEN [] ELSE c END AS c, CASE WHEN location = 'Remote' THEN [] ELSE r END AS r) FROM shown),
hinted AS (SELECT * REPLACE (CASE WHEN {hints} THEN list_concat(t, list_concat(c, list_concat(r, ['united states', 'emea']))) ELSE t END AS t,
    CASE WHEN {hints} THEN list_concat(c, ['united states']) ELSE c END AS c, CASE WHEN {hints} THEN list_concat(r, ['emea']) ELSE r END AS r) FROM owned),
said AS (SELECT *, {_MENTIONED} AS said FROM hinted),
titled AS (SELECT id, provider, external_id, company, geo AS location_raw, posted_at, url, location, is_flagged_remote OR contains(lower(geo), 'remote') AS is_remote,
    list_sort(list_distinct(CASE WHEN len(c) = 0 THEN list_concat(t, said) ELSE t END)) AS location_tokens, list_sort(list_distinct(CASE WHEN len(c) = 0 THEN said ELSE c END)) AS location_countries,
    list_sort(list_distinct(r)) AS location_regions, place, {titles.sql_without_location('trim(title)', 'location')} AS title FROM said),
roles AS (SELECT *, {_ROLE} AS any_role FROM titled),
jobs AS (SELECT * EXCLUDE (any_role), nullif(any_role, 'other') AS role, list_sort({_stack('any_role')}) AS stack,
    list_sort(list_filter(string_split({titles.sql_seniorities_of('title')}, ','), lambda x: x <> '')) AS seniorities,
    sha256(concat_ws('|', provider, external_id, lower(title), lower(company), lower(location), url, {ISO})) AS hash FROM roles)
"""


def joined(column: str) -> str:
    return f"array_to_string({column}, ',') AS {column}"


CLASSIFIED = (
    jobs_sql()
    + f"SELECT id, provider, external_id, title, company, location_raw, {ISO} AS posted_at, url, location, {joined('location_tokens')}, {joined('location_countries')}, {joined('location_regions')}, is_remote, role, {joined('stack')}, {joined('seniorities')}, hash FROM jobs"
)
HINTED = jobs_sql(True) + "SELECT id, array_to_string(location_tokens, ',') AS tokens, array_to_string(location_countries, ',') AS countries, array_to_string(location_regions, ',') AS regions FROM jobs"

_TIED = " OR ".join(sql_has(c, places._tied(w)) for c in ("title", "location_raw") for w in (places.REMOTE_COUNTRIES, places.REMOTE_REGIONS))
_NAMES_COUNTRY = r"regexp_matches(lower(title), '\b(germany|portugal|usa)\b')"
_FULLY = rf"(is_remote AND lower(trim(location)) = 'remote' AND len(location_countries) = 0 AND len(location_regions) = 0 AND NOT ({_TIED}) AND NOT {_NAMES_COUNTRY} AND NOT regexp_matches(lower(location_raw), '\bhybrid\b'))"
FULLY_REMOTE = jobs_sql() + f"SELECT id, location, location_raw FROM jobs WHERE {_FULLY}"

_SPLIT = "list_filter(list_transform(string_split({}, '{}'), lambda x: trim(x)), lambda x: x <> '')"
_PAGED = f"""paged AS (SELECT *, list_filter(commas, lambda x: lower(x) <> 'remote') AS geo_parts FROM (
  SELECT *, {_SPLIT.format('location_raw', '|')} AS bars, {_SPLIT.format('location_raw', ',')} AS commas, epoch_ms(max(posted_at) OVER ()) - epoch_ms(posted_at) <= 86400000 AS is_new FROM jobs))"""
_PAGE = f"""id, title, company, location, CASE WHEN contains(location_raw, '|') AND len(bars) > 0 THEN bars[1] WHEN provider = 'ashby' AND len(commas) > len(geo_parts) THEN coalesce(geo_parts[1] || ', Remote', 'Remote')
    WHEN provider = 'ashby' AND len(commas) > 0 THEN commas[1] ELSE location END AS location_primary,
  array_to_string(list_sort(CASE WHEN contains(location_raw, '|') AND len(bars) > 0 THEN bars[2:] WHEN provider = 'ashby' AND len(commas) > len(geo_parts) THEN list_filter(geo_parts, lambda x: x <> geo_parts[1])
    WHEN provider = 'ashby' AND len(commas) > 0 THEN commas[2:] ELSE [] END), ',') AS location_secondary, is_remote, {ISO} AS posted_at, is_new"""
_KEYWORDS = " OR ".join(titles.sql_title_keyword("title", k) for k in titles.ROLE_KEYWORDS["backend"])
_IN_GERMANY = r"(list_contains(location_countries, 'germany') OR list_contains(location_tokens, 'germany') OR contains(lower(location), 'germany') OR contains(lower(location_raw), 'germany') OR (len(location_countries) = 0 AND regexp_matches(lower(title), '\bgermany\b')))"
FEED = (
    jobs_sql()
    + f", {_PAGED} SELECT {_PAGE}, url, {joined('stack')}, {joined('seniorities')} FROM paged WHERE (role = 'backend' OR (role IS NULL AND ({_KEYWORDS}))) AND ({_IN_GERMANY} OR {_FULLY})"
    + " AND (len(seniorities) = 0 OR list_contains(seniorities, 'senior')) AND list_has_any(stack, ['python', 'java']) ORDER BY paged.posted_at DESC, id LIMIT 200"
)
_INSIDE = "(list_contains(location_countries, 'germany') OR contains(lower(location_raw), 'germany') OR contains(lower(location), 'germany'))"
PREVIEW = (
    jobs_sql()
    + f", {_PAGED} SELECT {_PAGE} FROM paged WHERE length(trim(coalesce(role, ''))) > 0 AND ({_INSIDE} OR is_remote) ORDER BY CASE WHEN {_INSIDE} THEN 0 ELSE 1 END, paged.posted_at DESC, id LIMIT 5"
)
EMPTY_GEOGRAPHY = jobs_sql() + r"""SELECT id, location_raw FROM jobs WHERE len(location_countries) = 0 AND len(location_regions) = 0 AND length(trim(location_raw)) > 1
  AND lower(trim(location_raw)) NOT IN ('remote', 'hybrid', 'anywhere', 'unknown') AND NOT (is_remote AND regexp_matches(trim(location_raw), '(?i)^(remote|hybrid|anywhere|distributed|unknown|worldwide|global)\s*$'))"""
_ONLY_REMOTE = "(len({0}) > 0 AND len(list_filter({0}, lambda x: x NOT IN ('remote', 'anywhere', 'distributed'))) = 0)"
#: Stored tokens of every fifth posting are `x`; what is expected comes from the place, the flag and the stored title.
MISMATCHES = (
    jobs_sql()
    + rf""", expected AS (
  SELECT jobs.*, CASE WHEN CAST(external_id AS BIGINT) % 5 = 0 THEN ['x'] ELSE location_tokens END AS st,
    len(c) + len(r) = 0 AND (regexp_matches(location_raw, '(?i)\b(?:remote|anywhere|distributed)\b') OR (is_remote AND lower(location_raw) = 'unknown')) AS away,
    list_sort(list_distinct(regexp_extract_all(lower(title), '\b(germany|portugal|usa)\b'))) AS said, t, c, r FROM jobs JOIN found USING (place)),
plain AS (SELECT *, CASE WHEN away THEN ['remote'] ELSE t END AS et0, CASE WHEN away THEN [] ELSE c END AS ec0, CASE WHEN away THEN [] ELSE r END AS er FROM expected),
named AS (SELECT *, CASE WHEN len(ec0) = 0 THEN list_transform(said, lambda x: CASE x WHEN 'usa' THEN 'united states' ELSE x END) ELSE ec0 END AS ec FROM plain),
both_sides AS (SELECT *, list_sort(list_distinct(list_concat(et0, ec))) AS et FROM named),
judged AS (SELECT *, st = et AS same_t, location_countries = list_sort(ec) AS same_c, location_regions = list_sort(er) AS same_r FROM both_sides),
kinds AS (SELECT CASE WHEN same_r AND NOT same_t AND ((len(ec) = 0 AND len(location_countries) = 0) OR (same_c AND len(location_countries) <= len(ec))) THEN 'layout_only'
  WHEN len(ec) = 0 AND len(location_countries) = 0 AND NOT (len(location_regions) > 0 OR len(er) > 0 OR (is_remote AND ({_ONLY_REMOTE.format('st')} OR {_ONLY_REMOTE.format('et')}))) THEN 'code_gap_candidate'
  ELSE 'hint_delta_or_stale' END AS category FROM judged WHERE NOT (same_t AND same_c AND same_r))
SELECT category, count(kinds.category) AS n FROM (VALUES ('hint_delta_or_stale'), ('layout_only'), ('code_gap_candidate')) every(category) LEFT JOIN kinds USING (category) GROUP BY 1"""
)

_EVENTS = "(SELECT user_id AS key, epoch_us(ts) // 1000 AS at_ms, event_id AS order_id, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events {})"
#: A breaker of 6 hours, 3 errors and 12 hours, event by event.
BREAKER = f"""
WITH RECURSIVE e AS {_EVENTS.format("WHERE event_type = 'error'")},
steps AS (
  SELECT key, n, at_ms, order_id, [at_ms] AS recent, false AS opens, CAST(0 AS BIGINT) AS open_until FROM e WHERE n = 1
  UNION ALL
  SELECT key, n, at_ms, order_id, recent, full_window AND open_until < at_ms, CASE WHEN full_window AND open_until < at_ms THEN at_ms + 43200000 ELSE open_until END FROM (
    SELECT *, len(recent) >= 3 AS full_window FROM (
      SELECT e.*, list_append(list_filter(s.recent, lambda t: e.at_ms - t < 21600000), e.at_ms) AS recent, s.open_until FROM steps s JOIN e ON e.key = s.key AND e.n = s.n + 1)))
SELECT key, at_ms, order_id, opens, open_until FROM steps WHERE opens"""
#: A limiter of 5 hits in 6 hours that blocks for an hour, event by event.
LIMITER = f"""
WITH RECURSIVE e AS {_EVENTS.format('')},
steps AS (
  SELECT key, n, at_ms, order_id, CAST(1 AS BIGINT) AS hits, at_ms + 21600000 AS ends, CAST(0 AS BIGINT) AS blocked, false AS held FROM e WHERE n = 1
  UNION ALL
  SELECT key, n, at_ms, order_id, new_hits, new_ends, CASE WHEN NOT held AND new_hits > 5 THEN at_ms + 3600000 ELSE blocked END, held FROM (
    SELECT e.*, s.blocked, s.blocked > e.at_ms AS held, CASE WHEN s.blocked > e.at_ms THEN s.hits WHEN s.ends > e.at_ms THEN s.hits + 1 ELSE 1 END AS new_hits,
      CASE WHEN s.blocked > e.at_ms OR s.ends > e.at_ms THEN s.ends ELSE e.at_ms + 21600000 END AS new_ends FROM steps s JOIN e ON e.key = s.key AND e.n = s.n + 1))
SELECT key, at_ms, order_id, CASE WHEN held THEN 6 ELSE hits END AS total_hits,
  CAST(CASE WHEN held THEN ceil((blocked - at_ms) / 1000) ELSE greatest(1, ceil((ends - at_ms) / 1000)) END AS BIGINT) AS time_to_expire,
  held OR hits > 5 AS is_blocked, CAST(CASE WHEN held THEN ceil((blocked - at_ms) / 1000) WHEN hits > 5 THEN 3600 ELSE 0 END AS BIGINT) AS time_to_block_expire FROM steps"""
#: Fetches and their outcomes as one sequence of moments for each provider. What was sent and is on its way is a list of
#: fetches; a timeout counts only if its fetch was sent.
GATED = """
WITH RECURSIVE fetches AS (
  SELECT 'p' || (user_id % 20) AS provider, event_id AS fetch_id, epoch_us(ts) // 1000 AS at_ms, event_type = 'error' AS slow, event_id % 7 * 600000 AS takes FROM events
), moments AS (
  SELECT provider, fetch_id, at_ms AS t, 1 AS kind, slow FROM fetches
  UNION ALL SELECT provider, fetch_id, at_ms + takes, CASE WHEN takes = 0 THEN 2 ELSE 0 END, slow FROM fetches WHERE slow
), e AS (
  SELECT *, row_number() OVER (PARTITION BY provider ORDER BY t, CASE kind WHEN 0 THEN 0 ELSE 1 END, fetch_id, kind) AS n FROM moments
), steps AS (
  SELECT provider, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS fetch_id, 9 AS kind, [CAST(0 AS BIGINT)][:0] AS recent, [CAST(0 AS BIGINT)][:0] AS coming, CAST(0 AS BIGINT) AS open_until, false AS sent
  FROM (SELECT DISTINCT provider FROM e)
  UNION ALL
  SELECT provider, n, fetch_id, kind, met, CASE WHEN kind = 1 AND open_until <= t AND slow THEN list_append(coming, fetch_id) WHEN kind <> 1 THEN list_filter(coming, lambda f: f <> fetch_id) ELSE coming END,
    CASE WHEN counts AND len(met) >= 3 AND open_until < t THEN t + 43200000 ELSE open_until END, kind = 1 AND open_until <= t
  FROM (SELECT *, CASE WHEN counts THEN list_append(list_filter(recent, lambda x: t - x < 21600000), t) ELSE recent END AS met
    FROM (SELECT e.provider, e.n, e.fetch_id, e.kind, e.t, e.slow, s.recent, s.coming, s.open_until, e.kind <> 1 AND list_contains(s.coming, e.fetch_id) AS counts
      FROM steps s JOIN e ON e.provider = s.provider AND e.n = s.n + 1))
)
SELECT fetch_id, provider, sent, open_until FROM steps WHERE kind = 1"""
#: The same mismatches by which facets differ.
MISMATCH_REASONS = (
    MISMATCHES[: MISMATCHES.index("kinds AS (")].rstrip().rstrip(",")
    + """
SELECT concat_ws('+', CASE WHEN NOT same_t THEN 'tokens' END, CASE WHEN NOT same_c THEN 'countries' END, CASE WHEN NOT same_r THEN 'regions' END) AS reason, count(*) AS n
FROM judged WHERE NOT (same_t AND same_c AND same_r) GROUP BY 1"""
)
