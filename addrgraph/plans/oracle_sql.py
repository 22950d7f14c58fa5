"""DuckDB SQL twins of the registered jobs, over the same Parquet tables.

Each entry restates the operator's rule in plain SQL (DuckDB dialect) so an
independent engine can check row count, schema and values.  Two rules have
no direct DuckDB form and are restated: the address pattern (no look-around
in DuckDB's regex: separators are doubled, then one is consumed on each
side) and numeric character references (the test tables only hold ``&#64;``).
Dot-segment removal in link resolution is not restated; the test tables
hold no dot segments (the randomised tests compare it against Python).
"""

from __future__ import annotations

from addrgraph.functions.urls import BLOCKED_EXTENSIONS, HOST_PATTERN
from addrgraph.operators.enrich import DEFAULT_SOURCES, ENRICHMENT_SOURCE_URL
from addrgraph.plans.fixtures import DISCOVERY_TARGET_DOMAIN, FIXTURE_SQL, SUFFIX_LINES
from addrgraph.plans.queries import BUDGET_PAGES, CRAWL, LINK_CAP


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# Characters dropped at both ends of a value: DuckDB's trim takes them as a list.
_TRIMMED = " || ".join(f"chr({c})" for c in (32, 9, 10, 11, 12, 13, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288))


def _expand_trims(sql: str) -> str:
    """Give every ``trim_ws(x)`` its list of characters."""
    out, at = [], 0
    while (i := sql.find("trim_ws(", at)) >= 0:
        depth, end = 1, i + len("trim_ws(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        out += [sql[at:i], "trim(", _expand_trims(sql[i + len("trim_ws("):end - 1]), ", ", _TRIMMED, ")"]
        at = end
    return "".join(out) + sql[at:]


def _in_list(vals) -> str:
    return "(" + ", ".join(_q(v) for v in vals) + ")"


SCHEME = "[a-zA-Z][a-zA-Z0-9+.-]*"
ORIGIN_RE = f"^({SCHEME}://[^/?#]*)"
PATH_RE = f"^{SCHEME}://[^/?#]*([^?#]*)"


def url_key(u: str) -> str:
    a = f"lower(regexp_replace({u}, '#.*$', ''))"
    b = f"regexp_replace(regexp_replace({a}, '^(http://[^/:?]+):80([/?]|$)', '\\1\\2'), '^(https://[^/:?]+):443([/?]|$)', '\\1\\2')"
    d = f"regexp_replace({b}, '^(https?://[^/?]+)([?]|$)', '\\1/\\2')"
    return (f"(case when length(regexp_extract({d}, '^https?://[^/?]+([^?]*)', 1)) > 1 "
            f"then regexp_replace({d}, '/+$', '') else {d} end)")


def host_of(u: str) -> str:
    return f"nullif(lower(regexp_extract({u}, '(?i)^https?://(?:[^/?#@]*@)?(\\[[^\\]/?#]*\\]|[^/?#:]+)', 1)), '')"


def path_of(u: str) -> str:
    return f"regexp_extract({u}, {_q(PATH_RE)}, 1)"


def ext_of(u: str) -> str:
    return f"lower(regexp_extract({path_of(u)}, '\\.([^./]+)$', 1))"


def blocked(u: str) -> str:
    return f"({ext_of(u)} in {_in_list(BLOCKED_EXTENSIONS)})"


def valid_email(e: str, strict: bool = False) -> str:
    dom = f"split_part({e}, '@', 2)"
    loc = f"split_part({e}, '@', 1)"
    c = (f"length({e}) > 0 and length({e}) <= 254 and not contains({e}, '..') "
         f"and len(string_split({e}, '@')) = 2 and length({loc}) > 0 and length({dom}) > 0 "
         f"and not starts_with({dom}, '.') and not ends_with({dom}, '.') and contains({dom}, '.')")
    if strict:
        c += f" and not starts_with({loc}, '.')"
    return f"coalesce(({c}), false)"


def normalize_email(v: str) -> str:
    e = f"lower(regexp_replace(trim_ws({v}), '[.,;:)\\]>]+$', ''))"
    return f"(case when {valid_email(e)} then {e} end)"


def normalize_host(v: str) -> str:
    x = f"lower(trim_ws({v}))"
    from_url = f"regexp_extract({x}, '^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)', 1)"
    bare = f"regexp_replace(split_part(regexp_replace({x}, '^\\*\\.', ''), '/', 1), ':[0-9]+$', '')"
    h = f"(case when contains({x}, '//') then {from_url} else {bare} end)"
    return f"(case when length({h}) > 0 and regexp_matches({h}, {_q(HOST_PATTERN)}) then {h} end)"


def in_domain(h: str, d: str) -> str:
    return f"({h} = {_q(d)} or ends_with({h}, {_q('.' + d)}))"


def normalize_url(x: str) -> str:
    v = f"regexp_replace(trim_ws({x}), '[\\t\\r\\n]', '', 'g')"
    v2 = f"(case when starts_with({v}, 'http://') or starts_with({v}, 'https://') then {v} else 'https://' || {v} end)"
    netloc = f"regexp_extract({v2}, '^https?://([^/?#]*)', 1)"
    out = f"regexp_replace(regexp_replace({v2}, '#.*$', ''), '\\?$', '')"
    return f"(case when length(trim_ws({x})) > 0 and length({netloc}) > 0 then {out} end)"


def two_label_domain(h: str) -> str:
    return (f"(case when regexp_matches({h}, '^[0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}$') then {h} "
            f"when contains({h}, '.') then regexp_extract({h}, '([^.]*\\.[^.]*)$', 1) else {h} end)")


def fx(*names: str) -> str:
    """CTEs for derived fixtures (same text as the Spark side)."""
    return ",\n".join(f"{n} as ({FIXTURE_SQL[n][0]})" for n in names)


# F1 on a page table with status/content_type.
def fetch_cols(t: str, accept_missing: bool = True) -> str:
    mt = "trim_ws(split_part(content_type, ';', 1))"
    blank = f"({mt} is null or length({mt}) = 0)"
    s_ok = "(status is null or (status >= 200 and status <= 299))"
    t_ok = f"(case when {blank} then {'true' if accept_missing else 'false'} else contains(lower({mt}), 'html') end)"
    reason = (f"(case when not {s_ok} then 'HTTP ' || cast(status as varchar) "
              f"when not {t_ok} and {blank} then 'Content type ''unknown'' is not HTML' "
              f"when not {t_ok} then 'Content type ''' || {mt} || ''' is not HTML' end)")
    return f"select *, ({s_ok} and {t_ok}) as ok, {reason} as failure_reason from {t}"


HREF_RE = """(?i)href\\s*=\\s*("[^">]+"|'[^'>]+'|[^\\s>]+)"""
TEXT_ELEMENTS = ["script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"]


def anchor_values(h: str) -> str:
    """Raw ``href`` values of link elements, step by step: all tokens, of these the link
    elements, of each its attributes, of these the first by that name."""
    quoted = """"[^"]*"|'[^']*'"""
    text = "|".join(f"<{e}(?:[\\s/][^>]*)?>.*?(?:</{e}|$)" for e in TEXT_ELEMENTS)
    tokens = f"regexp_extract_all({h}, {_q(f'(?is)<!--(?:.*?-->|.*$)|{text}|</?[a-z](?:[^' + chr(34) + f'{chr(39)}>]|{quoted})*>')})"
    links = f"list_filter({tokens}, lambda t: regexp_matches(t, '(?i)^<(a|area)[\\s/]'))"
    attributes = f"""regexp_extract_all(regexp_replace(t, '(?i)^<(a|area)|>$', '', 'g'), {_q(f'[^\\s/=]+(?:\\s*=\\s*(?:{quoted}|[^\\s>]*))?')})"""
    first = f"list_filter({attributes}, lambda x: lower(trim(split_part(x, '=', 1))) = 'href')[1]"
    return f"""list_filter(list_transform({links}, lambda t: regexp_extract({first}, '(?s)^[^=]*=\\s*(.*)$', 1)), lambda v: length(v) > 0)"""


def links_ctes(t: str, prefix: str = "lk", anchors: bool = False) -> str:
    """CTEs ``{prefix}`` = extract_links over table ``t`` (page_id, url, html):
    page_id, src_url, pos, raw, dst_url, dst_key."""
    h = "coalesce(html, '')"
    values = anchor_values(h) if anchors else f"regexp_extract_all({h}, {_q(HREF_RE)}, 1)"
    if anchors:
        unq = f"(case when raw[1] in ({_q(chr(34))}, {_q(chr(39))}) then raw[2:-2] else raw end)"
    else:
        unq = ("(case when regexp_matches(raw, '^\"[^\">]+\"$') or regexp_matches(raw, '^''[^''>]+''$') "
               "then substr(raw, 2, length(raw) - 2) else raw end)")
    dec = unq
    for ref, ch in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", None), ("&amp;", "&")]:
        dec = f"replace({dec}, {_q(ref)}, {'chr(160)' if ch is None else _q(ch)})"
    origin = f"regexp_extract(src_url, {_q(ORIGIN_RE)}, 1)"
    scheme = f"regexp_extract(src_url, '^({SCHEME}):', 1)"
    bpath = f"(case when {path_of('src_url')} = '' then '/' else {path_of('src_url')} end)"
    bdir = f"regexp_extract({bpath}, '^(.*/)', 1)"
    joined = (f"(case when regexp_matches(val, '^{SCHEME}:') then val "
              f"when starts_with(val, '//') then {scheme} || ':' || val "
              f"when starts_with(val, '/') then {origin} || val "
              f"when starts_with(val, '?') then {origin} || {bpath} || val "
              f"else {origin} || {bdir} || val end)")
    jo = f"regexp_extract(j, {_q(ORIGIN_RE)}, 1)"
    jp = path_of("j")
    fin = (f"(case when regexp_matches(j, {_q(ORIGIN_RE)}) then {jo} || (case when {jp} = '' then '/' else {jp} end) "
           f"|| substr(j, length({jo}) + length({jp}) + 1) else j end)")
    skip = "(length(trim_ws(val)) = 0 or starts_with(val, '#') or regexp_matches(val, '(?i)^(mailto:|tel:|javascript:)'))"
    return f"""{prefix}_h as (
  select page_id, url as src_url, unnest(hs) as raw, generate_subscripts(hs, 1) - 1 as pos
  from (select page_id, url, case when contains(lower({h}), 'href') then {values}
        else []::varchar[] end as hs from {t})),
{prefix}_v as (select page_id, src_url, pos, raw, trim_ws({dec}) as val from {prefix}_h),
{prefix}_j as (select page_id, src_url, pos, raw,
  case when regexp_matches(src_url, {_q(ORIGIN_RE)}) then regexp_replace({joined}, '#.*$', '') end as j
  from {prefix}_v where not {skip}),
{prefix}_r as (select page_id, src_url, pos, raw, {fin} as dst_url from {prefix}_j where j is not null),
{prefix} as (select page_id, src_url, pos, raw, dst_url, {url_key('dst_url')} as dst_key from {prefix}_r
  where regexp_matches(dst_url, '(?i)^https?://[^/?#]') and {host_of('dst_url')} is not null
  {'and not ' + blocked('dst_url') if anchors else ''})"""


ADDR_RE = "(?i)(?:^|[^A-Z0-9._%+-])([A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{2,63})(?:[^A-Z0-9._%+-]|$)"


def email_hits(t: str, text: str, id_col: str, url_col: str, decode: bool) -> str:
    """Address hits of a table (one row per distinct address per page)."""
    src = f"coalesce({text}, '')"
    if decode:
        src = f"replace({src}, '&#64;', '@')"
    doubled = f"regexp_replace({src}, '([^a-zA-Z0-9._%+@-])', '\\1\\1', 'g')"
    return f"""select distinct page_id, source_url, lower(e) as email from (
  select {id_col} as page_id, {url_col} as source_url,
    unnest(regexp_extract_all({doubled}, {_q(ADDR_RE)}, 1)) as e
  from {t} where contains({src}, '@')) m
where {valid_email('e')}"""


SEEDS_STRICT = """
seeds_v as (select line_no as seed_rank, trim_ws(line) as value from seed_lines where length(trim_ws(line)) > 0),
seeds_u as (select seed_rank, case when regexp_matches(value, '(?i)^https?://') then value else 'https://' || value end as url from seeds_v),
seeds_ok as (select seed_rank, url,
   regexp_extract(url, '(?i)^https?://(?:[^/?#@]*@)?(\\[[^\\]]*\\]|[^/?#:]*)', 1) as h,
   regexp_extract(url, '(?i)^https?://(?:[^/?#@]*@)?(?:\\[[^\\]]*\\]|[^/?#:]*)(:[^/?#]*)?', 1) as p
 from seeds_u),
seeds_k as (select seed_rank, url,
   regexp_replace(regexp_replace(regexp_replace(lower(url), '^(http://[^/?#]+):80([/?#]|$)', '\\1\\2'),
     '^(https://[^/?#]+):443([/?#]|$)', '\\1\\2'), '^(https?://[^/?#]+)([?#]|$)', '\\1/\\2') as k
 from seeds_ok where length(h) > 0 and not regexp_matches(h, '\\s') and (length(p) = 0 or (regexp_matches(p, '^:[0-9]{1,5}$') and cast(substr(p, 2) as integer) <= 65535))),
seeds as (select min(seed_rank) as seed_rank, arg_min(url, seed_rank) as url from seeds_k group by k)"""

SEEDS_LENIENT = f"""
seeds_l as (select min(line_no) as seed_rank, url from (select line_no, {normalize_url('line')} as url from seed_lines) x
  where url is not null group by url)"""

SITE_OK = f"site_ok as ({fetch_cols('site')})"

SITE_HITS = f"site_hits as ({email_hits('(select * from site_ok where ok)', 'html', 'page_id', 'url', True)})"

DOC_HITS = f"doc_hits as ({email_hits('documents', 'text', 'doc_id', 'source', False)})"

SEED_HOSTS = f"seed_hosts as (select distinct {host_of('url')} as host from seeds where {host_of('url')} is not null)"


def link_graph_ctes(cap: int, anchors: bool = False) -> str:
    """G1 over the site from F1-ok pages, limited to the strict seeds' hosts."""
    return f"""{links_ctes('(select page_id, url, html from site_ok where ok)', 'gl', anchors=anchors)},
g_f as (select * from gl where not {blocked('dst_url')} and {host_of('dst_url')} in (select host from seed_hosts)),
g_d as (select page_id, dst_key, min(pos) as pos, arg_min(dst_url, pos) as dst_url, any_value(src_url) as src_url
        from g_f group by page_id, dst_key),
g_r as (select *, row_number() over (partition by page_id order by pos) as rank from g_d),
edges as (select page_id, {url_key('src_url')} as src_key, pos, rank, dst_url, dst_key from g_r where rank <= {cap})"""


# Pages keyed by URL, first capture wins (D3) -- site pages.
SITE_KEYED = f"""site_keyed as (select {url_key('url')} as url_key, min(page_id) as page_id,
  arg_min(url, page_id) as url, arg_min(ok, page_id) as ok, arg_min(failure_reason, page_id) as failure_reason
  from site_ok group by 1)"""


def reach_ctes(max_depth: int, max_pages: int | None) -> str:
    """G2 by enumerating walks (recursive CTE): a URL's depth is its shortest
    walk, its FIFO position the smallest walk path at that depth."""
    budget = f"where fifo <= {max_pages}" if max_pages is not None else ""
    return f"""s0 as (select {url_key('url')} as k, min(seed_rank) as r, arg_min(url, seed_rank) as url from seeds group by 1),
walk(k, url, depth, path, parent) as (
  select k, url, 0, [r]::bigint[], null::varchar from s0
  union all
  select e.dst_key, e.dst_url, w.depth + 1, list_append(w.path, e.rank::bigint), w.k
  from walk w join site_keyed p on p.url_key = w.k and p.ok join edges e on e.src_key = w.k
  where w.depth < {max_depth}),
wmin as (select k, min(depth) as depth from walk group by k),
wbest as (select w.k, w.depth, min(w.path) as path, arg_min(w.parent, w.path) as parent_key, arg_min(w.url, w.path) as url
          from walk w join wmin m on w.k = m.k and w.depth = m.depth group by w.k, w.depth),
wfifo as (select *, row_number() over (order by depth, path) as fifo from wbest),
reach as (select b.k as url_key, b.url, b.depth, b.path, b.parent_key, p.page_id,
            coalesce(p.ok, false) as ok,
            case when p.page_id is null then 'not captured' else p.failure_reason end as failure_reason
          from wfifo b left join site_keyed p on p.url_key = b.k {budget})"""


def event_ctes(t: str = "event_lines", keep: str = "") -> str:
    """CTE ``ev``: the typed events of a table of lines; ``keep`` is a column to take along."""
    k = f"{keep}, " if keep else ""
    def ifield(f):
        s = f"json_extract_string(line, '$.{f}')"
        t = f"json_type(line, '$.{f}')"
        return (f"(case when kind = 'unparsed' then null when {t} in ('BIGINT', 'UBIGINT') then try_cast({s} as integer) "
                f"when {t} = 'VARCHAR' and regexp_matches({s}, '^\\s*[+-]?[0-9]+\\s*$') then try_cast(trim_ws({s}) as integer) end)")

    def dfield(f):
        s = f"json_extract_string(line, '$.{f}')"
        t = f"json_type(line, '$.{f}')"
        return (f"(case when kind = 'unparsed' then null when {t} in ('BIGINT', 'UBIGINT', 'DOUBLE') then try_cast({s} as double) "
                f"when {t} = 'VARCHAR' and regexp_matches({s}, '^\\s*[+-]?([0-9][0-9,]*\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?\\s*$') "
                f"then try_cast(replace(trim_ws({s}), ',', '') as double) end)")

    def sfield(f):
        return f"(case when kind = 'unparsed' then null else coalesce(json_extract_string(line, '$.{f}'), '') end)"

    strs = ["email", "source_url", "current_url", "message", "reason"]
    ints = ["processed_pages", "failed_pages", "unique_email_count", "total_email_hits", "queue_length"]
    cols = ", ".join([f"{sfield(f)} as {f}" for f in strs] + [f"{ifield(f)} as {f}" for f in ints]
                     + [f"{dfield('duration_seconds')} as duration_seconds"])
    return f"""{fx(t)},
ev_k as (select {k}line_no, line,
   case when not json_valid(line) then 'unparsed'
        when json_type(line) = 'OBJECT' and json_extract_string(line, '$.type') is not null
        then lower(json_extract_string(line, '$.type')) end as kind
 from {t} where length(trim_ws(line)) > 0),
ev as (select {k}line_no, kind, line, {cols} from ev_k where kind is not null)"""


LOG_MSGS = """msgs as (select line_no, '[Scrapy] ' || m as message from (
  select line_no, case when kind = 'unparsed' then line when kind = 'log' and length(trim_ws(message)) > 0 then message end as m
  from ev) x where m is not null)"""

DISC = f"""{fx('discovery')},
disc as (select rec_id, lower(trim_ws(source)) as source, lower(trim_ws(kind)) as kind, value from discovery)"""

ACCEPTED = f"""acc as (select rec_id, source, kind, v as value from (
  select rec_id, source, kind,
    case when kind = 'email' then {normalize_email('value')}
         when kind = 'host' and {in_domain(normalize_host('value'), DISCOVERY_TARGET_DOMAIN)} then {normalize_host('value')} end as v
  from disc where source in {_in_list(DEFAULT_SOURCES)}) x where v is not null)"""

HOST_SEEDS = """host_seeds as (select host, 'https://' || host as url, row_number() over (order by host) as host_rank
  from (select distinct value as host from acc where kind = 'host' order by host limit 250) t)"""

HITS_REPORT = """select email, count(*) as hits, min(seen_at) as first_seen, max(seen_at) as last_seen,
  first(source_url order by (seen_at is not null), seen_at nulls first, page_id) as source_url"""

ENRICHED_HITS = f"""enr_hits as (
  select -1::bigint as page_id, {_q(ENRICHMENT_SOURCE_URL)} as source_url, value as email, null::timestamp as seen_at
  from (select distinct value from acc where kind = 'email') e
  union all select page_id, source_url, email, seen_at from hits)"""


def oracle_sql() -> dict[str, str]:
    W = "with "
    site_base = f"{fx('site')}, {SITE_OK}"
    seeds_base = f"{fx('seed_lines')}, {SEEDS_STRICT}"
    crawl_base = f"{site_base}, {seeds_base}, {SEED_HOSTS}, {SITE_KEYED}, {link_graph_ctes(CRAWL.max_links_per_page)}"
    o: dict[str, str] = {}

    # sources and sinks
    o["read_pages"] = "select page_id, url, html from pages"
    o["load_seeds"] = W + seeds_base + "\nselect seed_rank, url from seeds"
    o["load_seeds_lenient"] = W + fx("seed_lines") + "," + SEEDS_LENIENT + "\nselect seed_rank, url from seeds_l"
    o["read_event_log"] = W + event_ctes() + """
select line_no, kind, email, source_url, current_url, message, reason, processed_pages, failed_pages,
  unique_email_count, total_email_hits, queue_length, duration_seconds from ev"""
    o["write_event_log"] = W + fx("hits") + """
select '{"type":"email","email":"' || email || '","source_url":"' || source_url || '"}' as value from hits"""
    o["load_discovery"] = W + DISC + "\nselect rec_id, source, kind, value from disc"
    o["export_report_csv"] = W + fx("hits") + f""", r as ({HITS_REPORT} from hits group by email)
select email as "Email", cast(hits as varchar) as "Hits", strftime(first_seen, '%Y-%m-%d %H:%M:%S') as "FirstSeen",
  strftime(last_seen, '%Y-%m-%d %H:%M:%S') as "LastSeen", source_url as "SourceUrl" from r"""

    # filters
    o["split_fetchable"] = W + site_base + "\nselect page_id, url, ok, failure_reason from site_ok"
    o["split_fetchable_reject"] = (W + fx("site") + f", site_ok as ({fetch_cols('site', accept_missing=False)})"
                                   + "\nselect page_id, url, ok, failure_reason from site_ok")
    o["filter_link_scheme"] = W + links_ctes("pages") + "\nselect page_id, pos, dst_url from lk"
    o["filter_same_host"] = (W + f"{site_base}, {seeds_base}, {SEED_HOSTS}, "
                             + links_ctes("(select * from site_ok where ok)")
                             + f"\nselect page_id, pos, dst_key from lk where {host_of('dst_url')} in (select host from seed_hosts)")
    o["filter_non_html_ext"] = (W + site_base + ", " + links_ctes("(select * from site_ok where ok)")
                                + f"\nselect page_id, pos, dst_key from lk where not {blocked('dst_url')}")
    o["valid_email"] = (W + DISC + f"\nselect rec_id, {valid_email('trim_ws(value)')} as basic, "
                        f"{valid_email('trim_ws(value)', strict=True)} as strict from disc")
    o["filter_hosts_in_domain"] = (W + DISC + f", h as (select rec_id, {normalize_host('value')} as host from disc where kind = 'host')"
                                   f"\nselect rec_id, host from h where host is not null and {in_domain('host', DISCOVERY_TARGET_DOMAIN)}")
    o["filter_sources"] = W + DISC + f"\nselect rec_id, source from disc where source in {_in_list(DEFAULT_SOURCES)}"
    o["filter_sources_given"] = W + DISC + "\nselect rec_id, source from disc where source in ('crtsh', 'thc')"
    o["drop_incomplete_email_events"] = W + event_ctes() + """
select line_no, email, source_url from ev
where kind = 'email' and length(trim_ws(email)) > 0 and length(trim_ws(source_url)) > 0"""

    # projections
    o["decode_html"] = W + fx("site") + """
select page_id, replace(replace(replace(html, '&#64;', '@'), '&lt;', '<'), '&gt;', '>') as decoded from site"""
    o["extract_emails"] = W + DOC_HITS + "\nselect page_id, source_url, email from doc_hits"
    o["extract_emails_pages"] = email_hits("pages", "html", "page_id", "url", True)
    o["extract_emails_site"] = W + f"{site_base}, {SITE_HITS}\nselect page_id, source_url, email from site_hits"
    o["normalize_email"] = W + DISC + f"\nselect rec_id, {normalize_email('value')} as email from disc where kind = 'email'"
    o["extract_links"] = W + links_ctes("pages") + "\nselect page_id, pos, raw, dst_url, dst_key from lk"
    o["extract_anchor_links"] = (W + links_ctes("pages", anchors=True) + """
select page_id, min(pos) as pos, arg_min(dst_url, pos) as dst_url, dst_key from lk group by page_id, dst_key""")
    o["extract_anchor_links_markup"] = (W + fx("markup") + ",\n" + links_ctes("markup", anchors=True) + """
select page_id, min(pos) as pos, arg_min(dst_url, pos) as dst_url, dst_key from lk group by page_id, dst_key""")
    o["resolve_links"] = W + fx("site") + ", " + links_ctes("site") + "\nselect page_id, pos, dst_url from lk"
    o["canonical_url"] = f"select page_id, url, {url_key('url')} as url_key from pages"
    o["normalize_url"] = W + fx("seed_lines") + f"\nselect line_no, {normalize_url('line')} as url from seed_lines"
    o["target_domain"] = (W + fx("seed_lines") + "," + SEEDS_LENIENT + f""",
th as (select seed_rank, {host_of('url')} as host from seeds_l where {host_of('url')} is not null)
select coalesce(arg_min({two_label_domain('lower(trim_ws(host))')}, seed_rank), '') as target_domain from th""")
    o["normalize_host"] = W + DISC + f"\nselect rec_id, {normalize_host('value')} as host from disc where kind = 'host'"
    o["hosts_to_seeds"] = (W + DISC + ", " + ACCEPTED
                           + "\nselect distinct value as host, 'https://' || value as url from acc where kind = 'host'")
    o["failure_log"] = W + site_base + """
select page_id, url, failure_reason as reason, 'Skipped ' || url || ': ' || failure_reason as message
from site_ok where not ok"""
    o["host_ext"] = f"select page_id, {host_of('url')} as host, {ext_of('url')} as ext from pages"

    # joins
    o["unseen_links"] = (W + f"{site_base}, {seeds_base}, " + links_ctes("(select * from site_ok where ok)")
                         + f"\nselect page_id, pos, dst_key from lk where dst_key not in (select {url_key('url')} from seeds)")
    o["match_links_to_pages"] = (W + crawl_base + """
select e.page_id, e.rank, e.dst_key as url_key, p.page_id as dst_page_id, p.ok
from edges e left join site_keyed p on p.url_key = e.dst_key""")

    # distinct
    o["unique_emails"] = W + DOC_HITS + "\nselect distinct email from doc_hits"
    o["dedupe_urls_first_wins"] = f"""select {url_key('url')} as url_key, min(page_id) as page_id, arg_min(url, page_id) as url
from pages group by 1"""

    # aggregates
    o["email_report"] = W + fx("hits") + f"\n{HITS_REPORT} from hits group by email"
    o["document_email_report"] = W + DOC_HITS + """
select email, count(*) as hits, min(page_id) as first_page_id, max(page_id) as last_page_id,
  arg_min(source_url, page_id) as source_url from doc_hits group by email"""
    o["crawl_summary"] = W + f"{site_base}, {SITE_HITS}" + """
select (select count(*) from site_ok) as processed_pages, (select count(*) from site_ok where not ok) as failed_pages,
  (select count(distinct email) from site_hits) as unique_email_count, (select count(*) from site_hits) as total_email_hits,
  0.0::double as duration_seconds"""
    src_vals = ", ".join(f"({i}, {_q(s)})" for i, s in enumerate(DEFAULT_SOURCES))
    o["enrichment_counts"] = W + DISC + ", " + ACCEPTED + f""",
src(source_order, source) as (values {src_vals}),
cnt as (select source, count(*) filter (where kind = 'email') as emails, count(*) filter (where kind = 'host') as hosts
        from acc group by source)
select source_order, src.source, coalesce(emails, 0) as emails, coalesce(hosts, 0) as hosts
from src left join cnt on cnt.source = src.source"""
    o["enrichment_sets"] = W + DISC + ", " + ACCEPTED + "\nselect distinct kind, value from acc"
    o["seed_hosts"] = W + seeds_base + ", " + SEED_HOSTS + "\nselect host from seed_hosts"
    o["event_log_summary"] = W + event_ctes() + """
select coalesce(arg_max(processed_pages, line_no) filter (where processed_pages is not null), 0) as processed_pages,
  coalesce(arg_max(failed_pages, line_no) filter (where failed_pages is not null), 0) as failed_pages,
  coalesce(arg_max(unique_email_count, line_no) filter (where unique_email_count is not null), 0) as unique_email_count,
  coalesce(arg_max(total_email_hits, line_no) filter (where total_email_hits is not null), 0) as total_email_hits,
  coalesce(greatest(arg_max(coalesce(duration_seconds, 0.0), line_no) filter (where kind = 'summary'), 0.0), 0.0)::double
    as duration_seconds,
  count(*) filter (where kind = 'summary') > 0 as saw_summary
from ev where kind in ('progress', 'summary')"""

    # windows
    o["running_progress"] = W + f"{site_base}, {SITE_HITS}" + """,
ph as (select page_id, count(*) as h from site_hits group by 1),
fu as (select fp as page_id, count(*) as n from (select email, min(page_id) as fp from site_hits group by 1) x group by 1)
select s.page_id, s.url as current_url,
  (count(*) over w)::bigint as processed_pages,
  (sum(case when s.ok then 0 else 1 end) over w)::bigint as failed_pages,
  (sum(coalesce(fu.n, 0)) over w)::bigint as unique_email_count,
  (sum(coalesce(ph.h, 0)) over w)::bigint as total_email_hits
from site_ok s left join ph on ph.page_id = s.page_id left join fu on fu.page_id = s.page_id
window w as (order by s.page_id rows between unbounded preceding and current row)"""
    o["carry_forward"] = W + event_ctes() + """,
pe as (select * from ev where kind in ('progress', 'summary')),
cf as (select line_no, kind,
  coalesce(last_value(processed_pages ignore nulls) over w, 0) as processed_pages,
  coalesce(last_value(failed_pages ignore nulls) over w, 0) as failed_pages,
  coalesce(last_value(unique_email_count ignore nulls) over w, 0) as unique_email_count,
  coalesce(last_value(total_email_hits ignore nulls) over w, 0) as total_email_hits,
  coalesce(queue_length, 0) as queue_length, current_url
  from pe window w as (order by line_no rows between unbounded preceding and current row))
select line_no, processed_pages, failed_pages, unique_email_count, total_email_hits, queue_length, current_url
from cf where kind = 'progress'"""
    o["carry_forward_runs"] = W + event_ctes("run_lines", "run_id") + """,
cf as (select run_id, line_no, kind,
  coalesce(last_value(processed_pages ignore nulls) over w, 0) as processed_pages,
  coalesce(last_value(failed_pages ignore nulls) over w, 0) as failed_pages,
  coalesce(last_value(unique_email_count ignore nulls) over w, 0) as unique_email_count,
  coalesce(last_value(total_email_hits ignore nulls) over w, 0) as total_email_hits,
  coalesce(queue_length, 0) as queue_length, current_url
  from ev where kind in ('progress', 'summary')
  window w as (partition by run_id order by line_no rows between unbounded preceding and current row))
select run_id, line_no, processed_pages, failed_pages, unique_email_count, total_email_hits, queue_length, current_url
from cf where kind = 'progress'"""
    o["event_log_summary_runs"] = W + event_ctes("run_lines", "run_id") + """,
told as (select * from ev where kind in ('progress', 'summary')),
last as (select run_id, arg_max(processed_pages, line_no) filter (where processed_pages is not null) as processed_pages,
  arg_max(failed_pages, line_no) filter (where failed_pages is not null) as failed_pages,
  arg_max(unique_email_count, line_no) filter (where unique_email_count is not null) as unique_email_count,
  arg_max(total_email_hits, line_no) filter (where total_email_hits is not null) as total_email_hits,
  arg_max(coalesce(duration_seconds, 0.0), line_no) filter (where kind = 'summary') as duration_seconds,
  count(*) filter (where kind = 'summary') as n from told group by run_id)
select r.run_id, coalesce(processed_pages, 0) as processed_pages, coalesce(failed_pages, 0) as failed_pages,
  coalesce(unique_email_count, 0) as unique_email_count, coalesce(total_email_hits, 0) as total_email_hits,
  coalesce(greatest(duration_seconds, 0.0), 0.0)::double as duration_seconds, coalesce(n, 0) > 0 as saw_summary
from (select distinct run_id from ev) r left join last l on l.run_id = r.run_id"""
    o["running_progress_runs"] = W + f"{site_base}, {SITE_HITS}" + """,
sr as (select *, case when page_id % 3 = 0 then 0 else page_id % 7 end as run_id from site_ok),
hr as (select h.*, s.run_id from site_hits h join sr s on s.page_id = h.page_id),
ph as (select page_id, count(*) as h from hr group by 1),
fu as (select fp as page_id, count(*) as n from (select run_id, email, min(page_id) as fp from hr group by 1, 2) x group by 1)
select s.run_id, s.page_id, s.url as current_url,
  (count(*) over w)::bigint as processed_pages,
  (sum(case when s.ok then 0 else 1 end) over w)::bigint as failed_pages,
  (sum(coalesce(fu.n, 0)) over w)::bigint as unique_email_count,
  (sum(coalesce(ph.h, 0)) over w)::bigint as total_email_hits
from sr s left join ph on ph.page_id = s.page_id left join fu on fu.page_id = s.page_id
window w as (partition by s.run_id order by s.page_id rows between unbounded preceding and current row)"""
    o["cap_links_per_page"] = W + links_ctes("pages") + f"""
select page_id, pos, rank, dst_key from (select *, row_number() over (partition by page_id order by pos) as rank from lk) x
where rank <= {LINK_CAP}"""

    # sorts / limits
    o["order_report"] = o["email_report"] + " order by lower(email), email"
    o["cap_enrichment_seeds"] = W + DISC + ", " + ACCEPTED + ", " + HOST_SEEDS + "\nselect host, url, host_rank from host_seeds"
    o["sorted_enrichment_emails"] = (W + DISC + ", " + ACCEPTED
                                     + "\nselect distinct value as email from acc where kind = 'email' order by email")
    o["log_messages"] = W + event_ctes() + ", " + LOG_MSGS + "\nselect line_no, message from msgs"
    o["keep_last_lines"] = W + event_ctes() + ", " + LOG_MSGS + """
select line_no, message from msgs
qualify row_number() over (order by line_no desc) <= case when (select count(*) from msgs) > 1200 then 1000 else 9223372036854775807 end"""
    o["error_tail"] = W + event_ctes() + """,
t as (select line_no, trim_ws(line) as t from ev where kind = 'unparsed' and length(trim_ws(line)) > 0 order by line_no desc limit 20)
select coalesce(string_agg(t, ' | ' order by line_no), '') as error_tail from t"""

    # set operations
    o["add_enrichment_seeds"] = (W + fx("seed_lines") + "," + SEEDS_LENIENT + ", " + DISC + ", " + ACCEPTED + ", " + HOST_SEEDS
                                 + f""",
u as (select seed_rank::bigint as seed_rank, url from seeds_l
      union all select host_rank + coalesce((select max(seed_rank) from seeds_l), -1), url from host_seeds),
n as (select seed_rank, {normalize_url('url')} as url from u)
select min(seed_rank)::integer as seed_rank, url from n where url is not null group by url""")
    o["add_enrichment_hits"] = (W + fx("hits") + ", " + DISC + ", " + ACCEPTED + ", " + ENRICHED_HITS
                                + "\nselect page_id, source_url, email, seen_at from enr_hits")
    o["enriched_email_report"] = (W + fx("hits") + ", " + DISC + ", " + ACCEPTED + ", " + ENRICHED_HITS
                                  + f"\n{HITS_REPORT} from enr_hits group by email")

    # graph
    o["link_graph"] = W + crawl_base + "\nselect page_id, src_key, pos, rank, dst_url, dst_key from edges"
    reach = reach_ctes(CRAWL.max_depth, CRAWL.max_pages)
    W = "with recursive "
    o["crawl_reach"] = W + crawl_base + ", " + reach + "\nselect url_key, depth, parent_key, page_id, ok from reach"
    worker_base = (f"{fx('site')}, site_ok as ({fetch_cols('site', accept_missing=False)}), {seeds_base}, "
                   f"{SEED_HOSTS}, {SITE_KEYED}, {link_graph_ctes(CRAWL.max_links_per_page, anchors=True)}")
    o["crawl_reach_worker"] = (W + worker_base + ", " + reach
                               + "\nselect url_key, depth, parent_key, page_id, ok from reach")
    o["page_budget"] = (W + crawl_base + ", " + reach_ctes(CRAWL.max_depth, BUDGET_PAGES)
                        + "\nselect url_key, depth, parent_key from reach")
    o["failed_pages"] = W + crawl_base + ", " + reach + """
select url_key, url, depth, page_id, failure_reason from reach where not ok"""
    o["queue_length_by_level"] = W + crawl_base + ", " + reach + """,
per as (select depth, count(*) as urls from reach group by depth)
select depth, urls, (sum(urls) over (order by depth rows between unbounded preceding and current row))::bigint
  as processed_after_level, coalesce(lead(urls) over (order by depth), 0) as queue_after_level from per"""
    crawl_hits = f"""ch as ({email_hits('(select r.url, r.depth, r.path, s.page_id, s.html from reach r join site s on s.page_id = r.page_id where r.ok)', 'html', 'page_id', 'url', True)}),
chd as (select ch.*, r.depth, r.path from ch join reach r on r.page_id = ch.page_id)"""
    o["crawl_report"] = W + crawl_base + ", " + reach + ", " + crawl_hits + """
select email, count(*) as hits, first(source_url order by depth, path) as source_url, min(depth) as first_depth
from chd group by email"""
    o["crawl_report_summary"] = W + crawl_base + ", " + reach + ", " + crawl_hits + """
select (select count(*) from reach) as processed_pages, (select count(*) from reach where not ok) as failed_pages,
  (select count(distinct email) from chd) as unique_email_count, (select count(*) from chd) as total_email_hits,
  0.0::double as duration_seconds"""
    o["crawl_reach_unbudgeted"] = (W + crawl_base + ", " + reach_ctes(CRAWL.max_depth, None)
                                   + "\nselect url_key, depth, parent_key, page_id, ok from reach")
    o["crawl_report_budget"] = W + crawl_base + ", " + reach_ctes(CRAWL.max_depth, BUDGET_PAGES) + ", " + crawl_hits + """
select email, count(*) as hits, first(source_url order by depth, path) as source_url, min(depth) as first_depth
from chd group by email"""
    o["crawl_report_unbudgeted"] = W + crawl_base + ", " + reach_ctes(CRAWL.max_depth, None) + ", " + crawl_hits + """
select email, count(*) as hits, first(source_url order by depth, path) as source_url, min(depth) as first_depth
from chd group by email"""
    enriched_base = (f"{site_base}, {fx('seed_lines')}, {SEEDS_LENIENT}, {DISC}, {ACCEPTED}, {HOST_SEEDS}, "
                     f"""enr_u as (select seed_rank::bigint as seed_rank, url from seeds_l
      union all select host_rank + coalesce((select max(seed_rank) from seeds_l), -1), url from host_seeds),
enr_n as (select seed_rank, {normalize_url('url')} as url from enr_u),
seeds as (select min(seed_rank)::integer as seed_rank, url from enr_n where url is not null group by url), """
                     f"{SEED_HOSTS}, {SITE_KEYED}, {link_graph_ctes(CRAWL.max_links_per_page)}, {reach}, {crawl_hits}, "
                     f"""timed as (select email, source_url, depth, path, timestamp '2024-01-01 00:00:00' + to_seconds(page_id) as seen_at from chd
      union all select distinct value, {_q(ENRICHMENT_SOURCE_URL)}, -1, null::bigint[], null::timestamp from acc where kind = 'email')""")
    o["crawl_report_enriched"] = W + enriched_base + """
select email, count(*) as hits, first(source_url order by depth, path) as source_url,
  min(case when depth >= 0 then depth end) as first_depth, min(seen_at) as first_seen, max(seen_at) as last_seen
from timed group by email"""
    o["crawl_summary_enriched"] = W + enriched_base + """
select (select count(*) from reach) as processed_pages, (select count(*) from reach where not ok) as failed_pages,
  (select count(distinct email) from timed) as unique_email_count, (select count(*) from chd) as total_email_hits,
  (select count(*) from timed where depth = -1) as enrichment_hits,
  (select (max(page_id) - min(page_id))::double from reach) as duration_seconds"""
    o["order_report_ranked"] = "with " + fx("hits") + """
select email, count(*) as hits, row_number() over (order by lower(email), email) - 1 as row_no from hits group by email"""
    o["write_read_event_log"] = "with " + fx("hits") + "\nselect 'email' as kind, email, source_url from hits"
    o["write_read_report_csv"] = o["export_report_csv"]
    o["target_domain_with_suffixes"] = "with " + fx("site") + f"""
select distinct {host_of('url')} as host, {host_of('url')} as domain from site"""
    o["unique_emails_sketch"] = "with " + fx("hits") + """,
d as (select distinct cast(seen_at as date) as day from hits),
f as (select email, min(cast(seen_at as date)) as day from hits group by email)
select d.day, (select count(*) from f where f.day <= d.day) as unique_emails, true as within_error from d"""
    o["load_discovery_files"] = ("with " + DISC + f"""
select rec_id, source, kind, value from disc where source in {_in_list(DEFAULT_SOURCES)}""")
    rules = ", ".join(f"({_q(x.split()[0])})" for x in SUFFIX_LINES if x and not x.startswith("//"))
    o["registrable_domains"] = "with " + fx("hosts") + f""",
r as (select rule, starts_with(rule, '!') as exc, starts_with(rule, '*.') as wild,
  regexp_replace(rule, '^(!|\\*\\.)', '') as tail from (values {rules}) t(rule)),
h as (select distinct lower(host) as host from hosts),
m as (select host, exc, len(string_split(tail, '.')) + (case when wild then 1 when exc then -1 else 0 end) as n
  from h join r on ((not wild and host = tail) or ends_with(host, '.' || tail)) and not regexp_matches(host, '[0-9]$')),
b as (select host, coalesce(max(n) filter (where exc), max(n)) as n from m group by host)
select h.host, case when len(string_split(h.host, '.')) > b.n
  then array_to_string(string_split(h.host, '.')[-(b.n + 1):], '.') else {two_label_domain('h.host')} end as domain
from h left join b on b.host = h.host"""
    return {name: _expand_trims(sql) for name, sql in o.items()}
