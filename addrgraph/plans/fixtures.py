"""Derived input tables, built from the driver's tables by SQL text that runs
unchanged in Spark SQL and in DuckDB.

``site``        captured, linked web site with failures      (from customer)
``markup``      pages of awkward markup              (from customer)
``hits``        address sightings with time                  (from events)
``hosts``       hosts under listed suffixes            (from customer)
``event_lines`` the typed NDJSON log                         (from events)
``run_lines``   the same of several interleaved runs  (from events)
``discovery``   enrichment records                           (from supplier)
``seed_lines``  raw seed input                               (from nation)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from addrgraph.sources.tables import register_tables

# Page count of the site, as a scalar subquery (evaluated once).
_N = "(select count(*) from customer)"

SITE_SQL = f"""
select c_custkey as page_id,
  concat('https://h', cast(c_custkey % 5 as string), '.example.com/c/', cast(c_custkey as string)) as url,
  concat(
    '<a href="https://h', cast((c_custkey + 10) % {_N} % 5 as string), '.example.com/c/', cast((c_custkey + 10) % {_N} as string), '#s">n</a>',
    '<a href="https://h', cast((c_custkey * 3 + 1) % {_N} % 5 as string), '.example.com/c/', cast((c_custkey * 3 + 1) % {_N} as string), '/">m</a>',
    '<a href="https://h', cast((c_custkey * 7 + 5) % {_N} % 5 as string), '.example.com/c/', cast((c_custkey * 7 + 5) % {_N} as string), '">p</a>',
    '<a href="', chr(9), '/i.png', chr(10), '">i</a><a href="mailto:x@y.org">w</a> &lt;user', cast(c_custkey % 37 as string), '&#64;mail', cast(c_custkey % 9 as string), '.example.com&gt;') as html,
  case when c_custkey % 17 = 16 then 404 else 200 end as status,
  case when c_custkey % 13 = 12 then 'application/pdf' when c_custkey % 11 = 10 then null else 'text/html; charset=utf-8' end as content_type
from customer
"""

# Markup whose links a search for ``href`` alone would get wrong.
MARKUP_SQL = """
select c_custkey as page_id,
  concat('https://h', cast(c_custkey % 5 as string), '.example.com/m/', cast(c_custkey as string)) as url,
  concat(
    '<!-- <a href="/comment', cast(c_custkey as string), '">no</a> --><title>a <a href="/title"> b</title>',
    '<script type="x>y">var s = "<a href=/script', cast(c_custkey as string), '>"; // </a></script>',
    '<a data-href="/data', cast(c_custkey as string), '" href="/t/', cast(c_custkey % 17 as string), '">t</a>',
    '<a title="href=/value" href=/w/', cast(c_custkey % 13 as string), '>w</a>',
    '<A class="a > b" HREF = ', chr(39), '/q?a=', cast(c_custkey % 7 as string), '&amp;b="2"', chr(39), '>q</A>',
    '<area shape=rect href="/t/', cast(c_custkey % 17 as string), '#part"/><abbr href="/abbr">x</abbr><link href="/l.css">',
    '<a href>none</a><a name="n">none</a><a href="/i/', cast(c_custkey as string), '.png">i</a>',
    '<a', chr(10), chr(9), 'href="/p/', cast(c_custkey as string), '" href="/second">p</a>',
    case when c_custkey % 5 = 0 then concat('<style>a:after { content: "<a href=/style>" }</style><a href=', chr(39), chr(39), '>e</a>') else '<textarea><a href="/area"></textarea>' end,
    case when c_custkey % 3 = 0 then '<a onclick="f(1 > 2)" href=up/x>u</a>' else '<!DOCTYPE html><p href="/p">' end,
    case when c_custkey % 11 = 0 then '<!-- open <a href="/open">' else '<a href="//h9.example.com/n">n</a>' end) as html
from customer
"""

HITS_SQL = """
select event_id as page_id,
  concat('https://h', cast(user_id % 5 as string), '.example.com/e/', cast(event_id % 997 as string)) as source_url,
  concat('user', cast(user_id as string), '@mail', cast(user_id % 9 as string), '.example.com') as email,
  ts as seen_at
from events
"""

# Hosts under suffixes that wildcard and exception rules describe.
HOSTS_SQL = """
select c_custkey as rec_id,
  case c_custkey % 11
    when 0 then concat('w', cast(c_custkey % 50 as string), '.Shop', cast(c_custkey % 20 as string), '.co.uk')
    when 1 then concat('x', cast(c_custkey % 9 as string), '.www.ck')
    when 2 then concat('p', cast(c_custkey % 40 as string), '.q', cast(c_custkey % 30 as string), '.ck')
    when 3 then concat('q', cast(c_custkey % 30 as string), '.ck')
    when 4 then concat('a', cast(c_custkey % 13 as string), '.b', cast(c_custkey % 10 as string), '.kawasaki.jp')
    when 5 then concat('h', cast(c_custkey % 7 as string), '.city.kawasaki.jp')
    when 6 then concat('s', cast(c_custkey % 100 as string), '.t.example.com')
    when 7 then concat('10.0.', cast(c_custkey % 30 as string), '.7')
    when 8 then concat('n', cast(c_custkey % 25 as string), '.unlisted')
    when 9 then case when c_custkey % 2 = 0 then 'www.ck' else 'ck' end
    else concat('k', cast(c_custkey % 6 as string), '.c', cast(c_custkey % 8 as string), '.kobe.jp') end as host
from customer
"""

EVENT_LINES_SQL = """
select event_id as line_no,
  case
    when event_id % 2500 = 2499 then concat('{"type":"summary","processed_pages":', cast(event_id as string), ',"failed_pages":3,"duration_seconds":1.5}')
    when event_id % 50 = 7 then chr(9)
    when event_type = 'signup' and event_id % 4 = 0 then concat('{"type":"EMAIL","email":"user', cast(user_id as string), '@example.com","source_url":"', chr(92), 't"}')
    when event_type = 'signup' then concat('{"type":"email","email":"user', cast(user_id as string), '@example.com","source_url":"https://h.example.com/', cast(event_id as string), '"}')
    when event_type = 'view' and event_id % 3 = 0 then concat('{"type":"progress","processed_pages":"', cast(event_id as string), '","queue_length":', cast(event_id % 11 as string), '}')
    when event_type = 'view' and event_id % 3 = 1 then concat('{"type":"progress","processed_pages":"x","failed_pages":', cast(event_id % 5 as string), ',"current_url":"https://h.example.com/"}')
    when event_type = 'view' then concat('{"type":"progress","unique_email_count":', cast(user_id as string), ',"total_email_hits":', cast(event_id as string), '}')
    when event_type = 'click' then concat('{"type":"log","message":"m', cast(event_id as string), '"}')
    when event_type = 'error' then concat('not json ', cast(event_id as string))
    else '{"no_type":1}'
  end as line
from events
"""

# The log of several runs, interleaved; run 0 has a third of all lines.
RUN_LINES_SQL = EVENT_LINES_SQL.replace(
    "select event_id as line_no,",
    "select event_id as line_no, case when event_id % 3 = 0 then 0 else 1 + user_id % 40 end as run_id,")

DISCOVERY_SQL = """
select s_suppkey as rec_id,
  case s_suppkey % 7 when 0 then 'crtsh' when 1 then 'rapiddns' when 2 then 'waybackarchive' when 3 then 'commoncrawl'
    when 4 then 'thc' when 5 then 'duckduckgo' else 'nosuch' end as source,
  case when s_suppkey % 2 = 0 then 'host' else 'email' end as kind,
  case s_suppkey % 12
    when 0 then concat('*.h', cast(s_nationkey as string), '.example.com')
    when 2 then concat('https://H', cast(s_nationkey as string), '.example.com/x?q=1')
    when 4 then concat('h', cast(s_nationkey as string), '.example.com:8443', chr(13))
    when 6 then concat('h', cast(s_nationkey as string), '.example.net')
    when 8 then 'bad_host'
    when 10 then 'EXAMPLE.com/path'
    when 1 then concat('User', cast(s_nationkey as string), '@Example.com>,')
    when 3 then concat(chr(9), 'user', cast(s_nationkey as string), '@example.com', chr(10))
    when 5 then 'a..b@example.com'
    when 7 then 'no-at.example.com'
    when 9 then 'x@y@example.com'
    else ' u@.example.com ' end as value
from supplier
"""

SEED_LINES_SQL = """
select n_nationkey as line_no,
  case when n_nationkey = 17 then 'http://[2001:db8::1]/a' when n_nationkey = 23 then 'http://[2001:db8::2]:80/b' else case n_nationkey % 6
    when 0 then concat('https://h', cast(n_regionkey as string), '.example.com/c/', cast(n_regionkey as string))
    when 1 then concat(chr(9), ' h', cast(n_regionkey as string), '.example.com/c/', cast(n_regionkey as string), chr(13))
    when 2 then concat('HTTPS://H', cast(n_regionkey as string), '.example.com/c/', cast(n_regionkey as string))
    when 3 then chr(9)
    when 4 then concat('http://h', cast(n_regionkey as string), '.example.com:80/c/', cast(n_regionkey as string), '/')
    else concat('https://h', cast(n_regionkey as string), '.example.com/c/', cast(n_regionkey as string), '#top') end end as line
from nation
"""

FIXTURE_SQL = {
    "site": (SITE_SQL, ["customer"]),
    "markup": (MARKUP_SQL, ["customer"]),
    "hits": (HITS_SQL, ["events"]),
    "hosts": (HOSTS_SQL, ["customer"]),
    "event_lines": (EVENT_LINES_SQL, ["events"]),
    "run_lines": (RUN_LINES_SQL, ["events"]),
    "discovery": (DISCOVERY_SQL, ["supplier"]),
    "seed_lines": (SEED_LINES_SQL, ["nation"]),
}

# Lines of a public-suffix list, as the list's own documentation gives them.
SUFFIX_LINES = ["// example rules", "com", "uk", "co.uk  // a comment", "", "*.ck", "!www.ck", "jp", "*.kawasaki.jp",
                "!city.kawasaki.jp", "*.kobe.jp"]

# Customers that one task makes pages of.
TASK_ROWS = 10_000

# Target domain of the discovery fixture.
DISCOVERY_TARGET_DOMAIN = "example.com"


def fixture(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    """Build one derived table from the folder's tables (lazy).

    Pages and hosts come from ``customer``, and all work on them is done in the row, so
    that table is dealt by rows: a narrow file of one row group would else be one task.
    """
    sql, deps = FIXTURE_SQL[name]
    register_tables(spark, data_dir, deps, task_rows={"customer": TASK_ROWS})
    # hits.seen_at stays TIMESTAMP_NTZ like events.ts; the streaming jobs cast
    # it to TIMESTAMP (UTC session) before a watermark.
    return spark.sql(sql)


def fixture_cte(*names: str) -> str:
    """``WITH`` clause defining the named fixtures, for SQL over the raw tables."""
    return "with " + ",\n".join(f"{n} as ({FIXTURE_SQL[n][0]})" for n in names)
