"""Site lists, earlier state and fetched pages derived from the test tables.

The test tables hold no contact pages, so these views build them: one site per
order, with its entry page, and one page per line number of the order. The
text runs in Spark SQL and, with plain table names filled in, in DuckDB. Some
sites answer on http only, redirect, fail, or lead to one shared parking host.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hailbook.sources.responses import read_pages

TABLES = ("orders", "lineitem", "region", "pages", "documents")
PAGES_PER_TASK = 5_000  # of the pages table
SEEDS_PER_TASK = 100_000  # rows of orders or lineitem that a page is built of

CONTACT_PAGES = """
select site_id, pos,
  concat(case when site_id % 4 = 0 then 'http://' else 'https://' end,
    'shop', cast(site_id as string), '.example.com') as root,
  case pos when 0 then '' when 1 then '/contacts' when 2 then '/contact' when 3 then '/about'
    when 4 then '/support' when 5 then '/team' else concat('/p/', cast(pos - 6 as string)) end
    as path,
  concat('<!DOCTYPE html><html><head><title>  ',
    case when pos % 3 = 1 then '' else concat('Shop ', cast(site_id as string), '  &amp; Sons') end,
    ' </title><style>p b</style><script>var m="hidden@example.org";</script></head><body>',
    '<!-- old: gone@example.org <a href="/gone">x</a> --><p>Write to Desk',
    cast(a % 7 as string), '@Mail', cast(b % 5 as string), '.Example.COM, or <b>sales&#64;shop',
    cast(site_id as string), '.example.com</b> today</p>',
    '<a href="mailto:Box', cast(a % 5 as string), '@example.org',
    case when a % 4 = 0 then '?subject=Hi' else '' end, '">Mail</a>',
    case when a % 3 = 0 then concat('<p>Telegram: @Chan_', cast(a % 11 as string), '</p>')
      when a % 3 = 1 then concat('<p>see https://telegram.me/News_', cast(b % 9 as string), ' now</p>')
      else '<p>mention @nobody</p>' end,
    case when b % 2 = 0 then concat('<a href="https://t.me/Team_', cast(a % 11 as string),
      '/"><i>tg:</i> @Desk_', cast(b % 6 as string), '</a>') else '' end,
    '<p>8 (9', lpad(cast(a % 97 as string), 2, '0'), ') 123-45-', lpad(cast(b % 90 as string), 2, '0'),
    '</p><a class="call" href="tel:+7 9', lpad(cast(a % 13 as string), 2, '0'), ' 555 44 33">call</a>',
    '<a href="/about?x=', cast(a % 3 as string), '">About</a><a href="p/', cast(a % 4 as string),
    '#top">More</a><a href="/shop/../help/./team">Team</a>',
    '<a href="https://other.example.org/contact">Partner</a><a href="//SHOP',
    cast(site_id as string), '.example.com/P/x;v=1">Item</a>',
    '<a href="javascript:void(0)">-</a><a href="#end">end</a><a name="end">.</a></body></html>')
    as html
from (
  select o_orderkey as site_id, 0 as pos, o_custkey as a, o_custkey % 100 as b from {orders}
  union all
  select l_orderkey as site_id, l_linenumber as pos, min(l_partkey) as a, min(l_suppkey) as b
  from {lineitem} group by l_orderkey, l_linenumber
) seeds
"""

RESPONSES = f"""
select concat(root, path) as requested_url,
  case when pos = 2 then concat(root, '/contacts')
    when pos = 0 and site_id % 17 = 2 then 'https://parking.example.net/welcome'
    when site_id % 23 = 6 and pos in (0, 1) then null
    when pos = 0 and site_id % 13 = 3 then concat(replace(root, '://', '://www.'), '/home/')
    else concat(root, path) end as final_url,
  case when pos = 3 and site_id % 3 = 0 then 404 when pos = 0 and site_id % 19 = 4 then 503
    else 200 end as status_code,
  case when pos = 4 and site_id % 5 = 0 then 'application/pdf'
    when pos = 5 and site_id % 2 = 0 then 'Text/Plain' else 'text/html; charset=utf-8' end
    as content_type,
  html
from ({CONTACT_PAGES}) contact_pages
where not (pos = 0 and site_id % 11 = 5)
union all
select concat('https://parking.example.net/welcome/', case r_regionkey when 0 then 'contacts'
    when 1 then 'about' else concat('p', cast(r_regionkey as string)) end) as requested_url,
  concat('https://parking.example.net/', cast(r_regionkey as string)) as final_url,
  200 as status_code, 'text/html' as content_type,
  concat('<title>', r_name, '</title><p>owner', cast(r_regionkey as string), '@parking.example.net')
    as html
from {{region}}
"""

# Messy single values and lists, one row per order.
VALUES = """
select o_orderkey as id,
  concat('  <INFO', cast(o_orderkey % 23 as string), '@Example', cast(o_custkey % 5 as string),
    '.COM>, ') as email,
  case o_orderkey % 9 when 0 then concat('@Chan_', cast(o_custkey as string))
    when 1 then concat('https://t.me/Team_', cast(o_custkey as string), '/?start=1')
    when 2 then concat('HTTP://WWW.Telegram.me/News', cast(o_custkey as string), ';v=1')
    when 3 then concat('t.me/joinchat/A', cast(o_custkey as string), '?x=1')
    when 4 then concat('https://example.com/contact', cast(o_custkey as string))
    when 5 then concat(' (bare-', cast(o_custkey as string), ') ')
    when 6 then concat('//t.me/foo', cast(o_custkey as string)) when 7 then ' .,; '
    else '' end as telegram,
  case o_orderkey % 5 when 0 then concat('8 (9', lpad(cast(o_custkey % 97 as string), 2, '0'), ') 123-45-67')
    when 1 then concat('+7 495 ', lpad(cast(o_custkey % 997 as string), 3, '0'), ' 11 22')
    when 2 then '12345' when 3 then concat('7-912-345-67-', lpad(cast(o_custkey % 89 as string), 2, '0'))
    else 'no phone' end as phone,
  concat('Telegram: @Chan_', cast(o_custkey % 50 as string), ' or tg @desk', cast(o_orderkey % 7 as string),
    ', see https://t.me/Team_', cast(o_custkey % 30 as string), '/ and http://www.telegram.me/chan_',
    cast(o_custkey % 50 as string), '. Contact person: @nobody; mtg:@ab t.me/bare') as note,
  concat('  Shop "', cast(o_orderkey as string), '",  ', o_orderstatus, ' ') as title,
  concat(' https://shop', cast(o_orderkey % 997 as string), '.example.com ') as url
from {orders}
"""

# Character references of every kind, one row per order: a number, a hex number,
# a name, an unknown name, a reference to a reference, a bare ampersand.
REFERENCES = """
select o_orderkey as id,
  concat('n&#', cast(65 + o_orderkey % 26 as string), '; h&#x', lower(hex(97 + o_custkey % 26)),
    '; ', case o_orderkey % 4 when 0 then '&eacute;' when 1 then '&hellip;' when 2 then '&Omega;'
      else '&laquo;' end, ' &none', cast(o_custkey % 10 as string), '; &amp;lt; R & D') as raw
from {orders}
"""

# Two spellings per site; for odd ones these are two URLs of one domain.
RAW_SITES = """
select o_orderkey * 2 as position,
  concat('  SHOP', cast(o_orderkey as string), '.Example.com/ ') as value from {orders}
union all
select o_orderkey * 2 + 1 as position,
  concat(case when o_orderkey % 2 = 0 then 'HTTPS://' else 'http://' end,
    'Shop', cast(o_orderkey as string), '.example.com?from=list') as value from {orders}
union all
select o_orderkey * 2 as position, '   ' as value from {orders} where o_orderkey % 50 = 0
"""

PROCESSED = """
select concat('https://SHOP', cast(o_orderkey as string), '.example.com/old') as value
from {orders} where o_orderkey % 7 = 0
union all
select concat('shop', cast(o_orderkey as string), '.example.com') as value
from {orders} where o_orderkey % 14 = 0
"""

VIEWS = {
    "contact_pages": CONTACT_PAGES,
    "responses": RESPONSES,
    "messy": VALUES,
    "references": REFERENCES,
    "raw_sites": RAW_SITES,
    "processed": PROCESSED,
}


def _tasks(spark: SparkSession, rows: int, rows_per_task: int) -> int:
    """Tasks that rows are spread over: they grow with the rows, so that one task's share does not."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // rows_per_task))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table. The pages are one small file, so its rows are spread over all cores."""
    path = f"{sf_dir}/{name}.parquet"
    if name == "pages":
        pages = read_pages(spark, path)
        return pages.repartition(_tasks(spark, pages.count(), PAGES_PER_TASK))
    return spark.read.parquet(path)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view over the tables in ``sf_dir``.

    The page views are far larger than the tables they come from, so the rows
    of these are spread over all cores, while they are narrow: html is built
    behind the shuffle. Counts come from the files' footers.
    """
    sql = VIEWS[name]
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql}
    if "lineitem" in used:
        orders, items = used["orders"], used["lineitem"]
        # orders in any way, items by the keys they are grouped by next
        used["orders"] = orders.repartition(_tasks(spark, orders.count(), SEEDS_PER_TASK))
        used["lineitem"] = items.repartition(
            _tasks(spark, items.count(), SEEDS_PER_TASK), "l_orderkey", "l_linenumber"
        )
    return spark.sql(sql, **used)


def view_sql(name: str) -> str:
    """The same view as DuckDB text, over tables of the same names."""
    return VIEWS[name].format(**{t: t for t in TABLES})
