"""DuckDB oracle SQL for every registered query.

Written independently of the Spark code, in the plainest SQL shape available
(dense grids by CROSS JOIN, one LEFT JOIN per cohort tier, correlated
aggregates), over the same driver tables. Parameters match
:mod:`boxpace.sources.tables`.
"""
from __future__ import annotations

AS_OF = "TIMESTAMP '2000-03-15 00:00:00'"
PRE_END = "TIMESTAMP '1998-01-01 00:00:00'"
POST_START = "TIMESTAMP '1999-07-01 00:00:00'"

SALES = """
sales AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
         o_orderdate AS sale_date,
         CAST(CAST(date_trunc('year', o_orderdate) + CASE WHEN month(o_orderdate) <= 6 THEN INTERVAL 6 MONTH
              ELSE INTERVAL 12 MONTH END AS DATE) - 10 AS TIMESTAMP) AS event_date,
         p_name AS event_name, p_type AS event_type, n_name AS venue,
         l_quantity AS qty_sold, l_extendedprice AS amount,
         o_orderpriority AS channel, c_mktsegment AS customer_type,
         concat(CAST(year(o_orderdate) AS VARCHAR), '-', lpad(CAST((year(o_orderdate) + 1) % 100 AS VARCHAR), 2, '0')) AS season
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN customer ON o_custkey = c_custkey
),
fact AS (
  SELECT *, dayname(event_date) AS weekday, event_name AS event_label,
         lower(event_name) || '|' || strftime(event_date, '%Y-%m-%d') AS event_instance,
         date_diff('day', CAST(sale_date AS DATE), CAST(event_date AS DATE)) AS days_out
  FROM sales
)"""

ORACLES: dict[str, str] = {}


def oracle(name: str, body: str) -> None:
    ORACLES[name] = ("WITH " + SALES + ",\n" + body.strip()).replace("{AS_OF}", AS_OF) \
        .replace("{PRE_END}", PRE_END).replace("{POST_START}", POST_START)


def _curve_sql(src: str, lead_expr: str, lead_filter: str, pct_scale: str, hi: str, out_scale: str,
               band: bool) -> str:
    """Grid curve: events x bins, running share, quartiles, fill, running max."""
    p25 = "least(p25_m, med_m)" if band else "p25_m"
    p75 = "greatest(p75_m, med_m)" if band else "p75_m"
    return f"""
d AS (SELECT event_name, event_date, {lead_expr} AS lead, qty_sold FROM {src}
      WHERE event_date IS NOT NULL AND sale_date IS NOT NULL AND qty_sold IS NOT NULL {lead_filter}),
eb AS (SELECT event_name, event_date, CAST(floor(lead / 3.0) * 3 AS INTEGER) AS d_bin, sum(qty_sold) AS q
       FROM d GROUP BY event_name, event_date, d_bin),
ev AS (SELECT event_name, event_date, sum(q) AS total FROM eb GROUP BY event_name, event_date),
bins AS (SELECT CAST(range AS INTEGER) AS d_bin FROM range(0, 121, 3)),
grid AS (SELECT ev.event_name, ev.event_date, ev.total, bins.d_bin FROM ev CROSS JOIN bins),
cum AS (SELECT g.d_bin, g.total,
               sum(coalesce(eb.q, 0)) OVER (PARTITION BY g.event_name, g.event_date ORDER BY g.d_bin DESC
                                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c
        FROM grid g LEFT JOIN eb ON eb.event_name = g.event_name AND eb.event_date = g.event_date AND eb.d_bin = g.d_bin),
pct AS (SELECT d_bin, CASE WHEN total <> 0 THEN {pct_scale} * c / total END AS p FROM cum),
agg AS (SELECT d_bin, quantile_cont(p, 0.5) AS med, quantile_cont(p, 0.25) AS p25, quantile_cont(p, 0.75) AS p75,
               count(p) AS n FROM pct GROUP BY d_bin),
full_ AS (SELECT bins.d_bin, agg.med, agg.p25, agg.p75, coalesce(agg.n, 0) AS n FROM bins LEFT JOIN agg USING (d_bin)),
ff AS (SELECT d_bin, n,
        coalesce(last_value(med IGNORE NULLS) OVER w, 0) AS med_f,
        coalesce(last_value(p25 IGNORE NULLS) OVER w, 0) AS p25_f,
        coalesce(last_value(p75 IGNORE NULLS) OVER w, 0) AS p75_f
       FROM full_ WINDOW w AS (ORDER BY d_bin DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
mono AS (SELECT d_bin, n,
          least(greatest(max(med_f) OVER w, 0), {hi}) AS med_m,
          least(greatest(max(p25_f) OVER w, 0), {hi}) AS p25_m,
          least(greatest(max(p75_f) OVER w, 0), {hi}) AS p75_m
         FROM ff WINDOW w AS (ORDER BY d_bin DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT CAST(d_bin AS BIGINT) AS d_bin,
       round(least(med_m * {out_scale}, 100), 6) AS median_pct,
       round(least({p25} * {out_scale}, 100), 6) AS p25_pct,
       round(least({p75} * {out_scale}, 100), 6) AS p75_pct,
       CAST(n AS BIGINT) AS n
FROM mono WHERE EXISTS (SELECT 1 FROM eb)"""


oracle("r3_baseline_curve", "past AS (SELECT * FROM fact WHERE event_date < {AS_OF}),\n" + _curve_sql(
    "past", "greatest(0, least(120, days_out))", "", "1.0", "1", "100", band=False))


ORDER = "sale_date, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"

PREP = """
prep AS (SELECT *, CAST(floor(days_out / 3.0) * 3 AS INTEGER) AS d_bin FROM fact WHERE days_out BETWEEN 0 AND 120),
run AS (SELECT *, sum(qty_sold) OVER (PARTITION BY event_name ORDER BY days_out DESC, """ + ORDER + """
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_qty FROM prep),
run2 AS (SELECT *, max(cum_qty) OVER (PARTITION BY event_name) AS final_qty FROM run),
runp AS (SELECT *, CASE WHEN final_qty <> 0 THEN 100.0 * cum_qty / final_qty END AS hist_cum_pct FROM run2),
hist AS (SELECT * FROM runp WHERE event_date < {AS_OF})"""

oracle("w2_running_name", PREP + """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
       event_name, CAST(days_out AS BIGINT) AS days_out, CAST(d_bin AS BIGINT) AS d_bin,
       round(cum_qty, 6) AS cum_qty, round(final_qty, 6) AS final_qty, round(hist_cum_pct, 6) AS hist_cum_pct
FROM runp""")

LIB = PREP + """,
med0 AS (SELECT event_type, weekday, venue, d_bin, quantile_cont(hist_cum_pct, 0.5) AS m, count(DISTINCT event_name) AS n
         FROM hist WHERE event_type IS NOT NULL AND weekday IS NOT NULL AND venue IS NOT NULL
         GROUP BY event_type, weekday, venue, d_bin),
med1 AS (SELECT event_type, weekday, d_bin, quantile_cont(hist_cum_pct, 0.5) AS m, count(DISTINCT event_name) AS n
         FROM hist WHERE event_type IS NOT NULL AND weekday IS NOT NULL GROUP BY event_type, weekday, d_bin),
med2 AS (SELECT event_type, d_bin, quantile_cont(hist_cum_pct, 0.5) AS m, count(DISTINCT event_name) AS n
         FROM hist WHERE event_type IS NOT NULL GROUP BY event_type, d_bin),
med3 AS (SELECT d_bin, quantile_cont(hist_cum_pct, 0.5) AS m, count(DISTINCT event_name) AS n FROM hist GROUP BY d_bin),
fin0 AS (SELECT event_type, weekday, venue, quantile_cont(final_qty, 0.5) AS f, count(DISTINCT event_name) AS ne
         FROM hist WHERE event_type IS NOT NULL AND weekday IS NOT NULL AND venue IS NOT NULL
         GROUP BY event_type, weekday, venue),
fin1 AS (SELECT event_type, weekday, quantile_cont(final_qty, 0.5) AS f, count(DISTINCT event_name) AS ne
         FROM hist WHERE event_type IS NOT NULL AND weekday IS NOT NULL GROUP BY event_type, weekday),
fin2 AS (SELECT event_type, quantile_cont(final_qty, 0.5) AS f, count(DISTINCT event_name) AS ne
         FROM hist WHERE event_type IS NOT NULL GROUP BY event_type),
fin3 AS (SELECT quantile_cont(final_qty, 0.5) AS f, count(DISTINCT event_name) AS ne FROM hist HAVING count(*) > 0),
medians AS (
  SELECT 0 AS tier_rank, 'event_type|weekday|venue' AS tier, event_type, weekday, venue, d_bin, m, n FROM med0
  UNION ALL SELECT 1, 'event_type|weekday', event_type, weekday, NULL, d_bin, m, n FROM med1
  UNION ALL SELECT 2, 'event_type', event_type, NULL, NULL, d_bin, m, n FROM med2
  UNION ALL SELECT 3, 'all', NULL, NULL, NULL, d_bin, m, n FROM med3),
finals AS (
  SELECT 0 AS tier_rank, 'event_type|weekday|venue' AS tier, event_type, weekday, venue, f, ne FROM fin0
  UNION ALL SELECT 1, 'event_type|weekday', event_type, weekday, NULL, f, ne FROM fin1
  UNION ALL SELECT 2, 'event_type', event_type, NULL, NULL, f, ne FROM fin2
  UNION ALL SELECT 3, 'all', NULL, NULL, NULL, f, ne FROM fin3)"""

oracle("a15_cohort_medians", LIB + """
SELECT CAST(tier_rank AS BIGINT) AS tier_rank, tier, event_type, weekday, venue, CAST(d_bin AS BIGINT) AS d_bin,
       round(m, 6) AS median_pct, CAST(n AS BIGINT) AS n FROM medians""")

oracle("a16_cohort_finals", LIB + """
SELECT CAST(tier_rank AS BIGINT) AS tier_rank, tier, event_type, weekday, venue,
       round(f, 6) AS median_final, CAST(ne AS BIGINT) AS n_events FROM finals""")

SOLD_NOW = """
up AS (SELECT event_name, event_date, event_type, weekday, venue, sum(qty_sold) AS tickets_so_far,
              min(days_out) AS days_out, first(event_label ORDER BY """ + ORDER + """) AS event_label
       FROM prep WHERE event_date >= {AS_OF} AND event_name IS NOT NULL AND event_date IS NOT NULL
         AND event_type IS NOT NULL AND weekday IS NOT NULL AND venue IS NOT NULL
       GROUP BY event_name, event_date, event_type, weekday, venue),
up2 AS (SELECT *, CAST(floor(days_out / 3.0) * 3 AS INTEGER) AS d_bin FROM up)"""

oracle("a14_sold_now", PREP + "," + SOLD_NOW + """
SELECT event_name, strftime(event_date, '%Y-%m-%d %H:%M:%S') AS event_date, event_type, weekday, venue,
       round(tickets_so_far, 6) AS tickets_so_far, CAST(days_out AS BIGINT) AS days_out, event_label,
       CAST(d_bin AS BIGINT) AS d_bin FROM up2""")


def _resolved(min_cohort: int) -> str:
    mc = str(min_cohort)
    return LIB + "," + SOLD_NOW + """,
lr AS (SELECT d_bin, quantile_cont(m, 0.5) AS m, sum(n) AS n FROM medians GROUP BY d_bin),
first_fin AS (SELECT f, ne FROM finals ORDER BY tier_rank, event_type, weekday, venue LIMIT 1),
res AS (
  SELECT u.*, m0.m AS m0, m0.n AS n0, f0.ne AS e0, f0.f AS f0, m1.m AS m1, m1.n AS n1, f1.ne AS e1, f1.f AS f1,
         m2.m AS m2, m2.n AS n2, f2.ne AS e2, f2.f AS f2, m3.m AS m3, m3.n AS n3, f3.ne AS e3, f3.f AS f3,
         lr.m AS lm, lr.n AS ln, ff.f AS ff, ff.ne AS fne
  FROM up2 u
  LEFT JOIN med0 m0 ON m0.event_type = u.event_type AND m0.weekday = u.weekday AND m0.venue = u.venue AND m0.d_bin = u.d_bin
  LEFT JOIN fin0 f0 ON f0.event_type = u.event_type AND f0.weekday = u.weekday AND f0.venue = u.venue
  LEFT JOIN med1 m1 ON m1.event_type = u.event_type AND m1.weekday = u.weekday AND m1.d_bin = u.d_bin
  LEFT JOIN fin1 f1 ON f1.event_type = u.event_type AND f1.weekday = u.weekday
  LEFT JOIN med2 m2 ON m2.event_type = u.event_type AND m2.d_bin = u.d_bin
  LEFT JOIN fin2 f2 ON f2.event_type = u.event_type
  LEFT JOIN med3 m3 ON m3.d_bin = u.d_bin
  LEFT JOIN fin3 f3 ON TRUE
  LEFT JOIN lr ON lr.d_bin = u.d_bin
  LEFT JOIN first_fin ff ON TRUE),
pick AS (
  SELECT *, CASE WHEN n0 >= """ + mc + """ AND e0 IS NOT NULL THEN 0 WHEN n1 >= """ + mc + """ AND e1 IS NOT NULL THEN 1
                 WHEN n2 >= """ + mc + """ AND e2 IS NOT NULL THEN 2 WHEN n3 >= """ + mc + """ AND e3 IS NOT NULL THEN 3
                 ELSE 9 END AS r FROM res),
chosen AS (
  SELECT *,
    CASE r WHEN 0 THEN 'event_type|weekday|venue' WHEN 1 THEN 'event_type|weekday' WHEN 2 THEN 'event_type' ELSE 'all' END AS tier,
    CASE r WHEN 0 THEN m0 WHEN 1 THEN m1 WHEN 2 THEN m2 WHEN 3 THEN m3 ELSE (CASE WHEN ln IS NULL THEN 0.0 ELSE lm END) END AS median_at_d,
    CASE r WHEN 0 THEN n0 WHEN 1 THEN n1 WHEN 2 THEN n2 WHEN 3 THEN n3 ELSE coalesce(ln, 0) END AS n,
    CASE r WHEN 0 THEN f0 WHEN 1 THEN f1 WHEN 2 THEN f2 WHEN 3 THEN f3 ELSE coalesce(ff, 1.0) END AS baseline_final,
    CASE r WHEN 0 THEN e0 WHEN 1 THEN e1 WHEN 2 THEN e2 WHEN 3 THEN e3 ELSE coalesce(fne, 0) END AS n_final
  FROM pick),
sc AS (
  SELECT *, least(greatest(100.0 * tickets_so_far / greatest(baseline_final, 1.0), 0), 100) AS cum_now FROM chosen),
sc2 AS (SELECT *, cum_now - median_at_d AS gap FROM sc),
scored AS (
  SELECT *, coalesce(event_label, event_name) AS event,
    round_even(cum_now, 1) AS sold_so_far_pct, round_even(median_at_d, 1) AS typical_at_day_pct,
    round_even(gap, 1) AS gap_pp, CAST(round_even(tickets_so_far, 0) AS BIGINT) AS ticket_count,
    CASE WHEN gap IS NULL OR isnan(gap) THEN 'No benchmark' WHEN gap <= -5.0 THEN 'Behind' WHEN gap >= 5.0 THEN 'Ahead'
         ELSE 'On pace' END AS status,
    CASE tier
      WHEN 'event_type|weekday|venue' THEN 'Type+Weekday+Venue (n=' || CAST(n AS VARCHAR) || '): ' || event_type || ' · ' || weekday || ' · ' || venue
      WHEN 'event_type|weekday' THEN 'Type+Weekday (n=' || CAST(n AS VARCHAR) || '): ' || event_type || ' · ' || weekday
      WHEN 'event_type' THEN 'Type only (n=' || CAST(n AS VARCHAR) || '): ' || event_type
      ELSE 'All events (global) (n=' || CAST(n AS VARCHAR) || ')' END AS cohort
  FROM sc2),
tbl AS (
  SELECT event, CAST(days_out AS BIGINT) AS days_out, sold_so_far_pct, typical_at_day_pct, gap_pp,
         ticket_count AS tickets_so_far, status, cohort
  FROM scored WHERE sold_so_far_pct < 98.0
  ORDER BY gap_pp ASC NULLS LAST, days_out ASC, event_name, event_date, event_type, weekday, venue LIMIT 50)"""


oracle("j6_cohort_resolution", _resolved(20) + """
SELECT event_name, strftime(event_date, '%Y-%m-%d %H:%M:%S') AS event_date, event_type, weekday, venue,
       CAST(d_bin AS BIGINT) AS d_bin, tier, round(median_at_d, 6) AS median_at_d, CAST(n AS BIGINT) AS n,
       round(baseline_final, 6) AS baseline_final, CAST(n_final AS BIGINT) AS n_final FROM scored""")

for _mc, _name in ((20, "r2_watchlist"), (5, "r2_watchlist_min5"), (62, "r2_watchlist_min62"), (65, "r2_watchlist_min65")):
    oracle(_name, _resolved(_mc) + """
SELECT event, days_out, round(sold_so_far_pct, 6) AS sold_so_far_pct, round(typical_at_day_pct, 6) AS typical_at_day_pct,
       round(gap_pp, 6) AS gap_pp, tickets_so_far, status, cohort FROM tbl""")

WATCH_SCORED = """
SELECT event, event_name, strftime(event_date, '%Y-%m-%d %H:%M:%S') AS event_date, CAST(days_out AS BIGINT) AS days_out,
       round(sold_so_far_pct, 6) AS sold_so_far_pct, round(typical_at_day_pct, 6) AS typical_at_day_pct,
       round(gap_pp, 6) AS gap_pp, ticket_count AS tickets_so_far, status, cohort FROM scored"""
# Only sales up to the as-of day count.
oracle("r2_watchlist_strict", _resolved(20).replace(
    "FROM fact WHERE days_out", "FROM fact WHERE sale_date < {AS_OF} + INTERVAL 1 DAY AND days_out") + WATCH_SCORED)
# The library's events are label and date instead of names.
oracle("r2_watchlist_by_instance", _resolved(20).replace("PARTITION BY event_name", "PARTITION BY event_instance")
       .replace("count(DISTINCT event_name)", "count(DISTINCT event_instance)") + WATCH_SCORED)

oracle("a26_watch_summary", _resolved(20) + """
SELECT count(*) AS evaluated, count(*) FILTER (WHERE status = 'Behind') AS behind FROM scored""")

oracle("a27_tiers_used", _resolved(20) + """
SELECT DISTINCT tier FROM scored""")

oracle("a24_status_counts", _resolved(20) + """
SELECT count(*) FILTER (WHERE status = 'Behind') AS n_behind, count(*) FILTER (WHERE status = 'On pace') AS n_on_pace,
       count(*) FILTER (WHERE status = 'Ahead') AS n_ahead,
       count(*) FILTER (WHERE status IN ('Behind', 'On pace', 'Ahead')) AS n_total FROM tbl""")

oracle("r9_checkpoints", _resolved(20) + """,
cp AS (SELECT 30 AS target_day, * FROM tbl WHERE days_out BETWEEN 25 AND 35
       UNION ALL SELECT 7, * FROM tbl WHERE days_out BETWEEN 2 AND 12),
ag AS (SELECT target_day,
         sum(sold_so_far_pct * greatest(tickets_so_far, 1)) / sum(greatest(tickets_so_far, 1)) AS actual,
         CASE WHEN count(*) FILTER (WHERE typical_at_day_pct IS NULL) = 0
              THEN sum(typical_at_day_pct * greatest(tickets_so_far, 1)) / sum(greatest(tickets_so_far, 1)) END AS median
       FROM cp GROUP BY target_day)
SELECT 'D-' || CAST(target_day AS VARCHAR) AS label, round(actual, 6) AS actual, round(median, 6) AS median,
       round(actual - median, 6) AS gap,
       CASE WHEN actual - median IS NULL THEN 'No benchmark' WHEN actual - median <= -5.0 THEN 'Behind'
            WHEN actual - median >= 5.0 THEN 'Ahead' ELSE 'On pace' END AS status
FROM ag""")


# --- ingest ---------------------------------------------------------------

# The rules as literals of their own, so that a wrong list in the code under test shows.
CATEGORY_MAP = (
    ('musical', 'Theatre'),
    ('musicals', 'Theatre'),
    ('opera', 'Theatre'),
    ('ballet', 'Theatre'),
    ('theatre', 'Theatre'),
    ('play', 'Theatre'),
    ('talk', 'Talks'),
    ('lecture', 'Talks'),
    ('panel', 'Talks'),
    ('concert', 'Concerts'),
    ('orchestra', 'Concerts'),
    ('symphony', 'Concerts'),
    ('choir', 'Concerts'),
    ('chorus', 'Concerts'),
    ('festival', 'Festivals'),
    ('film', 'Film'),
)
SERIES_LOOKUP = (
    ('gala', 'Gala'),
    ('chamber', 'Chamber Series'),
    ('dance', 'Dance Series'),
    ('family', 'Family Series'),
    ('lecture', 'Lecture Series'),
    ('opera', 'Opera Series'),
    ('symphony', 'Symphony Series'),
    ('ballet', 'Ballet Series'),
)
KEYWORD_TYPE_MAP = (
    ('symphony', 'Symphony Orchestra'),
    ('orchestra', 'Symphony Orchestra'),
    ('choir', 'Choir / Vocal'),
    ('chorus', 'Choir / Vocal'),
    ('glee', 'Choir / Vocal'),
    ('opera', 'Opera'),
    ('ballet', 'Ballet'),
    ('dance', 'Dance'),
    ('jazz', 'Jazz'),
    ('recital', 'Recital'),
    ('talk', 'Talk / Lecture'),
    ('lecture', 'Talk / Lecture'),
    ('festival', 'Festival'),
    ('film', 'Film / Screening'),
)
COLLAB_PATTERNS = (
    ('(theat(er|re)|play|drama|musical|opera|operetta|ballet|nutcracker)', 'Theatre'),
    ('(symph(ony|onic)|philharm|orchestra|concerto|chamber|baroque|quartet|classical)', 'Music—Classical'),
    ('jazz', 'Music—Jazz'),
    ('(rock|pop|folk|indie|singer[- ]songwriter)', 'Music—Folk/Rock/Pop'),
    ('(family|kids|children|youth|junior)', 'Family Fun'),
    ('\\bdance\\b', 'Dance'),
    ('circus', 'Circus Arts'),
    ('(lecture|talk|exhibit|symposium)', 'Lecture/Exhibit'),
    ('(festival|series|gala|residency|workshop|special)', 'Special Programs'),
    ('world|global|international|afro|latin|celtic|klezmer|tabla|sitar', 'World/Global'),
    ('\\bmusic\\b', 'Music'),
)
from .sources.tables import RAW_CATEGORIES, RAW_PARTS, RAW_TITLES  # noqa: E402

WS = "(' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))"


def q(v) -> str:
    return "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def title(x: str) -> str:
    return (f"array_to_string(list_transform(range(1, length({x}) + 1), lambda i: CASE WHEN i = 1 OR NOT "
            f"regexp_matches(({x})[i - 1], '\\p{{L}}') THEN upper(({x})[i]) ELSE lower(({x})[i]) END), '')")


def exact(x: str, pairs) -> str:
    return "CASE " + x + " " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in pairs) + " END"


def first_sub(x: str, pairs) -> str:
    return "CASE " + " ".join(f"WHEN contains({x}, {q(k)}) THEN {q(v)}" for k, v in pairs) + " END"


def first_re(x: str, pairs, default: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, {q(p)}) THEN {q(v)}" for p, v in pairs) + \
        f" ELSE {q(default)} END"


def norm_cat(raw: str) -> str:
    return (f"CASE WHEN {raw} IS NOT NULL AND length({raw}) > 0 THEN (CASE WHEN {strip(raw)} = '' THEN "
            f"'Other (Unmapped)' ELSE coalesce({exact('lower(' + strip(raw) + ')', CATEGORY_MAP)}, "
            f"{title(strip(raw))}) END) ELSE 'Other (Unmapped)' END")


def cat_from_name(name: str) -> str:
    return f"coalesce({first_sub('lower(' + strip(name) + ')', CATEGORY_MAP)}, 'Other (Unmapped)')"


def ev_type(part: str, name: str, cat: str) -> str:
    p = strip(part)
    return (f"CASE WHEN {part} IS NOT NULL AND {p} <> '' THEN coalesce({exact('lower(' + p + ')', SERIES_LOOKUP)}, "
            f"{first_sub('lower(' + p + ')', KEYWORD_TYPE_MAP)}, {title(p)}) ELSE coalesce("
            f"{first_sub('lower(coalesce(' + name + ', ' + q('') + '))', KEYWORD_TYPE_MAP)}, "
            f"CASE WHEN {cat} IS NOT NULL AND {strip(cat)} <> '' THEN {strip(cat)} END, 'Other') END")


def _list(vals) -> str:
    return "[" + ", ".join(f"CAST({q(v)} AS VARCHAR)" for v in vals) + "]"


RAW = """,
raw AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
    CASE WHEN l_orderkey % 101 = 0 THEN NULL WHEN l_orderkey % 97 = 0 THEN 'not a date'
         ELSE strftime(sale_date, '%Y-%m-%d') END AS " Sale Date",
    CASE WHEN l_partkey % 89 = 0 THEN strftime(event_date, '%m/%d/%Y') ELSE strftime(event_date, '%Y-%m-%d') END AS "Event Date",
    CASE WHEN l_orderkey % 103 = 0 THEN NULL
         ELSE '  ' || """ + _list(RAW_TITLES) + """[l_partkey % 18 + 1] || ' ' || event_name || ' ' END AS "EVENT NAME",
    """ + _list(RAW_PARTS) + """[l_suppkey % 8 + 1] AS "Event Part",
    CASE WHEN l_orderkey % 107 = 0 THEN 'n/a' WHEN l_orderkey % 41 = 0 THEN '-' || CAST(CAST(qty_sold AS BIGINT) AS VARCHAR)
         ELSE CAST(CAST(qty_sold AS BIGINT) AS VARCHAR) END AS "Qty Sold",
    CAST(amount AS VARCHAR) AS "Amount",
    """ + _list(RAW_CATEGORIES) + """[l_partkey % 7 + 1] AS "Event Category",
    CASE WHEN l_suppkey % 13 = 0 THEN NULL WHEN l_suppkey % 11 = 0 THEN ' ' ELSE venue END AS "Venue",
    channel AS "Channel", customer_type AS "Customer Type", season AS "Season"
  FROM sales),
typed AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    coalesce(try_strptime(""" + strip('" Sale Date"') + """, '%Y-%m-%d'), try_strptime(""" + strip('" Sale Date"') + """, '%m/%d/%Y')) AS sale_date,
    coalesce(try_strptime(""" + strip('"Event Date"') + """, '%Y-%m-%d'), try_strptime(""" + strip('"Event Date"') + """, '%m/%d/%Y')) AS event_date,
    "EVENT NAME" AS name_raw, "Event Part" AS event_part, TRY_CAST("Qty Sold" AS DOUBLE) AS qty_sold,
    TRY_CAST("Amount" AS DOUBLE) AS amount, "Event Category" AS cat_raw, "Venue" AS venue_raw, "Season" AS season
  FROM raw),
kept AS (
  SELECT *, """ + strip("name_raw") + """ AS event_name FROM typed
  WHERE sale_date IS NOT NULL AND event_date IS NOT NULL AND name_raw IS NOT NULL AND qty_sold IS NOT NULL),
cat AS (SELECT *, """ + norm_cat("cat_raw") + """ AS event_category FROM kept),
typ AS (SELECT *, """ + ev_type("event_part", "event_name", "event_category") + """ AS event_type FROM cat),
lab AS (SELECT *, CASE WHEN """ + strip("coalesce(event_part, '')") + """ = '' THEN event_name
                       ELSE event_name || ' – ' || """ + strip("event_part") + """ END AS event_label FROM typ),
enr AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    strftime(sale_date, '%Y-%m-%d %H:%M:%S') AS sale_date, strftime(event_date, '%Y-%m-%d %H:%M:%S') AS event_date,
    event_name, event_part, qty_sold, amount, event_category, event_type, event_label,
    """ + strip("lower(event_label)") + """ || '|' || strftime(event_date, '%Y-%m-%d') AS event_instance,
    dayname(event_date) AS weekday,
    CASE WHEN venue_raw IS NULL OR """ + strip("venue_raw") + """ = '' THEN 'Unknown' ELSE """ + strip("venue_raw") + """ END AS venue,
    season
  FROM lab)"""


def oracle_raw(name: str, body: str) -> None:
    oracle(name, "nofact AS (SELECT 1)" + RAW + ",\n" + body.strip())


oracle_raw("r1_enrich", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, sale_date, event_date, event_name,
       event_part, round(qty_sold, 6) AS qty_sold, round(amount, 6) AS amount, event_category, event_type, event_label,
       event_instance, weekday, venue, season FROM enr""")

oracle_raw("s1_csv_round_trip", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, sale_date, event_date, event_name,
       nullif(event_part, '') AS event_part, round(qty_sold, 6) AS qty_sold, round(amount, 6) AS amount, event_category, event_type,
       event_label, event_instance, weekday, venue, season, true AS has_files FROM enr""")

oracle_raw("f1_category_raw", """
SELECT "Event Category" AS raw_category, count(*) AS n_rows, """ + norm_cat('"Event Category"') + """ AS category
FROM raw GROUP BY "Event Category" """)

oracle_raw("f1_category_from_name", """
SELECT event_name, count(*) AS n_rows, """ + cat_from_name("event_name") + """ AS category FROM enr GROUP BY event_name""")

oracle_raw("f3_event_type", """
SELECT event_part, event_name, event_category, event_type, count(*) AS n_rows FROM enr
GROUP BY event_part, event_name, event_category, event_type""")

oracle_raw("f4_collab_category", """
SELECT event_name, round(sum(qty_sold), 6) AS qty_sold,
       """ + first_re("lower(coalesce(event_name, ''))", COLLAB_PATTERNS, "Other (Unmapped)") + """ AS collab_category
FROM enr GROUP BY event_name""")

oracle_raw("f8_title_case", """
SELECT text, """ + title("text") + """ AS title FROM (
  SELECT """ + strip('"Event Part"') + """ AS text FROM raw UNION SELECT """ + strip('"EVENT NAME"') + """ FROM raw)""")


# --- derived tables, comparisons, timing ----------------------------------------

LEAD_BUCKETS_CLOSED = (
    (0, 7, '0-7'),
    (8, 14, '8-14'),
    (15, 30, '15-30'),
    (31, 60, '31-60'),
    (61, 120, '61-120'),
)
LEAD_EDGES_HALF_OPEN = (
    -1,
    7,
    14,
    30,
    60,
    90,
    120,
)
LEAD_LABELS_HALF_OPEN = (
    "0–7",
    "8–14",
    "15–30",
    "31–60",
    "61–90",
    "91–120",
)
WEEKDAYS = (
    "Monday",
    "Tuesday",
    "Wednesday",
    "Thursday",
    "Friday",
    "Saturday",
    "Sunday",
)

BIN = "CAST(floor(days_out / 3.0) * 3 AS INTEGER)"
TS = "'%Y-%m-%d %H:%M:%S'"

PACING = """
pp AS (SELECT *, """ + BIN + """ AS d_bin FROM fact WHERE days_out BETWEEN 0 AND 120),
pr AS (SELECT *, sum(qty_sold) OVER (PARTITION BY event_instance ORDER BY days_out DESC, """ + ORDER + """
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_qty FROM pp),
pr2 AS (SELECT *, max(cum_qty) OVER (PARTITION BY event_instance) AS final_qty FROM pr),
pr3 AS (SELECT *, CASE WHEN final_qty > 0 THEN 100.0 * cum_qty / final_qty END AS cum_pct FROM pr2),
pac AS (SELECT event_instance, d_bin,
          first(event_type ORDER BY days_out DESC, """ + ORDER + """) AS event_type,
          first(weekday ORDER BY days_out DESC, """ + ORDER + """) AS weekday,
          first(venue ORDER BY days_out DESC, """ + ORDER + """) AS venue,
          first(event_date ORDER BY days_out DESC, """ + ORDER + """) AS event_date,
          max(cum_pct) AS cum_pct
        FROM pr3 GROUP BY event_instance, d_bin)"""

oracle("a18_event_pacing", PACING + """
SELECT event_instance, CAST(d_bin AS BIGINT) AS d_bin, event_type, weekday, venue,
       strftime(event_date, """ + TS + """) AS event_date, round(cum_pct, 6) AS cum_pct FROM pac""")


def _stats(keys: list[str], rank: int, tier: str) -> str:
    allk = ["event_type", "weekday", "venue"]
    sel = ", ".join(k if k in keys else f"CAST(NULL AS VARCHAR) AS {k}" for k in allk)
    where = " AND ".join([f"{k} IS NOT NULL" for k in keys] or ["TRUE"])
    grp = ", ".join(keys + ["d_bin"])
    return f"""SELECT {rank} AS tier_rank, '{tier}' AS tier, {sel}, d_bin,
       quantile_cont(cum_pct, 0.5) AS med, quantile_cont(cum_pct, 0.25) AS p25, quantile_cont(cum_pct, 0.75) AS p75,
       count(DISTINCT event_instance) AS sample_size FROM hp WHERE {where} GROUP BY {grp}"""


oracle("a17_cohort_stats", PACING + """,
hp AS (SELECT * FROM pac WHERE event_date < {AS_OF}),
st AS (""" + _stats(["event_type", "weekday", "venue"], 0, "event_type|weekday|venue") + """
  UNION ALL """ + _stats(["event_type", "weekday"], 1, "event_type|weekday") + """
  UNION ALL """ + _stats(["event_type"], 2, "event_type") + """
  UNION ALL """ + _stats([], 3, "all") + """)
SELECT CAST(tier_rank AS BIGINT) AS tier_rank, tier, event_type, weekday, venue, CAST(d_bin AS BIGINT) AS d_bin,
       round(med, 6) AS median_cum_pct, round(p25, 6) AS p25_cum_pct, round(p75, 6) AS p75_cum_pct,
       CAST(sample_size AS BIGINT) AS sample_size FROM st""")

oracle("a21_global_curve", PACING + """,
hp AS (SELECT * FROM pac WHERE event_date < {AS_OF}),
agg AS (SELECT d_bin, quantile_cont(cum_pct, 0.5) AS med, quantile_cont(cum_pct, 0.25) AS p25,
               quantile_cont(cum_pct, 0.75) AS p75 FROM hp GROUP BY d_bin),
bins AS (SELECT CAST(range AS INTEGER) AS d_bin FROM range(0, 121, 3)),
full_ AS (SELECT bins.d_bin, agg.med, agg.p25, agg.p75 FROM bins LEFT JOIN agg USING (d_bin)),
ff AS (SELECT d_bin, coalesce(last_value(med IGNORE NULLS) OVER w, 0) AS med_f,
              coalesce(last_value(p25 IGNORE NULLS) OVER w, 0) AS p25_f,
              coalesce(last_value(p75 IGNORE NULLS) OVER w, 0) AS p75_f
       FROM full_ WINDOW w AS (ORDER BY d_bin DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
mono AS (SELECT d_bin, least(greatest(max(med_f) OVER w, 0), 100) AS m, least(greatest(max(p25_f) OVER w, 0), 100) AS a,
                least(greatest(max(p75_f) OVER w, 0), 100) AS b
         FROM ff WINDOW w AS (ORDER BY d_bin DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT CAST(d_bin AS BIGINT) AS d_bin, round(m, 6) AS median_cum_pct, round(least(a, m), 6) AS p25_cum_pct,
       round(greatest(b, m), 6) AS p75_cum_pct FROM mono WHERE EXISTS (SELECT 1 FROM hp)""")

oracle("a2_avg_tickets", """
w AS (
  SELECT event_type, sum(qty_sold) / count(DISTINCT event_instance) AS avg_tickets, 'Pre (sale < Jan 1 1998)' AS "window"
  FROM fact WHERE sale_date < {PRE_END} AND event_type IS NOT NULL GROUP BY event_type
  UNION ALL
  SELECT event_type, sum(qty_sold) / count(DISTINCT event_instance), 'Post (sale ≥ Jul 1 1999)'
  FROM fact WHERE sale_date >= {POST_START} AND event_type IS NOT NULL GROUP BY event_type)
SELECT event_type, round(avg_tickets, 6) AS avg_tickets, "window" FROM w""")

for _nm, _cond in (("a1_category_share_pre", "sale_date < {PRE_END}"), ("a1_category_share_post", "sale_date >= {POST_START}")):
    oracle(_nm, """
g AS (SELECT event_type, coalesce(sum(qty_sold), 0) AS q FROM fact WHERE """ + _cond + """ GROUP BY event_type)
SELECT event_type, round(CASE WHEN (SELECT sum(q) FROM g) = 0 THEN 0.0 ELSE q / (SELECT sum(q) FROM g) END, 6) AS share_ratio
FROM g""")

oracle("a7_events_common", """
pre AS (SELECT event_name, sum(qty_sold) AS qty_pre FROM fact WHERE sale_date < {PRE_END} GROUP BY event_name),
post AS (SELECT event_name, sum(qty_sold) AS qty_post FROM fact WHERE sale_date >= {POST_START} GROUP BY event_name)
SELECT event_name, round(qty_pre, 6) AS qty_pre, round(qty_post, 6) AS qty_post
FROM pre JOIN post USING (event_name) WHERE event_name IS NOT NULL
ORDER BY qty_pre + qty_post DESC, event_name LIMIT 12""")


def _closed_bucket(x: str) -> str:
    body = " ".join(f"WHEN {x} BETWEEN {lo} AND {hi} THEN '{lab}'" for lo, hi, lab in LEAD_BUCKETS_CLOSED)
    return f"CASE WHEN {x} IS NULL THEN 'unknown' {body} WHEN {x} > 120 THEN '>120' ELSE '<0' END"


def _half_open_bucket(x: str) -> str:
    e = LEAD_EDGES_HALF_OPEN
    return "CASE " + " ".join(f"WHEN {x} > {e[i]} AND {x} <= {e[i + 1]} THEN '{lab}'"
                              for i, lab in enumerate(LEAD_LABELS_HALF_OPEN)) + " END"


oracle("a11_sales_heatmap", """
g AS (SELECT dayname(sale_date) AS weekday, """ + _closed_bucket("days_out") + """ AS lead_bucket,
             coalesce(sum(qty_sold), 0) AS q
      FROM fact WHERE days_out BETWEEN 0 AND 120 GROUP BY 1, 2),
t AS (SELECT *, sum(q) OVER (PARTITION BY weekday) AS tot FROM g)
SELECT weekday, lead_bucket, round(CASE WHEN tot > 0 THEN q / tot ELSE 0.0 END, 6) AS share FROM t""")

oracle("a23_kpis", _resolved(20) + """,
s AS (SELECT count(*) AS evaluated, count(*) FILTER (WHERE status = 'Behind') AS behind FROM scored),
k AS (SELECT
   coalesce(sum(qty_sold) FILTER (WHERE sale_date >= {AS_OF} - INTERVAL 29 DAY AND sale_date <= {AS_OF}), 0) AS t30,
   coalesce(sum(qty_sold) FILTER (WHERE sale_date >= {AS_OF} - INTERVAL 59 DAY AND sale_date < {AS_OF} - INTERVAL 29 DAY), 0) AS prev,
   coalesce(sum(amount) FILTER (WHERE sale_date >= {AS_OF} - INTERVAL 29 DAY AND sale_date <= {AS_OF}), 0) AS amt,
   count(DISTINCT event_instance) FILTER (WHERE event_date >= {AS_OF} AND event_date <= {AS_OF} + INTERVAL 30 DAY) AS open_events
 FROM fact)
SELECT round(t30, 6) AS tickets_30d, round(CASE WHEN prev > 0 THEN (t30 - prev) / prev END, 6) AS delta_30d,
       round(CASE WHEN t30 > 0 THEN amt / t30 END, 6) AS avg_price_30d, CAST(open_events AS BIGINT) AS open_events,
       round(CASE WHEN evaluated > 0 THEN behind / evaluated * 100.0 ELSE 0.0 END, 6) AS behind_pct,
       CASE WHEN evaluated > 0 THEN CAST(behind AS VARCHAR) || ' of ' || CAST(evaluated AS VARCHAR) ELSE '–' END AS behind_detail
FROM k, s""")

COLLAB = first_re("lower(coalesce(event_name, ''))", COLLAB_PATTERNS, "Other (Unmapped)")

for _nm, _cond in (("a5_categories_pre", "sale_date < {PRE_END}"), ("a5_categories_post", "sale_date >= {POST_START}")):
    oracle_raw(_nm, """
c AS (SELECT """ + COLLAB + """ AS event_category, coalesce(qty_sold, 0) AS q FROM lab
      WHERE sale_date IS NOT NULL AND event_name IS NOT NULL AND qty_sold IS NOT NULL AND """ + _cond + """)
SELECT event_category, round(sum(q), 6) AS qty_sold FROM c WHERE event_category <> 'Other (Unmapped)'
GROUP BY event_category""")

oracle_raw("a6_top_categories", """
c AS (SELECT """ + COLLAB + """ AS event_category, sale_date, coalesce(qty_sold, 0) AS q FROM lab
      WHERE sale_date IS NOT NULL AND event_name IS NOT NULL AND qty_sold IS NOT NULL),
pre AS (SELECT event_category, sum(q) AS qty_pre FROM c WHERE sale_date < {PRE_END} GROUP BY 1),
post AS (SELECT event_category, sum(q) AS qty_post FROM c WHERE sale_date >= {POST_START} GROUP BY 1),
top AS (SELECT * FROM pre WHERE event_category <> 'Other (Unmapped)' ORDER BY qty_pre DESC, event_category LIMIT 6)
SELECT top.event_category, round(qty_pre, 6) AS qty_pre, round(coalesce(qty_post, 0), 6) AS qty_post
FROM top LEFT JOIN post USING (event_category)""")

oracle("a3_avg_tickets_by_type", """
d AS (SELECT *, coalesce(event_type, 'Other') AS etype,
             CASE WHEN sale_date < {POST_START} THEN 'Pre-COVID' ELSE 'Post-COVID' END AS period
      FROM fact WHERE sale_date IS NOT NULL AND event_date IS NOT NULL AND qty_sold IS NOT NULL),
ev AS (SELECT etype, period, event_name, event_date, sum(qty_sold) AS tickets_event FROM d
       WHERE event_name IS NOT NULL GROUP BY ALL),
g AS (SELECT etype, period, count(DISTINCT event_name) AS n_events, sum(tickets_event) AS total_tickets FROM ev GROUP BY ALL),
types AS (SELECT DISTINCT etype FROM g),
periods AS (SELECT unnest(['Pre-COVID', 'Post-COVID']) AS period),
full_ AS (SELECT t.etype, p.period, coalesce(g.n_events, 0) AS n_events, coalesce(g.total_tickets, 0) AS total_tickets
          FROM types t CROSS JOIN periods p LEFT JOIN g ON g.etype = t.etype AND g.period = p.period),
top AS (SELECT etype FROM full_ GROUP BY etype ORDER BY sum(total_tickets) DESC, etype LIMIT 12)
SELECT etype, period, CAST(n_events AS BIGINT) AS n_events, round(total_tickets, 6) AS total_tickets,
       round(CASE WHEN n_events > 0 THEN total_tickets / n_events ELSE 0 END, 6) AS avg_tickets_per_event
FROM full_ WHERE etype IN (SELECT etype FROM top)""")

oracle("a28_share_shift", """
gp AS (SELECT event_type, coalesce(sum(qty_sold), 0) AS q FROM fact WHERE sale_date < {PRE_END} GROUP BY 1),
gq AS (SELECT event_type, coalesce(sum(qty_sold), 0) AS q FROM fact WHERE sale_date >= {POST_START} GROUP BY 1),
sp AS (SELECT 'Pre' AS "window", event_type, CASE WHEN (SELECT sum(q) FROM gp) = 0 THEN 0.0 ELSE q / (SELECT sum(q) FROM gp) END AS share_ratio FROM gp),
sq AS (SELECT 'Post' AS "window", event_type, CASE WHEN (SELECT sum(q) FROM gq) = 0 THEN 0.0 ELSE q / (SELECT sum(q) FROM gq) END AS share_ratio FROM gq),
comb AS (SELECT * FROM sp UNION ALL SELECT * FROM sq),
norm AS (SELECT *, CASE WHEN sum(share_ratio) OVER (PARTITION BY "window") > 0
                        THEN share_ratio / sum(share_ratio) OVER (PARTITION BY "window") * 100.0 ELSE 0.0 END AS share_pct,
                (event_type IS DISTINCT FROM 'Other (Unmapped)') OR share_ratio >= 0.05 AS keep FROM comb)
SELECT "window", event_type, round(share_ratio, 6) AS share_ratio, round(share_pct, 6) AS share_pct FROM norm
WHERE keep OR NOT EXISTS (SELECT 1 FROM norm WHERE keep)""")

oracle("a8_season_totals", """
g AS (SELECT season, coalesce(sum(qty_sold), 0) AS tickets FROM fact GROUP BY season)
SELECT season, round(tickets, 6) AS tickets, CAST(TRY_CAST(substr(season, 1, 4) AS INTEGER) AS BIGINT) AS start_year FROM g""")

MONTHLY = """
m AS (SELECT CAST(date_trunc('month', sale_date) AS DATE) AS month, coalesce(sum(qty_sold), 0) AS qty_sold
      FROM fact WHERE sale_date IS NOT NULL GROUP BY 1)"""

oracle("w8_monthly_trend", MONTHLY + """
SELECT strftime(month, '%Y-%m-%d') AS month, round(qty_sold, 6) AS qty_sold,
       round(CASE WHEN count(qty_sold) OVER w = 3 THEN avg(qty_sold) OVER w END, 6) AS roll3
FROM m WINDOW w AS (ORDER BY month ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)""")

oracle("a10_monthly_histogram", MONTHLY + """,
mm AS (SELECT *, min(qty_sold) OVER () AS lo, (max(qty_sold) OVER () - min(qty_sold) OVER ()) / 30 AS w FROM m),
b AS (SELECT *, CAST(CASE WHEN w = 0 THEN 0 ELSE least(floor((qty_sold - lo) / w), 29) END AS INTEGER) AS bin FROM mm)
SELECT CAST(bin AS BIGINT) AS bin, round(min(lo + bin * w), 6) AS bin_start, round(min(lo + (bin + 1) * w), 6) AS bin_end,
       count(*) AS n_months FROM b GROUP BY bin""")

oracle("a12_timing_heatmap", """
z AS (SELECT *, dayname(sale_date) AS wd, """ + _half_open_bucket("days_out") + """ AS lb FROM fact
      WHERE days_out BETWEEN 0 AND 120),
st AS (SELECT sum(qty_sold) AS t, count(DISTINCT event_name) AS names, count(*) AS nrows FROM z),
cells AS (SELECT wd, lb, sum(qty_sold) AS q FROM z GROUP BY wd, lb),
grid AS (SELECT w.wd, b.lb FROM (SELECT unnest(""" + _list(WEEKDAYS) + """) AS wd) w
         CROSS JOIN (SELECT unnest(""" + _list(LEAD_LABELS_HALF_OPEN) + """) AS lb) b),
m AS (SELECT grid.wd, grid.lb, cells.q,
             max(CASE WHEN cells.q IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY grid.wd) AS present
      FROM grid LEFT JOIN cells ON cells.wd = grid.wd AND cells.lb = grid.lb)
SELECT wd AS weekday, lb AS lead_bucket, round(CASE WHEN present = 1 THEN coalesce(q, 0) / st.t END, 6) AS share
FROM m, st WHERE st.t > 0 AND st.names >= 20 AND st.nrows >= 500""")

oracle("a13_event_bin_sums", """
d AS (SELECT event_name, event_date, greatest(0, least(120, days_out)) AS lead, qty_sold FROM fact
      WHERE event_date IS NOT NULL AND sale_date IS NOT NULL AND qty_sold IS NOT NULL)
SELECT event_name, strftime(event_date, """ + TS + """) AS event_date, CAST(floor(lead / 3.0) * 3 AS BIGINT) AS d_bin,
       round(sum(qty_sold), 6) AS qty_sold FROM d GROUP BY 1, 2, 3""")

oracle("w4_event_cum_share", """
past AS (SELECT * FROM fact WHERE event_date < {AS_OF}),
d AS (SELECT event_name, event_date, greatest(0, least(120, days_out)) AS lead, qty_sold FROM past
      WHERE event_date IS NOT NULL AND sale_date IS NOT NULL AND qty_sold IS NOT NULL),
eb AS (SELECT event_name, event_date, CAST(floor(lead / 3.0) * 3 AS INTEGER) AS d_bin, sum(qty_sold) AS q FROM d GROUP BY 1, 2, 3),
ev AS (SELECT event_name, event_date, sum(q) AS total FROM eb GROUP BY 1, 2),
bins AS (SELECT CAST(range AS INTEGER) AS d_bin FROM range(0, 121, 3)),
cum AS (SELECT ev.event_name, ev.event_date, bins.d_bin, ev.total,
               (SELECT coalesce(sum(e2.q), 0) FROM eb e2 WHERE e2.event_name = ev.event_name AND e2.event_date = ev.event_date
                AND e2.d_bin >= bins.d_bin) AS c
        FROM ev CROSS JOIN bins)
SELECT event_name, strftime(event_date, """ + TS + """) AS event_date, CAST(d_bin AS BIGINT) AS d_bin,
       round(CASE WHEN total <> 0 THEN c / total END, 6) AS cum_share FROM cum""")

oracle("a20_global_pacing_curve", "past AS (SELECT * FROM fact WHERE event_date < {AS_OF}),\n" + _curve_sql(
    "past", "least(days_out, 120)", "AND days_out >= 0", "100.0", "100", "1", band=True))

oracle("a22_current_curve", """
fut AS (SELECT * FROM fact WHERE event_date >= {AS_OF} AND days_out BETWEEN 0 AND 120
        AND sale_date IS NOT NULL AND qty_sold IS NOT NULL),
eb AS (SELECT event_name, event_date, """ + BIN + """ AS d_bin, sum(qty_sold) AS q FROM fut GROUP BY 1, 2, 3),
ev AS (SELECT event_name, event_date, sum(q) AS t FROM eb GROUP BY 1, 2),
bins AS (SELECT DISTINCT d_bin FROM eb),
cum AS (SELECT bins.d_bin, ev.t,
               sum(coalesce(eb.q, 0)) OVER (PARTITION BY ev.event_name, ev.event_date ORDER BY bins.d_bin DESC
                                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c
        FROM ev CROSS JOIN bins
        LEFT JOIN eb ON eb.event_name = ev.event_name AND eb.event_date = ev.event_date AND eb.d_bin = bins.d_bin)
SELECT CAST(d_bin AS BIGINT) AS d_bin, round(avg(CASE WHEN t <> 0 THEN 100.0 * c / t END), 6) AS cum_pct
FROM cum GROUP BY d_bin HAVING (SELECT count(*) FROM ev) >= 3""")

J8 = """
past AS (SELECT * FROM fact WHERE event_date < {AS_OF}),
cand AS (SELECT count(DISTINCT CASE WHEN event_type = 'STANDARD' THEN event_name || '|' || CAST(event_date AS VARCHAR) END) AS n0,
                count(DISTINCT event_name || '|' || CAST(event_date AS VARCHAR)) AS n1 FROM past),
pick AS (SELECT CASE WHEN n0 >= 25 THEN 'event type only' ELSE 'all events (global)' END AS cohort_label,
                CASE WHEN n0 >= 25 THEN n0 ELSE n1 END AS n_events,
                CASE WHEN n0 >= 25 THEN 'STANDARD' END AS event_type FROM cand)"""

oracle("j8_baseline_cohort", J8 + """
SELECT cohort_label, CAST(n_events AS BIGINT) AS n_events, event_type FROM pick""")

oracle("r3_baseline_curve_type", J8 + """,
chosen AS (SELECT past.* FROM past, pick WHERE pick.event_type IS NULL OR past.event_type = pick.event_type),
""" + _curve_sql("chosen", "greatest(0, least(120, days_out))", "", "1.0", "1", "100", band=False))

oracle("p20_curve_sample_size", "past AS (SELECT * FROM fact WHERE event_date < {AS_OF}),\n" + _curve_sql(
    "past", "greatest(0, least(120, days_out))", "", "1.0", "1", "100", band=False).replace(
    "\nSELECT CAST(d_bin AS BIGINT) AS d_bin,", ",\ncurve AS (SELECT CAST(d_bin AS BIGINT) AS d_bin,") + """)
SELECT CAST(coalesce(max(CASE WHEN d_bin = 0 THEN n END), arg_min(n, d_bin), 0) AS BIGINT) AS n FROM curve""")

oracle("u7_allocation", """
f AS (SELECT *, CAST(round(amount * 100) AS BIGINT) AS cents,
             CAST(sum(qty_sold) OVER (PARTITION BY event_name, event_date) AS BIGINT) AS event_total FROM fact),
g AS (SELECT *, sum(cents) OVER (PARTITION BY event_name, event_date) AS wsum FROM f),
h AS (SELECT *, CAST((cents * event_total) // wsum AS BIGINT) AS part FROM g),
k AS (SELECT *, event_total - sum(part) OVER (PARTITION BY event_name, event_date) AS rest,
             row_number() OVER (PARTITION BY event_name, event_date ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey,
                                l_quantity, l_extendedprice) AS rn FROM h)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
       event_name, strftime(event_date, """ + TS + """) AS event_date, event_total, cents,
       CAST(part + CASE WHEN rn <= rest THEN 1 ELSE 0 END AS BIGINT) AS alloc FROM k""")

oracle("p8_lead_days", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
       CAST(days_out AS BIGINT) AS days_out, CAST(floor(days_out / 3.0) * 3 AS BIGINT) AS d_bin,
       CAST(greatest(0, least(120, days_out)) AS BIGINT) AS lead_clamped,
       CAST(CASE WHEN days_out BETWEEN 0 AND 120 THEN 1 ELSE 0 END AS BIGINT) AS in_window FROM fact""")

oracle("p11_lead_capped", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
       CAST(least(days_out, 120) AS BIGINT) AS lead_capped, CAST(floor(least(days_out, 120) / 3.0) * 3 AS BIGINT) AS d_bin
FROM fact WHERE days_out >= 0""")

oracle("f12_lead_bucket_closed", """
SELECT """ + _closed_bucket("days_out") + """ AS lead_bucket, round(sum(qty_sold), 6) AS qty_sold, count(*) AS n_rows
FROM fact GROUP BY 1""")

oracle("f13_lead_bucket_half_open", """
SELECT """ + _half_open_bucket("days_out") + """ AS lead_bucket, round(sum(qty_sold), 6) AS qty_sold, count(*) AS n_rows
FROM fact GROUP BY 1""")

oracle("f9_sale_weekday", """
SELECT dayname(sale_date) AS sale_weekday, round(sum(qty_sold), 6) AS qty_sold,
       CAST(list_position(""" + _list(WEEKDAYS) + """, dayname(sale_date)) - 1 AS BIGINT) AS weekday_rank
FROM fact GROUP BY 1""")

oracle("p13_slice_filter", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
       season, channel, strftime(event_date, """ + TS + """) AS event_date FROM fact
WHERE season IN ('1996-97', '1997-98', '1998-99', '1999-00') AND channel IN ('1-URGENT', '2-HIGH', '3-MEDIUM')
  AND event_date BETWEEN TIMESTAMP '1996-06-01 00:00:00' AND TIMESTAMP '1999-12-22 23:59:59'""")

oracle("p14_default_seasons", """
SELECT season FROM (SELECT DISTINCT season FROM fact WHERE season IS NOT NULL) ORDER BY season DESC LIMIT 5""")

oracle("t6_all_seasons", "SELECT DISTINCT season FROM fact WHERE season IS NOT NULL")
oracle("t6_all_channels", "SELECT DISTINCT channel FROM fact WHERE channel IS NOT NULL")

oracle("p14_date_bounds", """
SELECT '2016-01-01' AS min_event,
       strftime(CASE WHEN max(event_date) IS NULL THEN DATE '2001-03-15'
                     ELSE least(CAST(max(event_date) AS DATE), DATE '2001-03-15') END, '%Y-%m-%d') AS max_event FROM fact""")

oracle("p15_default_as_of", """
SELECT strftime(CAST(max(sale_date) AS DATE), '%Y-%m-%d') AS as_of FROM fact""")

oracle("p17_window_label", """
SELECT CASE WHEN sale_date < {PRE_END} THEN 'pre' WHEN sale_date >= {POST_START} THEN 'post' ELSE 'bridge' END AS "window",
       count(*) AS n_rows, round(sum(qty_sold), 6) AS qty_sold FROM fact GROUP BY 1""")

oracle("p18_period_label", """
SELECT CASE WHEN sale_date < {POST_START} THEN 'Pre-COVID' ELSE 'Post-COVID' END AS period,
       count(*) AS n_rows, round(sum(qty_sold), 6) AS qty_sold FROM fact
WHERE sale_date IS NOT NULL AND event_date IS NOT NULL AND qty_sold IS NOT NULL GROUP BY 1""")

oracle("p19_past_upcoming", """
SELECT CASE WHEN event_date < {AS_OF} THEN 'past' ELSE 'upcoming' END AS side, count(*) AS n_rows,
       count(DISTINCT event_instance) AS n_events FROM fact GROUP BY 1""")

oracle("s7_data_stamp", """
SELECT strftime(min(sale_date), """ + TS + """) AS sale_min, strftime(max(sale_date), """ + TS + """) AS sale_max,
       count(*) AS n_rows FROM fact""")

oracle("a9_monthly_totals", MONTHLY + """
SELECT strftime(month, '%Y-%m-%d') AS month, round(qty_sold, 6) AS qty_sold FROM m""")

oracle_raw("a4_category_totals", """
c AS (SELECT """ + COLLAB + """ AS event_category, coalesce(qty_sold, 0) AS q FROM lab
      WHERE sale_date IS NOT NULL AND event_name IS NOT NULL AND qty_sold IS NOT NULL)
SELECT event_category, round(sum(q), 6) AS qty_sold FROM c WHERE event_category <> 'Other (Unmapped)'
GROUP BY event_category""")

oracle("w1_running_instance", PACING + """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
       event_instance, CAST(days_out AS BIGINT) AS days_out, CAST(d_bin AS BIGINT) AS d_bin,
       round(cum_qty, 6) AS cum_qty, round(final_qty, 6) AS final_qty, round(cum_pct, 6) AS cum_pct FROM pr3""")


# --- refunds and the derived tables as a whole --------------------------------------

_REFUNDS = """pp AS (SELECT * REPLACE (CASE WHEN l_partkey % 5 = 0 THEN -qty_sold ELSE qty_sold END AS qty_sold),
       """
for _nm in ("a18_event_pacing", "a21_global_curve"):
    ORACLES[_nm + "_refunds"] = ORACLES[_nm].replace("pp AS (SELECT *, ", _REFUNDS, 1)

_CORE = (
    ("event_pacing", "a18_event_pacing", ("event_instance", "d_bin"), ("cum_pct",)),
    ("global_pacing_curve", "a21_global_curve", ("d_bin",), ("median_cum_pct", "p25_cum_pct", "p75_cum_pct")),
    ("cohort_library", "a17_cohort_stats", ("tier", "event_type", "weekday", "venue", "d_bin"),
     ("median_cum_pct", "p25_cum_pct", "p75_cum_pct", "sample_size")),
    ("avg_tickets", "a2_avg_tickets", ('"window"', "event_type"), ("avg_tickets",)),
    ("category_share_pre", "a1_category_share_pre", ("event_type",), ("share_ratio",)),
    ("category_share_post", "a1_category_share_post", ("event_type",), ("share_ratio",)),
    ("events_pre_post", "a7_events_common", ("event_name",), ("qty_pre", "qty_post")),
    ("dows_heatmap", "a11_sales_heatmap", ("weekday", "lead_bucket"), ("share",)),
)
_core = ["""SELECT 'base' AS tbl, concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS key, m AS measure,
  CAST(CASE m WHEN 'days_out' THEN days_out ELSE floor(days_out / 3.0) * 3 END AS DOUBLE) AS value
FROM fact, (SELECT unnest(['days_out', 'd_bin']) AS m)"""]
for _tbl, _nm, _keys, _vals in _CORE:
    _key = "concat_ws('|', " + ", ".join(f"coalesce(CAST({k} AS VARCHAR), '')" for k in _keys) + ")"
    _core += [f"SELECT '{_tbl}', {_key}, '{v}', CAST({v} AS DOUBLE) FROM ({ORACLES[_nm]})" for v in _vals]
oracle("r5_derive_core", "SELECT tbl, key, measure, round(value, 6) AS value FROM (" + " UNION ALL ".join(_core) + ")")

# Rows in the order of the source: curves from the farthest bin to 0, the heatmap by weekday, then bucket text.
for _nm in ("r3_baseline_curve", "r3_baseline_curve_type", "a20_global_pacing_curve", "a21_global_curve",
            "a21_global_curve_refunds", "a22_current_curve"):
    ORACLES[_nm] = f"SELECT * FROM ({ORACLES[_nm]}) ORDER BY d_bin DESC"
ORACLES["a11_sales_heatmap"] = f"""SELECT * FROM ({ORACLES["a11_sales_heatmap"]}) ORDER BY list_position(
  ['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday'], weekday), lead_bucket"""

ORACLES["p3_loose_dates"] = """
WITH t AS (SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) + to_hours(o_orderkey % 24) + to_minutes(o_orderkey % 60) AS w,
                  o_orderkey % 8 AS k FROM orders),
x AS (SELECT *, CASE k WHEN 0 THEN strftime(w, '%a %b %-d %Y') WHEN 1 THEN strftime(w, '%m.%d.%Y') WHEN 2 THEN strftime(w, '%-d %B %Y')
  WHEN 3 THEN strftime(w, '%Y-%m-%dT%H:%M:%S+02:00') WHEN 4 THEN strftime(w, '%Y%m%d') WHEN 5 THEN strftime(w, '%m/%d/%Y %I:%M %p')
  WHEN 6 THEN strftime(w, '%a, %d %b %Y %H:%M:%S GMT') ELSE 'no date' END AS date_text FROM t)
SELECT o_orderkey, date_text, strftime(CASE k WHEN 0 THEN strptime(date_text, '%a %b %-d %Y') WHEN 1 THEN strptime(date_text, '%m.%d.%Y')
  WHEN 2 THEN strptime(date_text, '%-d %B %Y') WHEN 3 THEN strptime(date_text, '%Y-%m-%dT%H:%M:%S+02:00')
  WHEN 4 THEN strptime(date_text, '%Y%m%d') WHEN 5 THEN strptime(date_text, '%m/%d/%Y %I:%M %p')
  WHEN 6 THEN strptime(date_text, '%a, %d %b %Y %H:%M:%S GMT') END, '%Y-%m-%d %H:%M:%S') AS parsed FROM x"""
