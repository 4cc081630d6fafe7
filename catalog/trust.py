"""URL matching, ratings of posts, domain reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import (
    LINKS, RATINGS, SITES, TEXTS, domain_sql, query, resolution, site_urls, sites,
)
from catalog.daily import _TOP, r, rounded
from feedpanel.functions import urls as U
from feedpanel.operators import daily, domains, linking, panel, ratings
from feedpanel.plans import flows
from feedpanel.session import materialize

SINCE = "1998-01-01"


def make_urls(t):
    return linking.distinct_urls(site_urls(t))


def shorteners(t):
    return t.spark.createDataFrame([("m.short.example",), ("youtu.be",)], "domain string")


def all_urls(t):
    urls = make_urls(t)
    short, rest = linking.split_shortened(urls, shorteners(t))
    return linking.unique_urls(linking.resolve_urls(short, resolution(t)), rest)


@query("extract_domain_pages", f"SELECT url, {domain_sql('url')} AS domain FROM (SELECT DISTINCT url FROM pages)")
def extract_domain_pages(t):
    return t.pages_urls().distinct().withColumn("domain", U.extract_domain(F.col("url")))


@query("distinct_urls", f"WITH {SITES} SELECT url, domain FROM urls")
def distinct_urls(t):
    return make_urls(t)


_REG = "split_part(host, '.', -2) || '.' || split_part(host, '.', -1)"


@query("registered_domain", f"SELECT domain, {_REG} AS host FROM (SELECT DISTINCT {domain_sql('url')} AS domain, regexp_replace({domain_sql('url')}, '[:?#].*$', '') AS host FROM pages)")
def registered_domain(t):
    d = t.pages_urls().select(U.extract_domain(F.col("url")).alias("domain")).distinct()
    return d.withColumn("host", U.registered_domain(F.col("domain")))


@query("split_shortened", f"WITH {SITES} SELECT 'short' AS part, domain, count(*) AS n FROM shortened GROUP BY 2 UNION ALL SELECT 'rest', domain, count(*) FROM unshortened GROUP BY 2")
def split_shortened(t):
    short, rest = linking.split_shortened(make_urls(t), shorteners(t))
    n = F.count(F.lit(1)).alias("n")
    return short.groupBy(F.lit("short").alias("part"), "domain").agg(n).unionByName(
        rest.groupBy(F.lit("rest").alias("part"), "domain").agg(n))


@query("drop_platform_links", f"WITH {SITES} SELECT url FROM shortened WHERE domain NOT IN ('youtu.be', 'fb.me', 't.co', 'instagr.am', 'tmblr.co', 'chang.it')")
def drop_platform_links(t):
    return linking.drop_platform_links(linking.split_shortened(make_urls(t), shorteners(t))[0]).select("url")


@query("top_domains", f"SELECT domain, count(*) AS n FROM (SELECT {domain_sql('url')} AS domain FROM pages) GROUP BY 1 ORDER BY n DESC, domain LIMIT 15")
def top_domains(t):
    return linking.top_domains(t.pages_urls().select(U.extract_domain(F.col("url")).alias("domain")))


@query("host_from_failure", f"WITH {SITES} SELECT url, unraveled_url, domain FROM resolved")
def host_from_failure(t):
    return linking.read_resolution(resolution(t)).select("url", "unraveled_url", "domain")


@query("resolve_urls", f"WITH {SITES} SELECT * FROM expanded")
def resolve_urls(t):
    return linking.resolve_urls(linking.split_shortened(make_urls(t), shorteners(t))[0], resolution(t))


@query("resolution_report", f"WITH {SITES} SELECT count(*) - count(status_code) AS n_timeouts, {r('(count(*) - count(status_code)) * 100.0 / count(status_code)', 'pct_timeouts')}, {r('count(*) FILTER (domain IS NULL) * 100.0 / count(*)', 'pct_missing_domain')} FROM resolved")
def resolution_report(t):
    return rounded(linking.resolution_report(resolution(t)))


@query("unique_urls", f"WITH {SITES} SELECT url, domain FROM all_urls")
def unique_urls(t):
    return all_urls(t)


_HOST = "split_part(regexp_replace(domain, '[:?#].*$', ''), '.', -2) || '.' || split_part(regexp_replace(domain, '[:?#].*$', ''), '.', -1)"
# Both names are shorter than 34 characters here, so a ratio above 97 means one
# inserted or deleted character: lengths differ by one, edit distance one.
_MATCH = f"""WITH {SITES}, dom AS (SELECT DISTINCT domain FROM all_urls),
ex AS (SELECT domain, ng_domain, 'exact' AS matched_by FROM dom JOIN sites ON domain = ng_domain),
o1 AS (SELECT domain, {_HOST} AS host FROM dom WHERE domain NOT IN (SELECT domain FROM ex)),
re AS (SELECT domain, ng_domain, 'registered' AS matched_by FROM o1 JOIN sites ON host = ng_domain),
o2 AS (SELECT * FROM o1 WHERE domain NOT IN (SELECT domain FROM re)),
pairs AS (SELECT DISTINCT host, ng_domain, 1.0 / (length(host) + length(ng_domain)) AS far FROM o2, sites WHERE abs(length(host) - length(ng_domain)) = 1 AND length(host) + length(ng_domain) >= 34 AND levenshtein(host, ng_domain) = 1),
best AS (SELECT host, min(ng_domain) AS ng_domain FROM pairs p WHERE far = (SELECT min(far) FROM pairs q WHERE q.host = p.host) GROUP BY host),
fz AS (SELECT domain, ng_domain, 'fuzzy' AS matched_by FROM o2 JOIN best ON o2.host = best.host),
matched AS (SELECT url, a.domain, ng_domain, matched_by FROM all_urls a JOIN (SELECT * FROM ex UNION ALL SELECT * FROM re UNION ALL SELECT * FROM fz) m ON a.domain = m.domain)"""


def make_matched(t):
    return flows.matched_urls(site_urls(t), shorteners(t), resolution(t), sites(t))


@query("match_exact", f"{_MATCH} SELECT domain, ng_domain FROM ex")
def match_exact(t):
    return linking.match_exact(all_urls(t).select("domain").distinct(), sites(t)).select("domain", "ng_domain")


@query("unmatched_exact", f"{_MATCH} SELECT domain FROM o1")
def unmatched_exact(t):
    d = all_urls(t).select("domain").distinct()
    return d.join(linking.match_exact(d, sites(t)).select("domain"), "domain", "left_anti")


@query("match_registered", f"{_MATCH} SELECT domain, host, ng_domain FROM o1 JOIN sites ON host = ng_domain")
def match_registered(t):
    d = all_urls(t).select("domain").distinct()
    rest = d.join(linking.match_exact(d, sites(t)).select("domain"), "domain", "left_anti")
    return linking.match_registered(rest, sites(t)).select("domain", "host", "ng_domain")


@query("match_fuzzy", f"{_MATCH} SELECT best.host, best.ng_domain, {r('(1 - 1.0 / (length(best.host) + length(best.ng_domain))) * 100', 'similarity')} FROM best")
def match_fuzzy(t):
    d = all_urls(t).select("domain").distinct()
    rest = d.join(linking.match_exact(d, sites(t)).select("domain"), "domain", "left_anti")
    rest = rest.join(linking.match_registered(rest, sites(t)).select("domain"), "domain", "left_anti")
    hosts = rest.select(U.registered_domain(F.col("domain")).alias("host"))
    return rounded(linking.match_fuzzy(hosts, sites(t)))


_LONG = """hosts AS (SELECT DISTINCT l_suppkey, l_linenumber, concat('the-regional-observer-and-evening-courier-of-', md5('s' || l_suppkey), '.example-news.com') AS name FROM lineitem),
 cut AS (SELECT DISTINCT substr(name, 1, 4) || substr(name, 5 + l_linenumber) AS host FROM hosts),
 names AS (SELECT DISTINCT concat('the-regional-observer-and-evening-courier-of-', md5('s' || s_suppkey), '.example-news.com') AS ng_domain FROM supplier),
 near AS (SELECT host, ng_domain, CAST(levenshtein(host, ng_domain) AS DOUBLE) / (length(host) + length(ng_domain)) AS far FROM cut, names WHERE levenshtein(host, ng_domain) * 100 < 3 * (length(host) + length(ng_domain)))"""


# hosts lack up to seven characters of a name of 94; names differ in their digits by far more than may be, so the
# nearest name of a host is the one it comes from, and its distance is what was left out
@query("match_fuzzy_long", f"WITH {_LONG} SELECT host, ng_domain, {r('(1 - far) * 100', 'similarity')} FROM near p WHERE far = (SELECT min(far) FROM near q WHERE q.host = p.host)")
def match_fuzzy_long(t):
    def named(key):
        return F.concat(F.lit("the-regional-observer-and-evening-courier-of-"), F.md5(F.concat(F.lit("s"), key).cast("binary")), F.lit(".example-news.com"))

    names = t.table("supplier").select(named("s_suppkey").alias("ng_domain"))
    lines = t.table("lineitem").select("l_suppkey", "l_linenumber").distinct().withColumn("name", named("l_suppkey"))
    hosts = lines.select(F.concat(F.substr("name", F.lit(1), F.lit(4)), F.substr("name", F.col("l_linenumber").cast("int") + 5)).alias("host"))
    return rounded(linking.match_fuzzy(hosts, names))


@query("match_domains", f"{_MATCH} SELECT url, domain, ng_domain, matched_by FROM matched")
def match_domains(t):
    return make_matched(t)


@query("match_rate", f"{_MATCH} SELECT (SELECT count(*) FROM matched) AS n_matched, (SELECT count(*) FROM all_urls) AS n_urls, {r('(SELECT count(*) FROM matched) * 100.0 / (SELECT count(*) FROM all_urls)', 'pct_matched')}")
def match_rate(t):
    return rounded(linking.match_rate(all_urls(t), make_matched(t)))


# --- ratings ---------------------------------------------------------------
_RATED = f"""{RATINGS},
ratings AS (SELECT Domain, Country, file_date, Score, CASE WHEN Orientation IN ('Far Right', 'Slightly Right') THEN 'Right' WHEN Orientation IN ('Far Left', 'Slightly Left') THEN 'Left' ELSE coalesce(Orientation, 'Neutral') END AS Orientation, file_month
 FROM (SELECT *, CAST(date_trunc('month', file_date) AS DATE) AS file_month, row_number() OVER (PARTITION BY Domain, date_trunc('month', file_date) ORDER BY Score NULLS LAST, Orientation NULLS LAST) AS rn FROM raw_ratings) WHERE rn = 1)"""


def make_ratings(t):
    return ratings.build_ratings(t.raw_ratings())


@query("build_ratings", f"WITH {_RATED} SELECT Domain, Country, Score, Orientation, file_month FROM ratings")
def build_ratings(t):
    return make_ratings(t).select("Domain", "Country", "Score", "Orientation", "file_month")


@query("country_domains", f"WITH {_RATED} SELECT Domain, min(file_month) AS file_month FROM ratings WHERE Country = 'AT' GROUP BY 1")
def country_domains(t):
    return ratings.country_domains(make_ratings(t)).select("Domain", "file_month")


def link_map(t, posts=None):
    """URL to rated name of the order links; a few sites are not in the map."""
    urls = linking.distinct_urls(t.link_posts() if posts is None else posts)
    names = make_ratings(t).select(F.col("Domain").alias("ng_domain")).distinct().filter("ng_domain NOT LIKE 's%9.example.com'")
    return linking.match_exact(urls, names).select("url", "ng_domain")


_LK = f"""{LINKS}, {_RATED},
lk AS (SELECT p.id, p.author_id, p.created_at, CAST(date_trunc('month', p.created_at) AS DATE) AS month, u.pos - 1 AS position, u.url,
 CASE WHEN {domain_sql('u.url')} IN (SELECT Domain FROM ratings WHERE Domain NOT LIKE 's%9.example.com') THEN {domain_sql('u.url')} END AS ng_domain
 FROM link_posts p LEFT JOIN (SELECT id, unnest(string_split(expanded_urls, ' ')) AS url, generate_subscripts(string_split(expanded_urls, ' '), 1) AS pos FROM link_posts) u ON p.id = u.id),
fm AS (SELECT min(file_month) AS first FROM ratings),
overall AS (SELECT Domain, avg(Score) AS Score, string_agg(DISTINCT Orientation, ', ' ORDER BY Orientation) AS Orientation, count(*) AS n_ratings FROM ratings GROUP BY 1),
rl AS (SELECT lk.*, coalesce(m.Score, o.Score) AS Score, coalesce(m.Orientation, o.Orientation) AS Orientation, CASE WHEN m.Score IS NOT NULL THEN 1 ELSE o.n_ratings END AS n_ratings
 FROM lk CROSS JOIN fm LEFT JOIN ratings m ON lk.month >= fm.first AND m.Domain = lk.ng_domain AND m.file_month = lk.month
 LEFT JOIN overall o ON lk.month < fm.first AND o.Domain = lk.ng_domain)"""


def make_rated_links(t):
    return ratings.attach_rating(ratings.attach_domains(t.link_posts(), link_map(t)), make_ratings(t), SINCE)


def _per_post(links, *cols):
    """All links of a post in one row, so that a comparison has a row per post."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in cols]
    told = F.when(F.col("position").isNotNull(), F.struct("position", F.concat_ws("|", *parts).alias("link")))
    return links.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(told)), lambda x: x["link"]), " ").alias("links"))


@query("attach_domains", f"WITH {_LK} SELECT id, coalesce(string_agg(position || '|' || url || '|' || coalesce(ng_domain, '-'), ' ' ORDER BY position), '') AS links FROM lk GROUP BY id")
def attach_domains(t):
    return _per_post(ratings.attach_domains(t.link_posts(), link_map(t)), "position", "url", "ng_domain")


@query("attach_rating", f"WITH {_LK} SELECT id, coalesce(string_agg(position || '|' || coalesce(CAST(CAST(round(Score * 1000000) AS BIGINT) AS VARCHAR), '-') || '|' || coalesce(Orientation, '-') || '|' || coalesce(CAST(n_ratings AS VARCHAR), '-'), ' ' ORDER BY position), '') AS links FROM rl GROUP BY id")
def attach_rating(t):
    """Scores in millionths."""
    links = make_rated_links(t).withColumn("Score", F.round(F.col("Score") * 1_000_000).cast("bigint"))
    return _per_post(links, "position", "Score", "Orientation", "n_ratings")


_MERGED = f"""{_LK}, mg AS (SELECT id, author_id, min(created_at) AS created_at, sum(Score * n_ratings) / sum(n_ratings) FILTER (Score IS NOT NULL) AS Score,
 CASE WHEN count(Score) > 0 THEN string_agg(ng_domain, ', ' ORDER BY position) FILTER (Score IS NOT NULL) ELSE min_by(ng_domain, position) FILTER (ng_domain IS NOT NULL) END AS ng_domain,
 string_agg(DISTINCT Orientation, ', ' ORDER BY Orientation) FILTER (Score IS NOT NULL) AS Orientation FROM rl GROUP BY id, author_id)"""


def make_rated_posts(t):
    posts = materialize(t.link_posts())
    return flows.rated_posts(posts, link_map(t, posts), t.raw_ratings(), SINCE)


@query("merge_multilink", f"WITH {_MERGED} SELECT id, author_id, ng_domain, {r('Score', 'Score', 9)}, Orientation FROM mg")
def merge_multilink(t):
    return rounded(make_rated_posts(t).drop("created_at"), 9)


_LIT = f"""WITH {_LK}, ll AS (SELECT lk.*, x.Score, x.Orientation, x.Domain FROM lk CROSS JOIN fm LEFT JOIN ratings x ON x.Domain = lk.ng_domain AND (lk.month < fm.first OR x.file_month = lk.month)),
 g AS (SELECT id, count(Domain) AS n, avg(Score) AS Score, string_agg(ng_domain, ', ' ORDER BY position) FILTER (Domain IS NOT NULL) AS names, count(Orientation) AS n_labels FROM ll GROUP BY id)"""


@query("merge_multilink_literal", f"""{_LIT} SELECT g.id, {r('CASE WHEN n >= 2 THEN g.Score ELSE f.Score END', 'Score', 9)}, CASE WHEN n >= 2 THEN names ELSE f.ng_domain END AS ng_domain,
 CASE WHEN n >= 2 THEN CAST(n_labels AS BIGINT) WHEN f.Orientation IS NOT NULL THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS n_labels FROM g JOIN (SELECT id, Score, Orientation, ng_domain FROM ll WHERE position = 0 OR position IS NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY Score) = 1) f ON g.id = f.id""")
def merge_multilink_literal(t):
    posts = materialize(t.link_posts())
    out = flows.rated_posts(posts, link_map(t, posts), t.raw_ratings(), SINCE, literal=True)
    n = F.when(F.col("Orientation").isNull(), 0).otherwise(F.size(F.split("Orientation", ", "))).cast("bigint")
    return rounded(out.select("id", "Score", "ng_domain", n.alias("n_labels")), 9)


# --- criterion -------------------------------------------------------------
_CRIT = f"""{_MERGED},
rc0 AS (SELECT Domain, Country, Score, CAST(date_trunc('month', file_date) AS DATE) AS file_month, lower(trim(coalesce(crit_new, crit_old))) AS c FROM raw_ratings),
rc1 AS (SELECT *, CASE WHEN c IN ('yes', 'y', 'true', '1') THEN true WHEN c IN ('no', 'n', 'false', '0') THEN false END AS passes FROM rc0),
rc AS (SELECT * FROM rc1 QUALIFY row_number() OVER (PARTITION BY Domain, file_month ORDER BY Score NULLS LAST, passes NULLS LAST) = 1),
rd AS (SELECT Domain, avg(Score) AS ng_score, avg(CAST(NOT passes AS INTEGER)) AS fail_rate FROM rc GROUP BY 1),
ul AS (SELECT DISTINCT id, month, ng_domain FROM (SELECT id, CAST(date_trunc('month', created_at) AS DATE) AS month, unnest(string_split(ng_domain, ', ')) AS ng_domain FROM mg WHERE Score < 60)),
ur AS (SELECT ul.*, coalesce(m.Score, d.ng_score) AS ng_score, CASE WHEN m.Domain IS NOT NULL THEN m.passes WHEN d.fail_rate >= 0.5 THEN false WHEN d.fail_rate < 0.5 THEN true END AS passes
 FROM ul CROSS JOIN fm LEFT JOIN rc m ON ul.month >= fm.first AND m.Domain = ul.ng_domain AND m.file_month = ul.month LEFT JOIN rd d ON ul.month < fm.first AND d.Domain = ul.ng_domain),
lowf AS (SELECT *, CAST(NOT passes AS INTEGER) AS fails FROM ur WHERE ng_score < 60 AND passes IS NOT NULL)"""


def make_criterion(t):
    return ratings.ratings_with_criterion(t.raw_ratings(), ["crit_new", "crit_old"])


def make_criterion_links(t):
    return flows.criterion_links(make_rated_posts(t), t.raw_ratings(), ["crit_new", "crit_old"], SINCE)


@query("ratings_with_criterion", f"WITH {_CRIT} SELECT Domain, file_month, Score, passes FROM rc")
def ratings_with_criterion(t):
    return make_criterion(t).select("Domain", "file_month", "Score", "passes")


@query("criterion_coverage", f"WITH {_CRIT} SELECT count(*) AS n_domain_months, {r('avg(CAST(passes IS NULL AS INTEGER))', 'share_missing_criterion')} FROM rc")
def criterion_coverage(t):
    return rounded(ratings.criterion_coverage(make_criterion(t)))


@query("rating_by_domain", f"WITH {_CRIT} SELECT Domain, {r('ng_score', 'ng_score')}, {r('fail_rate', 'fail_rate')}, fail_rate < 0.5 AS passes FROM rd")
def rating_by_domain(t):
    return rounded(ratings.rating_by_domain(make_criterion(t)))


@query("untrustworthy_links", f"WITH {_CRIT} SELECT id, CAST(date_trunc('month', created_at) AS DATE) AS month, unnest(string_split(ng_domain, ', ')) AS ng_domain, {r('Score', 'Score', 9)} FROM mg WHERE Score < 60")
def untrustworthy_links(t):
    return rounded(ratings.untrustworthy_links(make_rated_posts(t)).select("id", "month", "ng_domain", "Score"), 9)


@query("attach_criterion", f"WITH {_CRIT} SELECT id, ng_domain, month, {r('ng_score', 'ng_score')}, passes FROM ur")
def attach_criterion(t):
    return rounded(make_criterion_links(t).select("id", "ng_domain", "month", "ng_score", "passes"))


@query("rating_coverage", f"WITH {_CRIT} SELECT count(*) AS n_links, {r('avg(CAST(ng_score IS NULL AS INTEGER))', 'share_no_rating')}, {r('avg(CAST(passes IS NULL AS INTEGER))', 'share_no_criterion')} FROM ur")
def rating_coverage(t):
    return rounded(ratings.rating_coverage(make_criterion_links(t)))


@query("share_failing", f"""WITH {_CRIT}, posts_f AS (SELECT id, bool_or(NOT passes) AS f FROM ur GROUP BY id), dom_f AS (SELECT ng_domain, avg(fails) >= 0.5 AS f FROM lowf GROUP BY 1)
 SELECT 'link' AS level, 'all' AS name, count(*) AS n, {r('avg(fails)', 'share_failing')} FROM lowf
 UNION ALL SELECT 'post', 'all', count(*), round(avg(CAST(f AS INTEGER)), 6) + 0.0 FROM posts_f WHERE f IS NOT NULL
 UNION ALL SELECT 'domain', 'all', count(*), round(avg(CAST(f AS INTEGER)), 6) + 0.0 FROM dom_f
 UNION ALL SELECT 'year', CAST(year(month) AS VARCHAR), count(*), round(avg(fails), 6) + 0.0 FROM lowf GROUP BY 2""")
def share_failing(t):
    return rounded(ratings.share_failing(make_criterion_links(t)))


@query("domain_month_stats", f"WITH {_RATED} SELECT file_month, {r('avg(Score)', 'mean_score')}, count(DISTINCT Domain) FILTER (Score < 60) AS n_untrustworthy, count(DISTINCT Domain) AS n_sources, {r('count(DISTINCT Domain) FILTER (Score < 60) * 100.0 / count(DISTINCT Domain)', 'fraction_untrustworthy')} FROM ratings GROUP BY 1")
def domain_month_stats(t):
    return rounded(ratings.domain_month_stats(make_ratings(t)))


# --- domain reports --------------------------------------------------------
_USES = f"""{_MERGED}, ex AS (SELECT id, CAST(created_at AS DATE) AS day, Score, unnest(string_split(ng_domain, ', ')) AS ng_domain FROM mg WHERE ng_domain IS NOT NULL AND Score IS NOT NULL),
 uses AS (SELECT day, ng_domain, min_by(Score, id) AS Score, count(*) AS n_used FROM ex GROUP BY 1, 2)"""


def make_uses(t):
    return domains.domains_per_day(make_rated_posts(t))


@query("domains_per_day", f"WITH {_USES} SELECT day, ng_domain, {r('Score', 'Score', 9)}, n_used FROM uses")
def domains_per_day(t):
    return rounded(make_uses(t), 9)


@query("before_after", f"""WITH {_USES.replace('Score, id) AS Score', 'Score, id) AS Score')}, b AS (SELECT ng_domain, round(Score, 9) AS Score, n_used, day < DATE '1998-07-01' AS early FROM uses WHERE Score < 60),
 s AS (SELECT ng_domain, Score, CAST(coalesce(sum(n_used) FILTER (early), 0) AS BIGINT) AS before, CAST(coalesce(sum(n_used) FILTER (NOT early), 0) AS BIGINT) AS after FROM b GROUP BY 1, 2)
 SELECT ng_domain, Score + 0.0 AS Score, before, after, after - before AS change, CASE WHEN before > 0 THEN round((after - before) * 100.0 / before, 6) + 0.0 END AS pct_change FROM s""")
def before_after(t):
    uses = make_uses(t).withColumn("Score", F.round("Score", 9))
    return rounded(domains.before_after(uses, "1998-07-01"), 9).withColumn("pct_change", F.round("pct_change", 6) + F.lit(0.0))


_CLASS = f"""{_USES}, pv AS (SELECT *, lag(Score) OVER w AS prev_score, row_number() OVER w = 1 AS first_appearance FROM uses WINDOW w AS (PARTITION BY ng_domain ORDER BY day)),
 cl AS (SELECT *, CASE WHEN first_appearance AND Score < 60 THEN 'first' WHEN prev_score >= 60 AND Score < 60 THEN 'downrated' WHEN prev_score < 60 AND Score < 60 THEN 'stable' ELSE 'Other' END AS classification FROM pv),
 cd AS (SELECT day, classification, CAST(sum(n_used) AS BIGINT) AS n_domains FROM cl WHERE Score < 60 AND classification <> 'Other' GROUP BY 1, 2),
 dt AS (SELECT day, CAST(sum(n_domains) AS BIGINT) AS total_untrustworthy FROM cd GROUP BY 1),
 sp AS (SELECT *, total_untrustworthy > (SELECT quantile_cont(total_untrustworthy, 0.9) FROM dt) AS is_spike FROM dt)"""


@query("classify_domains", f"WITH {_CLASS} SELECT day, ng_domain, n_used, {r('prev_score', 'prev_score', 9)}, first_appearance, classification FROM cl")
def classify_domains(t):
    return rounded(domains.classify_domains(make_uses(t)).drop("Score"), 9)


@query("classified_daily", f"WITH {_CLASS} SELECT * FROM cd")
def classified_daily(t):
    return domains.classified_daily(domains.classify_domains(make_uses(t)))


def make_report(t):
    return flows.domain_report(make_rated_posts(t))


@query("spike_days", f"WITH {_CLASS} SELECT * FROM sp")
def spike_days(t):
    return make_report(t)["spikes"]


@query("spike_comparison", f"""WITH {_CLASS}, lw AS (SELECT ng_domain, round(Score, 9) AS Score, n_used, u.day, is_spike FROM uses u JOIN sp ON u.day = sp.day WHERE Score < 60),
 bz AS (SELECT ng_domain, Score, CAST(sum(n_used) AS BIGINT) AS total_uses, count(DISTINCT day) AS n_spike_days, avg(n_used) AS b FROM lw WHERE is_spike GROUP BY 1, 2),
 nm AS (SELECT ng_domain, avg(n_used) AS u FROM lw WHERE NOT is_spike GROUP BY 1)
 SELECT bz.ng_domain, Score + 0.0 AS Score, total_uses, n_spike_days, {r('b', 'avg_uses_per_spike_day', 9)}, {r('u', 'avg_uses_normal', 9)}, {r('b - coalesce(u, 0)', 'spike_increase', 9)}, {r('b / coalesce(u, 0.1)', 'spike_ratio', 9)} FROM bz LEFT JOIN nm ON bz.ng_domain = nm.ng_domain""")
def spike_comparison(t):
    rated = make_rated_posts(t).withColumn("Score", F.round("Score", 9))
    return rounded(flows.domain_report(rated)["comparison"], 9)


@query("hashtags_on_spikes", f"{_TOP}, d AS (SELECT day, count(*) FILTER (Score < 60) AS total_untrustworthy FROM panel GROUP BY 1) SELECT d.day, total_untrustworthy, top_1, top_2, top_3 FROM d LEFT JOIN top ON d.day = top.day WHERE total_untrustworthy > (SELECT quantile_cont(total_untrustworthy, 0.9) FROM d)")
def hashtags_on_spikes(t):
    posts = t.panel()
    totals = panel.add_day(posts).groupBy("day").agg(F.count_if(F.col("Score") < 60).alias("total_untrustworthy"))
    spikes = domains.mark_spikes(totals).filter("is_spike").drop("is_spike")
    return domains.hashtags_on_days(spikes, daily.top_hashtags(daily.daily_hashtags(posts)))


# --- texts -----------------------------------------------------------------
_PICT = (
    r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F700}-\x{1F77F}\x{1F780}-\x{1F7FF}\x{1F800}-\x{1F8FF}"
    r"\x{1F900}-\x{1F9FF}\x{1FA00}-\x{1FA6F}\x{1FA70}-\x{1FAFF}\x{2702}-\x{27B0}\x{24C2}-\x{1F251}]+"
)
_CLEAN = (
    f"regexp_replace(translate(regexp_replace(regexp_replace(regexp_replace(text, '{_PICT}', '', 'g'), 'https.*', '', 'g'), "
    r"'@[\p{L}\p{N}_]+', '', 'g'), chr(10) || chr(92), '  '), '^[\s\p{Z}\x1c-\x1f\x{85}]+|[\s\p{Z}\x1c-\x1f\x{85}]+$', '', 'g')"
)


@query("filter_scorable", f"WITH {TEXTS} SELECT * FROM (SELECT id, {_CLEAN} AS text_cleaned FROM texts WHERE NOT starts_with(text, 'RT')) WHERE text_cleaned <> ''")
def filter_scorable(t):
    return panel.filter_scorable(t.texts())


