"""Panel restriction, daily series, weekly rollups and distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import END, POSTS, START, USERS, Inputs, keyed, query, scored_sql
from feedpanel.functions import scores as S
from feedpanel.operators import daily, panel
from feedpanel.plans import flows
from feedpanel.schema import EMOTIONS

R = 6  # digits kept for doubles on both sides


def rounded(df, digits=R):
    """Doubles rounded for the comparison."""
    return df.select(
        *[
            (F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c)
            for c, t in df.dtypes
        ]
    )


def r(expr: str, name: str, digits: int = R) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {name}"


_COUNT_BANDS = """
 count(*) FILTER (Score <= 39) AS count_max_caution,
 count(*) FILTER (Score >= 40 AND Score <= 59) AS count_caution,
 count(*) FILTER (Score >= 60 AND Score <= 74) AS count_exceptions,
 count(*) FILTER (Score >= 75 AND Score <= 99) AS count_generally_credible,
 count(*) FILTER (Score = 100) AS count_high_credibility,
 count(*) FILTER (Orientation = 'Right') AS count_right,
 count(*) FILTER (Orientation = 'Neutral') AS count_neutral,
 count(*) FILTER (Orientation = 'Left') AS count_left"""

_AT = ",\n ".join(
    f"count(*) FILTER ({e}_v2 >= 0.5) AS count_{e}_05, count(*) FILTER ({e}_v2 >= 0.65) AS count_{e}_065, "
    f"count(*) FILTER ({e}_v2 >= (SELECT {e} FROM q3)) AS count_{e}_q3"
    for e in EMOTIONS
)
_Q3 = "q3 AS (SELECT " + ", ".join(f"quantile_cont({e}_v2, 0.75) AS {e}" for e in EMOTIONS) + " FROM scored)"


def daily_sql(langs: str = "all") -> str:
    """CTE chain up to ``daily`` with unrounded doubles."""
    means = ", ".join(f"avg({e}_v2) AS mean_{e}" for e in EMOTIONS)
    return f"""WITH {scored_sql(langs)}, {_Q3},
daily AS (SELECT day, count(*) AS tweet_count, count(anger_v2) AS n_scored, count(ng_domain) AS count_ng_domains,
 count(Score) AS count_ng_scored, {_COUNT_BANDS}, avg(Score) AS mean_score,
 count(DISTINCT author_id) AS n_authors, {_AT}, {means} FROM scored GROUP BY day)"""


def make_daily(t: Inputs, langs: str = "all"):
    return flows.daily_series(t.scored(langs))


def _daily_out(langs: str) -> str:
    means = ", ".join(r(f"mean_{c}", f"mean_{c}") for c in ("score", *EMOTIONS))
    return f"{daily_sql(langs)} SELECT * REPLACE ({means}) FROM daily"


@query("daily_panel", _daily_out("all"))
def daily_panel_all(t):
    return rounded(make_daily(t))


@query("daily_panel_de_en", _daily_out("de_en"))
def daily_panel_de_en(t):
    return rounded(make_daily(t, "de_en"))


@query("restrict_panel", f"WITH {POSTS} SELECT id, author_id, epoch_us(created_at) AS t_us, lang, ng_domain, Score, Orientation FROM panel")
def restrict_panel(t):
    return t.panel().select(
        "id", "author_id", F.unix_micros("created_at").alias("t_us"), "lang", "ng_domain", "Score", "Orientation"
    )


@query("add_day", f"WITH {POSTS} SELECT id, CAST(created_at AS DATE) AS day FROM posts")
def add_day(t):
    return panel.add_day(t.posts()).select("id", "day")


@query("attach_scores_masked", f"WITH {scored_sql('de_en')} SELECT id, {', '.join(r(f'{e}_v2', f'{e}_v2') for e in EMOTIONS)} FROM scored")
def attach_scores_masked(t):
    return rounded(t.scored("de_en").select("id", *[f"{e}_v2" for e in EMOTIONS]))


@query("drop_languages", f"WITH {POSTS} SELECT lang, count(*) AS n, count(s.id) AS n_scored FROM panel p JOIN scores s ON p.id = s.id WHERE lang IN ('de', 'en') GROUP BY lang")
def drop_languages(t):
    scored = panel.attach_scores(t.panel(), t.scores(), "inner")
    return panel.drop_languages(scored, "de_en").groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.count("anger_v2").alias("n_scored")
    )


@query("flag_posts", f"""WITH {POSTS} SELECT id, CAST(ng_domain IS NOT NULL AS INTEGER) AS is_news,
 CAST(coalesce(Score < 60, false) AS INTEGER) AS is_untrustworthy, CAST(coalesce(Score >= 60, false) AS INTEGER) AS is_trustworthy,
 CAST(coalesce(Orientation IN ('Left', 'Right', 'Far Left', 'Far Right', 'Slightly Left', 'Slightly Right'), false) AS INTEGER) AS is_biased FROM panel""")
def flag_posts(t):
    return panel.flag_posts(t.panel()).select("id", "is_news", "is_untrustworthy", "is_trustworthy", "is_biased")


@query("emotion_present", f"WITH {scored_sql()} SELECT id, CAST(coalesce(anger_v2 >= 0.65, false) AS INTEGER) AS is_angry, CAST(coalesce(fear_v2 >= 0.65, false) AS INTEGER) AS is_fearful FROM scored")
def emotion_present(t):
    return t.scored().select(
        "id", S.at_least(F.col("anger_v2"), 0.65).alias("is_angry"), S.at_least(F.col("fear_v2"), 0.65).alias("is_fearful")
    )


@query("score_band", f"""WITH {POSTS} SELECT CASE WHEN Score <= 39 THEN 'max_caution' WHEN Score >= 40 AND Score <= 59 THEN 'caution'
 WHEN Score >= 60 AND Score <= 74 THEN 'exceptions' WHEN Score >= 75 AND Score <= 99 THEN 'generally_credible' WHEN Score = 100 THEN 'high_credibility' END AS band,
 count(*) AS n FROM posts WHERE Score IS NOT NULL GROUP BY 1""")
def score_band(t):
    posts = t.posts().filter("Score IS NOT NULL")
    return posts.groupBy(S.score_band(F.col("Score")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("all_scored", f"WITH {scored_sql('de_en')} SELECT author_id, count(*) AS n FROM scored WHERE anger_v2 IS NOT NULL AND fear_v2 IS NOT NULL AND disgust_v2 IS NOT NULL GROUP BY 1")
def all_scored(t):
    return panel.all_scored(t.scored("de_en")).groupBy("author_id").agg(F.count(F.lit(1)).alias("n"))


@query("posts_per_author_day", f"WITH {POSTS} SELECT author_id, CAST(created_at AS DATE) AS day, count(*) AS tweet_count FROM posts GROUP BY 1, 2")
def posts_per_author_day(t):
    return panel.posts_per_author_day(t.posts())


def _activity(agg):
    return f"WITH {POSTS} SELECT author_id FROM (SELECT author_id, CAST(created_at AS DATE) AS day, count(*) AS n FROM posts GROUP BY 1, 2) GROUP BY 1 HAVING {agg}(n) < 6"


@query("activity_filter", _activity("max"))
def activity_filter(t):
    return panel.activity_filter(t.posts(), 6)


@query("activity_filter_literal", _activity("min"))
def activity_filter_literal(t):
    return panel.activity_filter(t.posts(), 6, literal=True)


@query("filter_followers", f"WITH {POSTS} SELECT author_id, followers_count FROM users WHERE followers_count > 50 AND followers_count < 100000")
def filter_followers(t):
    return panel.filter_followers(t.users()).select("author_id", "followers_count")


@query("analysis_sample", f"""WITH {POSTS}, act AS (SELECT author_id FROM (SELECT author_id, CAST(created_at AS DATE) AS day, count(*) AS n FROM posts GROUP BY 1, 2) GROUP BY 1 HAVING max(n) < 6)
 SELECT author_id, CASE WHEN CAST(author_id AS BIGINT) % 3 = 0 THEN 'f2' ELSE 'f1' END AS file, followers_count FROM users
 WHERE author_id IN (SELECT author_id FROM act) AND followers_count > 50 AND followers_count < 100000""")
def analysis_sample(t):
    users = t.users().withColumn("file", F.lit("f1"))
    again = users.filter(F.col("author_id").cast("bigint") % 3 == 0).withColumn("file", F.lit("f2"))
    return panel.analysis_sample(t.posts(), users.unionByName(again), 6).select("author_id", "file", "followers_count")


@query("sample_authors", f"WITH {USERS} SELECT author_id FROM authors ORDER BY {keyed('author_id', 63)}, author_id LIMIT 20")
def sample_authors(t):
    return panel.sample_authors(t.authors(), 20)


@query("third_quartiles", f"WITH {scored_sql()} SELECT e AS emotion, round(q, 9) AS q3 FROM (SELECT " + ", ".join(f"quantile_cont({e}_v2, 0.75) AS {e}" for e in EMOTIONS) + " FROM scored) UNPIVOT (q FOR e IN (anger, fear, disgust))")
def third_quartiles(t):
    return rounded(daily.score_quantiles(t.scored(), {"q3": 0.75}), 9)


@query("daily_thresholds", f"WITH {POSTS} SELECT day, count(*) AS tweet_count, count(Score) AS n_rated, " + ", ".join(f'count(*) FILTER (Score < {k}) AS N_{k}' for k in (40, 50, 60, 70)) + " FROM panel GROUP BY day")
def daily_thresholds(t):
    return daily.daily_thresholds(t.panel())


_TAGS = f"""WITH {POSTS}, tags AS (SELECT day, unnest(string_split(hashtags, ' ')) AS hashtag FROM panel WHERE hashtags IS NOT NULL),
uses AS (SELECT day, hashtag, count(*) AS uses, sum(count(*)) OVER (PARTITION BY day) AS hashtag_count FROM tags GROUP BY 1, 2)"""


@query("daily_hashtags", f"{_TAGS} SELECT day, hashtag, uses, CAST(hashtag_count AS BIGINT) AS hashtag_count FROM uses")
def daily_hashtags(t):
    return daily.daily_hashtags(t.panel())


_TOP = f"""{_TAGS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY uses DESC, hashtag) AS rn FROM uses),
top AS (SELECT day, max(hashtag) FILTER (rn = 1) AS top_1, max(hashtag) FILTER (rn = 2) AS top_2, max(hashtag) FILTER (rn = 3) AS top_3 FROM ranked GROUP BY day)"""


@query("top_hashtags", f"{_TOP} SELECT * FROM top")
def top_hashtags(t):
    return daily.top_hashtags(daily.daily_hashtags(t.panel()))


@query("panel_totals", f"WITH {POSTS} SELECT count(*) AS n_tweets, count(Score) AS n_rated_tweets, count(*) FILTER (Score < 60) AS n_untrustworthy_tweets FROM panel")
def panel_totals(t):
    return daily.panel_totals(t.panel())


def _share_cols(trust="tweet_count", thr="065", denom="n_scored"):
    return f"""count_ng_domains * 100.0 / nullif(tweet_count, 0) AS prop_news,
 (count_caution + count_max_caution) * 100.0 / nullif({trust}, 0) AS prop_misinfo,
 count_right * 100.0 / nullif(tweet_count, 0) AS prop_right, count_left * 100.0 / nullif(tweet_count, 0) AS prop_left,
 (count_right + count_left) * 100.0 / nullif(tweet_count, 0) AS prop_bias, """ + ", ".join(
        f"count_{e}_{thr} * 100.0 / nullif({denom}, 0) AS prop_{e}" for e in EMOTIONS
    )


PROPS = ["prop_news", "prop_misinfo", "prop_right", "prop_left", "prop_bias", *[f"prop_{e}" for e in EMOTIONS]]
_PROPS_R = ", ".join(r(p, p) for p in PROPS)


def shares_sql(**kw) -> str:
    return f"{daily_sql()}, shares AS (SELECT *, {_share_cols(**kw)} FROM daily)"


@query("daily_shares", f"{shares_sql()} SELECT day, {_PROPS_R} FROM shares")
def daily_shares(t):
    return rounded(daily.daily_shares(make_daily(t)).select("day", *PROPS))


@query("daily_shares_news_denominator", f"{shares_sql(trust='count_ng_domains', thr='q3', denom='tweet_count')} SELECT day, {_PROPS_R} FROM shares")
def daily_shares_news(t):
    out = daily.daily_shares(make_daily(t), thr="q3", denom="tweet_count", trust_denom="count_ng_domains")
    return rounded(out.select("day", *PROPS))


@query("daily_shares_by_cutoff", f"""WITH {POSTS}, d AS (SELECT day, count(Score) AS n_rated, count(*) FILTER (Score < 40) AS n40 FROM panel GROUP BY day)
 SELECT day, {r('n40 * 100.0 / nullif(n_rated, 0)', 'prop_misinfo')} FROM d""")
def daily_shares_by_cutoff(t):
    full = make_daily(t).join(daily.daily_thresholds(t.panel()).drop("tweet_count"), "day", "left")
    return rounded(daily.daily_shares(full, cutoff=40).select("day", "prop_misinfo"))


@query("fill_days", f"""WITH {POSTS}, d AS (SELECT day, count(*) AS n_high FROM panel WHERE Score = 100 GROUP BY day)
 SELECT CAST(c.day AS DATE) AS day, coalesce(n_high, 0) AS n_high FROM (SELECT unnest(generate_series((SELECT min(day) FROM d), (SELECT max(day) FROM d), INTERVAL 1 DAY)) AS day) c LEFT JOIN d ON CAST(c.day AS DATE) = d.day""")
def fill_days(t):
    high = t.panel().filter("Score = 100")
    counts = panel.add_day(high).groupBy("day").agg(F.count(F.lit(1)).alias("n_high"))
    return daily.fill_days(counts, ["n_high"])


@query("interventions", f"{daily_sql()} SELECT day, CAST(day >= DATE '2024-01-10' AS INTEGER) AS step1, CAST(day >= DATE '2024-01-20' AS INTEGER) AS step2, greatest(CAST(day - DATE '2024-01-10' AS INTEGER) + 1, 0) AS ramp FROM daily")
def interventions(t):
    out = daily.interventions(make_daily(t), {"step1": "2024-01-10", "step2": "2024-01-20"}, "2024-01-10")
    return out.select("day", "step1", "step2", "ramp")


@query("rolling_means", f"{shares_sql()}, w AS (SELECT day, avg(prop_news) OVER f AS prop_news, avg(prop_anger) OVER f AS prop_anger, row_number() OVER (ORDER BY day) AS rn FROM shares WINDOW f AS (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)) SELECT day, {r('prop_news', 'prop_news')}, {r('prop_anger', 'prop_anger')} FROM w WHERE rn >= 7")
def rolling_means(t):
    shares = daily.daily_shares(make_daily(t)).select("day", "prop_news", "prop_anger")
    return rounded(daily.rolling_means(shares, ["prop_news", "prop_anger"], 7))


@query("differences", f"{shares_sql()} SELECT day, {r('prop_news - lag(prop_news) OVER (ORDER BY day)', 'd_prop_news')}, {r('prop_anger - lag(prop_anger) OVER (ORDER BY day)', 'd_prop_anger')} FROM shares QUALIFY row_number() OVER (ORDER BY day) > 1")
def differences(t):
    shares = daily.daily_shares(make_daily(t))
    return rounded(daily.differences(shares, ["prop_news", "prop_anger"]).select("day", "d_prop_news", "d_prop_anger"))


@query("observation_days", f"{daily_sql()}, o AS (SELECT row_number() OVER (ORDER BY day) AS ind, day, tweet_count FROM daily) SELECT ind, CAST(DATE '{START}' + CAST(ind - 1 AS INTEGER) AS DATE) AS day FROM o WHERE tweet_count > (SELECT avg(tweet_count) FROM daily)")
def observation_days(t):
    from pyspark.sql import Window

    d = make_daily(t).select("day", "tweet_count")
    ind = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("day"))
    big = d.withColumn("ind", ind.cast("bigint")).filter(F.col("tweet_count") > d.agg(F.avg("tweet_count")).scalar())
    big = big.select(F.col("ind").cast("int"))
    return daily.observation_days(big, F.lit(START).cast("date")).select(F.col("ind").cast("bigint").alias("ind"), "day")


_TRUST = "count_exceptions + count_generally_credible + count_high_credibility"
_WEEKLY = f"""{daily_sql()}, weekly AS (SELECT CAST(day - CAST(dayofweek(day) AS INTEGER) AS DATE) AS week,
 CAST(sum(tweet_count) AS BIGINT) AS tweet_count, CAST(sum(count_ng_domains) AS BIGINT) AS count_ng_domains,
 CAST(sum({_TRUST}) AS BIGINT) AS count_trustworthy, CAST(sum(count_max_caution + count_caution) AS BIGINT) AS count_untrustworthy,
 avg(mean_score) AS mean_score, avg(mean_anger) AS mean_anger FROM daily GROUP BY 1)"""


def make_weekly(t):
    d = daily.with_trust_counts(make_daily(t))
    sums = ["tweet_count", "count_ng_domains", "count_trustworthy", "count_untrustworthy"]
    return daily.weekly_rollup(d, sums, ["mean_score", "mean_anger"])


@query("weekly_rollup", f"{_WEEKLY} SELECT * REPLACE ({r('mean_score', 'mean_score')}, {r('mean_anger', 'mean_anger')}) FROM weekly")
def weekly_rollup(t):
    return rounded(make_weekly(t))


@query("weekly_shares", f"""{_WEEKLY} SELECT week, 'trustworthy' AS type, {r('count_trustworthy * 100.0 / nullif(count_ng_domains, 0)', 'proportion')} FROM weekly
 UNION ALL SELECT week, 'untrustworthy', round(count_untrustworthy * 100.0 / nullif(count_ng_domains, 0), {R}) + 0.0 FROM weekly""")
def weekly_shares(t):
    return rounded(daily.weekly_shares(make_weekly(t)))


@query("weekly_threshold_shares", f"""WITH {POSTS}, d AS (SELECT day, count(*) AS tc, count(Score) AS nr, {', '.join(f'count(*) FILTER (Score < {k}) AS n{k}' for k in (40, 50, 60))} FROM panel GROUP BY day),
 w AS (SELECT CAST(date_trunc('week', day) AS DATE) AS week, sum(tc) AS tc, sum(nr) AS nr, sum(n40) AS n40, sum(n50) AS n50, sum(n60) AS n60 FROM d GROUP BY 1),
 x AS (SELECT * FROM w WHERE week > (SELECT min(week) FROM w) AND week < (SELECT max(week) FROM w))
 """ + " UNION ALL ".join(
    f"SELECT week, '{typ}' AS type, {k} AS cutoff, CAST({e} AS BIGINT) AS \"count\", {r(f'({e}) * 100.0 / nullif(tc, 0)', 'share')} FROM x"
    for k in (40, 50, 60) for typ, e in (("Untrustworthy", f"n{k}"), ("Trustworthy", f"nr - n{k}"))))
def weekly_threshold_shares(t):
    return rounded(daily.weekly_threshold_shares(daily.daily_thresholds(t.panel())))


_LOW = "(count_caution + count_max_caution)"


@query("pooled_shares", f"{daily_sql()} SELECT " + ", ".join(
    f"{r(f'sum({_LOW}) * 100.0 / sum({c})', f'pooled_{n}')}, {r(f'avg({_LOW} * 100.0 / {c})', f'{n}_mean')}, {r(f'stddev_samp({_LOW} * 100.0 / {c})', f'{n}_sd')}, {r(f'max({_LOW} * 100.0 / {c})', f'{n}_max')}"
    for n, c in (("of_tweets", "tweet_count"), ("of_news", "count_ng_domains"))) + " FROM daily")
def pooled_shares(t):
    return rounded(daily.pooled_shares(make_daily(t)))


@query("describe_shares", f"""{shares_sql()}, l AS (UNPIVOT (SELECT {', '.join(PROPS)} FROM shares) ON {', '.join(PROPS)} INTO NAME variable VALUE value)
 SELECT variable, {r('avg(value)', 'mean')}, {r('stddev_samp(value)', 'sd')}, {r('min(value)', '"min"')}, {r('max(value)', '"max"')}, CAST(0 AS BIGINT) AS n_missing, {r('quantile_cont(value, 0.5)', 'median')} FROM l GROUP BY variable""")
def describe_shares(t):
    return rounded(daily.describe(daily.daily_shares(make_daily(t)), PROPS))


def _long(langs="de_en"):
    return f"""WITH {scored_sql(langs)}, long AS (UNPIVOT (SELECT id, anger_v2 AS anger, fear_v2 AS fear, disgust_v2 AS disgust FROM scored) ON anger, fear, disgust INTO NAME emotion VALUE score)"""


@query("emotion_stats", f"""{_long()} SELECT emotion, count(*) AS n, {r('avg(score)', 'mean')}, {r('avg(CAST(score >= 0.5 AS INTEGER))', 'share_ge_05')},
 {r('avg(CAST(score >= 0.65 AS INTEGER))', 'share_ge_065')}, {r('quantile_cont(score, 0.5)', 'median')}, {r('quantile_cont(score, 0.75)', 'q3')}, {r('quantile_cont(score, 0.9)', 'q90')} FROM long GROUP BY emotion""")
def emotion_stats(t):
    return rounded(daily.emotion_stats(t.scored("de_en")))


@query("log_histogram", f"""{_long()}, b AS (SELECT emotion, CAST(least(greatest(floor((log10(least(greatest(score, 1e-5), 1.0)) + 5.0) / 5.0 * 80), 0), 79) AS INTEGER) AS bin FROM long)
 SELECT emotion, bin, count(*) AS n, {r('count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY emotion)', 'pct')} FROM b GROUP BY emotion, bin""")
def log_histogram(t):
    return rounded(daily.log_histogram(t.scored("de_en")))


@query("histogram", f"""{shares_sql()}, e AS (SELECT min(prop_news) AS lo, max(prop_news) AS hi FROM shares)
 SELECT CAST(least(greatest(floor((prop_news - lo) / (hi - lo) * 20), 0), 19) AS INTEGER) AS bin, count(*) AS n FROM shares, e GROUP BY 1""")
def histogram(t):
    return daily.histogram(daily.daily_shares(make_daily(t)), "prop_news", 20)


@query("histogram_log", f"""WITH {POSTS}, c AS (SELECT log10(count(*) + 1) AS x FROM posts WHERE in_reply_to_user_id IS NOT NULL GROUP BY in_reply_to_user_id),
 e AS (SELECT min(x) AS lo, max(x) AS hi FROM c) SELECT CAST(least(greatest(floor((x - lo) / (hi - lo) * 10), 0), 9) AS INTEGER) AS bin, count(*) AS n FROM c, e GROUP BY 1""")
def histogram_log(t):
    replies = t.posts().filter("in_reply_to_user_id IS NOT NULL")
    counts = replies.groupBy("in_reply_to_user_id").agg(F.count(F.lit(1)).alias("n_replies"))
    return daily.histogram(counts, "n_replies", 10, log=True)


@query("language_shares", f"WITH {POSTS} SELECT coalesce(lang, 'missing') AS lang, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS pct_all FROM panel GROUP BY 1")
def language_shares(t):
    return panel.language_shares(t.panel())


@query("detected_language_shares", f"""WITH {POSTS} SELECT count(lang) AS n_detected, {r('count(lang) * 100.0 / count(*)', 'pct_detected')},
 {r("count(*) FILTER (lang = 'de') * 100.0 / count(lang)", 'pct_de')}, {r("count(*) FILTER (lang = 'en') * 100.0 / count(lang)", 'pct_en')} FROM panel""")
def detected_language_shares(t):
    return rounded(panel.detected_language_shares(t.panel()))


@query("language_shares_by_type", f"""WITH {POSTS} SELECT coalesce(tweet_type, 'original') AS tweet_type, coalesce(lang, 'missing') AS lang, count(*) AS n,
 round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY coalesce(tweet_type, 'original')), 2) AS pct_within_type FROM panel GROUP BY 1, 2""")
def language_shares_by_type(t):
    return panel.language_shares_by_type(t.panel())


@query("iso_calendar", f"""WITH {POSTS} SELECT day, strftime(day, '%G-%V') AS iso_week, strftime(day, '%G') AS iso_year, CAST(date_trunc('month', day) AS DATE) AS month,
 CAST(date_trunc('week', day) AS DATE) AS monday, CAST(day - CAST(dayofweek(day) AS INTEGER) AS DATE) AS sunday
 FROM (SELECT DISTINCT CAST(created_at AS DATE) AS day FROM posts UNION SELECT DISTINCT CAST(l_shipdate AS DATE) FROM lineitem)""")
def iso_calendar(t):
    ship = t.table("lineitem").select(F.col("l_shipdate").cast("date").alias("day"))
    day = F.col("day")
    return panel.add_day(t.posts()).select("day").union(ship).distinct().select(
        "day", S.iso_week(day).alias("iso_week"), S.iso_year(day).alias("iso_year"), S.month_start(day).alias("month"),
        S.week_start(day).alias("monday"), S.week_start(day, "sunday").alias("sunday"),
    )
