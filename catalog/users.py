"""User features, author-day panel, event windows, concentration and cohorts."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import POSTS, START, keyed, query, scored_sql
from catalog.daily import r, rounded
from feedpanel.functions import scores as S
from feedpanel.operators import features, panel, sharers, windows
from feedpanel.plans import flows
from feedpanel.schema import EMOTIONS

# --- features --------------------------------------------------------------
_BASE = f"""base AS (SELECT author_id, {', '.join(f'avg({e}_v2) AS {e}_baseline, stddev_samp({e}_v2) AS {e}_variability' for e in EMOTIONS)},
 count(ng_domain) AS n_news_shared, count(*) FILTER (ng_domain IS NOT NULL AND Score < 60) AS n_untrustworthy_shared,
 count(*) FILTER (ng_domain IS NOT NULL AND Orientation IN ('Left', 'Right')) AS n_biased_shared,
 count(*) AS n_tweets, count(anger_v2) AS n_scored FROM scored GROUP BY author_id)"""

_PERIOD = {
    "day": "strftime(created_at, '%Y-%m-%d')",
    "week": "strftime(created_at, '%G-%V')",
    "month": "strftime(created_at, '%Y-%m')",
}


def _dyn(unit: str, k: int) -> str:
    """CTEs for one period length, written with lag inside (author, period)."""
    lagged = ", ".join(f"lag({e}_v2) OVER w AS {e}_0" for e in EMOTIONS)
    secs = "floor((epoch_us(created_at) - epoch_us(t0)) / 1000000)"
    aggs = ", ".join(
        f"avg(CASE WHEN secs > 0 THEN ({e}_v2 - {e}_0) ^ 2 END) AS {e}_mssd, "
        f"count(*) FILTER ({e}_ok) AS {e}_pairs, min({e}_0) FILTER ({e}_ok) <> max({e}_0) FILTER ({e}_ok) AND "
        f"min({e}_v2) FILTER ({e}_ok) <> max({e}_v2) FILTER ({e}_ok) AS {e}_var, "
        f"sum(-hrs * ln(abs({e}_v2 / {e}_0))) FILTER ({e}_ok) AS {e}_xy, sum(hrs * hrs) FILTER ({e}_ok) AS {e}_xx"
        for e in EMOTIONS
    )
    oks = ", ".join(f"hrs > 0 AND {e}_0 <> 0 AND {e}_v2 <> 0 AS {e}_ok" for e in EMOTIONS)
    phis = ", ".join(
        f"CASE WHEN {e}_pairs >= 2 AND {e}_var THEN exp(-abs({e}_xy / {e}_xx)) END AS {e}_phi" for e in EMOTIONS
    )
    outs = ", ".join(f"avg({e}_mssd) AS {e}_instability_{unit}, avg({e}_phi) AS {e}_inertia_{unit}" for e in EMOTIONS)
    return f"""p_{unit} AS (SELECT *, {_PERIOD[unit]} AS period FROM scored WHERE anger_v2 IS NOT NULL AND fear_v2 IS NOT NULL AND disgust_v2 IS NOT NULL),
l_{unit} AS (SELECT *, {lagged}, lag(created_at) OVER w AS t0 FROM p_{unit} WINDOW w AS (PARTITION BY author_id, period ORDER BY created_at, id)),
s_{unit} AS (SELECT *, {secs} AS secs, floor({secs} / 3600) AS hrs FROM l_{unit}),
o_{unit} AS (SELECT *, {oks} FROM s_{unit}),
g_{unit} AS (SELECT author_id, period, count(*) AS n_posts, {aggs} FROM o_{unit} GROUP BY 1, 2 HAVING count(*) >= {k}),
w_{unit} AS (SELECT *, {phis} FROM g_{unit}),
u_{unit} AS (SELECT author_id, {outs} FROM w_{unit} GROUP BY 1)"""


# Means of few three-digit values end in a 5 too often to be rounded early.
FINE = 11
_FEATURE_COLS = [f"{e}_{m}" for e in EMOTIONS for m in features.MEASURES]
_FEATURES = f"WITH {scored_sql()}, {_BASE}, {_dyn('week', 10)}"
_FEATURE_LIST = ", ".join(
    [r(f"{e}_{m}", f"{e}_{m}", FINE) for e in EMOTIONS for m in ("baseline", "variability")]
    + [r(f"{e}_{m}_week", f"{e}_{m}", FINE) for e in EMOTIONS for m in ("instability", "inertia")]
)
FEATURES_SQL = f"""{_FEATURES}, features AS (SELECT b.* , {', '.join(f'u.{e}_{m}_week AS {e}_{m}' for e in EMOTIONS for m in ('instability', 'inertia'))}
 FROM base b LEFT JOIN u_week u ON b.author_id = u.author_id)"""


def make_features(t):
    return features.user_features(flows.stored_panel(t.scored()))


@query("user_baseline", f"WITH {scored_sql('de_en')}, {_BASE} SELECT * REPLACE ({', '.join(r(f'{e}_{m}', f'{e}_{m}') for e in EMOTIONS for m in ('baseline', 'variability'))}) FROM base")
def user_baseline(t):
    return rounded(features.user_baseline(t.scored("de_en")))


@query("period_dynamics_week", f"WITH {scored_sql()}, {_dyn('week', 10)} SELECT author_id, period, n_posts, {', '.join(r(f'{e}_{m}', f'{e}_{m}', FINE) for e in EMOTIONS for m in ('mssd', 'phi'))} FROM w_week")
def period_dynamics_week(t):
    pairs = features.with_previous(t.scored())
    return rounded(features.period_dynamics(pairs, "week", 10), FINE)


@query("user_features", f"""{_FEATURES} SELECT b.author_id, {_FEATURE_LIST}, n_news_shared, n_untrustworthy_shared, n_biased_shared, n_tweets, n_scored
 FROM base b LEFT JOIN u_week u ON b.author_id = u.author_id""")
def user_features(t):
    return rounded(make_features(t), FINE)


@query("previous_in_week", f"""WITH {scored_sql()} SELECT id, {r('lag(anger_v2) OVER w', 'prev_anger')}, epoch_us(lag(created_at) OVER w) AS prev_us FROM scored
 WHERE anger_v2 IS NOT NULL AND fear_v2 IS NOT NULL AND disgust_v2 IS NOT NULL WINDOW w AS (PARTITION BY author_id, strftime(created_at, '%G-%V') ORDER BY created_at, id)""")
def previous_in_week(t):
    pairs = features.with_previous(t.scored())
    week, before = (features.period_of(F.to_date(c), "week") for c in ("created_at", "prev_created_at"))
    same = week == before
    return rounded(pairs.select(
        "id", F.when(same, F.col("prev_anger_v2")).alias("prev_anger"),
        F.when(same, F.unix_micros("prev_created_at")).alias("prev_us")))


_WINDOWED = [f"{e}_{m}_{u}" for u in features.MIN_POSTS for e in EMOTIONS for m in ("instability", "inertia")]
_WINDOWED_SQL = f"""WITH {scored_sql()}, {', '.join(_dyn(u, k) for u, k in features.MIN_POSTS.items())},
 wf AS (SELECT * FROM u_day FULL JOIN u_week USING (author_id) FULL JOIN u_month USING (author_id))"""


@query("window_features", f"{_WINDOWED_SQL} SELECT author_id, {', '.join(r(c, c, FINE) for c in _WINDOWED)} FROM wf")
def window_features(t):
    return rounded(features.window_features(t.scored()), FINE)


@query("window_coverage", f"{_WINDOWED_SQL} " + " UNION ALL ".join(
    f"SELECT '{m}_{u}' AS feature, count(anger_{m}_{u}) AS n_users FROM wf" for m in ("instability", "inertia") for u in features.MIN_POSTS))
def window_coverage(t):
    return features.window_coverage(features.window_features(t.scored()))


def _agree(e, m):
    f = f"{e}_{m}"
    return (f"SELECT '{f}' AS feature, CAST(count(*) AS DOUBLE) AS n, {r(f'corr({f}_day, {f}_week)', 'day_week')}, {r(f'corr({f}_week, {f}_month)', 'week_month')}, "
            f"{r(f'corr({f}_day, {f}_month)', 'day_month')} FROM wf WHERE {f}_day IS NOT NULL AND {f}_week IS NOT NULL AND {f}_month IS NOT NULL")


@query("window_agreement", f"{_WINDOWED_SQL} " + " UNION ALL ".join(_agree(e, m) for m in ("instability", "inertia") for e in EMOTIONS))
def window_agreement(t):
    return rounded(features.window_agreement(features.window_features(t.scored())))


_AD = f"""ad AS (SELECT author_id, day, count(*) AS n_tweets, count(anger_v2) AS n_scored, count(ng_domain) AS n_news,
 count(*) FILTER (Score < 60) AS n_untrustworthy, count(*) FILTER (Score >= 60) AS n_trustworthy,
 {', '.join(f'count(*) FILTER ({e}_v2 >= 0.65) AS n_{e}' for e in EMOTIONS)}, count(*) FILTER (Orientation IN ('Left', 'Right')) AS n_biased FROM scored GROUP BY 1, 2)"""
AD_SQL = f"WITH {scored_sql('de_en')}, {_AD}"


def make_author_day(t):
    return features.author_day(t.scored("de_en"))


@query("author_day", f"""{AD_SQL} SELECT *, {', '.join(r(f'n_{c} / CAST(n_tweets AS DOUBLE)', f'prop_{c}') for c in ('news', 'untrustworthy', 'trustworthy', 'biased'))},
 {', '.join(r(f'CASE WHEN n_scored > 0 THEN n_{e} / CAST(n_scored AS DOUBLE) END', f'prop_{e}') for e in EMOTIONS)} FROM ad""")
def author_day(t):
    return rounded(make_author_day(t))


_STATS = f"""WITH {scored_sql()}, per_day AS (SELECT author_id, day, count(*) AS n FROM scored GROUP BY 1, 2),
 apd AS (SELECT author_id, avg(n) AS avg_tweets_per_day FROM per_day GROUP BY 1),
 st AS (SELECT s.author_id, epoch_us(min(s.created_at)) AS first_us, epoch_us(max(s.created_at)) AS last_us, count(*) AS total_tweets, avg(Score) AS avg_trustworthiness, avg(anger_v2) AS avg_anger, avg(fear_v2) AS avg_fear FROM scored s GROUP BY 1),
 us AS (SELECT st.*, avg_tweets_per_day, account_created, followers_count, following_count, tweet_count FROM st JOIN apd USING (author_id) LEFT JOIN users USING (author_id))"""


def make_user_stats(t):
    return features.user_statistics(t.scored(), t.users())


@query("user_statistics", f"{_STATS} SELECT * REPLACE ({', '.join(r(c, c) for c in ('avg_trustworthiness', 'avg_anger', 'avg_fear', 'avg_tweets_per_day'))}) FROM us")
def user_statistics(t):
    s = make_user_stats(t)
    return rounded(s.withColumns({"first_us": F.unix_micros("first_tweet_date"), "last_us": F.unix_micros("last_tweet_date")}).drop("first_tweet_date", "last_tweet_date"))


@query("user_statistics_summary", f"""{_STATS} SELECT {r('avg(total_tweets)', 'avg_tweets_per_user')}, {r('avg(avg_tweets_per_day)', 'avg_tweets_per_day')}, {r('avg(avg_trustworthiness)', 'mean_trustworthiness')},
 {r('avg(avg_anger)', 'mean_baseline_anger')}, {r('avg(avg_fear)', 'mean_baseline_fear')}, count(*) AS n_users FROM us""")
def user_statistics_summary(t):
    return rounded(features.user_statistics_summary(make_user_stats(t)))


def _between(child, parent):
    """Weighted squared distances of group means to the parent mean, as defined."""
    on = " AND ".join(f"c.{k} = p.{k}" for k in parent) or "TRUE"
    grp = (lambda ks: f"SELECT {', '.join(['emotion', *ks])}, count(*) AS n, avg(x) AS m FROM long GROUP BY ALL")
    return f"(SELECT c.emotion, sum(c.n * (c.m - p.m) ^ 2) AS v FROM ({grp(child)}) c JOIN ({grp(parent)}) p ON c.emotion = p.emotion AND {on} GROUP BY 1)"


_LV = ["author_id", "iso_year", "week", "day"]
_SS = f"""WITH {scored_sql('de_en')}, wide AS (SELECT author_id, strftime(created_at, '%G') AS iso_year, strftime(created_at, '%G-%V') AS week, day, anger_v2 AS anger, fear_v2 AS fear, disgust_v2 AS disgust FROM scored),
long AS (UNPIVOT wide ON anger, fear, disgust INTO NAME emotion VALUE x),
tot AS (SELECT emotion, sum((x - m) ^ 2) AS t FROM (SELECT emotion, x, avg(x) OVER (PARTITION BY emotion) AS m FROM long) GROUP BY 1),
wd AS (SELECT emotion, sum((x - m) ^ 2) AS v FROM (SELECT emotion, x, avg(x) OVER (PARTITION BY emotion, author_id, day) AS m FROM long) GROUP BY 1),
comp AS (SELECT emotion, 'between users' AS component, v FROM {_between(_LV[:1], [])}
 UNION ALL SELECT emotion, 'between years (within users)', v FROM {_between(_LV[:2], _LV[:1])}
 UNION ALL SELECT emotion, 'between weeks (within years)', v FROM {_between(_LV[:3], _LV[:2])}
 UNION ALL SELECT emotion, 'between days (within weeks)', v FROM {_between(_LV[:4], _LV[:3])}
 UNION ALL SELECT emotion, 'within days', v FROM wd),
bu AS (SELECT emotion, v FROM comp WHERE component = 'between users')"""


@query("variance_decomposition", f"""{_SS} SELECT c.emotion, component, {r('c.v / t * 100', 'pct_of_total')},
 CASE WHEN component <> 'between users' THEN round(c.v / (t - bu.v) * 100, 6) + 0.0 END AS pct_of_within_user FROM comp c JOIN tot USING (emotion) JOIN bu ON bu.emotion = c.emotion""")
def variance_decomposition(t):
    return rounded(features.variance_decomposition(t.scored("de_en")))


# --- event windows ---------------------------------------------------------
HOURS, MIN_MEAN = 72, 3


def _frames(span_us: int, min_mean: int) -> str:
    cols = []
    for side, frame in (("before", f"RANGE BETWEEN {span_us} PRECEDING AND 1 PRECEDING"), ("after", f"RANGE BETWEEN 1 FOLLOWING AND {span_us} FOLLOWING")):
        w = f"OVER (PARTITION BY author_id ORDER BY t {frame})"
        cols.append(f"count(*) {w} AS n_tweets_{side}")
        for e in EMOTIONS:
            cols.append(f"count({e}_v2) {w} AS n_{e}_{side}, CASE WHEN count({e}_v2) {w} >= {min_mean} THEN avg({e}_v2) {w} END AS mean_{e}_{side}")
    return ", ".join(cols)


WINDOWS_SQL = f"""WITH {scored_sql()}, tl AS (SELECT *, epoch_us(created_at) AS t FROM scored),
fr AS (SELECT *, {_frames(HOURS * 3600 * 10**6, MIN_MEAN)} FROM tl),
win AS (SELECT id AS event_id, author_id, t, Score AS event_score, {', '.join(f'n_tweets_{s}' for s in ('before', 'after'))},
 {', '.join(f'n_{e}_{s}, mean_{e}_{s}' for s in ('before', 'after') for e in EMOTIONS)}, {', '.join(f'{e}_v2 AS event_{e}' for e in EMOTIONS)}
 FROM fr WHERE Score IS NOT NULL AND {' AND '.join(f'n_{e}_{s} > 0' for s in ('before', 'after') for e in EMOTIONS)})"""
_MEANS = [f"mean_{e}_{s}" for s in ("before", "after") for e in EMOTIONS] + [f"event_{e}" for e in EMOTIONS]


def make_windows(t):
    return flows.window_tables(t.scored(), [HOURS], MIN_MEAN)[HOURS]


@query("event_windows", f"{WINDOWS_SQL} SELECT * REPLACE ({', '.join(r(c, c) for c in _MEANS)}) FROM win")
def event_windows(t):
    w = make_windows(t)
    return rounded(w.withColumn("t", F.unix_micros("event_timestamp")).drop("event_timestamp"))


@query("event_windows_1h", f"""WITH {scored_sql('de_en')}, tl AS (SELECT *, epoch_us(created_at) AS t FROM scored), fr AS (SELECT *, {_frames(3600 * 10**6, 1)} FROM tl)
 SELECT id AS event_id, n_tweets_before, n_tweets_after, {', '.join(f'n_{e}_{s}' for e in EMOTIONS for s in ('before', 'after'))} FROM fr WHERE Score IS NOT NULL""")
def event_windows_1h(t):
    posts = t.scored("de_en")
    totals = windows.window_totals(posts, windows.news_events(posts), 1)
    return totals.select("event_id", *[c for c in totals.columns if c.startswith("n_")])


def _values(side):
    cond = {"before": f"p.t >= w.t - {HOURS * 3600 * 10**6} AND p.t < w.t", "after": f"p.t > w.t AND p.t <= w.t + {HOURS * 3600 * 10**6}"}[side]
    return f"{WINDOWS_SQL} SELECT {r('anger_v2', 'value')}, count(*) AS weight FROM win w JOIN tl p ON p.author_id = w.author_id AND {cond} WHERE anger_v2 IS NOT NULL GROUP BY anger_v2"


@query("window_values_before", _values("before"))
def window_values_before(t):
    return rounded(windows.window_values(t.scored(), make_windows(t), HOURS, "anger", "before"))


@query("window_values_after", _values("after"))
def window_values_after(t):
    return rounded(windows.window_values(t.scored(), make_windows(t), HOURS, "anger", "after"))


_LONG = f"""{WINDOWS_SQL}, lw AS (UNPIVOT (SELECT author_id, event_id, {', '.join(f'mean_{e}_{s} AS {e}_{s}' for e in EMOTIONS for s in ('before', 'after'))} FROM win)
 ON {', '.join(f'{e}_{s}' for e in EMOTIONS for s in ('before', 'after'))} INTO NAME nm VALUE value)"""


@query("windows_long", f"{_LONG} SELECT author_id, event_id, string_split(nm, '_')[1] AS emotion, string_split(nm, '_')[2] AS \"window\", {r('value', 'value')} FROM lw")
def windows_long(t):
    return rounded(windows.windows_long(make_windows(t)))


@query("window_counts", f"{_LONG} SELECT author_id, string_split(nm, '_')[2] AS \"window\", count(DISTINCT event_id) AS n_events, count(*) AS n_tweets FROM lw GROUP BY 1, 2")
def window_counts(t):
    return windows.window_counts(windows.windows_long(make_windows(t)))


@query("untrust_degree", f"{WINDOWS_SQL} SELECT event_id, {r('(100 - event_score) / 100', 'untrustworthy')} FROM win")
def untrust_degree(t):
    return rounded(windows.with_untrust_degree(make_windows(t)).select("event_id", "untrustworthy"))


@query("ntile_users", f"WITH {scored_sql()}, b AS (SELECT author_id, avg(anger_v2) AS v FROM scored GROUP BY 1 HAVING avg(anger_v2) IS NOT NULL) SELECT author_id, CAST(ntile(10) OVER (ORDER BY v, author_id) AS INTEGER) AS decile FROM b")
def ntile_users(t):
    base = features.user_baseline(t.scored()).select("author_id", F.col("anger_baseline").alias("v")).filter("v IS NOT NULL")
    return windows.ntiles(base, "v", "author_id").select("author_id", "decile")


@query("sample_per_decile", f"WITH {scored_sql()}, b AS (SELECT author_id, avg(anger_v2) AS v FROM scored GROUP BY 1 HAVING avg(anger_v2) IS NOT NULL), d AS (SELECT *, CAST(ntile(10) OVER (ORDER BY v, author_id) AS INTEGER) AS decile FROM b) SELECT author_id, {r('v', 'v')}, decile FROM d QUALIFY row_number() OVER (PARTITION BY decile ORDER BY {keyed('author_id', 636)}, author_id) <= 5")
def sample_per_decile(t):
    base = features.user_baseline(t.scored()).select("author_id", F.col("anger_baseline").alias("v")).filter("v IS NOT NULL")
    return rounded(windows.sample_per_tile(windows.ntiles(base, "v", "author_id"), "decile", "author_id", 5))


@query("sample_per_decile_sizes", f"WITH {scored_sql()}, b AS (SELECT author_id, avg(anger_v2) AS v FROM scored GROUP BY 1 HAVING avg(anger_v2) IS NOT NULL), d AS (SELECT CAST(ntile(10) OVER (ORDER BY v, author_id) AS INTEGER) AS decile FROM b) SELECT decile, least(count(*), 5) AS n FROM d GROUP BY 1")
def sample_per_decile_sizes(t):
    return sample_per_decile(t).groupBy("decile").agg(F.count(F.lit(1)).alias("n"))


# --- concentration ---------------------------------------------------------
_TOT = f"""{AD_SQL}, tot AS (SELECT author_id, CAST(sum(n_untrustworthy) AS BIGINT) AS total_misinfo_count, CAST(sum(n_trustworthy) AS BIGINT) AS total_trustworthy_count,
 CAST(sum(n_news) AS BIGINT) AS total_news_count, CAST(sum(n_biased) AS BIGINT) AS total_biased_count FROM ad GROUP BY 1)"""


def _conc(name, col, cond):
    o = f"ORDER BY {col} DESC, CAST(author_id AS BIGINT)"
    return f"""{name} AS (SELECT author_id, {col} AS "count", CAST(sum({col}) OVER ({o} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumsum_count, CAST(sum({col}) OVER () AS BIGINT) AS total_count,
 row_number() OVER ({o}) AS user_rank, row_number() OVER ({o}) * 100.0 / count(*) OVER () AS percentile FROM tot WHERE {cond})"""


_CONC = f"{_TOT}, {_conc('cu', 'total_misinfo_count', 'TRUE')}, {_conc('ct', 'total_trustworthy_count', 'total_trustworthy_count > 0')}"


@query("user_totals", f"{_TOT} SELECT * FROM tot")
def user_totals(t):
    return sharers.user_totals(make_author_day(t))


def _conc_out(name):
    return f"{_CONC} SELECT * REPLACE ({r('percentile', 'percentile')}), {r('cumsum_count / CAST(total_count AS DOUBLE)', 'cumsum_prop')} FROM {name}"


@query("concentration_untrustworthy", _conc_out("cu"))
def concentration_untrustworthy(t):
    return rounded(sharers.concentration(sharers.user_totals(make_author_day(t)), "total_misinfo_count"))


@query("concentration_trustworthy", _conc_out("ct"))
def concentration_trustworthy(t):
    return rounded(sharers.concentration(sharers.user_totals(make_author_day(t)), "total_trustworthy_count", True))


GROUPS_SQL = f"""{_CONC}, groups AS (SELECT author_id, 'Untrustworthy' AS "group" FROM cu WHERE (cumsum_count - "count") / CAST(total_count AS DOUBLE) < 0.8
 UNION ALL SELECT author_id, 'Trustworthy' FROM ct WHERE (cumsum_count - "count") / CAST(total_count AS DOUBLE) < 0.8)"""


def make_groups(t):
    return flows.user_tables(t.scored("de_en"))["groups"]


@query("supersharer_groups", f"{GROUPS_SQL} SELECT * FROM groups")
def supersharer_groups(t):
    return make_groups(t)


_GF = f"""{GROUPS_SQL}, {_BASE}, {_dyn('week', 10)}, gf AS (SELECT g."group", b.*, {', '.join(f'u.{e}_{m}_week AS {e}_{m}' for e in EMOTIONS for m in ('instability', 'inertia'))}
 FROM groups g JOIN base b ON g.author_id = b.author_id LEFT JOIN u_week u ON u.author_id = b.author_id),
 gl AS (UNPIVOT (SELECT "group", {', '.join(_FEATURE_COLS)} FROM gf) ON {', '.join(_FEATURE_COLS)} INTO NAME metric VALUE value)"""
GROUP_FEATURES_SQL = _GF


def make_group_features(t):
    tables = flows.user_tables(t.scored("de_en"))
    return tables["groups"].join(tables["features"], "author_id")


@query("group_means", f"{_GF} SELECT \"group\", metric, count(*) AS n, {r('avg(value)', 'mean_value')}, {r('stddev_samp(value)', 'std_value')} FROM gl GROUP BY 1, 2")
def group_means(t):
    return rounded(sharers.group_means(make_group_features(t), "group", _FEATURE_COLS))


@query("group_means_wide", f"{_GF} SELECT metric, {r('''avg(value) FILTER ("group" = 'Trustworthy')''', 'Trustworthy')}, {r('''avg(value) FILTER ("group" = 'Untrustworthy')''', 'Untrustworthy')} FROM gl GROUP BY 1")
def group_means_wide(t):
    return rounded(sharers.group_means_wide(make_group_features(t), "group", _FEATURE_COLS, ["Trustworthy", "Untrustworthy"]))


@query("feature_coverage", f"{_GF} SELECT g.\"group\", count(*) AS n_all, count(f.author_id) AS n_with_features, round(count(f.author_id) * 100.0 / count(*), 1) AS pct_with_features FROM groups g LEFT JOIN (SELECT DISTINCT author_id FROM gf WHERE anger_instability IS NOT NULL) f ON g.author_id = f.author_id GROUP BY 1")
def feature_coverage(t):
    f = features.user_features(t.scored("de_en")).filter("anger_instability IS NOT NULL")
    return sharers.feature_coverage(make_groups(t), f)


@query("outcome_table", f"WITH {scored_sql()}, {_BASE} " + " UNION ALL ".join(
    f"SELECT '{k}' AS outcome, count(*) FILTER ({v} > 0) AS n_users, round(count(*) FILTER ({v} > 0) * 100.0 / count(*), 1) AS pct_users FROM base" for k, v in sharers.OUTCOMES.items()))
def outcome_table(t):
    return sharers.outcome_table(features.user_baseline(t.scored()))


@query("binarize_outcomes", f"WITH {scored_sql()}, {_BASE} SELECT author_id, {', '.join(f'CAST({v} > 0 AS INTEGER) AS {k}' for k, v in sharers.OUTCOMES.items())} FROM base")
def binarize_outcomes(t):
    return sharers.binarize_outcomes(features.user_baseline(t.scored())).select("author_id", *sharers.OUTCOMES)


@query("complete_zscores", f"""{FEATURES_SQL}, c AS (SELECT author_id, anger_instability AS a, ln(n_scored) AS l FROM features WHERE {' AND '.join(f'{c} IS NOT NULL' for c in _FEATURE_COLS)})
 SELECT author_id, {r('(a - avg(a) OVER ()) / stddev_samp(a) OVER ()', 'anger_instability')}, {r('(l - avg(l) OVER ()) / stddev_samp(l) OVER ()', 'log_n_scored')} FROM c""")
def complete_zscores(t):
    f = panel.complete_cases(make_features(t), _FEATURE_COLS).withColumn("log_n_scored", F.log("n_scored"))
    return rounded(panel.zscore(f, ["anger_instability", "log_n_scored"]).select("author_id", "anger_instability", "log_n_scored"))


# --- cohorts ---------------------------------------------------------------
@query("cohort_type", f"WITH {POSTS} SELECT author_id, CASE WHEN account_created >= DATE '2022-01-01' THEN 'new' ELSE 'old' END AS user_type, {r('''date_diff('day', account_created, DATE '2024-07-01') / CAST(365 AS DOUBLE)''', 'age')} FROM users")
def cohort_type(t):
    c = F.col("account_created")
    return rounded(t.users().select("author_id", sharers.cohort_type(c).alias("user_type"), sharers.account_age_years(c, "2024-07-01").alias("age")))


@query("join_months", f"WITH {POSTS} SELECT CAST(date_trunc('month', account_created) AS DATE) AS join_month, count(*) AS n_new_users FROM users WHERE account_created >= DATE '2019-01-01' GROUP BY 1")
def join_months(t):
    return sharers.join_months(t.users())


@query("active_account_ages", f"""{AD_SQL} SELECT author_id, {r('''date_diff('day', account_created, DATE '2022-07-01') / CAST(365 AS DOUBLE)''', 'account_age')}
 FROM (SELECT DISTINCT author_id FROM ad WHERE day >= DATE '2024-01-15') a JOIN users USING (author_id) WHERE account_created <= DATE '2022-07-01'""")
def active_account_ages(t):
    return rounded(sharers.active_account_ages(make_author_day(t), t.users(), "2024-01-15"))


@query("activity_by_cohort", f"""{AD_SQL} SELECT day, CASE WHEN account_created >= DATE '2022-01-01' THEN 'new' ELSE 'old' END AS user_type, {r('avg(n_tweets)', 'avg_tweets')},
 {r('avg(n_untrustworthy / CAST(n_tweets AS DOUBLE))', 'avg_untrustworthy')} FROM ad LEFT JOIN users USING (author_id) GROUP BY 1, 2""")
def activity_by_cohort(t):
    return rounded(sharers.activity_by_cohort(make_author_day(t), t.users()))
