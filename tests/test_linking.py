"""URL functions and matching, the fuzzy part against all pairs."""

import random
import string
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedpanel.functions import urls as U
from feedpanel.functions.text import clean_text, recode_yes_no, repair_utf8
from feedpanel.operators import linking


def apply(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["o"] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "url,want",
    [
        ("https://www.Example.com/a/b", "example.com"),
        ("/ HTTP://www.a.b.www.org// ", "a.b.org"),
        ("host.at?x=1", "host.at?x=1"),
        ("https://host.at:80/x", "host.at:80"),
        ("http:", None),
        ("https:/broken", None),
        ("a b.com/x", "ab.com"),
        ("", ""),
        (None, None),
        ("https://x.com//y//z", "x.com"),
        ("https:////x", ""),
    ],
)
def test_extract_domain(spark, url, want):
    assert apply(spark, U.extract_domain, [url]) == [want]


def test_hosts(spark):
    got = apply(spark, U.host_from_failure, ["Cannot connect to host a.com:443 ssl:default [x]", "https://b.com", None])
    assert got == ["a.com", "https://b.com", None]
    got = apply(spark, U.registered_domain, ["a.b.example.com", "x.orf.co.at", "b.org:80", "single", "n.at?q=1.2"])
    assert got == ["example.com", "orf.co.at", "b.org", None, "n.at"]


def test_clean_text(spark):
    got = apply(
        spark, clean_text,
        ["  hi \U0001F600 there", "see https://t.co/x and more", "one https://a\ntwo @us_er1é!", "a\\b", "漢字 ok", None,
         "RT @x: y", "line\r after https://x\r still gone"],
    )
    assert got == ["hi  there", "see", "one  two !", "a b", "ok", "", "RT : y", "line\r after"]


def test_yes_no(spark):
    assert apply(spark, recode_yes_no, [" Yes", "0", "maybe", None]) == [True, False, None, None]


def test_repair_utf8(spark):
    df = spark.createDataFrame([(bytearray(b"ok\xff"),)], "b binary")
    assert df.select(repair_utf8(F.col("b")).alias("s")).first()["s"] == "ok�"


def indel_by_table(a, b):
    """Textbook dynamic programme."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] if x == y else 1 + min(row[j], new[-1]))
        row = new
    return row[-1]


def test_indel_distances():
    rng = random.Random(1)
    pairs = [tuple("".join(rng.choices("abc.", k=rng.randrange(12))) for _ in range(2)) for _ in range(300)]
    pairs += [tuple("".join(rng.choices("abé\U0001F600", k=rng.choice([60, 63, 64, 65, 128, 129, 200]))) for _ in range(2)) for _ in range(60)]
    pairs += [("", ""), ("a" * 130, "a" * 130), ("", "abc"), ("b" * 64, "a" * 64)]
    got = linking.indel_distances([a for a, _ in pairs], [b for _, b in pairs])
    assert got.tolist() == [indel_by_table(a, b) for a, b in pairs]
    assert len(linking.indel_distances([], [])) == 0


def edited(rng, name, edits):
    s = list(name)
    for _ in range(edits):
        at = rng.randrange(len(s))
        if rng.random() < 0.5:
            del s[at]
        else:
            s.insert(at, rng.choice(string.ascii_lowercase))
    return "".join(s)


def test_match_fuzzy_equals_all_pairs(spark):
    rng = random.Random(11)
    # lengths around every change of the allowed number of edits, shared endings
    rated = ["".join(rng.choices("abcd", k=n - 12)) + ".example.com" for n in (16, 17, 18, 24, 32, 33, 34, 48, 49, 50, 66, 90, 120) for _ in range(4)]
    hosts = [edited(rng, rng.choice(rated), rng.randrange(6)) for _ in range(400)]
    want = {}
    for h in set(hosts):
        best = min(((indel_by_table(h, r) / (len(h) + len(r)), r) for r in set(rated)))
        if best[0] * 100 < 3 - 1e-12:
            want[h] = best[1]
    h = spark.createDataFrame([(x,) for x in hosts], "host string")
    r = spark.createDataFrame([(x,) for x in rated], "ng_domain string")
    got = {row["host"]: row["ng_domain"] for row in linking.match_fuzzy(h, r).collect()}
    assert got == want
    assert any(indel_by_table(k, v) > 2 for k, v in want.items())


@pytest.mark.parametrize("threshold", [97, 90, 80])
def test_long_names_equal_all_pairs(spark, threshold):
    rng = random.Random(threshold)
    stem = "regional-observer-and-evening-courier-of-the-"
    rated = [stem + "".join(rng.choices("abcdefgh", k=rng.choice([8, 20, 40]))) + ".example.com" for _ in range(20)]
    rated += ["a" * n + "." + "ab" * m for n, m in ((40, 10), (60, 5), (10, 40), (43, 10))]  # few pieces, often repeated
    most = {97: 7, 90: 16, 80: 24}[threshold]
    hosts = [edited(rng, rng.choice(rated), rng.randrange(most)) for _ in range(120)]
    want = {}
    for h in set(hosts):
        far, name = min((indel_by_table(h, r) / (len(h) + len(r)), r) for r in set(rated))
        if far * 100 < 100 - threshold - 1e-12:
            want[h] = name
    h = spark.createDataFrame([(x,) for x in hosts], "host string")
    r = spark.createDataFrame([(x,) for x in rated], "ng_domain string")
    got = {row["host"]: row["ng_domain"] for row in linking.match_fuzzy(h, r, threshold).collect()}
    assert got == want and len(want) > 30


def test_a_common_piece_lists_no_pairs(spark):
    stem = "regional-observer-and-evening-courier-of-the-"
    tail = F.lower(F.substr(F.base64(F.unhex(F.sha2(F.col("id").cast("string"), 256))), F.lit(1), F.lit(24)))
    rated = spark.range(100_000).select(F.concat(F.lit(stem), tail, F.lit(".example.com")).alias("ng_domain"))
    hosts = rated.select(F.concat(F.lit("x"), "ng_domain").alias("host")).limit(1000)
    pairs = linking.fuzzy_candidates(hosts, rated)
    found = pairs.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("host = 'x' || ng_domain")).alias("right")).first()
    # all 100,000,000 pairs share 45 characters and an ending
    assert found["right"] == 1000 and found["n"] < 50_000
    with pytest.raises(ValueError):
        linking.fuzzy_candidates(hosts, rated, 50)


def test_long_names_that_differ_in_their_digits_list_few_pairs(spark):
    names = spark.range(30_000).select(F.concat(F.lit("the-regional-observer-and-evening-courier-of-"), F.md5(F.concat(F.lit("s"), "id").cast("binary")), F.lit(".example-news.com")).alias("ng_domain"))
    hosts = names.limit(2000).select(F.concat(F.substr("ng_domain", F.lit(1), F.lit(4)), F.substr("ng_domain", F.lit(8))).alias("host"))
    n = linking.fuzzy_candidates(hosts, names).count()
    # pieces of four characters listed more than a hundred names per host
    assert 2000 <= n < 20_000


def test_rarest_pieces_apart():
    rng = random.Random(3)
    for q in (1, 2, 3):
        counts = [[rng.randrange(9) for _ in range(rng.randrange(3 * q - q + 1, 9))] for _ in range(40)]
        wanted = [rng.randrange(1, 4) for _ in counts]
        got = linking._rarest_apart([np.array(c, float) for c in counts], wanted, q)
        for c, k, places in zip(counts, wanted, got):
            ways = [w for w in combinations(range(len(c)), k) if all(b - a >= q for a, b in zip(w, w[1:]))]
            assert tuple(sorted(places)) in ways
            assert sum(c[i] for i in places) == min(sum(c[i] for i in w) for w in ways)


def test_resolution_and_platforms(spark):
    short = spark.createDataFrame([("u1", "bit.ly"), ("u2", "youtu.be"), ("u3", "bit.ly")], "url string, domain string")
    res = spark.createDataFrame(
        [("u1", "https://www.x.org/1", 200), ("u1", "https://www.x.org/1", 200), ("u9", "Cannot connect to host h.at:443 x", None)],
        "url string, unraveled_url string, status_code int",
    )
    got = {(r["url"], r["unraveled_url"], r["domain"]) for r in linking.resolve_urls(short, res).collect()}
    assert got == {("u1", "https://www.x.org/1", "x.org"), ("u9", "h.at", "h.at"), ("u2", "youtu.be", "youtube.com"), ("u3", "bit.ly", "bit.ly")}
    report = linking.resolution_report(res).first()
    # results are counted once: one answer, one timeout
    assert (report["n_timeouts"], report["pct_timeouts"], report["pct_missing_domain"]) == (1, 100.0, 0.0)
    assert {r["url"] for r in linking.drop_platform_links(short).collect()} == {"u1", "u3"}


def test_all_urls_of_a_near_host_are_kept(spark):
    urls = spark.createDataFrame(
        [("a", "x.supplier-000001-newss.com"), ("b", "supplier-000001-newss.com"), ("c", "other.org"), ("d", "www2.supplier-000001-news.com")],
        "url string, domain string",
    )
    rated = spark.createDataFrame([("supplier-000001-news.com",)], "ng_domain string")
    got = {(r["url"], r["matched_by"]) for r in linking.match_domains(urls, rated).collect()}
    assert got == {("a", "fuzzy"), ("b", "fuzzy"), ("d", "registered")}


def test_small_functions(spark):
    from datetime import datetime

    from feedpanel.functions import scores as S

    times = ["2021-01-01T10:00:00.123Z", "not a time", None]
    assert apply(spark, S.post_time, times) == [datetime(2021, 1, 1, 10, 0, 0, 123000), None, None]
    share = spark.range(20000).agg(F.avg(S.hash_share(F.col("id"), 636, 4).cast("int"))).first()[0]
    assert share == pytest.approx(0.25, abs=0.02)
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "x double")
    assert [r[0] for r in df.select(S.null_if_nan(F.col("x"))).collect()] == [None, 1.0]
    ratio = df.select(linking.indel_ratio(F.lit("abcd"), F.lit("abc"))).first()[0]
    assert ratio == pytest.approx((1 - 1 / 7) * 100)
