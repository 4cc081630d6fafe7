"""Readers and writers on files written into a fresh folder, release, scoring."""

import gzip
import json
import os
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from feedpanel.operators import panel, release, scoring
from feedpanel.schema import PANEL_SCHEMA, POST_COLUMNS, USER_COLUMNS
from feedpanel.session import work_folder
from feedpanel.sources import readers, writers

PAGE = {
    "data": [
        {
            "id": "1", "conversation_id": "1", "text": "a\nb\rc", "lang": "de", "created_at": "2021-01-01T10:00:00.000Z",
            "author_id": "7", "public_metrics": {"retweet_count": 1, "reply_count": 2, "quote_count": 0, "like_count": 3, "impression_count": 9},
            "entities": {"urls": [{"url": "u1", "expanded_url": "https://x.org/1"}, {"url": "u2", "expanded_url": "https://y.org"}],
                         "hashtags": [{"tag": "h1"}, {"tag": "h2"}], "mentions": [{"username": "m"}]},
            "referenced_tweets": [{"type": "quoted", "id": "55"}, {"type": "replied_to", "id": "56"}], "in_reply_to_user_id": "8",
        },
        {"id": "2", "conversation_id": "2", "text": 'say "hi", you', "lang": None, "created_at": "2021-01-02T10:00:00.000Z", "author_id": "7",
         "public_metrics": {"retweet_count": 0}, "referenced_tweets": [{"type": "retweeted", "id": "9"}]},
    ],
    "includes": {"users": [
        {"id": "7", "username": "u", "name": "n", "verified": False, "created_at": "2010-01-01T00:00:00.000Z", "description": "x\ny",
         "public_metrics": {"followers_count": 60, "following_count": None}, "entities": {"url": {"urls": [{"expanded_url": "https://me"}]}}},
        {"id": "8", "username": "v", "name": "w", "verified": True, "created_at": "2011-01-01T00:00:00.000Z"},
    ]},
}


@pytest.fixture()
def pages(new_folder):
    with gzip.open(f"{new_folder}/p1.json.gz", "wt") as f:
        json.dump(PAGE, f, indent=1)
    with open(f"{new_folder}/lines.jsonl", "w") as f:
        f.write(json.dumps(PAGE) + "\n" + json.dumps(PAGE) + "\n")
    return new_folder


def test_posts_json(spark, pages):
    df = readers.read_posts_json(spark, f"{pages}/*.json.gz")
    assert df.columns == POST_COLUMNS
    one, two = df.orderBy("id").collect()
    assert one["text"] == "a b c" and one["expanded_urls"] == "https://x.org/1 https://y.org" and one["hashtags"] == "h1 h2"
    assert (one["tweet_type"], one["quoted_id"], one["retweeted_id"], one["impression_count"]) == ("quoted replied_to", "55", "", 9.0)
    assert (two["urls"], two["mentions"], two["retweeted_id"], two["in_reply_to_user_id"], two["like_count"]) == ("", "", "9", "", None)


def test_reduced_and_users_json(spark, pages):
    reduced = readers.read_posts_json_reduced(spark, f"{pages}/lines.jsonl")
    assert reduced.columns == readers.REDUCED_COLUMNS and reduced.count() == 4
    users = readers.read_users_json(spark, f"{pages}/*.json.gz").orderBy("author_id")
    assert users.columns == USER_COLUMNS
    one, two = users.collect()
    assert (one["followers_count"], one["following_count"], one["description"], one["expanded_urls"]) == (60.0, 0.0, "x y", "https://me")
    assert (two["tweet_count"], two["description"], two["location"]) == (0.0, "", "")


def test_csv_round_trip(spark, pages, new_folder):
    posts = readers.read_posts_json(spark, f"{pages}/*.json.gz")
    out = f"{new_folder}/posts"
    writers.write_csv(posts, out)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        writers.write_csv(posts, out)
    back = readers.read_panel_csv(spark, out, with_file=True)
    assert back.columns == [*POST_COLUMNS, "file"]
    assert dict(back.dtypes)["like_count"] == "double" and dict(back.dtypes)["id"] == "string"
    rows = back.orderBy("id").collect()
    assert rows[1]["text"] == 'say "hi", you' and rows[1]["urls"] is None and rows[0]["file"].startswith("part-")
    few = readers.read_panel_csv(spark, out, ["id", "like_count"], {"like_count": "string"})
    assert few.dtypes == [("id", "string"), ("like_count", "string")]
    assert readers.read_columns(spark, out) == POST_COLUMNS


def test_user_files(spark, new_folder):
    head = "author_id,username,followers_count,following_count,tweet_count\n"
    for name, body in (("f1", "1,a,30,1,9\n1,b,20,1,6\n2,c,oops,1,1\n"), ("f2", "1,z,70,1,9\n")):
        with open(f"{new_folder}/{name}.part.csv", "w") as f:
            f.write(head + body)
    users = readers.read_users_csv(spark, f"{new_folder}/*.csv")
    got = {(r["file"], r["author_id"]): (r["username"], r["followers_count"]) for r in users.collect()}
    assert got == {("f1", "1"): ("b", 20.0), ("f1", "2"): ("c", None), ("f2", "1"): ("z", 70.0)}
    last = {r["author_id"]: r["username"] for r in panel.latest_users(users).collect()}
    assert last == {"1": "z", "2": "c"}
    assert panel.filter_followers(panel.latest_users(users)).count() == 1


def test_batches_annotations_split(spark, new_folder):
    for i in (1, 2):
        with open(f"{new_folder}/b{i}.csv", "w") as f:
            f.write(f"url,domain\nu{i},\n")
    assert sorted(r["url"] for r in readers.read_batches(spark, new_folder).collect()) == ["u1", "u2"]
    with open(f"{new_folder}/a.txt", "w") as f:
        f.write("id;text;uncodable\n1;a,b;1\n2;c;\n")
    sheet = readers.read_annotations(spark, f"{new_folder}/a.txt")
    assert sheet.columns == ["id", "text", "uncodable"] and sheet.count() == 2
    writers.write_split(spark.range(0, 25, 1, 2), f"{new_folder}/split", rows=5)
    counts = spark.read.option("header", True).csv(f"{new_folder}/split").groupBy(F.input_file_name()).count()
    assert counts.agg(F.max("count"), F.sum("count")).first()[:] == (5, 25)


def test_write_by_month(spark, new_folder):
    df = spark.createDataFrame([(datetime(2021, m, 3), m) for m in (1, 1, 2)], "created_at timestamp, x int")
    writers.write_by_month(df, f"{new_folder}/m")
    back = spark.read.parquet(f"{new_folder}/m")
    assert {(r["month"], r["count"]) for r in back.groupBy("month").count().collect()} == {("2021-01", 2), ("2021-02", 1)}


def test_a_rerun_replaces_its_month_only(spark, new_folder):
    def table(rows):
        return spark.createDataFrame([(datetime(2021, m, 3), x) for m, x in rows], "created_at timestamp, x int")

    path = f"{new_folder}/m"
    writers.replace_months(table([(1, 1), (1, 2), (2, 3)]), path)
    writers.replace_months(table([(2, 4), (3, 5)]), path)
    writers.replace_months(table([(2, 4), (3, 5)]), path)
    assert sorted(r["x"] for r in spark.read.parquet(path).collect()) == [1, 2, 4, 5]
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"


def test_schema():
    kinds = {f.name: f.dataType.simpleString() for f in PANEL_SCHEMA.fields}
    assert kinds["id"] == "string" and kinds["hope_v2"] == "double" and len(kinds) == 34


def test_release(spark):
    authors = spark.createDataFrame([("10",), ("9",), ("10",), ("100",)], "author_id string")
    ids = {r["author_id"]: r["anon"] for r in release.order_preserving_ids(authors, "author_id").collect()}
    assert ids == {"10": 1, "100": 2, "9": 3}
    w1 = spark.createDataFrame([("e1", "9", 1.0), ("e2", "10", 2.0)], "event_id string, author_id string, s double")
    w24 = spark.createDataFrame([("e2", "10", 2.0), ("e3", None, 0.0)], "event_id string, author_id string, s double")
    users = authors.distinct().withColumn("username", F.lit("secret"))
    keys = {"w1": ["author_id", "event_id"], "w24": ["author_id", "event_id"], "users": ["author_id"]}
    tables = {"w1": w1, "w24": w24, "users": users}
    out = release.release(tables, keys, authors, {"users": release.USER_DROPS})
    assert out["users"].columns == ["author_id"]
    by_s = {r["s"]: (r["event_id"], r["author_id"]) for r in out["w1"].unionByName(out["w24"]).collect()}
    assert {k: v[1] for k, v in by_s.items()} == {1.0: 3, 2.0: 1, 0.0: None}
    # the event in both tables has one number
    e = [r["event_id"] for t in ("w1", "w24") for r in out[t].filter("s = 2.0").collect()]
    assert e[0] == e[1] and {v[0] for v in by_s.values()} == {1, 2, 3}
    with pytest.raises(ValueError, match="identifying"):
        release.release({"users": users}, {"users": ["author_id"]}, authors)
    stranger = spark.createDataFrame([("77",)], "author_id string")
    out = release.release({"t": stranger}, {"t": ["author_id"]}, authors)["t"]
    with pytest.raises(Exception, match="not in the mapping"):
        out.collect()


def test_written_release_leaves_no_mapping(spark, new_folder):
    folder = work_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    events = spark.createDataFrame([("e1", "9"), ("e2", "10")], "event_id string, author_id string")
    release.write_release({"w": events}, {"w": ["author_id", "event_id"]}, events, f"{new_folder}/out")
    assert sorted(r["author_id"] for r in spark.read.parquet(f"{new_folder}/out/w").collect()) == [1, 2]
    with pytest.raises(ValueError, match="identifying"):
        release.write_release({"w": events}, {"w": ["event_id"]}, events, f"{new_folder}/no")
    assert set(os.listdir(folder)) == before


def test_files_with_another_header_fail(spark, new_folder):
    for name, text in (("a.csv", "id,author_id\n1,A\n"), ("b.csv", "author_id,id\nB,2\n")):
        with open(f"{new_folder}/{name}", "w") as f:
            f.write(text)
    with pytest.raises(Exception, match="header"):
        readers.read_panel_csv(spark, [f"{new_folder}/a.csv", f"{new_folder}/b.csv"]).collect()


def test_random_ids_differ_between_runs(spark):
    ids = spark.range(200).select(F.col("id").cast("string").alias("e"))
    a, b = (release.random_ids(ids, "e").orderBy("e").collect() for _ in range(2))
    assert sorted(r["anon"] for r in a) == list(range(1, 201))
    assert a != b


def test_scoring(spark):
    texts = spark.createDataFrame([(str(i), "good day" if i % 2 else "bad night") for i in range(100)], "id string, text_cleaned string")
    out = scoring.score_texts(texts.repartition(3), lambda batch: [[float("bad" in s), len(batch) / 100] for s in batch], ["a", "n"])
    assert out.count() == 100 and out.agg(F.sum("a"), F.max("n")).first()[:] == (50.0, 0.32)
    labelled = texts.withColumn("bad", F.col("text_cleaned").contains("bad").cast("int"))
    scored = scoring.apply_scorer(scoring.train_scorer(labelled, "bad"), texts, "p")
    assert scored.filter("(p > 0.5) <> (text_cleaned LIKE 'bad%')").count() == 0


def test_training_reads_its_texts_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        seen.add(1)
        return text

    texts = spark.createDataFrame([(str(i), "bad things" if i % 3 else "good things", int(i % 3 > 0)) for i in range(60)], "id string, raw string, bad int")
    model = scoring.train_scorer(texts.select("id", "bad", counted(F.col("raw")).alias("text_cleaned")), "bad")
    # both fits work on stored counts of words
    assert seen.value == 60
    low, high = (r["p"] for r in scoring.apply_scorer(model, texts.limit(2).withColumnRenamed("raw", "text_cleaned"), "p").orderBy("id").collect())
    assert low < 0.5 < high


def test_work_folder_is_read_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert work_folder(spark) == named if named else work_folder(spark).startswith("/tmp/run-")

    class Conf:
        def get(self, key, default=None):
            return "hdfs://shared/" if key == "spark.checkpoint.dir" else default

    class Session:
        conf = Conf()

    assert work_folder(Session()) == "hdfs://shared"


@pytest.mark.parametrize("size", [1, 2, 3, 10, 255, 256, 257, 1000])
def test_permutation_is_one_to_one(spark, size):
    key = release.fresh_key(spark, "k")
    out = spark.range(size).withColumn("_key", key.scalar()).select("id", release.permuted(F.col("id"), size, F.col("_key")).alias("p"))
    assert sorted(r["p"] for r in out.collect()) == list(range(size))


def test_permuted_ids(spark):
    ids = spark.range(20000).select((F.col("id") * 49_999_999_999_999).cast("string").alias("event_id"), "id")
    key = release.fresh_key(spark)
    out = release.permuted_ids(ids, "event_id", key)
    assert out.columns == ids.columns and out.select("event_id").distinct().count() == 20000
    again = release.permuted_ids(ids.filter("id < 100"), "event_id", key).join(out.withColumnRenamed("event_id", "e"), "id")
    assert again.filter("event_id = e").count() == 100
    other = release.permuted_ids(ids, "event_id", release.fresh_key(spark)).join(out.withColumnRenamed("event_id", "e"), "id")
    assert other.filter("event_id = e").count() < 5
    secret = key.first()["key"]
    assert secret not in out._jdf.queryExecution().toString()
    assert [r[0] for r in release.permuted_ids(spark.createDataFrame([(None,)], "event_id string"), "event_id", key).collect()] == [None]
    for bad in ("e1", "-5", "07", "1" * 19):
        with pytest.raises(Exception, match="whole number"):
            release.permuted_ids(spark.createDataFrame([(bad,)], "event_id string"), "event_id", key).collect()


def test_a_release_of_numbers_stores_no_event_mapping(spark, monkeypatch):
    monkeypatch.setattr(release, "random_ids", None)
    w = spark.createDataFrame([("11", "9", 1.0), ("12", "10", 2.0), (None, "9", 3.0)], "event_id string, author_id string, s double")
    out = release.release({"a": w, "b": w.filter("s > 1")}, {"a": ["event_id", "author_id"], "b": ["event_id", "author_id"]}, w)
    a, b = ({r["s"]: r["event_id"] for r in out[t].collect()} for t in "ab")
    assert a[3.0] is None and a[2.0] == b[2.0] and a[1.0] != a[2.0]


def test_page_files_are_read_in_splits_where_they_can_be(spark, new_folder):
    page = '{"data": [{"id": "%d", "text": "x", "author_id": "a"}], "includes": {"users": [{"id": "a"}]}}'
    with open(f"{new_folder}/lines.json", "w") as f:
        f.write("\n" + "".join(page % i + "\n" for i in range(4000)))
    with open(f"{new_folder}/pretty.json", "w") as f:
        f.write((page % 7).replace("{", "{\n").replace(",", ",\n"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    posts = readers.read_posts_json(spark, f"{new_folder}/lines.json")
    tasks = posts.select(F.spark_partition_id()).distinct().count()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert tasks > 3 and posts.count() == 4000 and readers.read_users_json(spark, f"{new_folder}/lines.json").count() == 4000
    assert [r["id"] for r in readers.read_posts_json(spark, f"{new_folder}/pretty.json").collect()] == ["7"]


def test_a_scorer_is_loaded_once_per_worker(spark):
    loads = spark.sparkContext.accumulator(0)

    def load():
        loads.add(1)
        return lambda batch: [[float(len(s))] for s in batch]

    texts = spark.range(4000).select(F.col("id").cast("string").alias("id"), F.lit("abc").alias("text_cleaned"))
    out = scoring.score_texts(texts.repartition(64), scoring.once_per_worker(load), ["n"], batch=20)
    assert out.agg(F.sum("n")).first()[0] == 12000
    # 64 tasks, but no more loads than worker processes
    assert 1 <= loads.value <= spark.sparkContext.defaultParallelism + 1


def test_a_scorer_is_loaded_no_more_often_after_tasks_with_two_python_steps(spark):
    def slowly(frames):
        for pdf in frames:
            time.sleep(0.05)
            yield pdf

    cores = spark.sparkContext.defaultParallelism
    two_steps = spark.range(0, 1000, 1, 4 * cores).mapInPandas(slowly, "id bigint").mapInPandas(slowly, "id bigint")
    assert two_steps.count() == 1000
    loads = spark.sparkContext.accumulator(0)

    def load():
        loads.add(1)
        return lambda batch: [[1.0]] * len(batch)

    texts = spark.range(4000).select(F.col("id").cast("string").alias("id"), F.lit("abc").alias("text_cleaned"))
    out = scoring.score_texts(texts.repartition(64), scoring.once_per_worker(load), ["n"], batch=20)
    assert out.agg(F.sum("n")).first()[0] == 4000
    assert 1 <= loads.value <= cores + 1


def test_a_profile_is_part_of_the_plan(spark):
    profile = scoring.accelerated(gpus=2, cores=2, memory="2g")
    texts = spark.createDataFrame([("1", "a")], "id string, text_cleaned string")
    plan = scoring.score_texts(texts, lambda b: [[1.0]] * len(b), ["n"], profile=profile)._jdf.queryExecution().optimizedPlan()
    held = plan.profile()
    assert held.isDefined() and "gpu" in held.get().toString()
    assert not scoring.score_texts(texts, lambda b: [[1.0]] * len(b), ["n"])._jdf.queryExecution().optimizedPlan().profile().isDefined()
