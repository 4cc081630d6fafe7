import hashlib
import random
import re

import pytest

from feedpanel.llm.personal_data import KINDS, Layer, all_spans, disguised_spans, luhn, masked, personal_data, plain_spans

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    return {
        "email": [m.span() for m in EMAIL.finditer(text)],
        "ip": [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in CARD.finditer(text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))],
        "phone": [m.span() for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15],
    }


def test_base_spans_of_random_texts():
    rng = random.Random(5)
    for _ in range(6000):
        text = "".join(rng.choice("01259ab@.+-( )_%é\n") for _ in range(rng.randint(0, 60)))
        assert plain_spans(text) == brute(text), text
    for _ in range(3000):
        text = "".join(rng.choice(["4111 1111", " 1111-1111 ", "+49", " 170", "(0)", "12", "a@b", ".c", "@", "1.2", ".3.4", "256.", " "]) for _ in range(8))
        assert plain_spans(text) == brute(text), text


@pytest.mark.parametrize("text,kind,part", [
    ("write to jane [at] mail (dot) example [dot] com now", "email", "jane [at] mail (dot) example [dot] com"),
    ("write to jane at example dot com now", "email", "jane at example dot com"),
    ("jane.d＠example．com", "email", "jane.d＠example．com"),
    ("x jаne@exаmple.com", "email", None),
    ("host 10[.]0[.]0[.]7 up", "ip", "10[.]0[.]0[.]7"),
    ("host １０.0.0.７ up", "ip", "１０.0.0.７"),
    ("card four one one one one one one one one one one one one one one one ok", "card", "four one one one one one one one one one one one one one one one"),
    ("call plus four nine one seven oh double five one two three ok", "phone", "plus four nine one seven oh double five one two three"),
    ("call +49 one seven one 2345678 ok", "phone", "+49 one seven one 2345678"),
    ("call +4​9 170 1234​567.", "phone", "+4​9 170 1234​567"),
])
def test_disguises(text, kind, part):
    found = disguised_spans(text)[kind]
    if part is None:
        assert found
    else:
        assert [text[a:b] for a, b in found] == [part]


@pytest.mark.parametrize("text", [
    "look at the house dot and stop", "one two three go", "we met at noon.", "a (at) b", "élève à l'école", "", "at dot at", "no one at home.com today",
])
def test_clean_texts_stay_clean(text):
    assert not any(all_spans(text)[1].values())


@pytest.mark.parametrize("text,kind,part", [
    ("call plus 49 170 1234567 today", "phone", "plus 49 170 1234567"),
    ("room one two, call plus 49 170 1234567 today", "phone", "plus 49 170 1234567"),
    ("write jane.doe at example.com today", "email", "jane.doe at example.com"),
    ("write jane_doe AT mail.example.com.", "email", "jane_doe AT mail.example.com"),
    ("E-mail: jane at example.com", "email", "jane at example.com"),
    ("jane at example.com", "email", None),
    ("look at example.com and meet us AT example.com", "email", None),
    ("e-mail us at example.com", "email", None),
    ("jane.doe at 5.30pm. Then jane.doe at home", "email", None),
    ("five plus 1200 is more", "phone", None),
])
def test_cues_of_their_own(text, kind, part):
    base, every = all_spans(text)
    added = [s for s in every[kind] if s not in base[kind]]
    assert [text[a:b] for a, b in added] == ([part] if part else [])


def test_layer_maps_back():
    layer = Layer("abXXcdYef", [(2, 4, "1"), (6, 7, "")])
    assert layer.text == "ab1cdef"
    assert [layer.source(i, i + 1) for i in range(7)] == [(0, 1), (1, 2), (2, 4), (4, 5), (5, 6), (7, 8), (8, 9)]
    assert layer.source(2, 6) == (2, 8)


def test_query_columns_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in personal_data(docs).collect()}
    seen = 0
    for r in docs.collect():
        want = brute(r.text or "")
        joined = ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in want[k])
        g = got[r.doc_id]
        assert [g.n_email, g.n_ip, g.n_card, g.n_phone] == [len(want[k]) for k in KINDS]
        assert g.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(g.spans.split(","))
        seen += len(joined)
    assert seen > 100


def test_odd_rows(spark):
    long = "9" * 200_000 + "a" * 200_000 + "@"
    rows = [(1, None, 0), (1, "", 0), (None, "a@b.c", 0), (2, "a@b.c a [at] b.cd", 0), (2, "a@b.c a [at] b.cd", 0), (3, long, 0), (4, "😀 a@b.c", 0)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, spans int")
    got = sorted((str(r.doc_id), r.n_email, r.spans) for r in personal_data(docs).collect())
    assert got == [("1", 0, ""), ("1", 0, ""), ("2", 1, "email:0:5,email:6:17"), ("2", 1, "email:0:5,email:6:17"), ("3", 0, ""), ("4", 1, "email:2:7"), ("None", 1, "email:0:5")]
    texts = [r.text for r in masked(docs).filter("doc_id = 2 OR doc_id = 1").collect()]
    assert sorted(map(str, texts)) == ["", "<email> <email>", "<email> <email>", "None"]
    assert personal_data(docs.limit(0)).count() == 0


def test_long_lists_of_addresses_take_linear_time():
    import time

    one = "write to jane.doe [at] example [dot] com or jim@example.org, call +49 170 1234567; "

    def seconds(copies):
        text = one * copies
        start = time.perf_counter()
        base, every = all_spans(text)
        assert len(base["email"]) == copies and len(every["email"]) == 2 * copies
        return time.perf_counter() - start

    seconds(100)
    assert seconds(40_000) < 60  # 3.3 million characters; quadratic work would take many minutes
