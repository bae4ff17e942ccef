"""Personal data: base kinds against regular expressions, the kinds that cues and schemes add, masking."""

import random
import re

import pytest
from oracle import SF

from skytrace.llm.personal_data import BASE, KINDS, find_personal_data, luhn, masked, personal_spans
from skytrace.llm.queries import op13_personal_data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plain(text):
    return [(k, *m.span()) for k in BASE for m in re.finditer(PLAIN[k], text or "") if valid(k, m[0])]


def base(text):
    return [s for s in personal_spans(text) if s[0] in BASE]


def test_given_texts(spark):
    rows = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text").collect()
    found = {r["doc_id"]: r for r in op13_personal_data(spark, SF.replace("0.001", "0.01")).collect()}
    assert len(found) == len(rows)
    for r in rows:
        expected, got = plain(r["text"]), found[r["doc_id"]]
        assert [tuple(s) for s in base(r["text"])] == expected
        assert [got[f"n_{k}"] for k in BASE] == [sum(s[0] == k for s in expected) for k in BASE]
        assert got["spans"].startswith(",".join(f"{k}:{a}:{b}" for k, a, b in expected))
    assert sum(r["n_email"] for r in found.values()) and sum(r["n_card"] for r in found.values())


@pytest.mark.parametrize("alphabet", ["a@.-", "1.@", "12. -", "+1 (.)-2", "a1@.+ -é", "@:1a+. \x00"])
def test_random_texts(alphabet):
    rng = random.Random(alphabet)
    for _ in range(4000):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 30)))
        assert base(text) == plain(text), text


def test_random_numbers():
    rng = random.Random(1)
    for _ in range(4000):
        parts = [rng.choice(["4111111111111111", "4111 1111-1111 1111", "10.0.0.256", "1.2.3.4", "+1 (482) 555-7163", "+44.20.7946.0958", "7", ".", " ", "-", "+", "x"]) for _ in range(rng.randint(1, 6))]
        text = "".join(parts)
        assert base(text) == plain(text), text


def test_luhn():
    assert luhn("4111111111111111") and not luhn("4111111111111112")


@pytest.mark.parametrize(
    ("text", "kind", "value"),
    [
        ("IBAN: DE89 3704 0044 0532 0130 00.", "iban", "DE89 3704 0044 0532 0130 00"),
        ("iban DE89 3704 0044 0532 0130 01.", "iban", None),
        ("account no. 12345678, due", "account", "12345678"),
        ("accounts 12345678", "account", None),
        ("On account of 12 reasons", "account", None),
        ("SSN 123-45-6789.", "ssn", "123-45-6789"),
        ("Social Security number: 666-45-6789.", "ssn", None),
        ("see https://me:secret@host.example/x", "login", "me:secret"),
        ("see https://host.example/x:1@y", "login", None),
        ("jane.doe [at] mail (dot) example.com now", "hidden_email", "jane.doe [at] mail (dot) example.com"),
        ("at 2001:db8::ff00:42:8329, or", "ipv6", "2001:db8::ff00:42:8329"),
        ("1:2:3:4:5:6:7:8", "ipv6", "1:2:3:4:5:6:7:8"),
        ("at 12:30:45 or std::vector", "ipv6", None),
    ],
)
def test_added_kinds(text, kind, value):
    assert [text[a:b] for k, a, b in personal_spans(text) if k == kind] == ([value] if value else [])


def test_masking():
    text = "é me@x.org, 4111 1111 1111 1111 and https://a:b@h.io"
    assert masked(text, personal_spans(text)) == "é [email], [card] and https://[login]"
    assert masked("none", []) == "none"


def test_odd(spark, odd, none):
    out = find_personal_data(odd, mask=True)
    assert out.columns == [*odd.columns, "personal"]
    assert sorted(str(r["text"]) for r in out.collect()) == sorted(str(r["text"]) for r in odd.collect())
    assert find_personal_data(none).collect() == []
    clash = spark.createDataFrame([(1, "me@x.org", "own")], "doc_id long, text string, personal string")
    assert find_personal_data(clash).collect()[0]["personal"] == [("email", 0, 8)]
    assert len(set(KINDS)) == len(KINDS)


@pytest.mark.parametrize("part", ["a", "1", "1.", "@", "a@", "1 ", "+1", ":", "a:", "1:", "[at]", "+1(", "account ", "://a:", "1-"])
def test_time_grows_with_length(part):
    import time

    def seconds(n):
        began = time.perf_counter()
        personal_spans(part * n)
        return time.perf_counter() - began

    assert seconds(160_000) < 40 * max(seconds(16_000), 0.01)
