"""Pseudonyms per format over many values: a permutation within the format that links equal values."""

import datetime
import random
import re

import pytest

from fieldstone.llm import pii, queries
from fieldstone.llm.common import table

KEY = b"key"


def dates(layout):
    for day in range(datetime.date(1995, 1, 1).toordinal(), datetime.date(2003, 1, 1).toordinal()):
        d = datetime.date.fromordinal(day)
        yield layout.format(y=d.year, m=d.month, d=d.day)


def numbers(kind, n=4000):
    rng = random.Random(kind)
    digits = lambda k: "".join(rng.choices("0123456789", k=k))
    for _ in range(n):
        if kind == "card":
            head = rng.choice("3456") + digits(14)
            yield next(head + c for c in "0123456789" if pii.luhn(head + c))
        elif kind == "ssn":
            yield f"{rng.randint(1, 665):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}"
        elif kind == "phone":
            yield "+1" + digits(10)
        elif kind == "foreign phone":
            yield "+" + rng.choice(("44", "49", "351", "7", "0")) + digits(rng.randint(6, 10))
        elif kind == "ipv4":
            yield ".".join(str(rng.randint(1, 255)) for _ in range(4))
        elif kind == "iban":
            inner = "".join(rng.choices("ABCDEFGH", k=4)) + digits(14)
            yield f"GB{98 - pii.iban_number(inner + 'GB00') % 97:02d}{inner}"
        elif kind == "email":
            yield f"{rng.choice('abc')}{digits(2)}@m{digits(2)}.example.org"
        else:
            yield f"token={digits(6)}{rng.choice('abcdef')}"


FORMATS = {"card": "card", "ssn": "ssn", "phone": "phone", "foreign phone": "phone", "ipv4": "ipv4", "iban": "iban", "email": "email", "secret": "secret"}


@pytest.mark.parametrize("kind", FORMATS)
def test_different_values_stay_different(kind):
    made = {}
    for value in numbers(kind):
        new = pii.FORMATS[FORMATS[kind]][0](value, KEY)
        if new is not None:
            assert made.setdefault(new, value) == value
            if kind != "ipv4":
                assert [c.isdigit() for c in new] == [c.isdigit() for c in value]
    assert len(made) > 1000


def test_dates_of_all_layouts():
    made, seen = {}, 0
    for layout in ("{y}-{m:02d}-{d:02d}", "{d:02d}.{m:02d}.{y}", "{d:02d}/{m:02d}/{y}", "{m:02d}/{d:02d}/{y}", "{d}/{m}/{y}", "{m}/{d}/{y}", "{d}.{m}.{y}"):
        for value in dates(layout):
            new = pii.date(value, KEY)
            assert [len(x) for x in re.split(r"[-./]", new)] == [len(x) for x in re.split(r"[-./]", value)]
            assert made.setdefault(new, value) == value
            seen += 1
    assert seen > 20_000
    same = [pii.date(v, KEY) for v in ("2024-02-29", "29.02.2024", "29/02/2024")]
    assert len({tuple(sorted(re.split(r"[-./]", v))) for v in same}) == 1


def test_phones_are_linked_and_checked():
    forms = ("+19885552485", "+1 988 555 2485", "+1 (988) 555-2485", "(988) 555-2485", "988-555-2485")
    new = [pii.phone(f, KEY) for f in forms]
    assert len({re.sub(r"\D", "", n)[-10:] for n in new}) == 1 and all(n.startswith("+1") for n in new[:3])
    assert re.sub(r"\D", "", pii.phone("+44 20 7946 0958", KEY)) == re.sub(r"\D", "", pii.phone("+442079460958", KEY))
    for bad in ("123-456-7890", "988-155-2485", "+44 12", "+0123456789"):
        assert pii.pseudonymise(f"call {bad} now", KEY, {})[0] == f"call {bad} now"


@pytest.mark.parametrize("text, value", [("api_key: abcdefgh", "abcdefgh"), ("access_token=abc123def", "abc123def"), ('secret_key = "zzTop"', "zzTop"), ('{"password": "hunterx"}', "hunterx"), ("my.secret-token: aaabbb", "aaabbb"), ("APIKEY=Zz", "Zz")])
def test_secrets_with_and_without_digits_elsewhere(text, value):
    alone, kinds = pii.pseudonymise(text, KEY, {})
    assert kinds == ["secret"] and value not in alone and len(alone) == len(text)
    assert pii.pseudonymise(f"{text} and 7", KEY, {})[0] == f"{alone} and 7"  # alike in every text


def test_query_against_plain_search(spark, sf_dir):
    """Every value that plain patterns find is gone, all else is as it was."""
    plain = re.compile(r"\S+@\S+\.\w+|\b(?:password|token|secret|api_key)\s*=\s*\"?[\w+/-]+|\bAKIA[A-Z0-9]{16}\b|\b\d{3}-\d{2}-\d{4}\b|\b\d{13,19}\b|\b(?:\d{4} ){3}\d{4}\b|\+1 \(\d{3}\) \d{3}-\d{4}|\b\d{1,3}(?:\.\d{1,3}){3}\b|\b\d{4}-\d{2}-\d{2}\b")
    got = {r.doc_id: r for r in queries.op5_pii(spark, sf_dir).collect()}
    found = 0
    for r in table(spark, sf_dir, "documents").collect():
        values = plain.findall(r.text)
        found += len(values)
        out = got[r.doc_id].text
        left, new = plain.split(r.text), plain.split(out)
        assert left == new and (out != r.text) == bool(got[r.doc_id].n_found)
        assert got[r.doc_id].n_found >= len([v for v in values if v not in out])
        assert not [v for v in values if v in out and not v.replace(" ", "").isdigit()]
    assert found > 5


def test_long_texts_and_empty_tables(spark):
    long = ("word " * 200_000) + "mail bo@mail8.example.com end " + "1 2 3 4 " * 50_000
    out, kinds = pii.pseudonymise(long, KEY, {})
    assert kinds == ["email"] and len(out) == len(long) and "bo@mail8" not in out
    df = spark.createDataFrame([], "doc_id long, text string, n_chars int, masked string")
    assert pii.mask_documents(df).columns == df.columns and pii.mask_documents(df).count() == 0
