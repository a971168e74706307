"""Surrogates by enumeration: whole classes of names, dates and house numbers map one to one; words are no names."""

import datetime
import itertools

import pytest
from tests.conftest import SF

from webloom.llm import pii

CLASSES = {
    "latin": ("RSTBKM", "aeiou", "bcdfghklmnprst", "aeioun"),
    "long latin": ("RS", "aei", "lnr", "aou", "nst", "aeio", "kms", "aeoi"),
    "cyrillic": ("РСТКБ", "аеиоу", "бвгдклмнпрст", "аеиояв", "аеионв"),
    "cyrillic endings": ("РСТК", "аеиоу", "бвгдклмнпрст", ("ова", "ева", "ина", "ов", "ев", "ин", "ский", "ская", "а", "о", "ы")),
    "greek": ("ΡΣΤΚΒ", "αεηιο", "βγδκλμνπρτ", "αεηιο", ("ς", "ν", "υ", "α", "η", "ός", "ης", "ου")),
    "hebrew": ("אבגדהוזחטי", "כלמנסעפצ", "אבגדהוזחטי", "כלמנסעפצקרשת"),
}


@pytest.mark.parametrize("kind", sorted(CLASSES))
@pytest.mark.parametrize("key", [b"surrogates", b"another"])
def test_names_of_a_class_stay_apart(kind, key):
    images: dict[str, str] = {}
    n = 0
    for letters in itertools.product(*CLASSES[kind]):
        name = "".join(letters)
        if name in pii._GIVEN_LIST:
            continue
        new = pii._word(key, "surname", name)
        assert new != name and new not in pii._GIVEN_LIST and len(new) == len(name) and pii._tail(new) == pii._tail(name)
        assert images.setdefault(new, name) == name
        n += 1
    assert n >= 2000


def test_ten_thousand_surnames():
    """All of one format: the surrogates are as many."""
    names = ["".join(p) for p in itertools.product("BCDFGHKLMNPRST", "aeiou", "bcdfghklmnprst", "aeiouy", "ns")]
    assert len(names) > 10_000 and len({pii._word(b"surrogates", "surname", n) for n in names}) == len(names)


def test_words_are_no_names():
    same = lambda t: pii.replace(b"key", t) == (t, [])
    assert same("Mr President spoke. The President left, and the president said so.") and same("Dr The best of all") and same("Ms Word is a program") and same("Paul The second")
    assert same("Mrs Chairman rose and Dr No one is there") or pii.replace(b"key", "Mrs Chairman rose")[1] == []
    text, found = pii.replace(b"key", "Mr Baker has a shop; the baker bakes. Mr Cooper The elder")
    assert [f[3] for f in found] == ["Mr Cooper"] and text.endswith(" The elder")
    assert pii.replace(b"key", "Mr President Mr Quark")[1][0][3] == "Mr Quark"


def test_more_entities():
    new = lambda t: pii.replace(b"key", t)
    for text, kind, value in (
        ("my name is Zelda Quark, hello", "name", "Zelda Quark"), ("Dear Ravi Kumar, thanks", "name", "Ravi Kumar"), ("السيد محمد علي هنا", "name", "السيد محمد علي"), ("שלום מר כהן לוי", "name", "מר כהן לוי"),
        ("she was born on 12.03.1984 there", "birth", "12.03.1984"), ("DOB: 1984-03-12.", "birth", "1984-03-12"), ("geboren am 1.2.1990", "birth", "1.2.1990"), ("born 31/12/1999", "birth", "31/12/1999"), ("DOB 02/30/1999", "birth", "02/30/1999"),
        ("at 12 High Street today", "street", "12 High Street"), ("in der Hauptstraße 12 wohnt", "street", "Hauptstraße 12"), ("au 7 rue de la Paix", "street", "7 rue de la Paix"), ("en Calle Mayor, 25 vive", "street", "Calle Mayor, 25"), ("221 Old Baker Road", "street", "221 Old Baker Road"),
    ):
        out, found = new(text)
        assert [(f[0], f[3]) for f in found] == [(kind, value)], (text, found)
        assert found[0][4] != value and out == text.replace(value, found[0][4]) and len(found[0][4]) == len(value)
    assert new("श्री राम कुमार आए")[1][0][3] == "श्री राम कुमार"
    assert new("in 12 days, on 12.03.1984, Street 7")[1] == []
    a, b = (new(t)[1][0][4] for t in ("call +1 (504) 555-2652 now", "call (504) 555-2652 now"))
    assert a.removeprefix("+1 ") == b


def test_dates_stay_apart():
    for write in ("{d:02}.{m:02}.{y}", "{d}.{m}.{y}", "{y}-{m:02}-{d:02}", "{d:02}/{m:02}/{y}", "{m:02}/{d:02}/{y}"):
        days = [datetime.date(1950, 1, 1) + datetime.timedelta(days=7 * k) for k in range(2500)]
        texts = {write.format(d=x.day, m=x.month, y=x.year) for x in days}
        made = {t: pii._birth(b"key", t) for t in texts}
        assert len(set(made.values())) == len(texts) and all(pii._shape(a) == pii._shape(b) and a != b for a, b in made.items())
    houses = [f"{n} High Street" for n in range(1, 3000)]
    assert len({pii._street(b"key", h) for h in houses}) == len(houses)


def test_no_collisions_in_documents(spark):
    done = pii.pseudonymise(spark.read.parquet(SF.replace("sf0.001", "sf0.01") + "/documents.parquet"), pii.DEMO_KEY)
    assert done.where("n_entities > 0").count() > 20 and pii.colliding_surrogates(done).count() == 0
