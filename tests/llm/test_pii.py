from __future__ import annotations

import random
import re
import string

import pytest
from pyspark.sql import functions as F

from gleaner.llm import pii
from tests.llm.conftest import rows_of

TEXT = (
    "Mr. John Smith (john.smith@mail3.example.com, +1 (386) 555-3733) met Mrs Smith at 10.2.3.4. "
    'JOHN.SMITH@mail3.example.com, +13865553733; token = "0641917ea4e9feb9cda83477b57ac2654884f485"; '
    "card 4111 1111 1111 1111 or 4111111111111111, 123-45-6789, DE89 3704 0044 0532 0130 00. г-жа Анна Петрова."
)


def replaced(spark, *texts, key="k"):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [row.text for row in pii.anonymize(frame, key).orderBy("doc_id").collect()]


def luhn(digits):
    total = 0
    for i, char in enumerate(reversed(digits)):
        value = int(char) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10


def test_replacements_keep_kind_format_script_and_coreference(spark):
    new, again = replaced(spark, TEXT, TEXT)
    assert new == again
    pattern = re.compile(
        r"Mr\. ([A-Z][\w-]+) ([A-Z]\w+) \(([a-z]+\.[a-z]+@[a-z]+\d\.[a-z]+\.com), \+(\d \(\d{3}\) \d{3}-\d{4})\) met Mrs (\w+) at (10(?:\.\d+){3})\. "
        r"([A-Z]+\.[A-Z]+@[a-z]+\d\.[a-z]+\.com), \+(\d{11}); token = \"([0-9a-f]{40})\"; "
        r"card (\d{4} \d{4} \d{4} \d{4}) or (\d{16}), (\d{3}-\d{2}-\d{4}), (DE\d{2}(?: \d{4}){4} \d{2})\. г-жа ([А-Я]\w+) ([А-Я]\w+)\."
    )
    found = pattern.fullmatch(new)
    assert found, new
    given, family, email, phone, other_family, _, shouted, digits, _, card, compact, *_, anna, petrova = found.groups()
    assert family == other_family and email == shouted.lower()
    assert re.sub(r"\D", "", phone) == digits
    assert card.replace(" ", "") == compact and compact[0] == "4" and luhn(compact) == 0
    assert given in pii.GIVEN["latin", "m"] and anna in pii.GIVEN["cyrillic", "f"]
    assert petrova.endswith(("ова", "ина"))
    for old in ("john", "smith@", "386", "4111", "0641917", "123-45", "3704", "Анна", "Петров"):
        assert old not in new.lower() and old not in new


def test_the_key_decides(spark):
    assert replaced(spark, TEXT, key="a") != replaced(spark, TEXT, key="b")


def test_distinct_entities_stay_distinct(spark):
    """Far more names than the list holds, and addresses in a small space."""
    texts = [f"Mr N{chr(97 + i % 26)}{chr(97 + i // 26)} Lee wrote x{i}@a.com" for i in range(300)]
    new = replaced(spark, *texts)
    names = [text.split()[1] for text in new]
    assert len(set(names)) == 300 and len({text.split()[2] for text in new}) == 1
    assert len({text.split()[-1] for text in new}) == 300
    assert not {text.split()[1] for text in texts} & set(names)


def test_collisions_are_settled_by_further_attempts(spark, monkeypatch):
    monkeypatch.setattr(pii, "_restyled", lambda value, stream: F.concat(F.lit("x"), F.substring(stream, 1, 1)))
    entities = spark.createDataFrame([("ssn", str(i)) for i in range(12)], "kind string, entity string")
    found = pii.register(entities, "k").collect()
    assert len(found) == 12 == len({row.surrogate for row in found})


def test_the_driver_tables_lose_every_entity(docs):
    new = pii.anonymize(docs, "k")
    assert new.count() == docs.count()
    before = {m.value for r in docs.select(pii.mentions(F.col("text")).alias("m")).collect() for m in r.m}
    after = {m.value for r in new.select(pii.mentions(F.col("text")).alias("m")).collect() for m in r.m}
    assert before and not before & after
    clean = docs.where(~pii.has_mention(F.col("text")))
    assert rows_of(clean.exceptAll(new)) == []


def test_only_built_in_functions_run(docs):
    plan = pii.anonymize(docs, "k")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty_tables_and_clashing_names(docs, nothing, clashing):
    assert pii.anonymize(nothing, "k").collect() == []
    new = pii.anonymize(clashing, "k")
    assert new.columns == clashing.columns
    assert rows_of(new.select("doc_id", "text")) == rows_of(pii.anonymize(docs, "k"))


@pytest.mark.parametrize("text", ["", " ", "no entity", "1.2.3", "a@b", "Mr", "999.1.1.1", "version 1.2.3.4.5"])
def test_what_is_no_entity_stays(spark, text):
    assert replaced(spark, text) == [text]


def test_long_secrets_are_replaced_as_a_whole(spark):
    rng = random.Random(4)
    letters = string.ascii_letters + string.digits
    make = lambda n, chars: "".join(rng.choice(chars) for _ in range(n))
    secrets = [
        make(800, letters), make(2000, letters), make(700, letters) + "." + make(900, letters) + "." + make(400, letters),
        "sk-" + make(2000, letters), "ghp_" + make(2000, letters), make(2000, "0123456789abcdef"), "1" * 60 + "a" * 60, make(50_000, letters),
    ]
    texts = [f'token = "{secret}".' if secret[:3] not in ("sk-", "ghp") else f"see {secret} here" for secret in secrets[:5]]
    texts += [f"see {secrets[5]} here", f"see {secrets[6]} here", f"password: {secrets[7]}. End"]
    for old, new, secret in zip(texts, replaced(spark, *texts), secrets, strict=True):
        at = old.index(secret)
        assert len(new) == len(old) and new[:at] == old[:at] and new[at + len(secret) :] == old[at + len(secret) :]
        kept = 4 if secret.startswith("ghp_") else 3 if secret.startswith("sk-") else 0
        for start in range(at + kept, at + len(secret) - 12, 97):
            assert new[start : start + 12] != old[start : start + 12]
