import pytest
from pyspark.sql import functions as F

from llm.brute import personal
from martloom.llm import pii

TEXTS = [
    None,
    "",
    "a@b.c a@b.c_d@e.f.g x..y@z @a.b a@b",
    "1.2.3.4.5.6.7.8 256.1.1.1 0255.000.1.9 1.2.3 ..1.2.3.4",
    "4111 1111 1111 1111, 4111-1111-1111-1112 5500005555555559x 41111111111111111111",
    "+1 (377) 555-0271 +12 +49.30.123456 +++123456789",
    "Ünïcode 😀 mail é@x.de me@x.de 😀 10.0.0.1",
    "iban DE89 3704 0044 0532 0130 00, call 030 1234567 now",
    "né a@b.cd 1.2.3.4 +49 30 123456 " * 30_000,
    " ".join(f"u{i}@x.org" for i in range(513)),
    "7" * 20000 + " " + "a." * 20000 + " " + "1-" * 9000,
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 5, "clash") for i, t in enumerate(TEXTS)] + [(2, TEXTS[2], 5, "again")], "doc_id long, text string, start int, t string")


def test_base_spans_equal_plain_python(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = pii.query(spark, str(tmp_path)).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == personal(TEXTS[r.doc_id]), r.doc_id


def test_added_spans(spark, docs):
    r = pii.find(docs).filter("doc_id = 7").select(F.col("more_iban")[0]["start"], "more_phone").first()
    assert r[0] == 5 and [(x.start, x.end) for x in r[1]] == [(39, 50)]


def test_empty_table(spark, docs):
    assert pii.find(docs.limit(0)).count() == 0
