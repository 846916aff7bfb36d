import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import clashing, empty, odd_docs, odd_rows
from pyspark.sql import functions as F

from larkseek.llm import pii
from larkseek.llm.common import table

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, s):
    digits = [int(c) for c in s if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        twice = [d * 2 - 9 * (d > 4) if k % 2 else d for k, d in enumerate(digits[::-1])]
        return 12 <= len(digits) <= 19 and sum(twice) % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def brute(text):
    """Base spans by the patterns themselves."""
    out = [(m.start(), k, m.end()) for k, p in enumerate(PATTERNS.values()) for m in re.finditer(p, text or "") if passes(list(PATTERNS)[k], m[0])]
    return sorted(out)


def base(text):
    return [s for s in pii.Finder().spans(text) if s[1] < 4]


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="a@.+-4 0()2é😀%_", max_size=60))
def test_parsers_equal_the_patterns(text):
    assert base(text) == brute(text)


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(["1.2.3.4", "255", ".", "4111 1111 1111 1111", "5500-0000-0000-0004", "-", " ", "+1 (555) 010-9999", "+", "a.b@c-d.ef", "@", "x@y.z", "..", "999.1.1.1", "00012", "é", "\n"]), max_size=9))
def test_joined_pieces_equal_the_patterns(parts):
    assert base("".join(parts)) == brute("".join(parts))


def found(text):
    return [(pii.KINDS[k], text[a:b]) for a, k, b in pii.Finder().spans(text)]


def test_added_kinds():
    assert found("see https://anna:pw@host.example:8080/x?y=1 now") == [("address", "https://anna:pw@host.example:8080/x?y=1"), ("email", "pw@host.example")]
    assert found("sftp://bob@files.example") == [("address", "sftp://bob@files.example"), ("email", "bob@files.example")]
    assert found("https://example.com/about and http://") == []
    assert found("IBAN: DE89 3704 0044 0532 0130 00 BIC and more") == [("account", "DE89 3704 0044 0532 0130 00")]
    assert found("IBAN DE88370400440532013000") == []
    assert found("SSN 078-05-1120, SSN 000-12-3456, ssn 078-05-1120") == [("account", "078-05-1120")]
    assert found("account number 12345678 or account no. 12") == [("account", "12345678")]
    assert found("the accountant counted 12345678 sheep") == []


def test_added_kinds_take_nothing_from_the_base():
    text = "IBAN GB82 WEST 1234 5698 7654 32 account number 4111 1111 1111 1111 ssh://+1 555 010 9999@1.2.3.4"
    assert base(text) == brute(text) and {"card", "ip", "phone", "account"} <= {k for k, _ in found(text)}


def expected(i, text):
    spans = brute(text)
    listed = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
    return (i, *(sum(s[1] == k for s in spans) for k in range(4)), hashlib.sha256(listed.encode()).hexdigest(), listed)


def test_odd_rows_and_long_texts(spark):
    docs = clashing(odd_docs(spark)).withColumn("spans", F.lit("y"))
    assert sorted(map(tuple, pii.report(docs).collect()), key=repr) == sorted((expected(r[0], r[1]) for r in odd_rows()), key=repr)
    assert pii.report(empty(spark)).collect() == []
    # pieces of 2000: the patterns themselves take squares of longer ones
    long = " ".join(("1" * 2000, "a@b.cd", "9.9." * 500, "+" * 1000, "x" * 2000 + "@" + "-1" * 1000)) * 60
    assert base(long) == brute(long)


def test_given_table(spark, sf):
    docs = table(spark, sf, "documents")
    got = sorted(map(tuple, pii.report(docs).collect()))
    assert got == sorted(expected(r["doc_id"], r["text"]) for r in docs.collect()) and all(sum(r[k] for r in got) for k in (1, 2, 3, 4))


def test_redact(spark):
    docs = spark.createDataFrame([(1, "mail a@b.cd or 1.2.3.4!"), (2, None), (3, "nothing")], "id long, text string").withColumn("redacted", F.lit("z"))
    out = pii.redact(docs)
    assert out.dtypes == docs.dtypes
    assert sorted(map(tuple, out.collect())) == [(1, "mail [email] or [ip]!", "z"), (2, None, "z"), (3, "nothing", "z")]
