"""Column functions against the Python standard library and hand-made cases."""

import datetime
import re
import urllib.parse

import pytest
from pyspark.sql import functions as F

from auditloom import fixed
from auditloom.functions import actors, prose, routes, text


def evaluate(spark, function, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in rows.select("i", function(F.col("v")).alias("x")).orderBy("i").collect()]


def test_iso_date_follows_the_standard_library(spark):
    values = ["2026-08-14", " 20260814 ", "2026-W33-5", "2026-W33", "2026W33", "2026W335",
              "2026-W53-1", "2020-W53-7", "2026-W54", "2026-W00", "2026-8-4", "2026-08",
              "2026-08-14T10:00", "0000-01-01", "2026-02-30", "0001-01-01", "9999-12-31", "",
              "2026W338", "2015-W53", "2026-W01-1"]

    def expected(value):
        try:
            return datetime.date.fromisoformat(value.strip())
        except ValueError:
            return None
    assert evaluate(spark, text.iso_date, values) == [expected(v) for v in values]


def test_usable_url_follows_the_standard_library(spark):
    values = ["http://:80", "https://h.example:99999/x", "https://%GG/", "https://a.b/%2",
              "http://user@", "http://user@h", "http://a_b.com", "HTTP://h", "http://h:",
              "http://h:0", "http://h:00080/x", "http://h:80:90", "http://[::1]:80/",
              "http://[::]/", "http://[1::2::3]/", "http://[1:2:3:4:5:6:7:8]",
              "http://[1:2:3:4:5:6:7]", "http://[::ffff:1.2.3.4]/", "http://[v1.a]/", "http:/x",
              "http:////h", "ftp://h", "http://h?x", "http://h#y", "http://@h", "http://a@b@c:1",
              "http://***", "http://h\\x", "http://h x", "http://h:+80", "http://h:8a", "!!!", "",
              "http://[1.2.3.4]", "http://[1::]", "http://[1:2:3:4:5:6:7::]", "http://[:1::]",
              "http://a]@h", "http://[a@h", "http://é.com", "http://[::1", "https://h/[x]",
              "http://h:65536", "http://h:65535", "http://[12345::]", "http://[]/"]

    def expected(value):
        value = value.strip()
        if not re.fullmatch(r"[A-Za-z0-9\-._~:/?#\[\]@!$&'()*+,;=%]+", value):
            return False
        if re.search(r"%(?![0-9A-Fa-f]{2})", value):
            return False
        try:
            parsed = urllib.parse.urlparse(value)
            host, port = parsed.hostname, parsed.port
        except ValueError:
            return False
        return (parsed.scheme in ("http", "https") and bool(host)
                and any(c.isalnum() for c in host) and (port is None or 0 < port <= 65535))
    assert evaluate(spark, routes.usable_url, values) == [expected(v) for v in values]


@pytest.mark.parametrize("value, is_blank, is_unusable", [
    ("", True, True), (None, True, True), (" TBD ", True, True), ("N/A", True, True),
    ("na", True, True), ("---", True, True), ("...", True, True), ("xxxx", True, True),
    ("??", True, True), ("　todo ", True, True), ("!!!", False, True),
    ("none given", False, False), ("数据", False, False), ("½", False, False)])
def test_filled_field_predicates(spark, value, is_blank, is_unusable):
    assert evaluate(spark, text.blank, [value]) == [is_blank]
    assert evaluate(spark, text.unusable, [value]) == [is_unusable]


def test_strip_takes_every_unicode_blank(spark):
    blanks = "".join(chr(c) for c in range(0x110000) if chr(c).isspace())
    assert set(fixed.BLANKS) == set(blanks)
    assert evaluate(spark, text.strip, [blanks + "a b" + blanks]) == ["a b"]


def test_actor_identity(spark):
    values = ["model=M-1; harness=cli; run=r1", "Model = m 1 ;HARNESS=CLI;run= R1; role=reviewer",
              "model=M; harness=c; run=1;", "role=runner", "model=M;harness=c;run=1;role=",
              "model=a;model=b;harness=c;run=1", "model=a;harness=c;run=1;x=2", None, "!!!"]
    got = evaluate(spark, actors.actor_identity, values)
    assert tuple(got[0]) == tuple(got[1]) == ("m 1", "cli", "r1")
    assert got[2:] == [None] * 7


def test_numbers(spark):
    values = ["1175,7,114", "12,3456", "4,200 and 0,123", "4.50 4.5 4.", "a" * 40 + " 7",
              "f" * 64, "x" + "a1" * 20, "٤٥ MW", "1,234,567.89,"]
    assert evaluate(spark, prose.numbers, values) == [
        ["1175", "7114"], ["12", "3456"], ["4200", "0123"], ["4.50", "4.5", "4"], ["7"], [],
        ["1"], ["٤٥"], ["1234567", "89"]]


def test_entities_and_sentences(spark):
    assert evaluate(spark, prose.sentences, ["A b.  C d?\nE! \n", "e.g. x", ""]) == [
        ["A b.", "C d?", "E!"], ["e.g.", "x"], []]
    values = ["Reported by Acme Power Grid Board Extra.", "Acme Corp said", "éAcme Bo", "A Bo",
              "then AT&T/Verizon-X. Not"]
    assert evaluate(spark, prose.entities, values) == [
        ["Acme Power Grid Board", "Extra."[:-1]], ["Acme Corp"], ["Bo"], ["Bo"],
        ["AT&T/Verizon-X. Not"]]


def test_bare_and_prose_numbers(spark):
    assert evaluate(spark, prose.bare_numbers, ["saw 1,204 of 7, v2 3.5 a/44 x-9 12"]) == [
        ["1,204", "3.5", "12"]]
    assert evaluate(spark, prose.prose_numbers, ["`999` 4,200 12 100. https://h/555 100 3.14"]) == [
        ["4,200", "100", "3.14"]]


def test_reference_defect(spark):
    values = ["see handoffs/x.md 2026-08-14", "2026-08-14, https://h/a).", "2026-13-01 x.md",
              "2026-08-14 http://h:99999/", "", "2026-08-14 ///", "x2026-08-14 a.md"]
    assert evaluate(spark, routes.reference_defect, values) == [
        None, None, "no_date", "no_route", "no_reference", "no_route", "no_date"]


def test_held_path(spark):
    values = ["a/b.txt", " ./a//b.txt ", "/a", "a/../b", "..", "", ".", "a..b"]
    assert evaluate(spark, routes.held_path, values) == [
        "a/b.txt", "a/b.txt", None, None, None, None, None, "a..b"]
