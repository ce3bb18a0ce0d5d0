"""Work in Python is dealt out over tasks, however few files or bytes its input is."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeplane import report
from citeplane.operators import diagnosis, extract, locate, verify
from citeplane.operators.outline import squeeze
from citeplane.sources import payloads


def tasks(df: DataFrame) -> int:
    """Tasks in which the rows of ``df`` are made."""
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def documents(spark, n: int, repo: str, body: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return spark.range(0, n, 1, 1).select(F.col("id").cast("string").alias("doc_key"), F.lit(repo).alias("repo"), F.lit("").alias("location"), F.lit(body).alias("body"), none.alias("miss"), none.alias("miss_reason"))


def test_chapters_are_dealt_out(spark):
    page = "<p>" + "before it all and so on " * 3 + "</p><h2>Book I</h2><p>" + "all that it says " * 5 + "</p>"
    got = payloads.gutenberg_files(spark.range(0, 100, 1, 1).select(F.col("id").cast("string").alias("key"), F.lit(page).alias("html")))
    assert tasks(got) >= 4 and got.count() == 200 and {r["title"] for r in got.collect()} == {"Preamble", "Book I"}


def test_location_is_dealt_out(spark, monkeypatch):
    rows = spark.range(0, 100, 1, 1).select("id", F.concat(F.lit("# A\n\nthis is what it says "), "id").alias("body"), F.concat(F.lit("what it says "), "id").alias("quote"))
    got = locate.locate(rows, ["id"])
    assert got.count() == 100 and {r["locator"] for r in got.collect()} == {"A"} and tasks(got) >= 4
    # Quotes of one document meet in one task, unless they are very many.
    same = rows.withColumn("body", F.lit("# A\n\n" + ", ".join(f"what it says {i}" for i in range(100))))
    assert tasks(locate.locate(same, ["id"])) == 1
    monkeypatch.setattr(locate, "LOT", 10)
    got = locate.locate(same, ["id"])
    assert tasks(got) > 1 and got.where("found_by = 'section'").count() == 100


def test_white_space_is_squeezed_as_before():
    every = "".join(f"{chr(c)}x{chr(c)}{chr(c)}" for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    assert squeeze(every) == re.sub(r"\s+", " ", every).strip()


def test_failures_are_dealt_out(spark):
    rows = spark.range(0, 100, 1, 1).select(F.lit("c").alias("check"), F.col("id").cast("string").alias("urn"), F.lit("one two three fower").alias("quote"), F.lit("one two three four").alias("text"), F.lit("").alias("where"))
    # Small tasks aren't put together, as they were when failures were dealt by their urn alone.
    got = verify._explained(rows)
    assert tasks(got) > 4 and {r["hint"]["ratio"] for r in got.collect()} == {6 / 7}


def test_texts_are_written_for_hints_only(spark):
    rows = spark.createDataFrame([("a", verify.NOT_FOUND), ("b", None), ("c", "no snippet")], "text string, fail string")
    assert [r["text"] for r in verify._for_hints(rows, "fail").orderBy("fail").collect()].count("a") == 1 and verify._for_hints(rows, "fail").where("text is not null").count() == 1


def test_outcomes_carry_the_stamp(spark):
    none = F.lit(None).cast("string")
    docs = extract.stamped(spark.range(3).select(F.col("id").cast("string").alias("doc_key"), F.lit("text of it").alias("body"), none.alias("miss"), none.alias("miss_reason")))
    targets = spark.range(4).select(F.col("id").cast("string").alias("doc_key"), F.lit("").alias("format"), none.alias("locator"), F.lit("").alias("anchor"), F.lit("u").alias("url"))
    got = {r["doc_key"]: r["stamp"] for r in extract.extract(targets, docs).collect()}
    assert got == {r["doc_key"]: r["stamp"] for r in docs.collect()} | {"3": None}


@pytest.mark.parametrize(("quote", "source", "want"), [("a b c d", "x a b c d y", ("a b c d", 1.0)), ("a a b c", "x " * 30 + "a b c a y", ("a b c", 6 / 7)), ("a b", "", None), ("a b c d", "x y z", None)])
def test_closest_passage(quote, source, want):
    q, keys = quote.split(), source.split()
    for n, at in diagnosis._shared(q, keys, 1):
        scan = SequenceMatcher(None, keys[at : at + len(q)], q, autojunk=False)
        assert -n * 2 / max(1, len(q) + len(keys[at : at + len(q)])) == scan.quick_ratio()
    found = diagnosis._best(q, keys)
    assert (found and (" ".join(keys[found[0] : found[1]]), found[2])) == want


def test_rendering_is_dealt_out(spark):
    page = "<pre><span class='h2'><a class='selflink' id='section-1'>1</a>. A</span>\n  text</pre>"
    got = payloads.rendered(documents(spark, 100, "rfc", page))
    assert tasks(got) >= 4 and got.distinct().count() == 100 and {r["body"] for r in got.collect()} == {payloads.rfc(page)}


def test_report_in_the_cluster_is_the_one_for_a_reader(spark):
    from citeplane.plans import derived

    got = derived._terms_run(spark, "/root/testdata/sf0.001")
    text = "\n".join(r["value"] for r in report.text_rows(got).collect())
    assert text in report.as_text(got) and text.count("           term ") > 1
