"""Location, the inverse query: from a quote and a document to a target that provably leads back to the quote."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeplane.operators import content, diagnosis, outline
from citeplane.operators.outline import squeeze
from citeplane.session import dealt

#: Quotes of one document that one task looks for; a document with more is dealt out in lots of about so many.
LOT = 1000
LOCATED = "format string, locator string, matched_text string, found_by string, ambiguous int, hint struct<source_text:string,ratio:double,kind:string,missing:array<string>,extra:array<string>,where:string,percent:int>"
_HINT = pa.struct([("source_text", pa.string()), ("ratio", pa.float64()), ("kind", pa.string()), ("missing", pa.list_(pa.string())), ("extra", pa.list_(pa.string())), ("where", pa.string()), ("percent", pa.int32())])


def hint_of(f: diagnosis.Finding | None) -> dict | None:
    return None if f is None else {**asdict(f), "percent": f.percent}


def find(doc: content.Document, quote: str, kind: str | None = None) -> dict:
    """By section, else by the format's own locator, else somewhere in the document, else the closest passage."""
    quote = squeeze(quote)
    found = {"format": None, "locator": None, "matched_text": None, "found_by": "none", "ambiguous": 0, "hint": None}
    if not quote:
        return found
    if section := doc.locate_section(quote):
        held = outline.holding(doc.sections(), quote)
        return found | {"format": "section", "locator": section, "matched_text": quote, "found_by": "section", "ambiguous": len(held) if len(held) > 1 else 0}
    if got := doc.locate(quote, kind):
        return found | {"format": got[0], "locator": got[1], "matched_text": got[2], "found_by": "format"}
    text = squeeze(doc.text())
    if quote in text:
        return found | {"format": doc.kind, "matched_text": quote, "found_by": "document"}
    return found | {"hint": hint_of(diagnosis.closest(quote, text))}


def _by_document(rows: DataFrame, body: str, quote: str) -> DataFrame:
    """``rows`` dealt out so that quotes of one document meet, which is parsed once for those that come in a row."""
    rows = rows.withColumn("__h", F.xxhash64(body))
    many = rows.groupBy(F.col("__h").alias("__d")).agg(F.count("*").alias("__n")).where(F.col("__n") > LOT)
    rows = rows.join(F.broadcast(many), F.col("__h") == F.col("__d"), "left")
    rows = rows.withColumn("__lot", F.pmod(F.xxhash64(quote), F.ceil(F.coalesce("__n", F.lit(1)) / LOT))).drop("__d", "__n")
    return dealt(rows, "__h", "__lot")


def locate(pairs: DataFrame, id_cols: list[str], body: str = "body", quote: str = "quote", kind: str | None = None, formats: tuple[content.Format, ...] = ()) -> DataFrame:
    """``id_cols`` and where each row's quote stands in its body; null bodies and quotes are empty."""
    rows = pairs.select(*id_cols, body, quote)
    heads = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*id_cols).schema.fields)
    made = [("format", pa.string()), ("locator", pa.string()), ("matched_text", pa.string()), ("found_by", pa.string()), ("ambiguous", pa.int32()), ("hint", _HINT)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str, content.Document] | None = None
        for batch in batches:
            out = []
            for b, q in zip(batch.column(len(id_cols)).to_pylist(), batch.column(len(id_cols) + 1).to_pylist()):
                if last is None or last[0] != b:
                    last = b, content.Document(b or "", formats)
                out.append(find(last[1], q or "", kind))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(id_cols)], *(pa.array([o[n] for o in out], t) for n, t in made)], names=[*id_cols, *(n for n, _ in made)])

    return _by_document(rows, body, quote).mapInArrow(run, f"{heads}, {LOCATED}")


def diagnose(rows: DataFrame, id_cols: list[str], quote: str = "quote", text: str = "text", where: str = "where") -> DataFrame:
    """``id_cols`` and ``hint``: the closest passage. Call it on failures only: a UDF in a CASE runs on all rows."""
    rows = rows.select(*id_cols, quote, text, where)
    heads = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*id_cols).schema.fields)
    hint = LOCATED.rpartition("hint ")[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(id_cols)
        for batch in batches:
            out = [hint_of(diagnosis.closest(q or "", t or "", w or "")) for q, t, w in zip(*(batch.column(n + i).to_pylist() for i in range(3)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(out, _HINT)], names=[*id_cols, "hint"])

    return rows.mapInArrow(run, f"{heads}, hint {hint}")
