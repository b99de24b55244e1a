"""Declared schemas of the tables that the engine reads and writes; nothing is inferred."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DateType, DoubleType, IntegerType, LongType, MapType, StringType, StructField, StructType, TimestampType

TEXTS = ArrayType(StringType())


def _row(**fields) -> StructType:
    """Fields by name; a type in a tuple is required."""
    return StructType([StructField(n, t[0] if isinstance(t, tuple) else t, not isinstance(t, tuple)) for n, t in fields.items()])


LINE = _row(page=(IntegerType(),), y=(DoubleType(),), x=DoubleType(), text=(StringType(),), bold_start=BooleanType(), size=DoubleType(), fn_refs=TEXTS, kind=StringType())
FOOTNOTE = _row(page=(IntegerType(),), marker=(StringType(),), text=(StringType(),))
PAGE = _row(page=(IntegerType(),), header=StringType(), printed_page=StringType(), lines=ArrayType(LINE), footnotes=ArrayType(FOOTNOTE))
CHUNK = _row(
    chunk_id=(StringType(),), section_id=(StringType(),), snapshot_id=(StringType(),), law=(StringType(),), law_code=(StringType(),), kind=(StringType(),), chapter=StringType(), part=StringType(), section=StringType(),
    subsection=StringType(), schedule=StringType(), clause=StringType(), title=StringType(), text=(StringType(),), amended_by=TEXTS, amendment_notes=TEXTS, tax_year_from=(IntegerType(),), tax_year_to=IntegerType(),
    source_url=StringType(), page=IntegerType(), page_end=IntegerType(), version_date=DateType(), n_tokens=IntegerType(), needs_review=BooleanType(),
)
ENCODED = _row(chunk_id=(StringType(),), dense=ArrayType(DoubleType()), sparse=MapType(IntegerType(), DoubleType()))
GLOSSARY = _row(roman=TEXTS, urdu=TEXTS, english=StringType(), section_ids=TEXTS, search=BooleanType(), notes=StringType())
QUESTION = _row(id=(StringType(),), question=(StringType(),), language=StringType(), group=StringType(), gold_section_ids=TEXTS, acceptable_section_ids=TEXTS, reference_answer=StringType(), split=StringType(), source_id=StringType(), tax_year=IntegerType(), verified=StringType())
ASK = _row(id=(StringType(),), created_at=TimestampType(), question=(StringType(),), language=StringType(), tax_year=IntegerType(), refused=BooleanType(), refusal_reason=StringType(), answer=StringType(), citations=TEXTS, confidence=StringType(), timings_ms=MapType(StringType(), IntegerType()))
FEEDBACK = _row(id=LongType(), ask_id=(StringType(),), created_at=TimestampType(), rating=(StringType(),), comment=StringType())
CACHE = _row(key=(StringType(),), created_at=TimestampType(), question=StringType(), data=StringType(), hits=IntegerType())

#: Values that a column of a fixed set may take.
ALLOWED = {"kind": ("section", "schedule_clause", "schedule_part", "table"), "rating": ("up", "down"), "split": ("dev", "test"), "language": ("en", "ur", "roman_ur")}
