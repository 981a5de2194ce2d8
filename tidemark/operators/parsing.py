"""Rows that fail to parse: a permissive reader for delimited records that keeps every record and says what is wrong.

Every record is first read permissively under an explicit schema of typed columns, which keeps the raw text of what does not fit as corrupt. A
record that was read counts if its text also has the strict form of the schema (the reader casts more freely and forgives quotes). All
others are reclassified: first their quoting is checked, then the number of fields, then each value against its form and cast.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stand-ins while a record is taken apart; where they occur in a record they are escaped.
_MARK, _ESCAPE = "\x01", "\x02"
#: Fields that the reader has room for. A record with more delimiters is not given to it but taken apart as corrupt ones are: the result is the same.
READ_FIELDS = 20_000


@dataclass(frozen=True)
class Field:
    """A column of the record: the form of its whole trimmed value (a regular expression; None: free), its type, and
    whether an empty value stands for null. Values of type timestamp_ntz must also exist in the calendar."""

    name: str
    form: str | None = None
    kind: str = "string"
    nullable: bool = False

    @property
    def strict(self) -> str:
        """The form of the value as it stands in a record without quotes, line breaks and spaces around it."""
        if self.form is None:
            return r'[^,"\r\n\x00]*'
        return f"(?:{self.form})?" if self.nullable else f"(?:{self.form})"

    def valid(self, value: Column) -> Column:
        if self.form is None:
            return F.lit(True)
        ok = value.rlike(rf"\A(?:{self.form})\z")
        if self.kind == "timestamp_ntz":
            ok = ok & value.try_cast(self.kind).isNotNull()
        return (value == "") | ok if self.nullable else ok


_ID = "[0-9a-f]{16}"
_DAY = r"(?!0000)[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}"
_AMOUNT = r"[0-9]+(?:\.[0-9]{1,2})?"
#: The order-item export.
ORDER_ITEM = (
    Field("order_id", _ID),
    Field("order_item_id", "[0-9]+", "bigint"),
    Field("product_id", _ID),
    Field("seller_id", _ID),
    Field("shipping_limit_date", _DAY, "timestamp_ntz"),
    Field("price", _AMOUNT, "double", nullable=True),
    Field("freight_value", _AMOUNT, "double", nullable=True),
    Field("item_note"),
)


def _settled(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once per row: a generator, which the optimizer does not copy into what reads the column."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _taken_apart(df: DataFrame, raw: Column) -> DataFrame:
    """df with ``_whole``, whether the quoting of a record holds, and ``_fields``, its fields without the quotes (null if it does not); both null where raw is null.

    Split at the quotes, a sound record alternates between text outside and inside of quotes. Text between two quoted
    stretches is either nothing (a doubled quote) or runs from a delimiter to a delimiter; the first and the last such
    text may be empty or must touch the quote with a delimiter.
    """
    safe = F.replace(F.replace(raw, F.lit(_ESCAPE), F.lit(_ESCAPE + "b")), F.lit(_MARK), F.lit(_ESCAPE + "a"))
    df = _settled(df, "_parts", F.split(safe, '"'))
    df = _settled(df, "_last", F.size("_parts") - 1)  # columns of their own, as the functions below read them for every part
    parts, last = F.col("_parts"), F.col("_last")

    def sound(x: Column, i: Column) -> Column:
        starts = (i == 0) | (x == "") | x.startswith(",")
        ends = (i == last) | (x == "") | x.endswith(",")
        return (i % 2 == 1) | (starts & ends)

    df = _settled(df, "_whole", (last % 2 == 0) & F.forall(F.transform(parts, sound), lambda x: x))
    # an empty text between two quoted stretches is a doubled quote and leaves one; other quotes go
    marked = F.transform(parts, lambda x, i: F.when(i % 2 == 1, x).when((x == "") & (i > 0) & (i < last), F.lit('"')).otherwise(F.replace(x, F.lit(","), F.lit(_MARK))))
    fields = F.split(F.array_join(marked, ""), _MARK)
    back = F.transform(fields, lambda x: F.replace(F.replace(x, F.lit(_ESCAPE + "a"), F.lit(_MARK)), F.lit(_ESCAPE + "b"), F.lit(_ESCAPE)))
    return _settled(df, "_fields", F.when(F.col("_whole"), back)).drop("_parts", "_last")


def parse_records(df: DataFrame, raw: str, fields: Sequence[Field] = ORDER_ITEM) -> DataFrame:
    """All columns of df and ``_reason`` (null: the record is sound), ``_row`` (its typed values; null if it is not) and ``_corrupt`` (its raw text; null if it is).

    Reasons, the first that applies: ``quoting`` (a quote that does not enclose a whole field, or is never closed),
    ``column_count`` (not as many fields as the schema), ``invalid_value`` (after removing spaces around it, a value has
    not the form of its column). Values lose the spaces around them, free text does not; an empty value of a nullable column is null; digits beyond
    the range of their type give null. A null record has no fields: column_count; an empty one has one. Repeated records are
    records. Texts of any length are read whole. The work is per row: no shuffle.
    """
    schema = ", ".join([*(f"`{f.name}` {f.kind}" for f in fields), "_corrupt string"])
    options = {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "quote": '"', "escape": '"', "nullValue": "", "emptyValue": "", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss",
        "maxCharsPerColumn": "-1", "maxColumns": str(READ_FIELDS + 1),
    }
    readable = F.length(F.translate(F.col(raw), '"', "")) - F.length(F.translate(F.col(raw), '",', "")) < READ_FIELDS
    read = _settled(df, "_read", F.when(readable, F.from_csv(F.col(raw), schema, options)))
    strict = F.col(raw).rlike(r"\A" + ",".join(f.strict for f in fields) + r"\z")
    taken = F.col("_read").isNotNull() & F.col("_read._corrupt").isNull() & strict
    read = _settled(read, "_taken", F.coalesce(taken, F.lit(False)))
    read = _taken_apart(read, F.when(~F.col("_taken"), F.col(raw)))
    fits = F.size("_fields") == len(fields)
    good, own, typed = F.lit(True), [], []
    for i, field in enumerate(fields):
        value = F.get("_fields", F.lit(i))
        if field.form is not None:
            value = F.trim(value)
        good = good & field.valid(value)
        own.append((value if field.kind == "string" else value.try_cast(field.kind)).alias(field.name))
        kept = F.col(f"_read.{field.name}")
        typed.append((F.coalesce(kept, F.lit("")) if field.kind == "string" else kept).alias(field.name))
    reason = F.when(F.col("_taken"), F.lit(None)).when(~F.col("_whole"), "quoting").when(~F.coalesce(fits, F.lit(False)), "column_count").when(~F.coalesce(good, F.lit(False)), "invalid_value")
    found = _settled(read, "_reason", reason)
    row = F.when(F.col("_taken"), F.struct(*typed)).when(F.col("_reason").isNull(), F.struct(*own))
    return found.withColumns({"_row": row, "_corrupt": F.when(F.col("_reason").isNotNull(), F.col(raw))}).drop("_read", "_taken", "_whole", "_fields")


def typed_rows(parsed: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The sound records of parse_records() as typed columns after the columns ``keep``."""
    return parsed.where(F.col("_reason").isNull()).select(*keep, "_row.*")


def rejected(parsed: DataFrame, keep: Sequence[str], raw: str | None = None) -> DataFrame:
    """The columns ``keep`` and the reason of each record that is set aside, and with ``raw`` its text under that name."""
    found = parsed.where(F.col("_reason").isNotNull())
    return found.select(*keep, F.col("_reason").alias("reason"), *([F.col("_corrupt").alias(raw)] if raw else []))
