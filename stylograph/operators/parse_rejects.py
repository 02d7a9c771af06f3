"""Raw CSV records: valid rows on one side, records that fail on the other, with the reason (problem 2).

The records of an Arrow batch go through pyarrow's CSV reader as one buffer. Its callback for invalid rows takes those with a
wrong number of columns; all fields are read as strings, and then checked column by column. The reader is lenient with quotes,
so quoting is judged before, by one linear regular expression over the whole column.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MISSING = ("", "NA")
WELL_QUOTED = r'(?s)^(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*$'
#: Bytes of records that are parsed together.
PART = 16 << 20
DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"


@dataclass(frozen=True)
class Field:
    """A column of the record: kind is "string", "date" or "int"; a present value has to match ``pattern`` and not ``forbidden``."""

    name: str
    kind: str = "string"
    required: bool = False
    pattern: str | None = None
    forbidden: str | None = None


#: The columns of a delivery of ``subset``.
SUBSET_FIELDS = (
    Field("doc_id", required=True, pattern=r"^ECLI:CZ:US:[0-9]{4}:(?:Pl|[0-9])\.US\.[0-9]+\.[0-9]{2}\.[0-9]+$"),
    Field("text", required=True, forbidden=r"[\x{FFFD}\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]"),
    Field("date_decision", "date"),
    Field("date_submission", "date"),
    Field("type_decision"),
    Field("importance", "int"),
    Field("judge_rapporteur_name"),
    Field("judge_rapporteur_id"),
    Field("type_verdict"),
    Field("grounds"),
    Field("separate_opinion"),
    Field("formation"),
    Field("outcome"),
    Field("length_proceeding", "int"),
)


def _calendar(values: pa.Array) -> np.ndarray:
    """Whether each present text is a date of the calendar written YYYY-MM-DD."""
    ok = pc.fill_null(pc.match_substring_regex(values, DATE), False).to_numpy(zero_copy_only=False)
    good = pc.if_else(pa.array(ok), values, "0001-01-01")
    part = [pc.cast(pc.utf8_slice_codeunits(good, a, b), pa.int32()).to_numpy() for a, b in ((0, 4), (5, 7), (8, 10))]
    year, month, day = part
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    days = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])
    limit = days[np.clip(month, 0, 12)] + ((month == 2) & leap)
    return ok & (year >= 1) & (month >= 1) & (month <= 12) & (day >= 1) & (day <= limit)


def _faulty(field: Field, values: pa.Array) -> np.ndarray:
    absent = pc.is_in(values, pa.array(MISSING)).to_numpy(zero_copy_only=False)
    bad = np.zeros(len(values), bool)
    if field.kind == "date":
        bad |= ~_calendar(values)
    elif field.kind == "int":
        bad |= ~pc.match_substring_regex(values, "^[0-9]+$").to_numpy(zero_copy_only=False)
    if field.pattern:
        bad |= ~pc.match_substring_regex(values, field.pattern).to_numpy(zero_copy_only=False)
    if field.forbidden:
        bad |= pc.match_substring_regex(values, field.forbidden).to_numpy(zero_copy_only=False)
    return np.where(absent, field.required, bad)


def _placeholders(lines: pa.Array) -> tuple[str, str]:
    """Two characters that no line has; they stand for line breaks while the reader runs. No batch has all: a part is of PART bytes."""
    found: list[str] = []
    for code in range(0xE000, 0xE010):  # private ones, which hardly any text has
        if not pc.any(pc.match_substring(lines, chr(code))).as_py():
            found.append(chr(code))
    if len(found) < 2:
        used = set().union(*lines.to_pylist())
        found = [c for c in map(chr, range(0x10FFFF, 0x9F, -1)) if not "\ud800" <= c <= "\udfff" and c not in used][:2]
    if len(found) < 2:
        raise _NoneLeft
    return found[0], found[1]


class _NoneLeft(Exception):
    """The lines have all characters together."""


def _parse(lines: pa.Array, fields: Sequence[Field]) -> tuple[np.ndarray, list[pa.Array]]:
    """For each line a reason ('' for none), and the columns as strings, null where there is no structure."""
    n, width = len(lines), len(fields)
    reason = np.full(n, "", object)
    quoted = pc.match_substring_regex(lines, WELL_QUOTED).to_numpy(zero_copy_only=False)
    reason[~quoted] = "quoting"
    at = np.flatnonzero(quoted)
    columns: list[pa.Array] = [pa.nulls(n, pa.string())] * width
    if len(at):
        try:
            nl, cr = _placeholders(lines)
        except _NoneLeft:
            if n == 1:  # one record of a million different characters, control characters among them, so no valid row anyhow
                reason[0] = "value"
                return reason, columns
            halves = [_parse(lines.slice(a, b - a), fields) for a, b in ((0, n // 2), (n // 2, n))]
            return np.concatenate([r for r, _ in halves]), [pa.concat_arrays([x, y]) for x, y in zip(halves[0][1], halves[1][1], strict=True)]
        flat = pc.replace_substring(pc.replace_substring(lines.take(pa.array(at)), "\n", nl), "\r", cr)
        keyed = pc.binary_join_element_wise(pc.cast(pa.array(at), pa.string()), flat, ",")
        data = ("\n".join(keyed.to_pylist()) + "\n").encode()

        def refuse(row: csv.InvalidRow) -> str:
            reason[int(row.text.partition(",")[0])] = "columns"
            return "skip"

        names = ["__at", *[f.name for f in fields]]
        table = csv.read_csv(
            pa.BufferReader(data),
            read_options=csv.ReadOptions(column_names=names, use_threads=False, block_size=len(data) + 1),
            parse_options=csv.ParseOptions(invalid_row_handler=refuse),
            convert_options=csv.ConvertOptions(column_types={c: pa.string() for c in names}, strings_can_be_null=False),
        )
        kept = np.array([int(x) for x in table["__at"].to_pylist()], dtype=np.int64)
        place = np.full(n, -1)
        place[kept] = np.arange(len(kept))
        take = pa.array(place, mask=place < 0)
        columns = []
        for f in fields:
            c = table[f.name].combine_chunks() if table.num_rows else pa.array([], pa.string())
            c = pc.replace_substring(pc.replace_substring(c, nl, "\n"), cr, "\r")
            columns.append(c.take(take))
    return reason, columns


def parse_records(df: DataFrame, fields: Sequence[Field] = SUBSET_FIELDS, raw_id: str = "raw_id", line: str = "line") -> DataFrame:
    """raw_id, reason, faults (names of the failing cells) and the fields as strings, missing values null.

    The reason is null for a valid row, else the first that holds of quoting, columns and value. A null line is an empty record, so it
    fails for its columns. Other columns of ``df`` are not read. A table without rows gives none; repeated records stay repeated.
    """
    fields = tuple(fields)
    schema = f"`{raw_id}` bigint, reason string, faults array<string>, " + ", ".join(f"`{f.name}` string" for f in fields)
    out_names = [raw_id, "reason", "faults", *[f.name for f in fields]]

    def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """The batch in parts of about PART bytes; a longer record is a part of its own."""
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, base + PART, side="right")))
            yield batch.slice(start, end - start)
            start = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in parts(b)):
            lines = pc.fill_null(batch.column(1).cast(pa.string()), "")
            reason, columns = _parse(lines, fields)
            whole = reason == ""
            bad = np.stack([_faulty(f, pc.fill_null(c, "")) for f, c in zip(fields, columns, strict=True)]) & whole
            reason[bad.any(0)] = "value"
            names = np.array([f.name for f in fields], object)
            faults = pa.array([list(names[b]) for b in bad.T], pa.list_(pa.string()))
            absent = [pc.is_in(c, pa.array(MISSING)) for c in columns]
            clean = [pc.if_else(a, pa.scalar(None, pa.string()), c) for a, c in zip(absent, columns, strict=True)]
            reasons = pa.array([r or None for r in reason], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), reasons, faults, *clean], names=out_names)

    return df.select(F.col(raw_id).cast("bigint").alias(raw_id), F.col(line).cast("string").alias(line)).mapInArrow(run, schema)


def rejects(parsed: DataFrame, raw_id: str = "raw_id") -> DataFrame:
    """raw_id and reason of the records that give no valid row."""
    return parsed.where(F.col("reason").isNotNull()).select(raw_id, "reason")


def failing_cells(parsed: DataFrame, fields: Sequence[Field] = SUBSET_FIELDS, raw_id: str = "raw_id") -> DataFrame:
    """raw_id, column, value for each failing cell; the value is null where it is missing though required."""
    values = F.create_map(*[x for f in fields for x in (F.lit(f.name), F.col(f.name))])
    return parsed.where(F.col("reason") == "value").select(raw_id, F.explode("faults").alias("column"), values.alias("m")).select(raw_id, "column", F.try_element_at("m", F.col("column")).alias("value"))


def valid_rows(parsed: DataFrame, fields: Sequence[Field] = SUBSET_FIELDS, raw_id: str = "raw_id") -> DataFrame:
    """The valid rows with their types; a number of digits only that is beyond the type's range comes out as null, and as a row of
    ``out_of_range``."""
    kinds = {"string": "string", "date": "date", "int": "int"}
    casts = [F.expr(f"try_cast(`{f.name}` AS {kinds[f.kind]})").alias(f.name) for f in fields]
    return parsed.where(F.col("reason").isNull()).select(raw_id, *casts)


def out_of_range(parsed: DataFrame, fields: Sequence[Field] = SUBSET_FIELDS, raw_id: str = "raw_id") -> DataFrame:
    """raw_id, column, value of the cells of valid rows that are well written but beyond what the column's type holds."""
    numbers = [f.name for f in fields if f.kind == "int"]
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in numbers]))
    held = parsed.where(F.col("reason").isNull()).select(raw_id, cells.alias("x")).select(raw_id, "x.column", "x.value")
    return held.where(F.col("value").isNotNull() & F.expr("try_cast(value AS int)").isNull())
