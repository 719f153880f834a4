"""Uploads: quantity gate (Q12), quantity check (Q13) and snapshot import
(W1 with P1, P4).

An upload is a frame with the spreadsheet's own headers (read with
``sources.sheets.read_upload``). All three operators are distributed: the gate
and the check are one global aggregate (partial sums per task, one row out);
the import is a projection and a union, written by the caller to a new
location (``sources.sinks.replace_table``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed
from ..functions import periods as P
from ..functions import scalars as S


def import_gate(upload: DataFrame, qty_header: str = fixed.FORECAST_QTY_HEADER,
                target=fixed.YEARLY_SHIPMENT_TARGET) -> DataFrame:
    """Q12: one row ``(total, res, msg)``: the file's quantity total (nulls as
    0), 1 when it reaches the yearly target, and the prompt shown before the
    import."""
    total = F.sum(F.coalesce(S.number_of(upload, qty_header), F.lit(0.0)))
    agg = upload.agg(total.alias("total"))
    ok = F.col("total") >= S.value(target).cast("double")
    return agg.select(
        F.coalesce(F.col("total"), F.lit(0.0)).alias("total"),
        F.when(ok, 1).otherwise(0).alias("res"),
        F.when(ok, fixed.GATE_MESSAGE_OK).otherwise(fixed.GATE_MESSAGE_SHORT).alias("msg"))


def quantity_check(view: DataFrame, qty_col: str = "order_qty",
                   target=fixed.YEARLY_SHIPMENT_TARGET) -> DataFrame:
    """Q13: ``chkfile`` = 'Check File' when the total quantity is under the
    target, else ''. An empty view sums to NULL, which is not under anything."""
    return view.agg(F.sum(S.number_of(view, qty_col)).alias("total")).select(
        S.below_target_message(F.col("total"), S.value(target).cast("double")).alias("chkfile"))


def map_upload(upload: DataFrame, mapping: Sequence[tuple[str, str]],
               fill: bool = True) -> DataFrame:
    """P1 (+P4): upload headers -> table fields; one header may feed several
    fields. Nulls become 0 / '0' first, as the spreadsheet import does."""
    src = S.fill_nulls(upload) if fill else upload
    return src.select(*[F.col(f"`{h}`").alias(f) for h, f in mapping])


def snapshot_import(current: DataFrame, upload: DataFrame,
                    mapping: Sequence[tuple[str, str]] = fixed.FORECAST_UPLOAD_FIELDS,
                    status_col: str = "status", date_fields: Sequence[str] = ("exfty_date",)
                    ) -> DataFrame:
    """The table after an import -- every existing row marked Inactive,
    every uploaded row appended as Active. Columns the upload does not carry
    are NULL; the result has the current table's schema."""
    old = current.withColumn(status_col, F.lit("Inactive"))
    return old.unionByName(imported_rows(current.schema, upload, mapping, status_col, date_fields))


def imported_rows(schema: T.StructType, upload: DataFrame, mapping: Sequence[tuple[str, str]],
                  status_col: str = "status", date_fields: Sequence[str] = ("exfty_date",)) -> DataFrame:
    """An upload's rows in the schema of the table they go to, Active."""
    new = map_upload(upload, mapping)
    cols = []
    for f in schema.fields:
        if f.name == status_col:
            cols.append(F.lit("Active").alias(f.name))
        elif f.name in new.columns:
            c = F.col(f.name)
            if f.name in date_fields:
                c = P.to_day(f.name, new.schema[f.name].dataType)
            elif isinstance(f.dataType, T.NumericType):
                c = S.number_of(new, f.name)      # "$10" is 10, text that is no number NULL
            cols.append(c.cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return new.select(*cols)


def unreadable_numbers(upload: DataFrame, mapping: Sequence[tuple[str, str]],
                       schema: T.StructType) -> DataFrame:
    """Cells of an upload that a number field cannot take, as ``(field, value,
    rows)``: what ``snapshot_import`` stores as NULL. All fields in one scan."""
    types = {f.name: f.dataType for f in schema.fields}
    new = map_upload(upload, mapping, fill=False)
    bad = [F.when(F.col(f).isNotNull() & S.number_of(new, f).isNull(),
                  F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")))
           for f in new.columns if isinstance(types.get(f), T.NumericType)]
    cells = new.select(F.explode(F.filter(F.array(*bad), lambda x: x.isNotNull())).alias("c"))
    return cells.groupBy("c.field", "c.value").agg(F.count(F.lit(1)).alias("rows"))


def as_upload(table: DataFrame, mapping: Sequence[tuple[str, str]]) -> DataFrame:
    """The upload a table's rows would come from (inverse of ``map_upload``):
    each header once, from the first field it feeds."""
    seen, cols = set(), []
    for h, f in mapping:
        if h not in seen and f in table.columns:
            seen.add(h)
            cols.append(F.col(f).alias(h))
    return table.select(*cols)
