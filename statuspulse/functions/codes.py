"""Code lists as expressions: day names, status and outlet codes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from statuspulse import params


def day_name(dow: Column) -> Column:
    return F.element_at(F.array(*(F.lit(name) for name in params.DAY_NAMES)), dow)


def encode(value: Column, codes: Mapping[str, int]) -> Column:
    """Code of a value; NULL outside the list."""
    out = F.lit(None).cast("int")
    for text, code in codes.items():
        out = F.when(value == text, F.lit(code)).otherwise(out)
    return out


def decode(code: Column, codes: Mapping[str, int]) -> Column:
    out = F.lit(None).cast("string")
    for text, number in codes.items():
        out = F.when(code == number, F.lit(text)).otherwise(out)
    return out


def status_code(status: Column) -> Column:
    return encode(status, params.STATUS_CODES)


def status_label(code: Column) -> Column:
    return decode(code, params.STATUS_CODES)


def outlet_code(outlet: Column) -> Column:
    return encode(outlet, params.OUTLET_CODES)
