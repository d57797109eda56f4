"""Ordered binary keys: big-endian numbers, escaped text, length-prefixed index keys, canonical JSON.

Bytes compare like the values that they stand for, so a scan by key range needs no decoding.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WIDTHS = (2, 4, 8)


def _check(width: int) -> None:
    if width not in _WIDTHS:
        raise ValueError(f"no integer of {width} bytes")


def unsigned(value: Column, width: int = 8) -> Column:
    """A number of ``width`` bytes, high bytes first. Numbers beyond the width are an error."""
    _check(width)
    digits = F.lpad(F.hex(value.cast("long")), 16, "0")
    if width < 8:
        fits = (value >= 0) & (value < F.lit(1 << (8 * width)))
        digits = F.when(fits | value.isNull(), digits).otherwise(F.raise_error(F.lit("the number does not fit")).cast("string"))
    return F.unhex(F.right(digits, F.lit(2 * width)))


def signed(value: Column, width: int = 8) -> Column:
    """As ``unsigned``, with the sign bit flipped so that negative numbers come first."""
    _check(width)
    if width == 8:
        return unsigned(value.cast("long").bitwiseXOR(F.lit(-(1 << 63))), 8)
    return unsigned(value.cast("long") + F.lit(1 << (8 * width - 1)), width)


def read_unsigned(data: Column) -> Column:
    """The number that ``unsigned`` wrote."""
    return F.conv(F.hex(data), 16, -10).cast("long")


def read_signed(data: Column, width: int = 8) -> Column:
    """The number that ``signed`` wrote."""
    _check(width)
    if width == 8:
        return read_unsigned(data).bitwiseXOR(F.lit(-(1 << 63)))
    return read_unsigned(data) - F.lit(1 << (8 * width - 1))


def escaped(data: Column) -> Column:
    """Bytes that end where they end: 00 becomes 00 FF, and 00 00 closes. A part of a composite key."""
    digits = F.regexp_replace(F.hex(data.cast("binary")), r"\G((?:(?!00)..)*+)00", "$100FF")
    return F.unhex(F.concat(digits, F.lit("0000")))


def composite(*parts: Column) -> Column:
    """Encoded parts as one key."""
    return F.unhex(F.concat(*[F.hex(p) for p in parts]))


def descending(data: Column) -> Column:
    """A key part whose order is reversed: every bit flipped."""
    return F.unhex(F.translate(F.hex(data), "0123456789ABCDEF", "FEDCBA9876543210"))


def length_prefixed(lookup: Column, row_id: Column) -> Column:
    """An index key: the length of the lookup in four bytes, the lookup, the row's id."""
    return composite(unsigned(F.octet_length(lookup), 4), lookup.cast("binary"), row_id.cast("binary"))


def split_prefixed(key: Column) -> tuple[Column, Column]:
    """Lookup and row id of an index key."""
    n = read_unsigned(F.substring(key, 1, 4)).cast("int")
    return F.substr(key, F.lit(5), n), F.substr(key, n + 5)


def entry_key(partition: Column, offset: Column) -> Column:
    """A record's key in a table of several partitions."""
    return composite(unsigned(partition, 4), unsigned(offset, 8))


def canonical_json(**fields: Column) -> Column:
    """An object with its members in the order of their names, without nulls left out."""
    return F.to_json(F.struct(*[fields[name].alias(name) for name in sorted(fields)]), {"ignoreNullFields": "false"})
