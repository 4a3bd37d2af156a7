"""Scalars on binary columns: big-endian fields, sign-magnitude, hexadecimal floats, bit fields. All JVM-side.

Offsets count from 0. A field that does not lie wholly inside the bytes is null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_int(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, even where body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unsigned(data: Column, offset, n: int) -> Column:
    """Big-endian unsigned number of n <= 7 bytes."""
    at = as_int(offset)
    value = F.conv(F.hex(F.substring(data, at + 1, F.lit(n))), 16, 10).cast("long")
    return F.when((at >= 0) & (F.octet_length(data) >= at + n), value)


def underflow(data: Column, offset, n: int) -> Column:
    """Why a field of n bytes cannot be read, or null."""
    at = as_int(offset)
    return F.when(data.isNull(), "no bytes").when(at < 0, "before the start").when(F.octet_length(data) < at + n, "past the end")


def sign_magnitude(data: Column, offset, n: int) -> Column:
    """Big-endian number whose top bit is the sign and whose other bits are the magnitude."""
    return sign_magnitude_of(unsigned(data, offset, n), n)


def sign_magnitude_of(word: Column, n: int) -> Column:
    top = 1 << (8 * n - 1)
    return F.when(word >= top, top - word).otherwise(word)


def hex_float(data: Column, offset) -> Column:
    """32-bit float with base-16 exponent: (-1)^s * mantissa * 2^-24 * 16^(e - 64)."""
    return hex_float_of(unsigned(data, offset, 4))


def hex_float_of(word: Column) -> Column:
    mantissa = word.bitwiseAND(F.lit((1 << 24) - 1)).cast("double")
    exponent = F.shiftright(word, 24).bitwiseAND(F.lit(127)) - 64
    sign = F.when(F.shiftright(word, 31) > 0, -1.0).otherwise(1.0)
    return sign * mantissa * F.pow(F.lit(2.0), (4 * exponent - 24).cast("double"))


def bit_field(data: Column, index, n: int, offset=0) -> Column:
    """The index-th of consecutive n-bit fields (n <= 32), most significant bit first, from byte offset on."""
    start = as_int(index).cast("long") * n
    at = as_int(offset) + F.floor(start / 8)
    window = F.conv(F.rpad(F.hex(F.substring(data, (at + 1).cast("int"), F.lit(5))), 10, "0"), 16, 10).cast("long")
    value = F.call_function("shiftrightunsigned", window, (40 - n - start % 8).cast("int")).bitwiseAND(F.lit((1 << n) - 1))
    return F.when(F.octet_length(data) * 8 >= (as_int(offset) * 8 + start + n), value)


def octets(data: Column) -> Column:
    """The bytes as numbers from 0 to 255. They are read from the row once: in a lambda each use of a column copies all its bytes,
    so a text would take the square of its length."""
    each = F.transform(F.split(F.decode(data, "ISO-8859-1"), ""), lambda x: F.ascii(x).cast("long"))
    return F.when(F.octet_length(data) > 0, each).when(data.isNotNull(), F.array().cast("array<long>"))


def fields(data: Column, n: int) -> Column:
    """All whole big-endian unsigned n-byte fields (n <= 7) as an array."""
    held = F.floor(F.octet_length(data) / n).cast("int")

    def read(o: Column) -> Column:
        number = lambda k: reduce(lambda v, j: v * 256 + F.get(o, k * n + j), range(1, n), F.get(o, k * n))
        return F.transform(F.sequence(F.lit(0), held - 1), number)

    return F.when(held > 0, let(octets(data), read)).otherwise(F.array().cast("array<long>"))


#: The bits of each hexadecimal digit.
NIBBLES = f"array({', '.join(f'array({", ".join(f"{x}L" for x in f"{k:04b}")})' for k in range(16))})"


def all_bits(data: Column) -> Column:
    """The bytes' bits as an array of 0 and 1; an expression for each hexadecimal digit, not for each bit."""
    bits = F.flatten(F.transform(F.split(F.hex(data), ""), lambda x: F.get(F.expr(NIBBLES), F.instr(F.lit("123456789ABCDEF"), x))))
    return F.when(F.octet_length(data) > 0, bits).when(data.isNotNull(), F.array().cast("array<long>"))


def bit_fields(data: Column, n: int, count: Column | int | None = None, offset=0) -> Column:
    """All n-bit fields (n <= 32, or the first count) as an array; the tail that fills no field is left out."""
    held = F.floor((F.octet_length(data) - as_int(offset)) * 8 / n).cast("int")
    count = held if count is None else F.least(held, as_int(count).cast("int"))
    rest = data if isinstance(offset, int) and offset == 0 else F.substring(data, as_int(offset) + 1, F.octet_length(data))
    # Bytes that may hold a field; missing ones at the end count as zeros.
    wide = (n + 14) // 8

    def read(o: Column) -> Column:
        def field(i: Column) -> Column:
            start = i.cast("long") * n
            at, over = F.shiftright(start, 3).cast("int"), (8 * wide - n - start % 8).cast("int")
            window = reduce(lambda v, j: v * 256 + F.coalesce(F.get(o, at + j), F.lit(0)), range(1, wide), F.get(o, at))
            return F.call_function("shiftright", window, over).bitwiseAND(F.lit((1 << n) - 1))

        return F.transform(F.sequence(F.lit(0), count - 1), field)

    got = F.slice(all_bits(rest), 1, count) if n == 1 else let(octets(rest), read)
    return F.when(count > 0, got).otherwise(F.array().cast("array<long>"))


def format_bits(value: Column, n: int) -> Column:
    return F.lpad(F.bin(value), n, "0")


def unpacked(raw: Column, scale: Column, reference: Column) -> Column:
    """Binary scaling: 2^scale * raw + reference."""
    return F.pow(F.lit(2.0), scale.cast("double")) * raw + reference


def decimal_scaled(value: Column, scale10: Column) -> Column:
    return value * F.pow(F.lit(10.0), -scale10.cast("double"))


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def ones(bits: Column) -> Column:
    """How many of an array of 0 and 1 are 1."""
    return F.size(F.array_remove(bits, F.lit(0).cast("long"))).cast("long")


def set_bits(data: Column) -> Column:
    """How many bits of the bytes are set: hexadecimal digits of each weight are counted by what is left without them."""
    digits = F.hex(data)
    of = lambda some: F.length(digits) - F.length(F.translate(digits, some, ""))
    return (of("1248") + 2 * of("3569AC") + 3 * of("7BDE") + 4 * of("F")).cast("long")
