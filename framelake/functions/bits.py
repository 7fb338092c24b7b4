"""Bytes and integers: order of bytes, hexadecimal text, forgiving number parsing. All of it native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def byteswapped(value: Column) -> Column:
    """A 64-bit integer with its bytes in opposite order."""
    def halves(v: Column, mask: int, by: int) -> Column:
        return F.shiftrightunsigned(v, by).bitwiseAND(F.lit(mask)).bitwiseOR(F.shiftleft(v.bitwiseAND(F.lit(mask)), by))

    value = F.shiftrightunsigned(value, 32).bitwiseOR(F.shiftleft(value, 32))
    return halves(halves(value, 0x0000FFFF0000FFFF, 16), 0x00FF00FF00FF00FF, 8)


def little(value: Column, count: int = 8) -> Column:
    """The lowest `count` bytes of a 64-bit integer, lowest first."""
    return F.unhex(F.substring(F.lpad(F.hex(byteswapped(value)), 16, "0"), 1, 2 * count))


def big_word(data: Column) -> Column:
    """Up to eight bytes as an integer, first byte highest."""
    return F.conv(F.hex(data), 16, -10).cast("long")


def little_word(data: Column) -> Column:
    """Up to eight bytes as an integer, first byte lowest."""
    return byteswapped(F.conv(F.rpad(F.hex(data), 16, "0"), 16, -10).cast("long"))


def payload_text(data: Column) -> Column:
    """Bytes as lower-case hexadecimal pairs with spaces between."""
    return F.lower(F.trim(F.regexp_replace(F.hex(data), "(..)", "$1 ")))


def hex_bytes(text: Column) -> Column:
    """Bytes from text such as `00 11`, `0011`, `0x00 0x11` or `0,1f`; null where it isn't that, empty for blank text.

    With several parts (or a 0x first) each part is one byte of any number of digits; a value above 255 spoils the row.
    One part alone is a run of pairs, or a single byte if its digits are odd in number."""
    clean = F.trim(F.regexp_replace(text, r"[,\s]+", " "))
    run = F.regexp_like(clean, F.lit("^(?:[0-9a-fA-F]{2})+$"))
    allowed = F.regexp_like(clean, F.lit("^(?:0[xX][0-9a-fA-F]+(?: (?:0[xX])?[0-9a-fA-F]+)*|[0-9a-fA-F]+(?: [0-9a-fA-F]+)*)$"))
    short = F.regexp_replace(F.concat(F.lit(" "), clean), " (?:0[xX])?0*([0-9a-fA-F])", " $1")
    single = F.regexp_like(short, F.lit("^(?: [0-9a-fA-F]{1,2})+$"))
    padded = F.regexp_replace(short, " ([0-9a-fA-F])(?= |$)", " 0$1")
    return F.when(clean == "", F.unhex(F.lit(""))).when(run, F.unhex(clean)).when(allowed & single, F.unhex(F.replace(padded, F.lit(" "))))


def integer(text: Column) -> Column:
    """0x1F and digit runs that hold a letter (up to eight signs) as hexadecimal, else decimal; null where neither."""
    clean = F.trim(text)
    hexadecimal = F.regexp_like(clean, F.lit("^0[xX][0-9a-fA-F]{1,15}$"))
    bare = F.regexp_like(clean, F.lit("^(?=.*[a-fA-F])[0-9a-fA-F]{1,8}$"))
    number = F.when(hexadecimal, F.conv(F.substring(clean, 3, 32), 16, 10)).when(bare, F.conv(clean, 16, 10)).when(F.regexp_like(clean, F.lit("^[+-]?[0-9]{1,18}$")), clean)
    return number.cast("long")


def fd_length(code: Column) -> Column:
    """Payload bytes of a length code of flexible-rate frames."""
    # Lengths by code.
    sizes = F.array(*map(F.lit, (0, 1, 2, 3, 4, 5, 6, 7, 8, 12, 16, 20, 24, 32, 48, 64)))
    return F.try_element_at(sizes, code.cast("int") + 1)


def frame_bits(dlc: Column, is_extended: Column) -> Column:
    """Approximate bits of a frame on the wire, stuffing included."""
    return (F.when(is_extended, 65).otherwise(47) + 8 * dlc) * F.lit(1.2)
