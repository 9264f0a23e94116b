"""Mainframe field formats as column expressions over the bytes of one field."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Code page 037 is a permutation of Latin-1, so text decodes by one `translate`.
_LATIN1 = "".join(map(chr, range(256)))
_CP037 = bytes(range(256)).decode("cp037")


def _pairs(source: str, target: str) -> tuple[str, str]:
    changed = [(a, b) for a, b in zip(source, target) if a != b]
    return "".join(a for a, _ in changed), "".join(b for _, b in changed)


_TO_TEXT = _pairs(_LATIN1, _CP037)
_TO_BYTES = _pairs(_CP037, _LATIN1)


def decode_text(raw: Column) -> Column:
    """Bytes in code page 037 as text without its trailing blanks."""
    text = F.translate(F.decode(raw, "ISO-8859-1"), *_TO_TEXT)
    return F.rtrim(F.translate(text, "\x00", " "))


def encode_text(text: Column, length: int) -> Column:
    """Text as `length` bytes in code page 037, padded with blanks."""
    return F.encode(F.translate(F.rpad(text, length, " "), *_TO_BYTES), "ISO-8859-1")


def number_type(digits: int, scale: int) -> T.DataType:
    """The smallest column type that holds the picture."""
    if scale or digits > 18:
        return T.DecimalType(max(digits, scale), scale)
    return T.IntegerType() if digits <= 9 else T.LongType()


def _scaled(unscaled: Column, digits: int, scale: int) -> Column:
    text = unscaled.cast("string")
    if scale:
        text = F.concat(text, F.lit(f"E-{scale}"))
    return text.try_cast(number_type(digits, scale))


def decode_comp(raw: Column, length: int, digits: int, scale: int = 0, signed: bool = True) -> Column:
    """Big-endian binary of 2, 4 or 8 bytes."""
    if length == 8:
        number = F.conv(F.hex(raw), 16, -10 if signed else 10).cast("decimal(20,0)")
    else:
        number = F.conv(F.hex(raw), 16, 10).cast("bigint")
        if signed:
            limit = 1 << (8 * length - 1)
            number = F.when(number >= limit, number - 2 * limit).otherwise(number)
    return _scaled(number, digits, scale)


def decode_comp3(raw: Column, digits: int, scale: int = 0) -> Column:
    """Packed decimal: two digits a byte, the last half-byte is the sign (D is negative).

    A field that holds anything but digits and a C, D or F sign is null.
    """
    nibbles = F.hex(raw)
    sign = F.when(F.right(nibbles, F.lit(1)) == "D", "-").otherwise("")
    whole = F.left(nibbles, F.length(nibbles) - 1)
    return F.when(
        nibbles.rlike("^[0-9]+[CDF]$"), _scaled(F.concat(sign, whole), digits, scale)
    )


def decode_zoned(raw: Column, digits: int, scale: int = 0, signed: bool = True, sign: str = "trailing") -> Column:
    """One digit a byte.  A signed field carries its sign in the zone of the last byte, or of the first (`leading`), where D is negative,
    or as a character of its own at that end (`leading separate`, `trailing separate`)."""
    nibbles = F.hex(raw)
    if not signed:
        fits, minus = "^(F[0-9])+$", F.lit(False)
    elif sign == "trailing":
        fits, minus = "^(F[0-9])*[CDF][0-9]$", F.substring(nibbles, -2, 1) == "D"
    elif sign == "leading":
        fits, minus = "^[CDF][0-9](F[0-9])*$", F.substring(nibbles, 1, 1) == "D"
    elif sign == "leading separate":
        fits, minus = "^(4E|60)(F[0-9])+$", F.substring(nibbles, 1, 2) == "60"
    else:
        fits, minus = "^(F[0-9])+(4E|60)$", F.substring(nibbles, -2, 2) == "60"
    if sign.endswith("separate") and signed:
        own = F.substring(nibbles, 3, 2 * digits) if sign.startswith("leading") else F.substring(nibbles, 1, 2 * digits)
    else:
        own = nibbles
    whole = F.regexp_replace(own, "(.)(.)", "$2")
    return F.when(nibbles.rlike(fits), _scaled(F.concat(F.when(minus, "-").otherwise(""), whole), digits, scale))


def decode_float(raw: Column, length: int) -> Column:
    """Hexadecimal floating point of 4 or 8 bytes: a sign bit, a power of 16 in excess 64, and a fraction."""
    nibbles = F.hex(raw)
    head = F.conv(F.substring(nibbles, 1, 2), 16, 10).cast("int")
    fraction = F.conv(F.substring(nibbles, 3, 2 * length - 2), 16, 10).cast("bigint").cast("double")
    power = F.pow(F.lit(16.0), (head % 128) - 64 - (2 * length - 2))
    number = F.when(head >= 128, -fraction).otherwise(fraction) * power
    return F.when(F.length(nibbles) == 2 * length, number.cast("float" if length == 4 else "double"))


def _digits(unscaled: Column, digits: int) -> Column:
    return F.lpad(F.abs(unscaled).cast("string"), digits, "0")


def encode_comp(unscaled: Column, length: int) -> Column:
    return F.unhex(F.right(F.lpad(F.hex(unscaled.cast("bigint")), 16, "0"), F.lit(2 * length)))


def encode_comp3(unscaled: Column, digits: int) -> Column:
    width = 2 * (digits // 2 + 1) - 1
    return F.unhex(F.concat(_digits(unscaled, width), F.when(unscaled < 0, "D").otherwise("C")))


def encode_zoned(unscaled: Column, digits: int, signed: bool = True) -> Column:
    text = _digits(unscaled, digits)
    head = F.regexp_replace(F.left(text, F.lit(digits - 1)), "(.)", "F$1")
    zone = F.when(unscaled < 0, "D").otherwise("C") if signed else F.lit("F")
    return F.unhex(F.concat(head, zone, F.right(text, F.lit(1))))


# The overpunched last digit of a signed number in a text (ASCII) file, 0-9.
OVERPUNCH_PLUS = "{ABCDEFGHI"
OVERPUNCH_MINUS = "}JKLMNOPQR"


def decode_display_text(text: Column, digits: int, scale: int = 0, sign: str = "trailing") -> Column:
    """Digits in a text file, with an optional sign: a character of its own at either end, or an overpunched digit, the last one or,
    if the sign is `leading`, the first."""
    trimmed = F.trim(text)
    first = sign.startswith("leading")
    punched = F.left(trimmed, F.lit(1)) if first else F.right(trimmed, F.lit(1))
    plain = F.translate(F.rtrim(trimmed, F.lit("+-")), OVERPUNCH_PLUS + OVERPUNCH_MINUS, "0123456789" * 2)
    minus = (F.instr(F.lit(OVERPUNCH_MINUS), punched) > 0) | F.endswith(trimmed, F.lit("-"))
    signed = F.when(minus, F.concat(F.lit("-"), plain)).otherwise(plain)
    fits = r"^([+-]?[0-9]+|[0-9{}A-R][0-9]*|[0-9]+[+-])$" if first else r"^([+-]?[0-9]*[0-9{}A-R]|[0-9]+[+-])$"
    return F.when(trimmed.rlike(fits), _scaled(signed, digits, scale))
