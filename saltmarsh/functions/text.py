"""Text functions: invisible characters, entropy, checksums, offsets. Plain and as columns."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default_Ignorable_Code_Point and Cf of Unicode 17, as ranges.
INVISIBLE = (
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x0600, 0x0605), (0x061C, 0x061C), (0x06DD, 0x06DD), (0x070F, 0x070F), (0x0890, 0x0891), (0x08E2, 0x08E2), (0x115F, 0x1160),
    (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0),
    (0xFFF0, 0xFFFB), (0x110BD, 0x110BD), (0x110CD, 0x110CD), (0x13430, 0x1343F), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)

INVISIBLE_RUN = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in INVISIBLE) + "]+")
JAVA_INVISIBLE = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in INVISIBLE) + "]+"
IDENTIFIER = r"^[a-z][a-z0-9]*([._-][a-z0-9]+)*$"


def normalize(text: Column) -> Column:
    """``text`` without invisible characters; all-ASCII texts pass as they are."""
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(F.regexp_replace(text, JAVA_INVISIBLE, ""))


def is_identifier(value: Column) -> Column:
    return value.rlike(IDENTIFIER) & (F.octet_length(value) <= 64)


def entropy(value: str) -> float:
    """Shannon entropy in bits per character, summed in the order in which characters first appear."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def entropy_column(value: Column) -> Column:
    """The same in SQL functions; equal to it but for rounding."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    n = F.size(chars).cast("double")
    shares = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return F.when(n > 0, F.aggregate(shares, F.lit(0.0), lambda s, p: s - p * F.log2(p))).otherwise(0.0)


def byte_start(text: Column, fragment: Column) -> Column:
    """Where ``fragment`` first stands in ``text``, in UTF-8 bytes from 0; null if nowhere."""
    at = F.instr(text, fragment)
    return F.when(at > 0, F.octet_length(F.substring(text, F.lit(1), at - 1)))


def code_points(text: Column, offset: Column) -> Column:
    """A byte offset as a number of code points."""
    return F.length(F.decode(F.substring(F.encode(text, "UTF-8"), F.lit(1), offset), "UTF-8"))


def luhn(digits: str) -> bool:
    if not re.fullmatch(r"[0-9]+", digits):
        return False
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_mod97(value: str) -> bool:
    turned = value[4:] + value[:4]
    return re.fullmatch(r"[A-Z0-9]{5,}", turned) is not None and int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def us_ssn(digits: str) -> bool:
    """Allocation rules of nine digits: area, group and serial."""
    if not re.fullmatch(r"[0-9]{9}", digits):
        return False
    area, group, serial = int(digits[:3]), int(digits[3:5]), int(digits[5:])
    return area not in (0, 666) and area < 900 and group > 0 and serial > 0


def iban_column(value: Column) -> Column:
    """Mod-97 of an IBAN without blanks, in SQL functions: digits are folded in one by one."""
    turned = F.concat(F.substring(value, 5, 40), F.substring(value, 1, 4))
    chars = F.filter(F.split(turned, ""), lambda c: c != "")
    number = lambda c: F.conv(c, 36, 10).cast("int")
    left = F.aggregate(chars, F.lit(0), lambda a, c: F.when(number(c) > 9, (a * 100 + number(c)) % 97).otherwise((a * 10 + number(c)) % 97))
    return value.rlike("^[A-Z0-9]{5,40}$") & (left == 1)


def ssn_column(digits: Column) -> Column:
    part = lambda a, n: F.substring(digits, a, n)
    return digits.rlike("^[0-9]{9}$") & ~part(1, 3).isin("000", "666") & (part(1, 1) != "9") & (part(4, 2) != "00") & (part(6, 4) != "0000")
