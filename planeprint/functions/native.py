"""The same as Spark expressions, and formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def extension(path: Column) -> Column:
    """Lower-case suffix after the last dot of the name; none for names whose only dot leads."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def basename(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(name == "", F.lit("<unnamed>")).otherwise(name)


def median_word(block: Column) -> Column:
    """The word of 64 coefficients: the first is set to 0, bit t is whether coefficient t is above the median."""
    c = F.transform(block, lambda x, i: F.when(i == 0, F.lit(0.0)).otherwise(x.cast("double")))

    def word(x: Column) -> Column:
        mid = (F.element_at(x["s"], 32) + F.element_at(x["s"], 33)) / 2
        bits = F.zip_with(x["c"], F.sequence(F.lit(0), F.lit(63)), lambda v, t: F.when(v > mid, F.call_function("shiftleft", F.lit(1).cast("long"), t)).otherwise(F.lit(0).cast("long")))
        return F.aggregate(bits, F.lit(0).cast("long"), lambda a, v: a.bitwiseOR(v))

    # an array of one, so that the sorted array is made once and not for each coefficient
    once = F.array(F.struct(c.alias("c"), F.array_sort(c).alias("s")))
    return F.when(F.size(block) == 64, F.get(F.transform(once, word), F.lit(0)))


def hash_hex(w0: Column, w1: Column, bits: int, kind: str = "lossless") -> Column:
    """Lower-case hex. 'lossless': all digits of the live words; 'reference': shifted right by what the word has
    beyond the bits, which loses low bits unless there are 64."""
    word = lambda w, n: F.lower(F.lpad(F.hex(w), n, "0"))
    if kind == "reference":
        digits = -(-bits // 4)
        if bits <= 64:
            return F.lower(F.lpad(F.hex(F.shiftrightunsigned(w0, 64 - bits)), digits, "0"))
        return F.concat(word(w0, 16), F.lower(F.lpad(F.hex(F.shiftrightunsigned(w1, 128 - bits)), digits - 16, "0")))
    return word(w0, 16) if bits <= 64 else F.concat(word(w1, 16), word(w0, 16))


def hamming(a0: Column, b0: Column, a1: Column | None = None, b1: Column | None = None) -> Column:
    d = F.bit_count(a0.bitwiseXOR(b0))
    return d if a1 is None else d + F.bit_count(a1.bitwiseXOR(b1))


def bit(w0: Column, w1: Column, position: int) -> Column:
    return F.shiftrightunsigned(w0 if position < 64 else w1, position % 64).bitwiseAND(F.lit(1).cast("long"))


def lsh_key(w0: Column, w1: Column, positions: list[int]) -> Column:
    if len(positions) > 64:
        raise ValueError("a key has 64 bits")
    key = F.lit(0).cast("long")
    for b, p in enumerate(positions):
        key = key.bitwiseOR(F.shiftleft(bit(w0, w1, p), b))
    return key


def size_text(n: Column) -> Column:
    """Bytes with two decimals and a unit, base 1024."""
    out = F.format_string("%.2f TB", F.bround(n / 1024.0**4, 2))
    for k, unit in ((3, "GB"), (2, "MB"), (1, "KB"), (0, "B")):
        out = F.when(n < 1024.0 ** (k + 1), F.format_string(f"%.2f {unit}", F.bround(n / 1024.0**k, 2))).otherwise(out)
    return out


def size_label(n: int) -> str:
    x = float(n)
    for unit in ("B", "KB", "MB", "GB"):
        if x < 1024:
            return f"{x:.2f} {unit}"
        x /= 1024
    return f"{x:.2f} TB"


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, 100.0 * part / whole).otherwise(F.lit(0.0))
