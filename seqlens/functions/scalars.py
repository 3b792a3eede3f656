"""Column-level helpers. All return native Spark expressions (codegen, no UDF)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqlens.functions.constants import ADDRESS_HEX_DIGITS, HEX_ALPHABET, SCORE_HEX_DIGITS


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def decode_hex_score(col: Column | str, mode: str = "reference",
                     first: int = 7, digits: int = 12) -> Column:
    """Decode a ``0x`` + 16-hex-digit u64 score string.

    ``mode``:

    * ``"reference"`` — positional decode of the characters ``first`` ..
      ``first + digits - 1`` (1-based): each character contributes
      ``(position in the lowercase hex alphabet - 1) * 16^k``. This is the
      definition the reports use, including its behaviour on malformed input
      (upper case and unknown characters count -1, missing characters 0, the
      top 16 bits are ignored).
    * ``"strict"`` — canonical strings only (``^0x[0-9a-f]{16}$``), decoded
      over the same digit window; anything else is NULL.
    * ``"full"`` — all 16 digits as ``DECIMAL(20,0)`` (canonical input only).
    """
    s = _c(col)
    canonical_pattern = f"^0x[0-9a-f]{{{SCORE_HEX_DIGITS}}}$"
    if mode == "reference":
        last = first + digits - 1
        total = None
        for pos in range(first, last + 1):
            digit = F.instr(F.lit(HEX_ALPHABET), F.substring(s, pos, 1)).cast("bigint") - F.lit(1)
            term = digit * F.lit(16 ** (last - pos))
            total = term if total is None else total + term
        if first < 3 or last > SCORE_HEX_DIGITS + 2:
            return total
        # On canonical text the positional sum equals conv() of the digit
        # window, which is much cheaper; only other text takes the sum.
        return F.when(s.rlike(canonical_pattern),
                      F.conv(F.substring(s, first, digits), 16, 10).cast("bigint")).otherwise(total)
    canonical = s.rlike(canonical_pattern)
    if mode == "strict":
        window = F.substring(s, first, digits)
        return F.when(canonical, F.conv(window, 16, 10).cast("bigint"))
    if mode == "full":
        return F.when(canonical, F.conv(F.substring(s, 3, SCORE_HEX_DIGITS), 16, 10)
                      .cast("decimal(20,0)"))
    raise ValueError(f"unknown decode mode {mode!r}")


def encode_hex_score(col: Column | str) -> Column:
    """Inverse of the decode for non-negative integers: ``0x`` + 16 lowercase digits."""
    return F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(_c(col).cast("bigint"))), SCORE_HEX_DIGITS, "0"))


def encode_address(col: Column | str) -> Column:
    """Integer id -> canonical address text ``0x`` + 64 lowercase digits."""
    return F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(_c(col).cast("bigint"))), ADDRESS_HEX_DIGITS, "0"))


def short_hex(col: Column | str) -> Column:
    """Integer -> ``0x`` + lowercase hex without zero padding (``0x0`` for zero)."""
    return F.concat(F.lit("0x"), F.lower(F.hex(_c(col).cast("bigint"))))


def normalise_address(col: Column | str) -> Column:
    """Canonical form of a hex address: case, ``0x`` prefix and zero padding ignored.

    Two spellings normalise to the same string exactly when they denote the
    same integer, so an equi-join on the result is numeric address matching.
    Text that is no hex number (also ``''`` and ``'0x'``) gives NULL. Digits
    beyond 64 are kept, never truncated.
    """
    text = F.lower(F.trim(_c(col)))
    # drops the prefix and the leading zeros in one pass (x is not a hex digit)
    digits = F.ltrim(text, F.lit("0x"))
    width = F.greatest(F.length(digits), F.lit(ADDRESS_HEX_DIGITS))
    return F.when(text.rlike("^(0x)?[0-9a-f]+$"), F.concat(F.lit("0x"), F.lpad(digits, width, F.lit("0"))))


def canonical_address(text: str) -> str:
    """``normalise_address`` of a constant."""
    return f"0x{int(text, 16):0{ADDRESS_HEX_DIGITS}x}"


def same_number(col: Column | str, value: str) -> Column:
    """Does the text denote the hex number ``value``, whatever its spelling?
    Cheaper than normalising: only the digits that count are compared."""
    text = F.lower(F.trim(_c(col)))
    digits = f"{int(value, 16):x}".lstrip("0")
    same = F.ltrim(text, F.lit("0x")) == digits
    return same & text.rlike("^(0x)?[0-9a-f]+$")


def bucketize(col: Column | str, bounds: Sequence[tuple[int, str]], otherwise: str
              ) -> tuple[Column, Column]:
    """Ordered bucketing by inclusive upper bounds.

    Returns ``(order, label)``: ``order`` is 1 for the first bound, 2 for the
    second, ..., ``len(bounds)+1`` for ``otherwise``.
    """
    c = _c(col)
    order = label = None
    for i, (upper, name) in enumerate(bounds, start=1):
        if order is None:
            order, label = F.when(c <= upper, F.lit(i)), F.when(c <= upper, F.lit(name))
        else:
            order, label = order.when(c <= upper, F.lit(i)), label.when(c <= upper, F.lit(name))
    n = len(bounds) + 1
    if order is None:
        return F.lit(n), F.lit(otherwise)
    return order.otherwise(F.lit(n)), label.otherwise(F.lit(otherwise))


def ntile_of_position(pos: Column, total: Column, k: int) -> Column:
    """SQL ``NTILE(k)`` from a 0-based position among ``total`` ordered rows.

    The first ``total mod k`` tiles hold one extra row, as in NTILE.
    """
    base = F.floor(total / F.lit(k)).cast("bigint")
    rem = total - base * F.lit(k)
    big = rem * (base + F.lit(1))
    return F.when(pos < big, F.floor(pos / (base + F.lit(1))) + F.lit(1)) \
        .otherwise(F.floor((pos - big) / F.greatest(base, F.lit(1))) + rem + F.lit(1)) \
        .cast("bigint")
