"""Deterministic +-1 symbol vectors and dense-vector arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfind.functions.text import let

BITS_PER_BLOCK = 128


def symbol_bits(seed: int, token: Column, dim: int = BITS_PER_BLOCK) -> Column:
    """Hex digits (4 bits each) of a token's symbol; ``dim`` is a multiple of 128."""
    if dim % BITS_PER_BLOCK:
        raise ValueError("dim must be a multiple of 128")
    blocks = [
        F.md5(F.concat(F.lit(f"{seed}:"), token, F.lit(f":{b}")))
        for b in range(dim // BITS_PER_BLOCK)
    ]
    return F.concat(*blocks)


def _sign(hex_digits: Column, position: Column) -> Column:
    digit = F.ascii(F.substr(hex_digits, F.shiftright(position, 2) + 1, F.lit(1)))
    value = digit - F.when(digit > 96, 87).otherwise(48)
    bit = F.call_function("shiftright", value, F.lit(3) - position.bitwiseAND(F.lit(3))).bitwiseAND(F.lit(1))
    return (bit * 2 - 1).cast("int")


def symbol(seed: int, token: Column, dim: int = BITS_PER_BLOCK) -> Column:
    """The +-1 vector of a token."""
    positions = F.sequence(F.lit(0), F.lit(dim - 1))
    return let(symbol_bits(seed, token, dim), lambda digits: F.transform(positions, lambda i: _sign(digits, i)))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def bind(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def bundle(seed: int, tokens: Column, dim: int = BITS_PER_BLOCK) -> Column:
    """Per-dimension majority of the tokens' symbols; a tie gives 0.

    The bag of a text sits in one row, so this needs no shuffle.
    """
    zero = F.array_repeat(F.lit(0), dim)
    total = F.aggregate(tokens, zero, lambda acc, t: add(acc, symbol(seed, t, dim)))
    return majority(total)


def majority(total: Column) -> Column:
    return F.transform(total, lambda s: F.signum(s).cast("int"))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0).cast("double"), lambda s, p: s + p)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 when either vector has no length."""
    scale = norm(a) * norm(b)
    return F.when(scale > 0, dot(a, b) / scale).otherwise(0.0)
