"""Random draws as a function of (seed, path, step): any engine with MD5 makes the same ones, whatever task asks.

Four steps share one hash, of ``seed:path:block``; each takes 32 of its bits."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Draws a hash.
PER_HASH = 4


def hashed(seed: int, path: Column, block: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), path.cast("string"), block.cast("string")).cast("binary"))


def bits(hash_: Column, k: int) -> Column:
    """The k-th 32 bits of a hash, as a long."""
    return F.conv(F.substring(hash_, 8 * k + 1, 8), 16, 10).cast("long")


def uniform(hash_: Column, k: int) -> Column:
    """Above 0 and below 1."""
    return (bits(hash_, k) + 0.5) / 4294967296.0


def below(hash_: Column, k: int, n: Column) -> Column:
    """A whole number from 0 to n - 1; n is under 2 ** 31."""
    return F.shiftright(bits(hash_, k) * n, 32)


def normals(seed: int, path: Column, steps: int) -> Column:
    """An array of ``steps`` standard normal draws, by pairs of uniform ones."""
    def four(h: Column) -> Column:
        out = []
        for k in (0, 2):
            far, turn = F.sqrt(-2.0 * F.ln(uniform(h, k))), 2.0 * math.pi * uniform(h, k + 1)
            out += [far * F.cos(turn), far * F.sin(turn)]
        return F.array(*out)

    blocks = F.sequence(F.lit(0), F.lit((steps - 1) // PER_HASH))
    return F.slice(F.flatten(F.transform(F.transform(blocks, lambda b: hashed(seed, path, b)), four)), 1, steps)
