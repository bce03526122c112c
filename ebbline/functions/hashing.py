"""Deterministic pseudo-random values keyed by content, not by row position.

A generator seeded per partition gives other values after a repartition or a
task retry; a hash of the key gives the same value on every run.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def _hex_field(digest: Column, start: int, digits: int) -> Column:
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("bigint")


def hash52(key: Column, seed: int) -> Column:
    """A 52-bit hash as a double, which holds it exactly."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), key))
    return _hex_field(digest, 1, 13).cast("double")


def gaussian_noise(seed: Column, key: Column, scale: float) -> Column:
    """Approximately N(0, scale): the sum of twelve uniforms, less six.

    One digest feeds all twelve: two 60-bit words of six 10-bit fields each.
    ``(field + 0.5) / 1024`` has mean one half, so the sum is centred; integer
    arithmetic up to the last step gives the same bits in every engine.
    """
    digest = F.md5(F.concat(seed.cast("string"), F.lit("|"), key))
    words = [_hex_field(digest, 1, 15), _hex_field(digest, 17, 15)]
    fields = [F.shiftright(word, 10 * i).bitwiseAND(F.lit(1023)) for word in words for i in range(6)]
    total = reduce(add, fields)
    return ((total + 6) / F.lit(1024.0) - F.lit(6.0)) * F.lit(scale)
