"""Random draws as functions of a row's number, so that values depend on neither partitions nor order."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Draws:
    """Draws of one table. ``exact`` uses MD5, which other engines can repeat; else a faster hash of the JVM."""

    seed: int
    table: str
    id: Column
    exact: bool = True

    def at(self, id: Column) -> Draws:
        """The same draws for another row's number."""
        return Draws(self.seed, self.table, id, self.exact)

    def _key(self, name: str, k: int) -> str:
        return f"{self.seed}|{self.table}|{name}|{k}|"

    def uniform(self, name: str, k: int = 0) -> Column:
        """From 0 to below 1."""
        if self.exact:
            digest = F.md5(F.concat(F.lit(self._key(name, k)), self.id.cast("string")))
            return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))
        salt = int.from_bytes(hashlib.md5(self._key(name, k).encode()).digest()[:8], "big", signed=True)
        return F.shiftrightunsigned(F.xxhash64(self.id, F.lit(salt)), 11) / F.lit(float(1 << 53))

    def integer(self, low: int, high: int, name: str, k: int = 0) -> Column:
        """A whole number from ``low`` to below ``high``."""
        return (F.lit(low) + F.floor(self.uniform(name, k) * (high - low))).cast("bigint")

    def between(self, low: float, high: float, name: str, k: int = 0) -> Column:
        return F.lit(float(low)) + self.uniform(name, k) * F.lit(float(high) - float(low))

    def pick(self, values: Sequence, name: str, k: int = 0) -> Column:
        """One of the values; null of none."""
        if not values:
            return F.lit(None)
        return F.element_at(F.array(*[F.lit(v) for v in values]), (self.integer(0, len(values), name, k) + 1).cast("int"))

    def weighted(self, values: Sequence, weights: Sequence[float] | None, name: str, k: int = 0) -> Column:
        """One of the values by weight. Negative weights count as 0; without any weight above 0, all are alike."""
        weights = [max(0.0, float(w)) for w in weights or []]
        if len(values) < 2 or sum(weights) <= 0:
            return self.pick(values, name, k)
        upto, total = [], 0.0
        for w in weights:
            total += w
            upto.append(total)
        roll = self.uniform(name, k) * F.lit(total)
        out = None
        for v, u in zip(values[:-1], upto, strict=False):
            out = F.when(roll < u, F.lit(v)) if out is None else out.when(roll < u, F.lit(v))
        # a weight of 0 at the end must not catch what rounding leaves over
        last = max(i for i, w in enumerate(weights) if w > 0)
        return out.otherwise(F.lit(values[last]))

    def normal(self, mean: float, sd: float, low: float, high: float, name: str) -> Column:
        """Normal by Box and Muller, held within bounds; the bounded mean without spread."""
        if sd <= 0 or low == high:
            return F.lit(float(min(max(mean, low), high)))
        u1 = F.greatest(self.uniform(name, 0), F.lit(2.2250738585072014e-308))
        z = F.sqrt(F.lit(-2.0) * F.ln(u1)) * F.cos(F.lit(2 * math.pi) * self.uniform(name, 1))
        return F.least(F.greatest(F.lit(float(mean)) + F.lit(float(sd)) * z, F.lit(float(low))), F.lit(float(high)))

    def alphanumeric(self, length: int, name: str) -> Column:
        """Letters and digits; 12 characters from each digest."""
        alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
        parts = []
        for k in range(-(-length // 12)):
            text = F.base64(F.unhex(F.md5(F.concat(F.lit(self._key(name, 100 + k)), self.id.cast("string")))))
            parts.append(F.substring(F.translate(text, "+/=", alphabet[k % 62] + alphabet[(k + 31) % 62]), 1, min(12, length - 12 * k)))
        return parts[0] if len(parts) == 1 else F.concat(*parts)

    def uuid(self, name: str) -> Column:
        """A version-4 UUID made from the digest."""
        d = F.md5(F.concat(F.lit(self._key(name, 0)), self.id.cast("string")))
        variant = F.element_at(F.array(*[F.lit(x) for x in "89ab"]), (self.integer(0, 4, name, 1) + 1).cast("int"))
        return F.concat(F.substring(d, 1, 8), F.lit("-"), F.substring(d, 9, 4), F.lit("-4"), F.substring(d, 14, 3), F.lit("-"), variant, F.substring(d, 18, 3), F.lit("-"), F.substring(d, 21, 12))


def permutation(size: int, seed: int, name: str) -> tuple[int, int]:
    """Step and shift of a permutation of 0 to ``size`` - 1: the step has no divisor in common with the size.

    Steps lie near the golden section of the size, so that a few rows are spread as evenly as many. Only where the
    product of a place and a step would pass 63 bits (from about 3.9 thousand million places on) they are smaller.
    """
    h = int.from_bytes(hashlib.md5(f"{seed}|{name}|permutation".encode()).digest()[:8], "big")
    if size < 3:
        return 1, (h >> 20) % max(1, size)
    step = min(size * 618_033_988_749_895 // 10**15 + h % (size // 64 + 1), (2**63 - 1) // size - 1) % size or 1
    while math.gcd(step, size) != 1:
        step -= 1
    return step, (h >> 20) % size


def permuted(id: Column, size: int, seed: int, name: str) -> Column:
    """A place from 0 to below ``size`` for each row; rows 0 to size - 1 get different ones."""
    step, shift = permutation(size, seed, name)
    return F.pmod(id * F.lit(step) + F.lit(shift), F.lit(size))


def whole_part(value: Column, by: int) -> Column:
    """Division of whole numbers, exact at any size."""
    return F.call_function("div", value, F.lit(by).cast("bigint"))


def combination(id: Column, sizes: Sequence[int], at: int, seed: int, names: Sequence[str], draws: Draws) -> Column:
    """Member ``at`` of the id-th of all combinations of one value below each size; rows get different combinations.

    The row's number is read as digits, one for each size. Each digit is shifted by a hash of the digits before it and
    then permuted: given those before, that keeps digits apart, and few rows spread over every size.
    """
    rest, made = id, None
    for k in range(at + 1):
        digit = F.pmod(rest, F.lit(sizes[k])) if k + 1 < len(sizes) else rest
        if made is not None:
            digit = F.pmod(digit + draws.at(made).integer(0, sizes[k], f"digit:{','.join(names)}", k), F.lit(sizes[k]))
        place = permuted(digit, sizes[k], seed, f"{draws.table}.{','.join(names)}.{k}")
        made = place if made is None else made * F.lit(sizes[k]) + place
        rest = whole_part(rest, sizes[k])
    return place


def later(time: Column, days: Column | None = None, hours: Column | None = None, minutes: Column | None = None, seconds: Column | None = None) -> Column:
    """A time moved by whole days, hours, minutes and seconds; negative ones move it back."""
    return time + F.make_dt_interval(*[F.lit(0) if x is None else x.cast("int") for x in (days, hours, minutes)], F.lit(0) if seconds is None else seconds.cast("decimal(18,6)"))
