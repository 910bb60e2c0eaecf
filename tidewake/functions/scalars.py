"""Column builders: angles, vectors, clips, digests, hashed buckets and box tests. Everything stays in the JVM.

Three-vectors are arrays of three numbers. A null component or an array that is too short makes a result null:
what was not observed stays unknown.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def at(array: Column | str, i: int) -> Column:
    """Element i from 0, null beyond the end."""
    return F.get(col(array), i)


def angle_diff(a: Column | str, b: Column | str) -> Column:
    """M1: a - b in degrees, wrapped to [-180, 180) with a floored modulus."""
    return F.pmod(col(a) - col(b) + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)


def angle_diff_folded(a: Column | str, b: Column | str) -> Column:
    """M2: a - b by truncated modulus, then folded: both -180 and 180 can come out."""
    d = (col(a) - col(b)) % F.lit(360.0)
    return F.when(d > 180, d - 360).when(d < -180, d + 360).otherwise(d)


def finite(v: Column | str, size: int = 3) -> Column:
    """whether a vector has size components, all of them finite numbers."""
    ok = F.forall(col(v), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(col(v)) == size) & ok, F.lit(False))


def dist2(a: Column | str, b: Column | str) -> Column:
    """Squared distance of two vectors of any one length."""
    parts = F.zip_with(col(a), col(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def dist(a: Column | str, b: Column | str) -> Column:
    """M4: distance of two vectors."""
    return F.sqrt(dist2(a, b))


def speed_xy(v: Column | str) -> Column:
    return F.hypot(at(v, 0), at(v, 1))


def local_frame(x: Column, y: Column, z: Column, yaw: Column, scale: float = 1.0) -> list[Column]:
    """M3: a vector turned into the frame that looks along yaw (degrees), divided by scale."""
    c, s = F.cos(F.radians(yaw)), F.sin(F.radians(yaw))
    return [(x * c + y * s) / scale, (-x * s + y * c) / scale, z / scale]


def clip(c: Column | str, low: float, high: float) -> Column:
    """M5: c within [low, high]; null stays null."""
    c = col(c)
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(high)), F.lit(low)))


def one_hot(c: Column | str, vocabulary: list[str]) -> Column:
    """M6: 1.0 at the value's place in the vocabulary; all 0 for null or other values."""
    return F.transform(F.array(*map(F.lit, vocabulary)), lambda w: F.when(w == col(c), 1.0).otherwise(0.0))


def left_pad(rows: Column, size: int, zero: Column) -> Column:
    """M6: an array of the last size elements, zeros in front."""
    return F.concat(F.array_repeat(zero, F.greatest(F.lit(size) - F.size(rows), F.lit(0))), F.slice(rows, F.greatest(F.size(rows) - size + 1, F.lit(1)), size))


def cell(c: Column | str, width: int) -> Column:
    """M9: the number of the cell of that width that holds c."""
    return F.floor(col(c) / width)


def sigmoid(c: Column | str, bound: float = 30.0) -> Column:
    """Logistic function of c clipped to +-bound."""
    return 1 / (1 + F.exp(-clip(c, -bound, bound)))


def softmax(logits: Column) -> Column:
    """Softmax of an array, shifted by its maximum."""
    e = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def safe_log(c: Column | str, least: float = 1e-9) -> Column:
    return F.log(F.greatest(col(c), F.lit(least)))


def corrected(logits: Column, weights: Column, changed: Column, switch: float) -> Column:
    """Logits - log(class weight) - changed * log(switch factor), by class; weights are those of training."""
    import math

    shifted = F.zip_with(logits, weights, lambda z, w: z - F.log(w))
    return F.zip_with(shifted, changed, lambda z, c: z - c * math.log(switch))


def hex_bucket(digest: Column, buckets: int, digits: int = 8) -> Column:
    """The leading hex digits of a digest as a number, modulo buckets."""
    return (F.conv(F.substring(digest, 1, digits), 16, 10).cast("long") % buckets).cast("long")


def fnv1a(text: Column | str) -> Column:
    """64-bit FNV-1a of a string's UTF-8 bytes as 16 hex digits.

    64-bit products would overflow, so the hash is kept as two 32-bit halves in longs.
    """
    code = F.hex(F.encode(col(text), "UTF-8"))
    bytes_ = F.transform(F.sequence(F.lit(0), (F.length(code) / 2 - 1).cast("int")), lambda i: F.conv(F.substr(code, (i * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("long"))
    bytes_ = F.when(F.length(code) > 0, bytes_).otherwise(F.array().cast("array<bigint>"))
    low32 = F.lit(0xFFFFFFFF)

    def step(h, b):  # times 0x100000001B3: 435 in the low half, 256 from low to high
        low = h["lo"].bitwiseXOR(b)
        p = low * 435
        high = (h["hi"] * 435 + low * 256 + F.shiftrightunsigned(p, 32)).bitwiseAND(low32)
        return F.struct(high.alias("hi"), p.bitwiseAND(low32).alias("lo"))

    start = F.struct(F.lit(0xCBF29CE4).alias("hi"), F.lit(0x84222325).alias("lo"))
    return F.aggregate(bytes_, start, step, lambda h: F.lower(F.concat(F.lpad(F.hex(h["hi"]), 8, "0"), F.lpad(F.hex(h["lo"]), 8, "0"))))


def slab(start: list[Column], end: list[Column], low: list[Column], high: list[Column]) -> Column:
    """M7: whether the segment from start to end meets the closed box [low, high]; a start inside counts."""
    enter, leave, flat = [F.lit(0.0)], [F.lit(1.0)], F.lit(True)
    for s, e, lo, hi in zip(start, end, low, high):
        d = e - s
        still = F.abs(d) < 1e-9
        a, b = F.try_divide(lo - s, d), F.try_divide(hi - s, d)
        enter.append(F.when(still, F.lit(0.0)).otherwise(F.least(a, b)))
        leave.append(F.when(still, F.lit(1.0)).otherwise(F.greatest(a, b)))
        flat &= ~still | ((s >= lo) & (s <= hi))
    return flat & (F.greatest(*enter) <= F.least(*leave))


def push_direction(pitch: Column, yaw: Column, roll: Column) -> list[Column]:
    """M8: unit direction of a launch volume's angles; (0,-1,0) is up, (0,-2,0) down and (0,0,0) nowhere."""
    flat = (pitch == 0) & (roll == 0)
    p, y = F.radians(pitch), F.radians(yaw)
    special = lambda up, down, other: F.when(flat & (yaw == -1), up).when(flat & (yaw == -2), down).when(flat & (yaw == 0), 0.0).otherwise(other)
    return [special(0.0, 0.0, F.cos(p) * F.cos(y)), special(0.0, 0.0, F.cos(p) * F.sin(y)), special(1.0, -1.0, -F.sin(p))]


def vector(text: Column | str, limit: float = 65536.0) -> Column:
    """C4: a text of three finite numbers below limit in size, apart by white space, as an array; null for any other text."""
    parts = F.transform(F.split(F.trim(F.regexp_replace(col(text), r"\s+", " ")), " "), lambda x: x.try_cast("double"))
    return F.when(F.coalesce(finite(parts) & F.forall(parts, lambda x: F.abs(x) < limit), F.lit(False)), parts)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
