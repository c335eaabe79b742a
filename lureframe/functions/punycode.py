"""RFC 3492 decoding of host labels as a fold over the label's characters.

Only built-in functions are used, so the decoding works inside array lambdas
and stays in the JVM.  Malformed labels are returned unchanged.
"""
from __future__ import annotations

from pyspark.sql import Column, functions as F

# FIXED VALUES: the parameters of RFC 3492, section 5.
TMIN, TMAX, SKEW, DAMP, BIAS0, N0 = 1, 26, 38, 700, 72, 128
BASE = TMAX + 10
DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"
_STATE = "i bigint, n bigint, bias bigint, w bigint, k bigint, start bigint, out array<bigint>, ok boolean"


def _adapted(delta: Column, count: Column, first: Column) -> Column:
    d = F.when(first, F.floor(delta / DAMP)).otherwise(F.floor(delta / 2))
    d = d + F.floor(d / count)
    limit = ((BASE - TMIN) * TMAX) // 2
    # a label has at most 63 characters, so a handful of reductions is enough
    state = F.aggregate(
        F.sequence(F.lit(1), F.lit(12)),
        F.struct(d.cast("bigint").alias("d"), F.lit(0).cast("bigint").alias("k")),
        lambda s, _: F.struct(
            F.when(s.d > limit, F.floor(s.d / (BASE - TMIN))).otherwise(s.d).cast("bigint").alias("d"),
            F.when(s.d > limit, s.k + BASE).otherwise(s.k).cast("bigint").alias("k"),
        ),
        lambda s: s.k + F.floor((BASE - TMIN + 1) * s.d / (s.d + SKEW)),
    )
    return state


def _consume(s: Column, ch: Column) -> Column:
    digit = (F.instr(F.lit(DIGITS), ch) - 1).cast("bigint")
    t = F.when(s.k <= s.bias, F.lit(TMIN)).when(s.k >= s.bias + TMAX, F.lit(TMAX)).otherwise(s.k - s.bias)
    i = s.i + digit * s.w
    count = F.size(s.out) + 1
    ends = digit < t
    at = F.pmod(i, count)
    code = s.n + F.floor(i / count)
    longer = F.concat(F.slice(s.out, F.lit(1), at.cast("int")), F.array(code.cast("bigint")),
                      F.slice(s.out, (at + 1).cast("int"), F.size(s.out)))
    return F.struct(
        F.when(ends, at + 1).otherwise(i).cast("bigint").alias("i"),
        F.when(ends, code).otherwise(s.n).cast("bigint").alias("n"),
        F.when(ends, _adapted(i - s.start, count, s.start == 0)).otherwise(s.bias).cast("bigint").alias("bias"),
        F.when(ends, F.lit(1)).otherwise(s.w * (BASE - t)).cast("bigint").alias("w"),
        F.when(ends, F.lit(BASE)).otherwise(s.k + BASE).cast("bigint").alias("k"),
        F.when(ends, at + 1).otherwise(s.start).cast("bigint").alias("start"),
        F.when(ends, longer).otherwise(s.out).alias("out"),
        (s.ok & (digit >= 0) & (i < 1 << 40) & (s.w < 1 << 40) & (code < 0x110000)).alias("ok"),
    )


def decode_label(label: Column) -> Column:
    """The decoded label; one that is not valid, or longer than a label may be (63), stays as it is."""
    body = F.substring(label, 5, 63)
    basic = F.when(body.contains("-"), F.regexp_extract(body, "^(.*)-[^-]*$", 1)).otherwise(F.lit(""))
    tail = F.substring_index(body, "-", -1)
    start = F.struct(
        F.lit(0).cast("bigint").alias("i"), F.lit(N0).cast("bigint").alias("n"), F.lit(BIAS0).cast("bigint").alias("bias"),
        F.lit(1).cast("bigint").alias("w"), F.lit(BASE).cast("bigint").alias("k"), F.lit(0).cast("bigint").alias("start"),
        F.transform(F.filter(F.split(basic, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint")).alias("out"),
        F.lit(True).alias("ok"),
    )
    done = F.aggregate(
        F.filter(F.split(tail, ""), lambda c: c != ""),
        start,
        lambda s, ch: F.when(s.ok, _consume(s, ch)).otherwise(s),
        lambda s: F.when(
            s.ok & (s.w == 1),
            F.array_join(F.transform(s.out, lambda c: F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32")), ""),
        ),
    )
    return F.when(F.length(label) <= 63, F.coalesce(done, label)).otherwise(label)


def decode_host(host: Column) -> Column:
    return F.array_join(
        F.transform(F.split(host, r"\."), lambda lb: F.when(lb.startswith("xn--"), decode_label(lb)).otherwise(lb)), "."
    )
