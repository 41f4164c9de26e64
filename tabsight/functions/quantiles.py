"""Exact quantiles of many columns at once, without a sort and without a task that holds a column's values."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Accuracy of the sketches that bracket a rank; values that are collected at most in a bracket's counts, all brackets
#: together.
ACCURACY, COLLECTED = 10_000, 200_000


def exact_quantiles(df: DataFrame, values: dict[str, Column], shares: list[float], accuracy: int = ACCURACY, collected: int = COLLECTED) -> dict[str, list[float] | None]:
    """The linearly interpolated quantiles of each expression (doubles); None where there are no values.

    Sketches of fixed size bracket each rank, a pass counts what lies below the brackets, and the few values inside are
    counted one by one; a bracket that still holds too many different values is narrowed by a sketch of its own. Each
    pass is one aggregation over all columns, and only bounded results reach the driver.
    """
    names = list(values)
    x = df.select(*(v.cast("double").alias(f"x{i}") for i, v in enumerate(values.values())))
    margin = 3 / accuracy
    edges = [min(1.0, max(0.0, s + m)) for s in shares for m in (-margin, margin)]
    first = x.agg(*(F.struct(F.count(f"x{i}"), F.min(f"x{i}"), F.max(f"x{i}"), F.percentile_approx(f"x{i}", edges, accuracy)).alias(f"s{i}") for i in range(len(names)))).first()
    size, open_, found = {}, {}, {}
    for i in range(len(names)):
        n, least, most, cuts = first[i]
        size[i] = n
        for k, share in enumerate(shares if n else []):
            at = share * (n - 1)
            # Brackets take in both neighbours of the position; at the ends, and in small columns, the least and greatest value.
            low = least if edges[2 * k] <= 0 or n < accuracy else cuts[2 * k]
            high = most if edges[2 * k + 1] >= 1 or n < accuracy else cuts[2 * k + 1]
            open_[i, k] = (math.floor(at), math.ceil(at), low, high)
    while open_:
        keys = list(open_)
        below = x.agg(*(F.struct(F.count_if(F.col(f"x{i}") < open_[i, k][2]), F.count_if(F.col(f"x{i}").between(*open_[i, k][2:]))).alias(f"b{j}") for j, (i, k) in enumerate(keys))).first()
        inside = {}
        for j, key in enumerate(keys):
            n_below, n_in = below[j]
            a, b, low, high = open_[key]
            if n_below > a or n_below + n_in <= b:  # the sketch was off: everything on that side again
                _, least, most, _ = first[key[0]]
                open_[key] = (a, b, least if n_below > a else low, most if n_below + n_in <= b else high)
            elif low == high:
                found[key] = (low, low)
                del open_[key]
            else:
                inside[key] = (n_below, n_in)
        if not inside:
            continue
        cells = F.array(*(F.struct(F.lit(j).alias("j"), F.when(F.col(f"x{i}").between(*open_[i, k][2:]), F.col(f"x{i}")).alias("v")) for j, (i, k) in enumerate(inside)))
        kept = x.select(F.inline(F.filter(cells, lambda c: c["v"].isNotNull())))
        small = list(inside) if sum(n for _, n in inside.values()) <= collected else []
        if not small:  # few different values, however often?
            distinct = {r["j"]: r["n"] for r in kept.groupBy("j").agg(F.approx_count_distinct("v", 0.02).alias("n")).collect()}
            room = collected
            for j, key in sorted(enumerate(inside), key=lambda e: distinct[e[0]]):
                if 1.1 * distinct[j] <= room:
                    small.append(key)
                    room -= 1.1 * distinct[j]
        place = {key: j for j, key in enumerate(inside)}
        if small:
            counts: dict[int, list] = {}
            for r in kept.where(F.col("j").isin([place[key] for key in small])).groupBy("j", "v").agg(F.count("*").alias("n")).collect():
                counts.setdefault(r["j"], []).append((r["v"], r["n"]))
            for key in small:
                a, b, *_ = open_.pop(key)
                upto, pair = inside[key][0], {}
                for v, n in sorted(counts[place[key]]):
                    upto += n
                    for rank in (a, b):
                        if rank < upto:
                            pair.setdefault(rank, v)
                found[key] = (pair[a], pair[b])
        rest = [key for key in inside if key in open_]
        if rest:
            shares_in = {key: sorted({min(1.0, max(0.0, (open_[key][0] - inside[key][0] + d) / inside[key][1])) for d in (-inside[key][1] * margin, inside[key][1] * margin)}) for key in rest}
            cuts = x.agg(*(F.percentile_approx(F.when(F.col(f"x{i}").between(*open_[i, k][2:]), F.col(f"x{i}")), shares_in[i, k], accuracy).alias(f"c{j}") for j, (i, k) in enumerate(rest))).first()
            stuck = False
            for j, key in enumerate(rest):
                a, b, low, high = open_[key]
                narrow = (max(low, cuts[j][0]), min(high, cuts[j][-1]))
                stuck = stuck or narrow == (low, high)
                open_[key] = (a, b, *narrow)
            if stuck:  # many equal values at the edges: a finer sketch, exact in the end
                accuracy = min(10 * accuracy, 1 << 30)
                margin = 3 / accuracy
    out: dict[str, list[float] | None] = {}
    for i, name in enumerate(names):
        if not size[i]:
            out[name] = None
            continue
        out[name] = []
        for k, share in enumerate(shares):
            low, high = found[i, k]
            at = share * (size[i] - 1)
            part = at - math.floor(at)
            out[name].append(low if part == 0 else (1 - part) * low + part * high)
    return out
