"""Token sampling filters on logits: repetition penalty, temperature, top-k, top-p; no draw."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is built once: as a lambda's variable. Used plainly inside another lambda it would be built for each element."""
    return F.get(F.transform(F.array(value), use), 0)


def filtered_probabilities(logits: Column, seen: Column, penalty: float = 1.0, temperature: float = 1.0, top_k: int = 0, top_p: float = 1.0) -> Column:
    """Probabilities by token id (position) after all filters, in their usual order; filtered ids get 0.

    Positive logits of seen ids are divided by the penalty, others multiplied. Ties at the top-k floor
    all stay; ids leave the nucleus once the probability before them exceeds ``top_p``, ties in order
    of id; ``top_p`` outside (0, 1) filters nothing. A null or empty array gives the same.
    """
    mass = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

    def shares(kept: Column) -> Column:
        return _bound(F.struct(kept.alias("a"), mass(kept).alias("m")), lambda t: F.transform(t["a"], lambda x: x / t["m"]))

    def softmax(scaled: Column) -> Column:
        floor = F.element_at(F.sort_array(scaled, asc=False), F.least(F.lit(top_k), F.size(scaled))) if top_k > 0 else F.lit(float("-inf"))
        limits = F.struct(floor.alias("floor"), F.array_max(scaled).alias("top"))
        return _bound(limits, lambda t: _bound(F.transform(scaled, lambda x: F.when(x >= t["floor"], F.exp(x - t["top"])).otherwise(0.0)), shares))

    def nucleus(probs: Column) -> Column:
        ranked = F.array_sort(F.transform(probs, lambda p, i: F.struct((-p).alias("p"), i.alias("i"))))
        start = F.struct(F.lit(0.0).alias("sum"), F.struct(F.lit(0.0).alias("p"), F.lit(-1).alias("i")).alias("last"))
        last = F.aggregate(ranked, start, lambda s, x: F.struct((s["sum"] - x["p"]).alias("sum"), F.when(s["sum"] <= top_p, x).otherwise(s["last"]).alias("last")))["last"]
        return _bound(last, lambda t: _bound(F.transform(probs, lambda p, i: F.when((-p < t["p"]) | ((-p == t["p"]) & (i <= t["i"])), p).otherwise(0.0)), shares))

    scaled = F.transform(logits, lambda x, i: F.when(F.array_contains(seen, i), F.when(x > 0, x / penalty).otherwise(x * penalty)).otherwise(x) / max(temperature, 1e-5))
    out = _bound(scaled, softmax)
    out = _bound(out, nucleus) if 0.0 < top_p < 1.0 else out
    return F.when(F.size(logits) > 0, out).otherwise(logits)
