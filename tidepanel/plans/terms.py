"""Factor terms: a column that knows how it is written, what it reads and how far it looks back.

Factors are formed from terms, so their catalog entries follow from the formulas instead of being typed beside them.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidepanel.functions.scalar import col, larger, safe_div, smaller
from tidepanel.operators.timeseries import POSITION, delay, last_rows

SUM, PRODUCT, WHOLE = 1, 2, 3


@dataclass(frozen=True)
class Term:
    """A column with its text; ``binding`` says how tightly the text holds together."""

    column: Column
    text: str
    inputs: tuple[str, ...] = ()
    lookback: int = 0
    window: int | None = None
    binding: int = WHOLE
    name: str = ""
    counted: str = ""

    def _wrapped(self, least: int) -> str:
        return self.text if self.binding >= least else f"({self.text})"

    def _with(self, other, column: Column, text: str, binding: int) -> Term:
        other = term(other)
        windows = [w for w in (self.window, other.window) if w]
        inputs = tuple(dict.fromkeys((*self.inputs, *other.inputs)))
        return Term(column, text, inputs, max(self.lookback, other.lookback), max(windows, default=None), binding)

    def __add__(self, other) -> Term:
        other = term(other)
        return self._with(other, self.column + other.column, f"{self.text} + {other.text}", SUM)

    def __sub__(self, other) -> Term:
        other = term(other)
        return self._with(other, self.column - other.column, f"{self.text} - {other._wrapped(PRODUCT)}", SUM)

    def __mul__(self, other) -> Term:
        other = term(other)
        text = f"{self._wrapped(PRODUCT)} * {other._wrapped(WHOLE)}"
        return self._with(other, self.column * other.column, text, PRODUCT)

    def __truediv__(self, other) -> Term:
        """Quotient, missing where the denominator is zero."""
        other = term(other)
        text = f"{self._wrapped(PRODUCT)} / {other._wrapped(WHOLE)}"
        return self._with(other, safe_div(self.column, other.column), text, PRODUCT)

    def call(self, name: str, function, *others: Term, **changes) -> Term:
        """``function`` of the columns, written as a call."""
        out = self
        for o in others:
            out = self._with(o, out.column, out.text, WHOLE)
        text = f"{name}({', '.join(t.text for t in (self, *others))})"
        return replace(out, column=function(*[t.column for t in (self, *others)]), text=text, binding=WHOLE, name="", counted="", **changes)

    def stored(self, name: str, counted: str = "") -> Term:
        """The same term read from the column ``name``; ``counted`` is missing in the same rows."""
        return replace(self, column=F.col(name), name=name, counted=counted or name)


def term(x) -> Term:
    return x if isinstance(x, Term) else Term(F.lit(x), f"{x:g}")


def field(name: str, text: str = "") -> Term:
    return Term(F.col(name), text or name, (name,), name=name, counted=name)


def before(x: Term, rows: int) -> Term:
    """The value so many rows earlier."""
    value = x.column if rows == 0 else delay(x.column, rows)
    text = x.text if rows == 0 else f"delay({x.text}, {rows})"
    return replace(x, column=value, text=text, lookback=x.lookback + rows, window=rows or x.window, binding=WHOLE, name="", counted="")


def trailing(operator, x: Term, w: int, *others: Term) -> Term:
    """A window operator of :mod:`tidepanel.operators.timeseries` over the last ``w`` rows of ``x`` (and of others)."""
    both = x
    for o in others:
        both = both._with(o, x.column, f"{both.text}, {o.text}", WHOLE)
    value = operator(x.column, *[o.column for o in others], w)
    return Term(value, f"{operator.__name__}({both.text}, {w})", both.inputs, both.lookback + w, w)


def max_of(a: Term, b: Term) -> Term:
    return a.call("max", larger, b)


def min_of(a: Term, b: Term) -> Term:
    return a.call("min", smaller, b)


class Trailing:
    """Aggregates over the last ``w`` rows; none of them may be missing.

    Spark computes a window expression as often as it is written, so every aggregate becomes one named column
    (``parts``) and terms refer to that.
    """

    def __init__(self, w: int):
        self.w = w
        self.frame = last_rows(w)
        self.parts: dict[str, Column] = {}

    def _part(self, name: str, aggregate: Column) -> Column:
        full = f"_w{self.w}_{name}"
        self.parts.setdefault(full, aggregate.over(self.frame))
        return F.col(full)

    def _full(self, x: str, value: Column) -> Column:
        return F.when(self._part(f"n_{x}", F.count(col(x))) >= self.w, value)

    def _term(self, x: Term, name: str, value: Column, *arguments) -> Term:
        text = ", ".join([x.text, str(self.w), *map(str, arguments)])
        return Term(value, f"{name}({text})", x.inputs, x.lookback + self.w, self.w)

    def _aggregate(self, x: Term, name: str, short: str, aggregate) -> Term:
        key = _key(x)
        return self._term(x, name, self._full(x.counted, self._part(f"{short}_{key}", aggregate(col(key)))))

    def mean(self, x: Term) -> Term:
        return self._aggregate(x, "ts_mean", "avg", F.avg)

    def std(self, x: Term) -> Term:
        return self._aggregate(x, "ts_std", "sd", F.stddev_samp)

    def total(self, x: Term) -> Term:
        return self._aggregate(x, "ts_sum", "sum", F.sum)

    def top(self, x: Term) -> Term:
        return self._aggregate(x, "ts_max", "max", F.max)

    def bottom(self, x: Term) -> Term:
        return self._aggregate(x, "ts_min", "min", F.min)

    def _values(self, x: Term) -> Column:
        return self._part(f"list_{_key(x)}", F.collect_list(col(_key(x))))

    def quantile(self, x: Term, q: float) -> Term:
        """Interpolated between the two nearest of the window's sorted values."""
        ordered, place = F.array_sort(self._values(x)), q * (self.w - 1)
        low = int(place)
        value = F.element_at(ordered, low + 1)
        if place > low:
            value = value + (F.element_at(ordered, low + 2) - value) * (place - low)
        return self._term(x, "ts_quantile", self._full(x.counted, value), f"{q:g}")

    def rank(self, x: Term) -> Term:
        """Share of the window at or below the value, ties at their mean place."""
        values, now = self._values(x), x.column
        below = F.size(F.filter(values, lambda v: v < now))
        equal = F.size(F.filter(values, lambda v: v == now))
        share = (below + (equal + 1) / 2.0) / F.size(values)
        return self._term(x, "ts_rank", self._full(x.counted, F.when(now.isNotNull(), share)))

    def place_of_top(self, x: Term) -> Term:
        return self._term(x, "ts_idxmax", F.array_position(self._values(x), self.top(x).column).cast("double"))

    def place_of_bottom(self, x: Term) -> Term:
        return self._term(x, "ts_idxmin", F.array_position(self._values(x), self.bottom(x).column).cast("double"))

    def slope(self, x: Term) -> Term:
        return self._aggregate(x, "ts_slope", "slope", lambda c: F.regr_slope(c, F.col(POSITION)))

    def r_square(self, x: Term) -> Term:
        spread = self.std(x).column
        found = self._aggregate(x, "ts_rsquare", "r2", lambda c: F.regr_r2(c, F.col(POSITION)))
        return replace(found, column=F.when(spread > 0, found.column))

    def residual(self, x: Term) -> Term:
        """Distance to the end of the fitted line."""
        fitted = self.mean(x).column + self.slope(x).column * ((self.w - 1) / 2.0)
        return self._term(x, "ts_residual", x.column - fitted)

    def correlation(self, x: Term, y: Term) -> Term:
        a, b = col(_key(x)), col(_key(y))
        left, right, name = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b), f"{_key(x)}_{_key(y)}"
        spread = self._part(f"sx_{name}", F.stddev_samp(left)) * self._part(f"sy_{name}", F.stddev_samp(right))
        both = F.try_divide(self._part(f"co_{name}", F.covar_samp(a, b)), spread)
        value = F.when(self._part(f"n_{name}", F.count(left)) >= self.w, both)
        pair = x._with(y, value, f"{x.text}, {y.text}", WHOLE)
        return self._term(pair, "ts_corr", value)


def _key(x: Term) -> str:
    """Name of the column that holds the term."""
    if not x.name:
        raise ValueError(f"store the term in a column first: {x.text}")
    return x.name
