"""A factor table and the catalog that describes its columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.functions.scalar import finite
from tidepanel.operators.cross_section import cs_pct_rank, cs_zscore, industry_neutralize
from tidepanel.operators.joins import combine_on_keys
from tidepanel.operators.keys import require_columns, require_unique
from tidepanel.plans.terms import Term
from tidepanel.scale import settled

DAILY_KEYS = ("stock_code", "trade_date")

CATALOG_SCHEMA = (
    "name string, source string, category string, inputs array<string>, expression string, "
    "window int, lookback int, availability string, description string"
)


@dataclass(frozen=True)
class CatalogEntry:
    """Where a factor belongs; everything else that the catalog says of it follows from its term."""

    name: str
    source: str
    category: str
    term: Term
    availability: str = "feature_asof_date"
    note: str = ""

    def row(self) -> tuple:
        t = self.term
        return (self.name, self.source, self.category, list(t.inputs), t.text, t.window, t.lookback, self.availability, self.note)

    def form(self, kind: str, text: str, *more_inputs: str) -> CatalogEntry:
        """The entry of a form made from this factor."""
        made = replace(self.term, text=text, inputs=(*self.term.inputs, *more_inputs))
        return replace(self, name=f"{self.name}_{kind}", category=f"{self.category}.{kind}", term=made, note=f"{kind} derived from {self.name}")


@dataclass(frozen=True)
class FactorTable:
    """Key columns, factor columns, and one catalog entry per factor."""

    df: DataFrame
    entries: tuple[CatalogEntry, ...] = ()
    keys: tuple[str, ...] = DAILY_KEYS

    @property
    def names(self) -> list[str]:
        return [e.name for e in self.entries]

    def output(self) -> DataFrame:
        return self.df.select(*self.keys, *self.names)

    def max_lookback(self) -> int:
        return max((e.term.lookback for e in self.entries), default=0)

    def validate(self) -> FactorTable:
        """Raise unless factor names and keys are unique and all columns exist."""
        twice = sorted({n for n in self.names if self.names.count(n) > 1})
        if twice:
            raise ValueError(f"factor names must be unique: {twice}")
        require_columns(self.df, [*self.keys, *self.names], "factor")
        require_unique(self.df.select(*self.keys), self.keys, "factor")
        return self


def catalog(spark: SparkSession, entries: Sequence[CatalogEntry]) -> DataFrame:
    """The factor catalog: one row per factor."""
    return spark.createDataFrame([e.row() for e in entries], CATALOG_SCHEMA)


def combine(tables: Sequence[FactorTable]) -> FactorTable:
    """Outer join of factor tables on their keys."""
    keys = tables[0].keys
    if any(t.keys != keys for t in tables):
        raise ValueError("factor tables have different keys")
    joined = combine_on_keys([t.output() for t in tables], keys)
    return FactorTable(joined, tuple(e for t in tables for e in t.entries), keys)


@dataclass(frozen=True)
class NeutralForms:
    """Which derived forms to add to which factors."""

    cs_pct: bool = True
    cs_z: bool = True
    industry: bool = True
    names: tuple[str, ...] | None = None
    industry_column: str = "industry"
    date_column: str = "trade_date"


def append_neutral(table: FactorTable, forms: NeutralForms = NeutralForms()) -> FactorTable:
    """Add percentile rank, z-score and industry-neutral forms of each factor.

    The table is stored once; all ranks come from one long table, all means and deviations from one aggregate per grouping.
    """
    names = list(forms.names) if forms.names is not None else table.names
    unknown = [n for n in names if n not in table.names]
    if unknown:
        raise KeyError(f"cannot neutralise unknown factors: {unknown}")
    by = (forms.date_column,)
    require_columns(table.df, [*by, *([forms.industry_column] if forms.industry else [])], "neutral")
    df = base = settled(table.df, "factors")
    if forms.cs_pct:
        df = cs_pct_rank(df, {f"{n}_cs_pct": n for n in names}, by, row=table.keys)
    if forms.cs_z:
        df = cs_zscore(df, {f"{n}_cs_z": n for n in names}, by, source=base)
    if forms.industry:
        df = industry_neutralize(df, {f"{n}_ind_neu": n for n in names}, forms.industry_column, by, base)
    made = []
    for base in (e for e in table.entries if e.name in names):
        if forms.cs_pct:
            made.append(base.form("cs_pct", f"cs_pct_rank({base.name})"))
        if forms.cs_z:
            made.append(base.form("cs_z", f"cs_zscore({base.name})"))
        if forms.industry:
            made.append(base.form("ind_neu", f"industry_neutralize({base.name}, {forms.industry_column})", forms.industry_column))
    return FactorTable(df, (*table.entries, *made), table.keys)


def eligible_factors(df: DataFrame, names: Sequence[str], max_missing_rate: float | None = 0.25) -> list[str]:
    """Factors whose share of missing values is small enough; one pass for all of them."""
    if max_missing_rate is None or not names:
        return list(names)
    shares = missing_rates(df, names).first()
    return [n for i, n in enumerate(names) if shares[i] is not None and shares[i] <= max_missing_rate]


def missing_rates(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row with the share of missing values of each column."""
    return df.agg(*[F.avg(finite(n).isNull().cast("double")).alias(n) for n in names])


class FactorList:
    """Collects factor terms in order, then makes the table."""

    def __init__(self, source: str, prefix: str):
        self.source, self.prefix = source, prefix
        self.columns: dict[str, Column] = {}
        self.entries: list[CatalogEntry] = []

    def add(
        self,
        name: str,
        value: Column,
        category: str,
        inputs: Sequence[str],
        expression: str,
        window: int | None = None,
        lookback: int | None = None,
    ) -> str:
        back = (window or 0) if lookback is None else lookback
        return self.add_term(name, Term(value, expression, tuple(inputs), back, window), category)

    def add_term(self, name: str, value: Term, category: str) -> str:
        """Add a factor whose catalog entry follows from its term."""
        full = f"{self.prefix}{name}"
        self.columns[full] = value.column
        self.entries.append(CatalogEntry(full, self.source, category, value))
        return full

    def table(self, work: DataFrame, keep: Sequence[str]) -> FactorTable:
        """Key columns and all factors, none of them NaN or infinite.

        The factors become columns first, so no window expression is repeated.
        """
        raw = work.select(*keep, *[value.alias(name) for name, value in self.columns.items()])
        return FactorTable(raw.select(*keep, *[finite(n).alias(n) for n in self.columns]), tuple(self.entries))
