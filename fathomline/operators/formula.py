"""Design columns from model formulas: terms, interactions, factors and Spark SQL expressions.

"y ~ x1 * z + log(w) + C(region) - 1" names the response and the terms. a:b is a product, a*b is a + b + a:b, C(a) is a factor
with treatment contrasts, - 1 leaves out the intercept, and any other term is a Spark SQL expression.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.operators import frontier as FR
from fathomline.operators.panel import complete_cases, quoted

FACTOR = re.compile(r"C\(\s*(\w+)\s*\)")


def _split(text: str, sign: str) -> list[str]:
    """Parts between signs that are in no brackets."""
    parts, depth = [""], 0
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == sign and depth == 0:
            parts.append("")
        else:
            parts[-1] += c
    return [p.strip() for p in parts]


@dataclass(frozen=True)
class Formula:
    response: str
    terms: tuple[tuple[str, ...], ...]
    intercept: bool

    @classmethod
    def of(cls, text: str) -> Formula:
        response, _, right = text.partition("~")
        if not right.strip() or not response.strip():
            raise ValueError("a formula is response ~ terms")
        terms: dict[tuple[str, ...], None] = {}
        intercept = True
        # "- 1" and "+ 0" leave out the intercept, also before other terms.
        for term in _split(re.sub(r"-\s*1(?=\s*(?:$|[+-]))", "+ 0", right), "+"):
            if term == "0":
                intercept = False
            elif term and term != "1":
                factors = _split(term, "*")
                for pick in sorted(product((0, 1), repeat=len(factors)), key=lambda p: (sum(p), [-x for x in p])):
                    if any(pick):
                        terms[tuple(part for f, used in zip(factors, pick) if used for part in _split(f, ":"))] = None
        return cls(response.strip(), tuple(sorted(terms, key=len)), intercept)

    def variables(self, df: DataFrame) -> list[str]:
        """Columns of df that the formula reads."""
        words = set(re.findall(r"\w+", " ".join([self.response, *(p for t in self.terms for p in t)])))
        return [c for c in df.columns if c in words]


def levels(df: DataFrame, column: str, most: int = 1000) -> list:
    """Distinct values of a factor in order, which become columns; more than most are an error."""
    found = [r[0] for r in df.select(column).filter(F.col(column).isNotNull()).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} levels")
    return sorted(found)


def term_columns(df: DataFrame, parsed: Formula) -> list[tuple[str, Column]]:
    """(name, column) of each term but the intercept; levels of factors are read from df."""

    def columns(part: str) -> list[tuple[str, Column]]:
        m = FACTOR.fullmatch(part)
        if m:
            return [(f"{m[1]}[{v}]", F.when(F.col(quoted(m[1])) == v, 1.0).otherwise(0.0)) for v in levels(df, m[1])[1:]]
        return [(part, F.expr(part).cast("double"))]

    out = []
    for term in parsed.terms:
        for pick in product(*map(columns, term)):
            value = pick[0][1]
            for _, c in pick[1:]:
                value = value * c
            out.append((":".join(n for n, _ in pick), value))
    return out


def design(df: DataFrame, formula: str, keep: Sequence[str] = ()) -> DataFrame:
    """keep, response and a column for each term of the complete rows of df: _cons, then terms by order, as x1, x1:z or region[b].

    The first level of a factor is the base. Rows with a null, NaN or infinite value in a column that the formula reads, or in
    the response or a term, are left out.
    """
    parsed = Formula.of(formula)
    rows = complete_cases(df, parsed.variables(df))
    terms = [(parsed.response, F.expr(parsed.response).cast("double")), *term_columns(rows, parsed)]
    constant = [F.lit(1.0).alias("_cons")] if parsed.intercept else []
    out = [c.alias(n) for n, c in terms]
    return complete_cases(rows.select(*keep, out[0], *constant, *out[1:]), [n for n, _ in terms])


def frontier(df: DataFrame, formula: str, id: str = "id", time: str = "time", **settings) -> tuple[DataFrame, FR.Frontier]:
    """(panel, model) of a frontier "y ~ terms", with determinants as formulas "~ terms": zuit, zvit, zvi0, zui0 and mu.

    The panel has id, time and a column for each term, by its name; the model's other settings go through. "- 1" leaves out the
    frontier's intercept; determinants always have one. Rows that any formula can't use are left out by the fit.
    """
    blocks = {k: v for k, v in settings.items() if k in ("zuit", "zvit", "zvi0", "zui0", "mu") and isinstance(v, str)}
    main = Formula.of(formula)
    parsed = {k: Formula.of(f"0 {v}") for k, v in blocks.items()}
    for k, f in parsed.items():
        if not blocks[k].lstrip().startswith("~") or not f.intercept:
            raise ValueError(f"{k} must be a formula ~ terms, with its constant")
    everything = list(dict.fromkeys(c for f in (main, *parsed.values()) for c in f.variables(df)))
    rows = complete_cases(df, everything)
    if rows.isEmpty():
        raise ValueError("no complete rows")
    columns, names = {main.response: F.expr(main.response).cast("double")}, {}
    for k, f in (("x", main), *parsed.items()):
        found = term_columns(rows, f)
        names[k] = [n for n, _ in found]
        columns |= dict(found)
    keys = [F.col(quoted(c)).alias(n) for n, c in (("id", id), ("time", time)) if c in df.columns]
    panel = rows.select(*keys, *[c.alias(n) for n, c in columns.items()])
    return panel, FR.Frontier(main.response, names.pop("x"), intercept=main.intercept, **{**settings, **names})
