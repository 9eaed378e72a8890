"""Step-by-step parsing as stacked projections.

A cell parser needs a dozen steps, each using the one before it several times.
Nested in one expression that doubles with every step. Here every step is a
projection of its own, so each value is computed once and stays in generated
code. Keep the frame narrow, as steps may copy the row.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

Env = Callable[[str], Column]


class Quick(NamedTuple):
    """A short way for the usual cells: steps, whether the cell is one it reads, and the same fields."""

    steps: list[Callable[[Env], dict[str, Column]]]
    ready: Callable[[Env], Column]
    fields: Callable[[Env], dict[str, Column]]


class Parser(NamedTuple):
    """Steps that make named values, and the fields made of them at the end."""

    steps: list[Callable[[Env], dict[str, Column]]]
    fields: Callable[[Env], dict[str, Column]]
    quick: Quick | None = None


def parse(df: DataFrame, parsers: dict[str, Parser]) -> DataFrame:
    """Run parsers; field ``x`` of parser ``p`` becomes ``p_x``, field ``""`` ``p``.

    Parsers with a quick way go first, all in one: their other cells take the
    steps inside one expression. The rest follow one after the other, each pinned:
    generated methods stay short enough to be compiled well, which running all
    side by side would not.
    """
    quick = {prefix: parser for prefix, parser in parsers.items() if parser.quick}
    if quick:
        df = _parse_quickly(df, quick)
    for prefix, parser in parsers.items():
        if prefix in quick:
            continue

        def v(name: str, prefix: str = prefix) -> Column:
            return F.col(f"__{prefix}_{name}")

        for step in parser.steps:
            df = df.withColumns({f"__{prefix}_{name}": expr for name, expr in step(v).items()})
        df = pin(df, _outputs(prefix, parser.fields(v)), (f"__{prefix}_",))
    return df


def _outputs(prefix: str, fields: dict[str, Column]) -> dict[str, Column]:
    return {f"{prefix}_{name}" if name else prefix: expr for name, expr in fields.items()}


def _parse_quickly(df: DataFrame, parsers: dict[str, Parser]) -> DataFrame:
    def env(prefix: str) -> Env:
        return lambda name: F.col(f"__{prefix}_{name}")

    for i in range(max(len(p.quick.steps) for p in parsers.values())):
        made = {prefix: p.quick.steps[i](env(prefix)) for prefix, p in parsers.items() if i < len(p.quick.steps)}
        df = df.withColumns({f"__{prefix}_{name}": expr for prefix, values in made.items() for name, expr in values.items()})

    def whole(prefix: str, parser: Parser) -> Column:
        return F.when(parser.quick.ready(env(prefix)), _struct(parser.quick.fields(env(prefix)))).otherwise(_nested(parser))

    df = df.withColumns({f"__{prefix}": whole(prefix, p) for prefix, p in parsers.items()})
    outputs = {}
    for prefix, p in parsers.items():
        outputs |= _outputs(prefix, {name: F.col(f"__{prefix}")[name or "value"] for name in p.quick.fields(env(prefix))})
    return pin(df, outputs, tuple(f"__{prefix}" for prefix in parsers))


def _struct(fields: dict[str, Column]) -> Column:
    return F.struct(*[expr.alias(name or "value") for name, expr in fields.items()])


def _nested(parser: Parser, at: int = 0, known: dict[str, Column] | None = None) -> Column:
    """The steps of a parser as one expression that computes every value once: each step binds a variable of the next."""
    known = known or {}
    if at == len(parser.steps):
        return _struct(parser.fields(known.__getitem__))
    made = parser.steps[at](known.__getitem__)
    bound = F.transform(F.array(_struct(made)), lambda x: _nested(parser, at + 1, known | {name: x[name] for name in made}))
    return F.get(bound, F.lit(0))


def pin(df: DataFrame, outputs: dict[str, Column], drop: tuple[str, ...] = ()) -> DataFrame:
    """Add columns through a one-element generator; drop those prefixed ``drop``.

    Spark rewrites a filter on a projected column in terms of that column's
    inputs and pushes it down, so a parser would run once more per filter. A
    filter on a generated column stays where it is.
    """
    kept = [c for c in df.columns if c not in outputs and not (drop and c.startswith(drop))]
    packed = F.explode(F.array(F.struct(*[expr.alias(name) for name, expr in outputs.items()])))
    return df.select(*kept, packed.alias("__out")).select(*kept, *[F.col("__out")[name].alias(name) for name in outputs])
