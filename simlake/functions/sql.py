"""The library from SQL text: vector expressions as SQL functions of a session, and extractors as table functions for LATERAL joins.

``register`` defines temporary functions, which Catalyst inlines: ``unit_vector``, ``vector_dot``, ``vector_cosine``,
``signed_power``, ``p_normalised``, ``hellinger``. ``register_extractor`` makes any function of a picture or vector (one value
to a matrix) a table function; rows travel in Arrow batches. (Spark's table functions of whole Arrow arrays cannot stand in a
LATERAL join.)

    SELECT image, d.desc, d.x FROM pictures, LATERAL extract(pictures.data) d
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from simlake.operators.runtime import ship

_V = "ARRAY<DOUBLE>"
_SUM = "aggregate({0}, 0D, (s, e) -> s + {1})"
_LET = "transform(array({0}), n -> {1})[0]"  # computed once a row, not once an element
_NORM = f"sqrt({_SUM.format('{0}', 'e * e')})"
_P_NORM = f"power({_SUM.format('v', 'power(abs(e), p)')}, 1 / p)"
#: Name, parameters, result, body.
FUNCTIONS = (
    ("vector_dot", f"a {_V}, b {_V}", "DOUBLE", _SUM.format("zip_with(a, b, (x, y) -> x * y)", "e")),
    ("vector_norm", f"v {_V}, p DOUBLE", "DOUBLE", _P_NORM),
    ("unit_vector", f"v {_V}", _V, _LET.format(_NORM.format("v"), "CASE WHEN n > 0 THEN transform(v, x -> x / n) ELSE v END")),
    ("vector_cosine", f"a {_V}, b {_V}", "DOUBLE", "CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN coalesce(try_divide({0}, {1} * {2}), 0D) END".format(_SUM.format("zip_with(a, b, (x, y) -> x * y)", "e"), _NORM.format("a"), _NORM.format("b"))),
    ("signed_power", f"v {_V}, alpha DOUBLE", _V, "transform(v, x -> signum(x) * power(abs(x), alpha))"),
    ("p_normalised", f"v {_V}, p DOUBLE", _V, _LET.format(f"{_P_NORM} + 1e-9D", "transform(v, x -> x / n)")),
    ("hellinger", f"v {_V}", _V, _LET.format(f"{_SUM.format('v', 'e')} + 1e-7D", "transform(v, x -> sqrt(x / n))")),
)


def register(spark: SparkSession) -> list[str]:
    """Define the functions in this session; gives their names."""
    for name, parameters, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return [f[0] for f in FUNCTIONS]


def register_extractor(spark: SparkSession, name: str, function: Callable[[Any], np.ndarray | None], width: int) -> None:
    """Make ``function``, of one value to an (n, width) matrix or None, the table function ``name(value)`` with rows (desc int, x array<double>). A matrix of another width is an error."""
    ship(spark)

    class Extractor:
        def eval(self, value: Any) -> Iterator[tuple[int, list[float]]]:
            made = None if value is None else function(value)
            x = np.zeros((0, width)) if made is None else np.asarray(made, float)
            if x.ndim != 2 or x.shape[1] != width:
                raise ValueError(f"an extractor of width {width} gave an array of shape {x.shape}")
            yield from enumerate(x.tolist())

    spark.udtf.register(name, udtf(Extractor, returnType="desc int, x array<double>", useArrow=True))
