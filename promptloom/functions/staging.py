"""Keep long expressions cheap to build and evaluated once."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

_BUILT: OrderedDict[tuple, object] = OrderedDict()
KEPT = 512


def built_once(name: str, build: Callable[[], object], owner: object = None):
    """Build an expression over fixed column names once per Spark application.

    Building a long expression costs thousands of driver-to-JVM calls; the result is an unresolved
    expression that any later frame with the same column names can use again. ``owner`` is an object that
    the expression depends on; the last ``KEPT`` expressions are held.
    """
    key = (SparkContext.getOrCreate().applicationId, name, owner)  # holds the owner: its id is not used again
    if key not in _BUILT:
        _BUILT[key] = build()
        while len(_BUILT) > KEPT:
            _BUILT.popitem(last=False)
    _BUILT.move_to_end(key)
    return _BUILT[key]


def evaluate_here(col: Column) -> Column:
    """Stop Catalyst from copying ``col`` into a filter above it.

    A predicate on a computed column is normally pushed below the projection, which would run the
    whole text pipeline twice. Predicates do not move through a non-deterministic projection.
    """
    return F.when(F.spark_partition_id() >= 0, col)
