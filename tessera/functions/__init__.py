"""Column -> Column building blocks (all JVM-side built-ins, no Python UDF)."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and pass it to ``body`` as a lambda
    variable.

    Higher-order functions re-evaluate any non-variable expression used
    inside their lambda for every element; binding it first keeps an
    O(d) expression from becoming O(d^2).
    """
    return F.element_at(F.transform(F.array(value), body), 1)
