"""convolens — conversation and lead analytics as Spark DataFrame operators.

Every operator is a plain ``DataFrame -> DataFrame`` function built from
Spark SQL expressions, joins, aggregations and (rarely) Arrow-batched pandas
code inside tasks.  A :class:`~convolens.plans.recipe.Recipe` composes them
into one lazy plan that Catalyst optimises.
"""

from convolens.session import AS_OF_DEFAULT, checkpoint_dir, get_spark, tune_session

__all__ = ["AS_OF_DEFAULT", "checkpoint_dir", "get_spark", "tune_session"]
__version__ = "0.1.0"
