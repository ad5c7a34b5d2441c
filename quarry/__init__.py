"""quarry: corpus preparation, indexing and retrieval as Spark jobs.

Every operator is a ``DataFrame -> DataFrame`` function built from Spark SQL
expressions, joins, windows and (where Python is unavoidable) Arrow-batched
``mapInPandas`` / ``pandas_udf`` helpers.
"""

from quarry.session import build_session, checkpoint_dir, ship_package

__all__ = ["build_session", "checkpoint_dir", "ship_package"]
