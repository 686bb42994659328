"""tallyspark — clean, summarise and reconcile two ledgers with Spark DataFrames.

Every operator is a ``Column -> Column`` or ``DataFrame -> DataFrame`` function
that takes column names, keys and code lists as parameters, so the same code
runs on invoice layouts and on any table that plays the part of a ledger.
"""

from tallyspark.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
