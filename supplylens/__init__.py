"""supplylens: supply, price and exposure analytics as lazy Spark DataFrame operators.

Every operator takes DataFrames and returns a DataFrame.  Nothing is
collected to the driver; the work is planned by Catalyst and run by Spark.
"""

from supplylens.session import get_session, scratch_path, checkpoint_root

__all__ = ["get_session", "scratch_path", "checkpoint_root"]
