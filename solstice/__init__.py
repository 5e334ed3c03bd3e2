"""solstice: seasonal climatology, rolling extremes and "how unusual is this
period" reports over daily time series, written as Spark DataFrame jobs.

Every public operator is a ``DataFrame -> DataFrame`` function over *all*
series at once (key columns are parameters), so it composes with
``df.transform(...)`` and lets Catalyst plan the whole job.
"""

__version__ = "0.1.0"
