"""gristmill: catalog-quality, news-feed, text-verification and corpus-cleaning jobs for Spark.

Every public operator is a plain function ``DataFrame -> DataFrame`` (or ``Column -> Column``), so the
logical plan stays visible to Catalyst and jobs compose like any other Spark code.
"""

__version__ = "0.1.0"
