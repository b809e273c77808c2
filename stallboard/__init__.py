"""stallboard: merchant sales analytics as Spark jobs over every merchant at once.

Layout
------
sources/    readers for the raw tables (CSV with fixed schemas, the parquet adapter), sinks
functions/  column expressions (dates, numbers, labels, text) -- all JVM-side
operators/  relational building blocks: view, cleaning, filters, aggregates, windows,
            ordering, statistics, the ARIMA solver and the quantity models
plans/      user-level jobs composed from operators (customers, sales, forecasts, reports, ETL)
streaming/  incremental form of the daily summary over a growing order-line folder
"""

from stallboard.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
