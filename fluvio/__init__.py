"""fluvio: station-month flow forecasting and geo-record analytics on Spark.

Every operator is a function from DataFrame(s) to a DataFrame. Nothing is
collected to the driver; all per-station work is partitioned by
``station_id`` and every statistic is a grouped aggregate or a window.
"""

__version__ = "0.1.0"
