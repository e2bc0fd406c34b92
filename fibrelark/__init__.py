"""fibrelark: a Spark-first engine for degradation analytics on fleet telemetry."""

__version__ = "0.1.0"
