"""Technical indicators over price-bar tables and streams, built on Spark."""
