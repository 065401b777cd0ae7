"""Analytics for browser script errors on Spark."""
