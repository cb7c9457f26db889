"""Analytics over longitudinal entity data, written as DataFrame to DataFrame functions on Spark."""
