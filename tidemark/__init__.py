"""Analytics over ordered, timed text on Spark."""
