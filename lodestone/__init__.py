"""Analytics over source repositories and the activity around them, on PySpark."""
