"""Route-network, track, content and subscription analytics on PySpark."""
