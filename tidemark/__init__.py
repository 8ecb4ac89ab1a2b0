"""tidemark: a market-data and event analytics library on PySpark."""
