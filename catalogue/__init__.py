"""The registered queries: inputs derived from the test tables, the queries on
Spark, and the equivalent SQL."""
