"""Domain tables over the test data, and the queries on them."""
