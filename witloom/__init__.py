"""witloom: collation of many copies of a text, on Spark."""
