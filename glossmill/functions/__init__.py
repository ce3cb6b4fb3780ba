"""Column functions: everything here is a Column to Column composition of built-in Spark functions."""
