"""Column functions: values of a row in, a value of the row out, but for the aggregates in ``stats``."""
