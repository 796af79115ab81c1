"""Training-data operators: one module per operator, plus the queries and their SQL."""
