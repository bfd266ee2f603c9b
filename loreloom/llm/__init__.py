"""Training-data operators: one module each, queries and their SQL in ``queries``."""
