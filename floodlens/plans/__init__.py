"""Composed query plans and the query/oracle registry used by ``__spark_entry__``."""
