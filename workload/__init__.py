"""The operators bound to the star-schema test tables, each with its check in SQL."""
