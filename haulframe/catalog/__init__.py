"""The operators bound to the test tables, and the SQL they are checked against."""
