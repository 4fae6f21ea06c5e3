"""DataFrame -> DataFrame operators. Column names are arguments, so each runs on any table."""
