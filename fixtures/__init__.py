"""Stand-ins for tables that the given star schema does not hold, with the queries over them. Nothing in the package imports this."""
