"""Training-data operators: each module holds one operator, ``queries`` the
registered queries and their SQL. Nothing outside this package imports it."""
