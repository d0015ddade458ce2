"""DataFrame operators, one relational step each."""
