"""DataFrame-to-DataFrame operators, parameterised by key, order and value columns."""
