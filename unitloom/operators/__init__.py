"""DataFrame operators: filters, joins, ordered groups, positions, syntax nodes."""
