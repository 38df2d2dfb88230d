"""DataFrame to DataFrame operators: running values, joins, aggregates, audits."""
