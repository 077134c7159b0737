"""Table operators: filters, joins, aggregates, ranks, splits, learning jobs."""
