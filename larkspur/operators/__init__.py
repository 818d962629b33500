"""Query operators: paging, aggregation, lookups, search, explanation."""
