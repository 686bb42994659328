"""DataFrame → DataFrame operators: filters, dedup, aggregates, funnels and
reconciliation joins (SURVEY §2.4–§2.9)."""
