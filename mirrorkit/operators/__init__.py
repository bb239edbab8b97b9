"""DataFrame-to-DataFrame operators: deduplication, routing, membership, changes, repair, reports."""
