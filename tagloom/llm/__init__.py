"""Training-data operators: tokenisers, filters, deduplication, mixing. Nothing else in the library imports this."""
