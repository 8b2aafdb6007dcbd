"""Training-data operators: the ten dealt corpus operators and their queries."""
