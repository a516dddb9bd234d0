"""Training-data operators: ten dealt operators, each a module of its own."""
