"""Training-data operators: one module each, with a general operator and a thin ``opN_`` query."""
