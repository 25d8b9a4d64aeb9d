"""Training-data operators: one module per operator, each a Spark job over whole tables."""
