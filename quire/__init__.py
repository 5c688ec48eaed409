"""Document analytics on Spark: office packages and text as relational tables, rendered, compared and prepared for training."""
