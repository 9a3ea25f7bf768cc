"""Formula functions as builders of Spark columns."""
