"""A Spark engine for code knowledge graphs and for the corpora around them."""
