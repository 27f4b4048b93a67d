"""Training-data operators: one module for each problem, ``queries`` registers them."""
