"""Training-data operators: ten dealt components and the pipeline built from them."""
