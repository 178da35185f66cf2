"""Reading corpora and results."""
