"""Model training and the end-to-end runs."""
