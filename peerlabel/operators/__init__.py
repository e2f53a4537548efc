"""Table-level operators of a co-training round."""
