"""End-to-end runs: dictionary, vectors, training and labelling."""
