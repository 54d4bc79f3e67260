"""Training-data operators: packing, extraction, archives, classifiers, joins and search."""
