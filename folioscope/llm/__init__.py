"""Training-data operators: filters, duplicates, fingerprints, counting and packing of documents."""
