"""Training-data operators: fingerprints, language ID, near-duplicates,
packing, decontamination, LM scoring, URL filters, substring duplicates,
secret scans and sharding."""
