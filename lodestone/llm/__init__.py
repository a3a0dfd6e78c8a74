"""Training-data operators: secret scans, mixing, licence scans, language ID,
chat formatting, decontamination, line dedup, quality, near-duplicate joins
and vector search. Nothing outside this subpackage imports it."""
