"""Training-data operators: sharding, quality rules, URL filters, near-copy and
repeat removal, decontamination, language-model scoring, token files, toxicity
and byte-level BPE.  Nothing else in the library imports this subpackage."""
