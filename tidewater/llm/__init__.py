"""Training-data operators: near and exact dedup, language, toxicity and quality models, decontamination,
licences, byte-level BPE, line dedup and sharding.  Nothing outside this folder imports it."""
