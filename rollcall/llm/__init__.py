"""Training-data operators: extraction, rules, de-duplication, sharding, packing, language and quality models."""
