"""Training-data operators: decontamination, sharding, secrets, chat, search, quality, URLs, BPE, HTML, near duplicates."""
