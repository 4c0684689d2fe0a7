"""Training-data operators: dedup, privacy, toxicity, quality, chat, tokenising, archives, decontamination.

Nothing outside this subpackage imports it.
"""
