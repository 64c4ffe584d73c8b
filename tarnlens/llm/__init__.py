"""Training-data operators: token counts, token binaries, toxicity, deduplication, decontamination, encoding, media.

Self-contained: nothing outside this folder imports it, and it imports nothing from the rest of the library.
"""
