"""Training-data operators: token counts, toxicity, language, packing, PII, decontamination, URL filters, three kinds of deduplication, whitening, source divergence and lattice scores.

Nothing outside this package imports it, so it can be removed without touching the rest of the library.
"""
