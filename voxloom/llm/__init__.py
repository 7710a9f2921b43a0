"""Training-data operators: language ID, near-dedup, packing, extraction, token counts,
quality, decontamination, binary output, sanitisation, best-fit packing, vector codes and source divergence. Nothing else in the library imports
this subpackage."""
