"""Training-data operators: tokens, extraction, deduplication, packing, filters and scans."""
