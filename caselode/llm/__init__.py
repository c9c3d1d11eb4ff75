"""Training-data operators: language-model scoring, licences, packing, segmentation, deduplication and safety."""
