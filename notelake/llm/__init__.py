"""Operations of a training-data pipeline: deduplication, fingerprints, packing, mixing, filters, quality, scoring."""
