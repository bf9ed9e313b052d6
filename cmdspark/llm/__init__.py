"""Operations of a training-data pipeline: deduplication, packing, mixing, filters, archives."""
