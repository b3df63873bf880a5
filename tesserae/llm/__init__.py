"""Operations of a training-data pipeline: deduplication, decontamination, filters, scoring, packing."""
