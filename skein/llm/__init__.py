"""Operations of a training-data pipeline: cleaning, deduplication, scoring, mixing, packing and token output."""
