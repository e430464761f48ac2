"""Operations of a large-scale training-data pipeline, each by its own method."""
