"""Operations of a training-data pipeline."""
