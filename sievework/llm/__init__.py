"""Operations of a training-data pipeline over the text, page and embedding tables."""
