"""Training-data operators: ten ways to clean, score, pack and store a text corpus."""
