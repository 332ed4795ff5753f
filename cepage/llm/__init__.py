"""cepage.llm: operators for training-data pipelines."""
