"""Operators for training data of language models: source files and documents.  Nothing else in the library imports this package."""
