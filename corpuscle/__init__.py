"""Corpus preparation, tokenizer measurement and paired evaluation statistics on Spark."""
