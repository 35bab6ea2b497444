"""Training-data operators for very large text corpora.  Nothing outside this folder imports it."""
