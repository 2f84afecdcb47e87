"""Training-data operators for text corpora.  Nothing outside this subpackage imports it."""
