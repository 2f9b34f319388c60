"""Training-data operators over a corpus of documents. Nothing else in the library imports this subpackage."""
