"""Document processing: chunks, metadata, a store of documents with retrieval."""
