"""leafmill: document-tree analytics expressed as Spark DataFrame plans."""
