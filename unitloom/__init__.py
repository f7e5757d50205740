"""Source corpora as Spark tables: facts, references, budgeted context and repair rounds."""
