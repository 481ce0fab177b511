"""quillstrata: provenance-preserving retrieval and replayable state on PySpark."""
