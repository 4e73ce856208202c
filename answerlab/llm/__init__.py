"""Training-data pipeline operators (sharding, filters, deduplication, packing,
decontamination, language ID, chat formatting). Nothing else in the library
imports this package; ``corpus_pipeline.py`` and ``__spark_entry__`` use it."""
