"""sigilo: de-identification analytics over paged text corpora, on PySpark."""
