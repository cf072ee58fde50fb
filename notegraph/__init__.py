"""notegraph: note-corpus analytics as PySpark DataFrame operators."""
