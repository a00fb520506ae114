"""folioflow: document-layout and corpus analytics on PySpark."""
